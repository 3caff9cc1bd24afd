"""Nearest neighbours by cosine, through a block matrix join of int8 tiles with error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.common import query, stored, table

#: Rows of a tile's sides: a tile multiplies so many queries by so many candidates, so all candidates are sent once per block of queries.
QUERY_BLOCK, CANDIDATE_BLOCK = 16_384, 16_384
#: Queries of a tile that are multiplied at once.
QUERY_STEP = 1024
#: Integer products of so many components are exact in single precision: 127 * 127 * 1024 < 2 ** 24.
EXACT_COMPONENTS = 1024
#: Above any rounding error of the double-precision sums compared with the bounds.
SLACK = 1e-9
#: Survivors listed at once (or those of one query), and doubles of a side that are measured at once.
PAIRS, VALUES = 1 << 20, 1 << 22
FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    """Not null, some component not zero, no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors u as int8 steps q and step sizes s with u = s * q + e; the norms of s * q and of e."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    near = q * s[:, None]
    return q, s, np.sqrt((near * near).sum(axis=1)), np.sqrt(((u - near) ** 2).sum(axis=1))


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 matrices, exactly."""
    total = np.zeros((len(a), len(b)), np.float64)
    for k in range(0, a.shape[1], EXACT_COMPONENTS):
        total += a[:, k : k + EXACT_COMPONENTS].astype(np.float32) @ b[:, k : k + EXACT_COMPONENTS].astype(np.float32).T
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision; equal rows give equal results wherever they stand."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest candidates of each query in one tile: query ids, candidate ids, cosines.

    int8 products give each cosine up to |s*q| * |e'| + |e|. Who can't reach the k-th best lower bound is out;
    the others are measured on the original vectors.
    """
    qa, sa, na, ea = quantised(queries)
    qb, sb, _, eb = quantised(candidates)
    about = integer_products(qa, qb) * sa[:, None] * sb[None, :]
    off = na[:, None] * eb[None, :] + ea[:, None] + SLACK
    about[query_ids[:, None] == ids[None, :]] = -np.inf
    lower = about - off
    at = max(len(ids) - k, 0)
    least = np.partition(lower, at, axis=1)[:, at]
    left = (about + off >= least[:, None]) & np.isfinite(about)
    # some queries and some pairs at a time, so memory does not grow with the number of ties
    ends = np.cumsum(left.sum(axis=1))
    found, first, step = [], 0, max(1, VALUES // queries.shape[1])
    while first < len(queries):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        i, j = np.nonzero(left[first:last])
        i += first
        score = np.concatenate([np.zeros(0), *(cosines(queries[i[x : x + step]], candidates[j[x : x + step]]) for x in range(0, len(i), step))])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((query_ids[i[best]], ids[j[best]], score[best]))
        first = last
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` candidates of largest cosine for each query, exactly.

    Both sides are written once and dealt into blocks by the number of the written row, whatever their ids, so a task that is run again finds the same rows.
    Each pair of blocks is a tile and a task, and a tile returns k rows per query. The tiles' rows meet by query in heaps. Nearest first, ties to the smaller vec_id. A candidate with the query's own id is left out. Fewer
    than k candidates are all returned; a query without any has no row.

    Vectors that are null, zero, or hold null or non-finite components take no part; a vector is compared with those of its
    own length. Rows that repeat a vec_id: as candidates each counts, as queries the smallest vector is searched once. Rows with a
    null id take no part. Empty tables give an empty table. Other columns are not read, whatever their names.
    """
    def sides(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))

    asked = stored(sides(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "nearest-queries")
    others = stored(sides(candidates), "nearest-candidates")
    n_asked, n_others = asked.count(), others.count()
    by_query, by_candidate = max(1, -(-n_asked // query_block)), max(1, -(-n_others // candidate_block))

    def blocks(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        number = F.monotonically_increasing_id()
        return df.withColumn(own, F.pmod(number + F.shiftright(number, 33), F.lit(n_own)).cast("int")).select(
            "*", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        )

    keys = ["dim", "q", "c"]
    left = blocks(asked, "q", by_query, "c", by_candidate).groupBy(*keys)
    right = blocks(others, "c", by_candidate, "q", by_query).groupBy(*keys)

    def one_tile(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [], [], []
        if len(a) and len(b):
            ids, asked_of, others_of = a["vec_id"].to_numpy(), vectors_of(a["v"]), vectors_of(b["v"])
            steps = [tile(ids[x : x + QUERY_STEP], asked_of[x : x + QUERY_STEP], b["vec_id"].to_numpy(), others_of, k) for x in range(0, len(ids), QUERY_STEP)]
            found = [np.concatenate(x) for x in zip(*steps, strict=True)]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for q, v, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                heap = best.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                else:
                    heapq.heappushpop(heap, (s, -v))
        rows = [(q, i + 1, -v, s) for q, heap in best.items() for i, (s, v) in enumerate(sorted(heap, reverse=True))]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    tiles = left.cogroup(right).applyInArrow(one_tile, FOUND)
    return tiles.repartition("query_id").mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")


@query("op3_nearest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector of `embeddings` among all."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where(F.pmod("vec_id", F.lit(50)) == 0), rows)
