"""Codes of vectors: a codebook per part of the vector, fitted in rounds over metric trees of the parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.common import looked_up, query, stored, table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: A component becomes the integer floor(STEPS * x).
STEPS = 1024
#: A ball of so few points is not divided.
LEAF = 96
#: Above any rounding error of double-precision radii, as a share of them; a thousandth of it is above that of squared distances.
SLACK = 1e-9


@dataclass(frozen=True)
class Tree:
    """Balls over points (integers, in the order of the leaves). Ball i holds points[spans[i, 0] : spans[i, 1]], is no larger than
    radii[i] around sums[i] / count, and has the balls links[i], or is a leaf (-1). Ball 0 holds all; `rows` are the points' numbers before."""

    points: np.ndarray
    rows: np.ndarray
    links: np.ndarray
    spans: np.ndarray
    radii: np.ndarray
    sums: np.ndarray

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.points, self.rows, self.links, self.spans, self.radii, self.sums)]

    @classmethod
    def unpacked(cls, columns: list[bytes], dim: int) -> Tree:
        shapes = ((np.int64, dim), (np.int32, 0), (np.int32, 2), (np.int32, 2), (np.float64, 0), (np.int64, dim))
        return cls(*(np.frombuffer(b, t).reshape(-1, d) if d else np.frombuffer(b, t) for b, (t, d) in zip(columns, shapes, strict=True)))


def lengths_of(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def anchors(x: np.ndarray, k: int) -> list[np.ndarray]:
    """Up to `k` groups of rows, each around an anchor: the next anchor is the point farthest from its own, and takes over the points that
    are nearer to it. Points within half the distance of both anchors cannot be, and are not measured."""
    pivots, owner, dist = [0], np.zeros(len(x), np.int64), lengths_of(x - x[0])
    while len(pivots) < k:
        far = int(dist.argmax())
        if not dist[far]:
            break
        gaps = lengths_of(x[pivots] - x[far])
        near = np.flatnonzero(2 * dist > gaps[owner])
        new = lengths_of(x[near] - x[far])
        taken = new < dist[near]
        owner[near[taken]], dist[near[taken]] = len(pivots), new[taken]
        pivots.append(far)
    return [g for g in (np.flatnonzero(owner == a) for a in range(len(pivots))) if len(g)]


class _Ball:
    """A ball while the tree is built."""

    def __init__(self, rows: np.ndarray | None, sums: np.ndarray, count: int, radius: float, below: tuple = ()):
        self.rows, self.sums, self.count, self.radius, self.below = rows, sums, count, radius, below
        self.center = sums / count


def _joined(balls: list[_Ball]) -> _Ball:
    """One ball over all, by joining the two that make the smallest ball until one is left."""
    balls = list(balls)
    centers = np.array([b.center for b in balls])
    counts, radii = np.array([b.count for b in balls], float), np.array([b.radius for b in balls])

    def around(i: int) -> np.ndarray:
        apart, both = lengths_of(centers - centers[i]), counts + counts[i]
        return np.maximum(apart * counts / both + radii[i], apart * counts[i] / both + radii)

    size = np.array([around(i) for i in range(len(balls))])
    np.fill_diagonal(size, np.inf)
    for _ in range(len(balls) - 1):
        i, j = sorted(divmod(int(size.argmin()), len(balls)))
        a, b = balls[i], balls[j]
        # a hair more than computed, so that rounding never leaves a point outside
        balls[i] = _Ball(None, a.sums + b.sums, a.count + b.count, float(size[i, j]) * (1 + SLACK), (a, b))
        centers[i], counts[i], radii[i] = balls[i].center, balls[i].count, balls[i].radius
        size[j], size[:, j] = np.inf, np.inf
        row = around(i)
        row[np.isinf(size[i])] = np.inf
        row[i] = np.inf
        size[i], size[:, i] = row, row
    return balls[0]


def _grown(points: np.ndarray, rows: np.ndarray) -> _Ball:
    """Middle out: about sqrt(n) anchors first, the tree above them by joining, the trees below them in the same way."""
    x = points[rows]
    sums = x.sum(axis=0)
    radius = 0.0 if (x == x[0]).all() else float(lengths_of(x - sums / len(x)).max()) * (1 + SLACK)
    if len(rows) <= LEAF or not radius:
        return _Ball(rows, sums, len(rows), radius)
    groups = anchors(x.astype(float), int(np.ceil(np.sqrt(len(rows)))))
    return _joined([_grown(points, rows[g]) for g in groups])


def grow(points: np.ndarray) -> Tree:
    """The tree over the rows of an integer matrix; at least one row."""
    rows, links, spans, radii, sums, at = [], [], [], [], [], 0
    waiting: list[tuple[_Ball, int, int]] = [(_grown(points, np.arange(len(points))), -1, 0)]
    while waiting:
        ball, above, side = waiting.pop()
        if above >= 0:
            links[above][side] = len(links)
        if ball.rows is not None:
            rows.append(ball.rows)
        # leaves come in the order of the walk, so a ball's points are the next `count` ones
        spans.append((at, at + ball.count))
        at += ball.count if ball.rows is not None else 0
        waiting += [(b, len(links), i) for i, b in reversed(list(enumerate(ball.below)))]
        links.append([-1, -1])
        radii.append(ball.radius)
        sums.append(ball.sums)
    order = np.concatenate(rows).astype(np.int32)
    return Tree(points[order], order, np.array(links, np.int32), np.array(spans, np.int32), np.array(radii), np.array(sums))


class Book:
    """Entries of a codebook (integers), with what the search needs of them."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.near = entries, entries.astype(float)
        self.gaps = np.array([lengths_of(self.near - e) for e in self.near])
        # of equal entries only the first is ever chosen
        self.different = np.sort(np.unique(entries, axis=0, return_index=True)[1])
        self.squares = (entries * entries).sum(axis=1)

    def nearest(self, points: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The nearest entry of each point, exactly; `among` ascends, so ties go to the lower one."""
        top = max(int(np.abs(points).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        if 4 * top * top * points.shape[1] < 1 << 53:  # integers that doubles hold
            apart = self.squares[among] - 2 * (points.astype(float) @ self.near[among].T)
        else:
            apart = np.stack([((points - self.entries[e]) ** 2).sum(axis=1) for e in among], axis=1)
        return among[apart.argmin(axis=1)]


def assign(tree: Tree, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry of each point of the tree; sums and counts of the points of each entry.

    A ball inherits the entries that may be nearest to points of the ball above, and drops those that another entry beats on all of the
    ball. With one left the ball is owned: its sums and count are added and its points are not looked at.
    """
    codes, loose = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), bool)
    sums, counts = np.zeros_like(book.entries), np.zeros(len(book.entries), np.int64)
    centers = tree.sums / (tree.spans[:, 1:] - tree.spans[:, :1])
    of_center = (centers * centers).sum(axis=1)
    apart = of_center[:, None] + book.squares - 2 * (centers @ book.near.T)
    slack = SLACK * (1 + of_center * 1e-3 + float(book.squares.max()) * 1e-3)
    waiting = [(0, book.different)]
    while waiting:
        i, among = waiting.pop()
        start, stop = tree.spans[i]
        if len(among) > 1:
            d = apart[i, among]
            best = int(d.argmin())
            # |x - e|^2 - |x - best|^2 is at least d(e) - d(best) - 2 * radius * |e - best| anywhere in the ball
            left = d - d[best] <= 2 * tree.radii[i] * book.gaps[among[best], among] + slack[i]
            left[best] = True
            among = among[left]
        left_link, right_link = tree.links[i]
        if len(among) == 1:
            codes[start:stop] = among[0]
            sums[among[0]] += tree.sums[i]
            counts[among[0]] += stop - start
        elif left_link >= 0:
            waiting += [(right_link, among), (left_link, among)]
        elif not tree.radii[i]:  # equal points
            e = book.nearest(tree.points[start : start + 1], among)[0]
            codes[start:stop] = e
            sums[e] += tree.sums[i]
            counts[e] += stop - start
        else:
            codes[start:stop], loose[start:stop] = book.nearest(tree.points[start:stop], among), True
    np.add.at(sums, codes[loose], tree.points[loose])
    counts += np.bincount(codes[loose], minlength=len(counts))
    return codes, sums, counts


def integers(vectors: np.ndarray, parts: int) -> np.ndarray:
    """floor(STEPS * x) as 64-bit integers. Values whose squared distances might not fit are refused."""
    v = np.floor(vectors.astype(np.float64) * STEPS)
    if v.size and 4 * float(np.abs(v).max()) ** 2 * (v.shape[1] // parts) >= 2.0**63:
        raise ValueError("a component is too large: squared distances would not fit 64 bits")
    return v.astype(np.int64)


FIELDS = ["points", "rows", "links", "spans", "radii", "sums"]


def _trees_of(batch: pa.RecordBatch, i: int, dim: int, parts: int) -> list[Tree]:
    columns = [batch.column(f)[i].as_py() for f in FIELDS]
    return [Tree.unpacked([c[p] for c in columns], dim) for p in range(parts)]


def vector_codes(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label: the code of each vector by codebooks that are fitted to all of them.

    Components become integers floor(1024 * x); vectors are cut into `parts` equal parts. The codebook of a part starts as that part of
    the vectors with the smallest ids. In each round every part goes to its nearest entry, ties to the lower one, and
    entries become the floor of the mean of their parts; unused ones stay. `error` is the squared distance to the chosen entries,
    `label_error` its sum over equal labels, nulls together. All of it is exact.

    Each task grows metric trees over the vectors of a batch, once; they are stored. A round reads them and returns at most parts * entries
    sums per task, which are added up by Spark; only codebooks reach the driver. Sums per label meet rows in salted keys.

    Vectors that are null or empty, hold null or non-finite components, or are not as long as that of the smallest id take no part. A length that
    `parts` does not divide, or a component too large for 64-bit distances, is an error. Rows that repeat an id are coded each; as first entries they
    count each, in the order of their components. A null id is coded, and is larger than all others. With fewer vectors than
    entries the codebook is as long as they are many. An empty table gives an empty table. Other columns are not read, whatever their names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry is written with two digits")
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True))
    kept = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where(usable)
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    length = len(first[0]["v"]) if first else parts
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    dim = length // parts
    kept = kept.where(F.size("v") == length)
    seeds = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.split(integers(np.array([r["v"] for r in seeds]).reshape(len(seeds), length), parts), parts, axis=1)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            trees = [grow(p).packed() for p in np.split(integers(flat.reshape(batch.num_rows, length), parts), parts, axis=1)]
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in ("vec_id", "label")]
            packed = [pa.array([list(column)], pa.list_(pa.binary())) for column in zip(*trees, strict=True)]
            yield pa.RecordBatch.from_arrays([*lists, *packed], names=["ids", "labels", *FIELDS])

    label_type = kept.schema["label"].dataType.simpleString()
    planted = kept.mapInArrow(plant, f"ids array<bigint>, labels array<{label_type}>, " + ", ".join(f"{f} array<binary>" for f in FIELDS))
    # small row groups: a reader takes a group of such long rows at once
    blocks = stored(planted, "vector-trees", **{"parquet.block.size": 16 << 20})

    for _ in range(rounds if seeds else 0):
        now = [Book(b) for b in books]

        def sums_of(batches: Iterator[pa.RecordBatch], now: list[Book] = now) -> Iterator[pa.RecordBatch]:
            sums, counts = [np.zeros_like(b.entries) for b in now], [np.zeros(len(b.entries), np.int64) for b in now]
            for batch in batches:
                for i in range(batch.num_rows):
                    for p, tree in enumerate(_trees_of(batch, i, dim, parts)):
                        _, s, n = assign(tree, now[p])
                        sums[p] += s
                        counts[p] += n
            used = [(p, e) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
                    pa.array([[int(counts[p][e]), *sums[p][e].tolist()] for p, e in used], pa.list_(pa.int64())),
                ],
                names=["part", "entry", "sums"],
            )

        added = (
            blocks.mapInArrow(sums_of, "part int, entry int, sums array<bigint>").select("part", "entry", F.posexplode("sums").alias("at", "x"))
            .groupBy("part", "entry", "at").agg(F.sum("x").alias("x"))
        )
        total = np.zeros((parts, len(seeds), dim + 1), np.int64)
        for r in added.collect():
            total[r["part"], r["entry"], r["at"]] = r["x"]
        books = [np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), b) for t, b in zip(total, books, strict=True)]

    written = ",".join(str(x) for b in books for x in b.ravel().tolist())
    last = [Book(b) for b in books] if seeds else []

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                digits, error = [], 0
                for p, tree in enumerate(_trees_of(batch, i, dim, parts)):
                    codes, _, _ = assign(tree, last[p])
                    back = np.argsort(tree.rows)
                    digits.append(codes[back].tolist())
                    error = error + ((tree.points - last[p].entries[codes]) ** 2).sum(axis=1)[back]
                code = pa.array([bytes(d).hex() for d in zip(*digits, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, code, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    result = stored(blocks.mapInArrow(coded, f"vec_id bigint, label {label_type}, code string, error bigint"), "vector-codes")
    by_label = result.groupBy("label").agg(F.sum("error").alias("label_error"))
    digest = F.lit(hashlib.sha256(written.encode()).hexdigest())
    return looked_up(result, by_label, "label", F.xxhash64("vec_id", "code", "error")).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"), "label")


def _sql() -> str:
    """The fit in SQL, a step per round."""
    steps = [
        f"""
k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({STEPS} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, label, i AS part, v[i * len(v) // {PARTS} + 1 : (i + 1) * len(v) // {PARTS}] AS x FROM k, range({PARTS}) t(i)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {ENTRIES})"""
    ]
    apart = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := d, e := entry)) AS m FROM (SELECT p.r, p.part, b.entry, CAST({apart} AS BIGINT) AS d FROM p JOIN b{i} b USING (part)) GROUP BY ALL)""")
        if i < ROUNDS:
            steps.append(f"""
c{i} AS (SELECT part, entry, list(z ORDER BY pos) AS x FROM (SELECT part, m.e AS entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS z
  FROM (SELECT a.part, a.m, unnest(p.x) AS x, generate_subscripts(p.x, 1) AS pos FROM a{i} a JOIN p USING (r, part)) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(c.x, b.x) AS x FROM b{i} b LEFT JOIN c{i} c USING (part, entry))""")
    return f"""
WITH {",".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
e AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (r), h
"""


@query("op11_vector_codes", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all `embeddings`: 4 parts, 256 entries, 4 rounds."""
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")
