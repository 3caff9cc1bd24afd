"""Toxicity scores: logistic regression on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.common import column, query, table, tidy

ORDERS = (4, 5, 6)
BUCKET_BITS = 20
#: Starting places of n-grams of a text that are hashed at a time, and training values that a step looks at at a time.
CHUNK, STEP_VALUES = 1 << 18, 1 << 20
#: Labelled documents without and with toxicity that the classifier is fitted on at most, the first by a hash of doc_id.
TRAIN_ROWS = 3500, 1500
#: A feature counts if so many training documents have it, and if its ratio is so far from 1, as a logarithm.
LEAST_DOCUMENTS, LEAST_RATIO = 4, 1.0
STEPS, RIDGE = 200, 1.0
#: Length of a document's vector of counts; with it, most weights stay below 1.
LENGTH = 30.0


@dataclass(frozen=True)
class Model:
    """Bucket of each feature, sorted; its ratio times its weight; the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BUCKET_BITS


def ngrams(text: str | None, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of the lower-cased text between two spaces, each once and in order, and how often each occurs.

    `wanted` says which buckets count. CHUNK starting places are taken at a time, so memory does not grow with the length of a text by more than its
    characters.
    """
    c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    buckets, counts, longest = [], [], max(orders)
    for a in range(0, len(c), CHUNK):
        part, found = c[a : a + CHUNK + longest - 1], []
        h = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
            if n in orders:
                m = (h[:CHUNK] + np.uint32(n)) * np.uint32(0x85EBCA6B)
                m ^= m >> np.uint32(15)
                m *= np.uint32(0x9E3779B1)
                m >>= np.uint32(32 - bits)
                found.append(m if wanted is None else m[wanted[m]])
        if found:
            at, times = np.unique(np.concatenate(found), return_counts=True)
            buckets.append(at)
            counts.append(times)
    if len(buckets) < 2:
        return (buckets[0], counts[0]) if buckets else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    at, place = np.unique(np.concatenate(buckets), return_inverse=True)
    return at, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts of a document's features as a vector of length LENGTH, so that long and short texts weigh the same."""
    counts = counts.astype(float)
    return LENGTH * counts / np.sqrt((counts * counts).sum() + 1e-9)


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, bits: int = BUCKET_BITS, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Fit on the distinct buckets of each document and their counts. `weights` say how many documents of its class each one stands for.

    `features` is emptied on the way: only the values of chosen buckets stay, in single precision.
    """
    toxic = labels == 1
    n1, n0 = float(weights[toxic].sum()), float(weights[~toxic].sum())
    none = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))), bits=bits)
    if not toxic.any() or toxic.all():
        return none
    with_, seen = [], np.zeros(1 << bits, np.int32)
    for of_class in (toxic, ~toxic):
        df = np.zeros(1 << bits)
        for i in np.flatnonzero(of_class):
            df[features[i][0]] += weights[i]
            seen[features[i][0]] += 1
        with_.append(df)
    share = n1 / (n1 + n0)
    prior = float(weights.mean())
    ratio = np.log((with_[0] + prior * share) / n1) - np.log((with_[1] + prior * (1 - share)) / n0)
    chosen = np.flatnonzero((seen >= LEAST_DOCUMENTS) & (np.abs(ratio) >= LEAST_RATIO))
    if not len(chosen):
        return none
    place = np.full(1 << bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    n, r = len(features), ratio[chosen]
    columns, values = [], []
    for i in range(n):
        buckets, counts = features[i]
        features[i] = None
        p = place[buckets]
        columns.append(p[p >= 0])
        values.append((scaled(counts[p >= 0]) * r[columns[-1]]).astype(np.float32))
    lengths = np.array([len(c) for c in columns], np.int64)
    columns, values = np.concatenate(columns), np.concatenate(values)
    ends = np.cumsum(lengths)
    # documents of about STEP_VALUES values together; one with more is on its own
    cuts = [0, *(np.flatnonzero(np.diff(ends // STEP_VALUES)) + 1).tolist(), n]
    target, share_of = labels.astype(float), weights / weights.sum()
    # gradient steps of Adam; everything is a sum over the fixed sample, so that a repeated task gives the same model
    w, b = np.zeros(len(chosen)), none.intercept
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = ridge * w / n, 0.0
        for first, last in zip(cuts, cuts[1:], strict=False):
            x = slice(int(ends[first] - lengths[first]), int(ends[last - 1]))
            row_of = np.repeat(np.arange(last - first), lengths[first:last])
            p = sigmoid(np.bincount(row_of, weights=w[columns[x]] * values[x], minlength=last - first) + b)
            error = (p - target[first:last]) * share_of[first:last]
            g += np.bincount(columns[x], weights=error[row_of] * values[x], minlength=len(w))
            gb += float(error.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * min(1.0, 2 * (1 - t / (steps + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return Model(chosen, w * r, b, bits=bits)


def held_out(key: Column) -> Column:
    """Documents whose labels are never learnt: a fifth, by checksum of the id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: tuple[int, int] = TRAIN_ROWS, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS) -> Model:
    """Fit on at most `rows` labelled documents of class 0 and 1 that are not held out.

    The sample is the first by a hash of the id, so it does not depend on how data are stored; only its ids (bounded) are broadcast and
    only its n-grams meet in the one task that fits. Its two classes are weighted as all labelled documents have them. Labels other
    than 0 and 1 and null ids are left out; an id with several labels counts as 1 if any says so; a document that repeats
    its id is learnt as often. Without labels of both classes the score is the share of class 1, a half if there is none.
    """
    known = (
        labels.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    order = [F.xxhash64("id"), F.col("id")]
    # of either class the first; each limit bounds what is broadcast
    sample = known.where("y = 1").orderBy(*order).limit(rows[1]).unionByName(known.where("y = 0").orderBy(*order).limit(rows[0]))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.concatenate(ngrams(t, orders, bits)).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], names=["id", "y", "ngrams"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, y = [], []
        for batch in batches:
            for x in batch.column("ngrams"):
                buckets, counts = np.frombuffer(x.as_py(), "<u4").reshape(2, -1)
                # few counts are above 255; the narrow copies take the place of the batch
                features.append((buckets.copy(), counts.astype(np.min_scalar_type(counts.max(initial=0)))))
            y += batch.column("y").to_pylist()
        y = np.array(y, np.int64)
        of_class = np.bincount(y, minlength=2)
        weights = np.array([sizes.get(c, 0) / max(of_class[c], 1) for c in (0, 1)])[y]
        model = fit(features, y, weights, bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.buckets.astype("<i8").tobytes()], pa.binary()), pa.array([model.weights.astype("<f8").tobytes()], pa.binary()), pa.array([model.intercept], pa.float64())],
            names=["buckets", "weights", "intercept"],
        )

    row = texts.mapInArrow(tidy(extract), "id bigint, y int, ngrams binary").repartition(1).sortWithinPartitions("id", "ngrams").mapInArrow(tidy(solve), "buckets binary, weights binary, intercept double").first()
    if row is None:  # no labelled document at all
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, orders, bits)
    return Model(np.frombuffer(row["buckets"], "<i8"), np.frombuffer(row["weights"], "<f8"), row["intercept"], orders, bits)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns of `docs` and the score of their whole text, 0 to 1. A null text counts as empty; empty texts get the
    score of no evidence. A column called like `into` is replaced. An empty table gives an empty table."""
    kept = [c for c in docs.columns if c != into]
    rest = docs.select(*map(column, kept))
    schema = rest.withColumn(into, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << model.bits)
        weights[model.buckets] = model.weights
        used = weights != 0
        for batch in batches:
            raw = []
            for t in batch.column(text).to_pylist():
                at, times = ngrams(t, model.orders, model.bits, used)
                raw.append(weights[at] @ scaled(times) + model.intercept)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sigmoid(np.array(raw, float)), pa.float64())], names=[*kept, into])

    return rest.mapInArrow(tidy(run), schema)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all `documents`, learnt from `labels`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
