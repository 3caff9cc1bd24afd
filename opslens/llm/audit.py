"""How document filters interact: what each removes in every order, from sorted lists of the ids that fail."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from opslens.llm.common import looked_up, query, stored, table

#: Orders are listed in full, n! * n rows per part.
MOST_FILTERS = 6
WORD_GAP = "[\\x20\\x09-\\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = "[#$%&*|]"


def gallop(ids: Sequence[int], x: int, i: int) -> int:
    """The first place from `i` on whose id is not below `x`: steps double until they pass it, then the last step is searched."""
    n = len(ids)
    if i >= n or ids[i] >= x:
        return i
    step, end = 1, i + 1
    while end < n and ids[end] < x:
        i, step = end, 2 * step
        end = i + step
    return bisect_left(ids, x, i + 1, min(end, n))


def union_size(lists: list[list[int]]) -> int:
    """How many ids are in any of the sorted lists: runs of one list up to the next head of the others are counted at once."""
    heads, size = [(ids, 0) for ids in lists if ids], 0
    while len(heads) > 1:
        least = min(ids[at] for ids, at in heads)
        others = [ids[at] for ids, at in heads if ids[at] != least]
        if len(others) == len(heads) - 1:
            bound, moved = min(others), []
            for ids, at in heads:
                if ids[at] == least:
                    end = gallop(ids, bound, at)
                    size, at = size + end - at, end
                moved.append((ids, at))
        else:
            size, moved = size + 1, [(ids, at + (ids[at] == least)) for ids, at in heads]
        heads = [(ids, at) for ids, at in moved if at < len(ids)]
    return size + sum(len(ids) - at for ids, at in heads)


def difference(ids: list[int], lists: list[list[int]]) -> list[int]:
    """The ids that are in none of the sorted lists, in order: runs up to the next head of a list are taken at once."""
    heads, out, i = [(other, 0) for other in lists if other], [], 0
    while i < len(ids) and heads:
        x, found, moved = ids[i], False, []
        bound = None
        for other, at in heads:
            at = gallop(other, x, at)
            if at < len(other):
                moved.append((other, at))
                if other[at] == x:
                    found = True
                elif bound is None or other[at] < bound:
                    bound = other[at]
        heads = moved
        if found:
            i += 1
        elif bound is None:
            break
        else:
            end = gallop(ids, bound, i)
            out += ids[i:end]
            i = end
    return out + ids[i:]


def steps(n: int) -> list[tuple[int, int]]:
    """Every filter and set of other filters, as bits, that may have run before it."""
    return [(f, before) for f in range(n) for before in range(1 << n) if not before >> f & 1]


def counted(failing: list[list[int]], marked: list[list[int]], size: int) -> np.ndarray:
    """For one range of ids and each of `steps`: how many are kept after the filter, how many it removes, and how many of them are in each
    of the `marked` lists."""
    n, out = len(failing), []
    kept = [size - union_size([failing[g] for g in range(n) if s >> g & 1]) for s in range(1 << n)]
    for f, before in steps(n):
        removed = difference(failing[f], [failing[g] for g in range(n) if before >> g & 1])
        out.append([kept[before | 1 << f], len(removed), *(len(removed) - len(difference(removed, [m])) for m in marked)])
    return np.array(out, np.int64)


def interactions(rows: DataFrame, part: str, key: str, filters: dict[str, str], marks: list[str]) -> DataFrame:
    """A row per part, order of all filters, and step: part, filter_order, step, kept, removed, redundant, unique_fails, `mark`_lost per mark, shapley.

    `filters` names the boolean column that says "fails" for each filter; names are letters, as orders are written with them. kept: rows of
    the part that no filter up to this step removes; removed: what this one removes; redundant: what fails it but was removed before;
    unique_fails: what fails it alone; x_lost: the removed rows whose column x holds; shapley: what it removes, summed over all orders.

    Rows are sorted by part and key over all tasks, so a part, however large, is spread over tasks by ranges of its ids. A task keeps, for each part
    and range, a sorted list per filter and mark of the rows' places. Unions and differences of lists are galloping merges; only their sizes
    leave the task and are summed per part.

    A null flag does not fail, a null mark does not hold, a null part is the empty string. Rows that repeat a key count each. Rows that are
    alike in part, key and all flags stay in one range. An empty table gives an empty table. Other columns are not read, whatever their names.
    """
    letters, n = list(filters), len(filters)
    if not 1 <= n <= MOST_FILTERS or any(len(x) != 1 for x in letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters, named by a letter each")

    def bits(columns: list[str]) -> Column:
        return sum((F.when(F.col(f"`{c}`"), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0)).cast("int")

    flags = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(key).alias("id"), bits(list(filters.values())).alias("fails"), bits(marks).alias("marks"))
    order = ["part", "id", "fails", "marks"]
    ranged = flags.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "fails", "marks")
    lost = [f"{m}_lost" for m in marks]
    names = ["part", "filter", "before", "kept", "removed", *lost]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of_part, total = 0, None, None

        def closed() -> pa.RecordBatch:
            which = steps(n)
            columns = [[of_part] * len(which), [f for f, _ in which], [b for _, b in which], *total.T.tolist()]
            types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * (2 + len(marks))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").dictionary_encode()
            code = parts.indices.to_numpy()
            fails, marked = (batch.column(c).to_numpy() for c in ("fails", "marks"))
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for a, b in zip(edges, edges[1:], strict=False):
                name = parts.dictionary[int(code[a])].as_py()
                if name != of_part:
                    if of_part is not None:
                        yield closed()
                    of_part, total = name, 0
                lists = [[(np.flatnonzero(x[a:b] >> i & 1) + at + a).tolist() for i in range(m)] for x, m in ((fails, n), (marked, len(marks)))]
                total = total + counted(*lists, b - a)
            at += len(code)
        if of_part is not None:
            yield closed()

    sizes = ranged.mapInArrow(run, "part string, filter int, before int, " + ", ".join(f"{c} bigint" for c in names[3:]))
    summed = sizes.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in names[3:]])
    # how many orders put exactly these filters before
    others = F.bit_count("before")
    weight = F.array(*[F.lit(factorial(i) * factorial(n - 1 - i)) for i in range(n)])
    own = Window.partitionBy("part", "filter")
    full = summed.withColumns({
        "fails": F.max(F.when(F.col("before") == 0, F.col("removed"))).over(own),
        "unique_fails": F.max(F.when(others == n - 1, F.col("removed"))).over(own),
        "shapley": F.sum(F.col("removed") * F.get(weight, others)).over(own),
    })
    listed = [("".join(letters[f] for f in p), i + 1, f, sum(1 << g for g in p[:i])) for p in permutations(range(n)) for i, f in enumerate(p)]
    orders = rows.sparkSession.createDataFrame(listed, "filter_order string, step int, filter int, before int")
    # n! * n rows of numbers, whatever the input
    return full.join(F.broadcast(orders), ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley"
    )


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, doc_id, and as booleans a: few words, b: few distinct words, c: many capitals, d: signs, e: the text of a smaller doc_id; good and toxic: a label says so.

    Texts are read once; the rest works on a narrow table that is stored. Equal texts are told by SHA-256, over the whole table. A null text is empty;
    a null doc_id is neither smaller nor larger than another; an id with several labels has a mark if any of them gives it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, WORD_GAP), lambda w: w != "")
    capitals = F.octet_length(t) - F.octet_length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    read = docs.select(
        F.col(part).alias("part"), F.col(key).cast("bigint").alias("doc_id"), F.unhex(F.sha2(t, 256)).alias("digest"),
        F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct"), (100 * capitals > MOST_CAPITALS * F.char_length(t)).alias("c"), t.rlike(SIGNS).alias("d"),
    )
    narrow = stored(
        read.select("part", "doc_id", "digest", (F.col("words") < LEAST_WORDS).alias("a"), (100 * F.col("distinct") < LEAST_DISTINCT * F.col("words")).alias("b"), "c", "d"),
        "filter-flags",
    )
    spread = F.xxhash64("doc_id")
    firsts = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    told = looked_up(narrow, firsts, "digest", spread).withColumn("e", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("digest", "first")
    marks = labels.select(F.col(key).cast("bigint").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    return looked_up(told, marks, "doc_id", F.xxhash64("part", "a", "b", "c", "d", "e"))


def _sql() -> str:
    letters = "ABCDE"
    pairs = " AND ".join(f"o{i}.f <> o{j}.f" for i, j in combinations(range(5), 2))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(ws) < {LEAST_WORDS} AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) AS INT)
    + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '{SIGNS}') AS INT) + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS m
  FROM w LEFT JOIN l USING (doc_id)),
p AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT i AS f FROM range(5) t(i)),
orders AS (SELECT [o0.f, o1.f, o2.f, o3.f, o4.f] AS fs FROM o o0, o o1, o o2, o o3, o o4 WHERE {pairs}),
s AS (SELECT fs, step, 1 << CAST(fs[step] AS INT) AS own, list_sum(list_transform(fs[1 : step - 1], lambda x: 1 << CAST(x AS INT))) AS before0
  FROM orders, range(1, 6) t(step)),
r AS (SELECT part, fs, step, own,
    CAST(coalesce(sum(n) FILTER (m & (own | before) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (m & own > 0 AND m & before = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (m & own > 0 AND m & before > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (m = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (m & own > 0 AND m & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (m & own > 0 AND m & before = 0), 0) AS BIGINT) AS toxic_lost
  FROM p, (SELECT fs, step, own, CAST(coalesce(before0, 0) AS INT) AS before FROM s) GROUP BY part, fs, step, own)
SELECT part, array_to_string(list_transform(fs, lambda x: '{letters}'[CAST(x AS INT) + 1]), '') AS filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


@query("op12_filter_audit", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all `documents`, per source, in all orders."""
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interactions(rows, "part", "doc_id", dict(zip("ABCDE", "abcde", strict=True)), ["good", "toxic"])
