"""Digest trees against plain reconciliation, and sketches against exact answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opslens.operators import digests, sketches, sync

NAMES = ["key", "source_only_rows", "target_only_rows", "difference"]


def said(df):
    return sorted(((r.key, r.source_only_rows, r.target_only_rows, r.difference) for r in df.select(*NAMES).collect()), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    source = spark.range(20_000).selectExpr("CASE WHEN id = 7 THEN NULL ELSE id END AS key", "concat('v', id) AS v").unionByName(spark.createDataFrame([(1, "v1"), (1, "v1"), (3, "more")], "key bigint, v string"))
    changed = F.when(F.col("key") % 5000 == 11, "changed").otherwise(F.col("v"))
    target = source.where("key IS NULL OR key % 7000 != 9").withColumn("v", changed).unionByName(spark.createDataFrame([(50_000, "new"), (None, "null too")], "key bigint, v string"))
    return source, target


@pytest.mark.parametrize("bits", [4, 12, 16])
def test_same_as_plain(sides, bits):
    source, target = sides
    want = said(sync.reconcile_rows(source, target, ["key"], ["key", "v"]))
    assert len(want) == 9 and said(digests.reconcile_tree(source, target, ["key"], ["v"], bits)) == want


def test_only_differing_ranges_go_on(sides):
    source, target = sides
    leaves = digests.differing(*[digests.tree(s, ["key"], ["v"]) for s in sides])
    assert len(leaves) == 9
    assert digests.in_leaves(source, ["key"], leaves).count() < 60
    assert digests.differing(*[digests.tree(s, ["key"], ["v"]) for s in (source, source.repartition(5))]) == []
    assert digests.reconcile_tree(source, source.orderBy(F.rand(3)), ["key"], ["v"]).count() == 0


def test_tree_adds_up(sides):
    t = digests.tree(sides[0], ["key"], ["v"], 8)
    sums = [tuple(r) for r in t.groupBy("level").agg(F.sum("rows"), F.sum("digest")).orderBy("level").select("sum(rows)", "sum(digest)").collect()]
    assert len(sums) == 3 and len(set(sums)) == 1 and sums[0][0] == 20_003
    assert t.where("level = 2").count() == 256
    with pytest.raises(ValueError):
        digests.tree(sides[0], ["key"], ["v"], 7)


def test_stored_tree_and_empty_sides(spark, sides, tmp_path):
    source, target = sides
    digests.tree(target, ["key"], ["v"]).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert said(digests.reconcile_tree(source, target, ["key"], ["v"], target_tree=stored)) == said(digests.reconcile_tree(source, target, ["key"], ["v"]))
    few = source.limit(3)
    empty = few.limit(0)
    assert {r.difference for r in digests.reconcile_tree(few, empty, ["key"], ["v"]).collect()} == {"source_only"}
    assert digests.reconcile_tree(empty, empty, ["key"], ["v"]).count() == 0


def test_sketches_merge(spark, tmp_path):
    """Five minutes, hours, days: answers from merged sketches stay within their bounds."""
    rows = spark.range(60_000).selectExpr("concat('k', id % 2) AS k", "timestampadd(SECOND, cast(id * 2 AS INT), TIMESTAMP_NTZ '2024-01-01') AS ts", "id % 9000 AS q", "cast(pow(id % 10007, 1.5) AS DOUBLE) AS ms")
    sketches.rollup(rows, ["k"], "ts", 300, ["q"], ["ms"]).write.parquet(str(tmp_path / "five"))
    five = spark.read.parquet(str(tmp_path / "five"))
    hour = sketches.merge(five, ["k"], F.date_trunc("hour", "slot"), ["q"], ["ms"])
    day = sketches.merge(hour, ["k"], F.date_trunc("day", "slot").cast("timestamp_ntz"), ["q"], ["ms"])
    got = sketches.finish(day, ["k"], ["q"], {"ms": [0.5, 0.99]}).withColumnRenamed("n", "rows")
    exact = rows.groupBy("k", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("slot")).agg(F.count("*").alias("n"), F.count_distinct("q").alias("d"))
    for r in got.join(exact, ["k", "slot"]).collect():
        assert r.rows == r.n and abs(r.q_distinct - r.d) <= 0.06 * r.d
        of_day = rows.where((F.col("k") == r.k) & (F.date_trunc("day", "ts") == F.lit(r.slot)))
        for q, x in ((0.5, r.ms_p50), (0.99, r.ms_p99)):
            below, upto = of_day.agg(F.avg((F.col("ms") < x).cast("int")), F.avg((F.col("ms") <= x).cast("int"))).first()
            assert below - 0.01 <= q <= upto + 0.01


def test_sketches_of_nulls_and_nothing(spark):
    schema = "k string, ts timestamp_ntz, q bigint, ms double"
    rows = spark.createDataFrame([(None, datetime(2024, 1, 1), None, None), ("a", None, 5, 1.5)], schema)
    day = sketches.merge(sketches.rollup(rows, ["k"], "ts", 300, ["q"], ["ms"]), ["k"], F.date_trunc("day", "slot").cast("timestamp_ntz"), ["q"], ["ms"])
    got = {r.k: (r.slot, r.n, r.q_distinct, r.ms_p99) for r in sketches.finish(day, ["k"], ["q"], {"ms": [0.99]}).collect()}
    assert got == {None: (datetime(2024, 1, 1), 1, 0, None), "a": (None, 1, 1, 1.5)}
    assert sketches.rollup(rows.limit(0), ["k"], "ts", 300, ["q"], ["ms"]).count() == 0
