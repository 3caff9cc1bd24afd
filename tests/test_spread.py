"""Ordered work in time slots gives what a plain window over the key gives, and building it starts no job."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions import spread
from opslens.operators import scd2, series

WIDTHS = [1, 3600, 10**9]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    out = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 11}")
        # many equal times, and gaps over several hours
        at = t0 + timedelta(seconds=rng.choice([0, 1, 1, 2, 3600, 7200, 7201]) * rng.randint(1, 9), microseconds=rng.choice([0, 250, 999_999]))
        out.append((key, at, i, rng.randint(0, 40), rng.choice("AAB"), rng.choice([None, None, "x", "y"])))
    return spark.createDataFrame(out, "k string, ts timestamp, id bigint, c bigint, state string, mark string").cache()


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def plain():
    return W.partitionBy("k").orderBy("ts", "id")


@pytest.mark.parametrize("width", WIDTHS)
def test_counter_delta(rows, width):
    back = F.lag("c").over(plain())
    want = rows.withColumn("delta", F.when(back.isNull(), None).when(F.col("c") < back, F.col("c")).otherwise(F.col("c") - back))
    same(series.counter_delta(rows, ["k"], "ts", ["id"], "c", slot_seconds=width), want)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("n", [1, 7, 25])
def test_rolling(rows, n, width):
    frame = plain().rowsBetween(-n, -1)
    got = series.rolling_stats(rows, ["k"], "ts", ["id"], "c", n, slot_seconds=width).select("id", "roll_mean", "roll_std")
    x = F.col("c").cast("double")
    want = rows.select("id", F.avg(x).over(frame).alias("roll_mean"), F.stddev_samp(x).over(frame).alias("roll_std"))
    both = got.alias("g").join(want.alias("w"), "id")
    assert both.count() == 900
    near = (F.col("g.roll_mean").eqNullSafe(F.col("w.roll_mean"))) & (F.col("g.roll_std").eqNullSafe(F.col("w.roll_std")))
    assert both.where(~near).count() == 0


@pytest.mark.parametrize("scale", [1e12, 1e-6])
def test_rolling_of_large_and_of_close_values(spark, scale):
    values = [scale * x for x in (1.0, 3.0, 2.0, 5.0, 4.0)]
    df = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, 0, i), i, 0.9999 + x if scale < 1 else x) for i, x in enumerate(values)], "k string, ts timestamp, id bigint, v double")
    last = series.rolling_stats(df, ["k"], "ts", ["id"], "v").where("id = 4").first()
    assert last.roll_std == pytest.approx(np.std(values[:4], ddof=1), rel=1e-6)
    assert last.z_score == pytest.approx((values[4] - np.mean(values[:4])) / np.std(values[:4], ddof=1), rel=1e-6)


@pytest.mark.parametrize("seconds, parts", [(3600, 60), (7200, 1), (2, 4), (10**6, 1000)])
def test_rolling_range(rows, seconds, parts):
    at = F.unix_micros("ts")
    df = rows.unionByName(rows.limit(40)).withColumn("v", F.when(F.col("id") % 6 > 0, F.col("c") / 7 + 1e6))
    frame = W.partitionBy("k").orderBy(at).rangeBetween(-seconds * 1_000_000, -1)
    got = series.rolling_range(df, ["k"], "ts", "v", seconds, parts)
    assert got.columns == [*df.columns, "rows_in_range", "range_mean", "range_std", "z_score", "is_anomaly"] and got.count() == 940
    want = df.select("id", F.count("v").over(frame).alias("n"), F.avg("v").over(frame).alias("m"), F.stddev_samp("v").over(frame).alias("d"))
    both = got.alias("g").join(want.distinct().alias("w"), "id")
    assert both.count() == 940 and both.where("rows_in_range <> n OR (range_mean IS NULL) <> (m IS NULL) OR (range_std IS NULL) <> (n < 2)").count() == 0
    assert both.where("abs(range_mean - m) > 1e-6 OR (n > 1 AND abs(range_std - d) > 1e-6)").count() == 0
    assert both.where("n > 1").count() > 0


def test_rolling_range_at_its_edges(spark):
    t = datetime(2024, 1, 1)
    times = [0, 0, 10, 10, 70, None, 130]
    df = spark.createDataFrame([(None, t + timedelta(seconds=s) if s is not None else None, i, 0.1, i) for i, s in enumerate(times)], "k string, ts timestamp, id int, v double, `a.b` int")
    got = {r.id: r for r in series.rolling_range(df, ["k"], "ts", "v", 60, 6).collect()}
    assert [got[i].rows_in_range for i in range(7)] == [0, 0, 2, 2, 2, 0, 1]
    assert got[2].range_std == 0.0 and got[2].z_score is None and got[6].range_std is None and got[6].range_mean == 0.1
    assert series.rolling_range(df.limit(0), ["k"], "ts", "v", 60, 6).count() == 0
    with pytest.raises(ValueError):
        series.rolling_range(df, ["k"], "ts", "v", 1, 7)


@pytest.mark.parametrize("width", WIDTHS)
def test_neighbours_ahead(rows, width):
    got = spread.over_ordered(rows, ["k"], "ts", ["id"], lambda w: {"ahead": F.lead("id", 3).over(w)}, after=3, slot_seconds=width)
    same(got, rows.withColumn("ahead", F.lead("id", 3).over(plain())))


@pytest.mark.parametrize("width", WIDTHS)
def test_fill_forward(rows, width):
    want = rows.withColumn("mark", F.last("mark", ignorenulls=True).over(plain().rowsBetween(W.unboundedPreceding, 0)))
    same(spread.fill_forward(rows, ["k"], "ts", ["id"], "mark", slot_seconds=width), want)


@pytest.mark.parametrize("width", WIDTHS)
def test_scd2(rows, width):
    built = scd2.build(rows, ["k"], "ts", ["id"], ["state", "mark"], slot_seconds=width)
    state = F.struct("state", "mark")
    kept = rows.withColumn("p", F.lag(F.struct(F.lit(True).alias("there"), state.alias("v"))).over(plain())).where(F.col("p").isNull() | ~F.col("p.v").eqNullSafe(state))
    end = F.lead("ts").over(plain())
    same(built, kept.select("k", "state", "mark", "id", F.col("ts").alias("valid_from"), end.alias("valid_to"), end.isNull().alias("is_current")))
    checked = scd2.validate(built, ["k"], ["id"], slot_seconds=width)
    assert checked.where("NOT valid").count() == 0 and checked.count() == rows.select("k").distinct().count()


@pytest.mark.parametrize("width", WIDTHS)
def test_as_of(rows, width):
    history = scd2.build(rows, ["k"], "ts", ["id"], ["state"]).where("k IS NOT NULL")
    facts = rows.where("k IS NOT NULL").selectExpr("k", "ts + INTERVAL 1 SECOND AS at", "id AS fact")
    joined = facts.alias("f").join(
        history.alias("h"),
        F.expr("f.k = h.k AND h.valid_from <= f.at AND (h.valid_to IS NULL OR f.at < h.valid_to)"),
        "left",
    )
    same(scd2.as_of_lookup(facts, history, ["k"], "at", "fact", "state", "id", slot_seconds=width), joined.select("f.k", "f.at", "f.fact", F.col("h.state").alias("state_as_of")))


def test_fact_before_first_version(spark):
    history = spark.createDataFrame([("a", "X", 1, datetime(2024, 1, 2), None, True)], "k string, s string, id bigint, valid_from timestamp, valid_to timestamp, is_current boolean")
    facts = spark.createDataFrame([("a", datetime(2024, 1, 1), 7), ("a", datetime(2024, 1, 2), 8), ("b", datetime(2024, 1, 3), 9)], "k string, at timestamp, f bigint")
    got = {r.f: r.s_as_of for r in scd2.as_of_lookup(facts, history, ["k"], "at", "f", "s", "id").collect()}
    assert got == {7: None, 8: "X", 9: None}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 0.99, 1.0])
def test_percentile(spark, q):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 100, 501), "e": rng.normal(1000, 0.01, 700), "b": np.array([5.0]), "c": np.repeat([1.0, 2.0, 1e9], 50), "d": np.array([-3.0, 0.0, 0.0, 7.0]), None: np.array([1.0, 2.0])}
    data = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("a", None)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {r.k: r.p for r in spread.percentile_exact(df, ["k"], "x", q, "p").collect()}
    for k, xs in groups.items():
        assert got[k] == pytest.approx(np.percentile(xs, q * 100), rel=1e-12, abs=1e-12)


def test_percentile_without_keys(spark):
    df = spark.range(101).selectExpr("cast(id AS double) AS x")
    assert spread.percentile_exact(df, [], "x", 0.5, "p").first()["p"] == 50.0


def test_percentile_skips_what_is_no_number(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (3.0,), (float("inf"),)], "x double").withColumn("k", F.lit("k"))
    assert spread.percentile_exact(df, ["k"], "x", 0.5, "p").first()["p"] == 2.5
    assert spread.percentile_exact(df, ["k"], "x", 1.0, "p").first()["p"] == float("inf")


def test_building_starts_no_job(spark, rows):
    rows.count()
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        series.rolling_stats(rows, ["k"], "ts", ["id"], "c")
        series.idle_timeout(rows, ["k"], "ts", ["id"])
        scd2.validate(scd2.build(rows, ["k"], "ts", ["id"], ["state"]), ["k"], ["id"])
        spread.fill_forward(rows, ["k"], "ts", ["id"], "mark")
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
