"""History analytics: bounds, labels, ties, rollups, seed rows with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.operators import history as H
from opslens.operators import series as S
from opslens.operators import status

NOW = datetime(2024, 1, 2)


def stats(spark, rows):
    return spark.createDataFrame(
        [(q, f"q{q}", c, tot, mean, 1, 1024, at) for q, c, tot, mean, at in rows],
        "queryid bigint, query string, calls bigint, total_exec_time double, mean_exec_time double, rows bigint, shared_blks_read bigint, snapshot_timestamp timestamp",
    )


def test_top_slow(spark):
    t = NOW - timedelta(hours=1)
    df = stats(spark, [(1001, 15_000, 45_000.0, 3.0, t), (1002, 50_000, 25_000.0, 0.5, t), (1003, 8_000, 160_000.0, 20.0, t), (9, 1, 9e9, 1.0, NOW - timedelta(hours=24))])
    rows = H.top_slow(df, NOW).collect()
    assert [r.queryid for r in rows] == [1003, 1001, 1002] and rows[0].total_read_mb == 8.0


@pytest.mark.parametrize("recent,label", [(20.0, "WARNING"), (20.1, "REGRESSION"), (15.0, "STABLE"), (15.1, "WARNING"), (1.0, "STABLE")])
def test_regression_labels(spark, recent, label):
    df = stats(spark, [(1, 1, 1.0, 10.0, NOW - timedelta(hours=5)), (1, 1, 1.0, recent, NOW - timedelta(minutes=5)), (2, 1, 1.0, 0.0, NOW - timedelta(hours=5)), (2, 1, 1.0, 5.0, NOW)])
    rows = H.regression(df, NOW).collect()
    assert [(r.queryid, r.status) for r in rows] == [(1, label)]


def test_regression_windows_overlap(spark):
    """A row between one and two hours old counts on both sides, as declared."""
    df = stats(spark, [(1, 1, 1.0, 10.0, NOW - timedelta(minutes=90))])
    r = H.regression(df, NOW).first()
    assert (r.baseline_ms, r.recent_ms) == (10.0, 10.0)


def test_window_bounds(spark):
    df = spark.createDataFrame([(i, NOW - timedelta(hours=i)) for i in range(27)], "i int, ts timestamp")
    assert df.schema["ts"].dataType.typeName() == "timestamp"
    assert sorted(r.i for r in H.since(df, "ts", NOW, hours=2).collect()) == [0, 1]
    assert sorted(r.i for r in H.between(df, "ts", NOW, timedelta(hours=25), timedelta(hours=23)).collect()) == [23, 24, 25]


def test_filter_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = H.since(events, "ts", datetime(2024, 1, 30), hours=24).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts,2024-01-29T00:00" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_names_and_pages(spark):
    df = spark.createDataFrame([("cache_hit_ratio",)], "metric_name string")
    with pytest.raises(ValueError):
        H.only_metrics(df, ["cache_hit_ratio", "nope"])
    for limit, offset in ((0, 0), (501, 0), (5, -1)):
        with pytest.raises(ValueError):
            H.page(df, [F.col("metric_name")], limit, offset)


def test_latest_keeps_ties_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), (None, 5, 4)], "k string, t int, id int")
    assert sorted(r.id for r in H.latest_per_key(df, ["k"], "t").collect()) == [2, 3, 4]
    assert sorted(r.id for r in H.latest_per_key(df, ["k"], "t", "one", ["id"]).collect()) == [3, 4]


def test_top_k_limits_before_the_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = H.top_k_per_key(df, ["o_orderstatus"], [F.desc("o_totalprice")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_rollup_of_partials_is_direct(spark):
    df = spark.range(5000).selectExpr(
        "'p' AS project_id", "'b' AS branch_id", "concat('m', id % 3) AS metric_name", "cast(id % 101 AS DECIMAL(12,3)) AS metric_value",
        "timestampadd(SECOND, id * 37, TIMESTAMP '2024-01-01') AS snapshot_timestamp",
    )
    keys = ["project_id", "branch_id", "metric_name"]
    hour = F.date_trunc("hour", F.col("slot"))
    merged = H.finish_rollup(H.merge_rollup(H.rollup_samples(df, 300), keys, hour))
    direct = H.finish_rollup(H.merge_rollup(H.rollup_samples(df, 1), keys, hour))
    assert merged.exceptAll(direct).count() == 0 and merged.count() == direct.count()


def test_counter_reset(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10, 15, 3, 3, 9])], "i int, c bigint").withColumn("k", F.lit("k"))
    got = [r.delta for r in S.counter_delta(df.withColumn("t", F.timestamp_seconds("i")), ["k"], "t", ["i"], "c").orderBy("i").collect()]
    assert got == [None, 5, 3, 0, 6]


def test_period_delta(spark):
    df = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 15.0), ("k", 3, 15.0), ("k", 4, 0.0), ("k", 5, 3.0)], "k string, p int, v double")
    got = [(r.pct_change, r.direction) for r in S.period_delta(df, ["k"], "p", "v").orderBy("p").collect()]
    assert got == [(50.0, "up"), (0.0, "flat"), (-100.0, "down"), (None, "up")]


def test_anomaly(spark):
    df = spark.range(41).selectExpr("id", "'m' AS m", "timestamp_seconds(id) AS t", "cast(CASE WHEN id = 40 THEN 99 ELSE id % 2 END AS DOUBLE) AS v")
    rows = S.rolling_stats(df, ["m"], "t", ["id"], "v").orderBy("id").collect()
    assert [r.id for r in rows if r.is_anomaly] == [40]
    assert rows[0].roll_mean is None and rows[1].roll_std is None
    assert rows[40].roll_std == pytest.approx((20 * 0.25 / 19) ** 0.5)


def test_forecast(spark):
    df = spark.range(10).selectExpr("'d' AS k", "date_add(DATE '2024-01-01', cast(id AS INT)) AS day", "cast(100 + 5 * id AS DOUBLE) AS v")
    r = S.capacity_forecast(df, ["k"], "day", "v", 200.0).first()
    assert r.growth_per_day == pytest.approx(5) and r.projected == pytest.approx(295) and r.days_to_threshold == pytest.approx(11) and r.peak == 145 and r.headroom_pct == pytest.approx(27.5)


def test_correlation(spark):
    df = spark.range(48).selectExpr("timestamp_seconds(id * 3600) AS snapshot_timestamp", "id").selectExpr("snapshot_timestamp", "stack(2, 'a', cast(id AS DOUBLE), 'b', cast(-2 * id AS DOUBLE)) AS (metric_name, metric_value)")
    r = S.metric_correlation(df, ["b", "a"]).first()
    assert (r.metric_a, r.metric_b, r.slots) == ("a", "b", 48) and r.correlation == pytest.approx(-1)


def test_seed_rows(spark):
    recs = spark.createDataFrame(
        [("1", "drop_unused", "high", "pending_review", NOW), ("2", "drop_unused", "medium", "pending_review", NOW), ("3", "create_missing", "high", "pending_review", NOW)],
        "recommendation_id string, recommendation_type string, confidence string, status string, created_at timestamp",
    )
    got = {(r.recommendation_type, r.confidence): (r.n, r.pending_review, r.approved) for r in status.recommendation_status(recs, NOW).collect()}
    assert got == {("drop_unused", "high"): (1, 1, 0), ("drop_unused", "medium"): (1, 1, 0), ("create_missing", "high"): (1, 1, 0)}
    log = spark.createDataFrame([("a", 150_000, 75_000_000, NOW, "success"), ("b", 500_000, 250_000_000, NOW, "success"), ("c", 1, 1, NOW, "failed")], "source_table string, rows_archived bigint, bytes_reclaimed bigint, archived_at timestamp, status string")
    rows = status.archival_summary(log).collect()
    assert sum(r.total_rows_archived for r in rows) == 650_000 and sorted(round(r.mb_reclaimed, 2) for r in rows) == [71.53, 238.42]
    ev = spark.createDataFrame(
        [("p", "production", "created", False, NOW), ("p", "staging", "created", True, NOW), ("p", "dev", "created", False, NOW), ("p", "ci-1", "created", False, NOW), ("p", "ci-1", "reset", False, NOW)],
        "project_id string, branch_id string, event_type string, is_protected boolean, event_timestamp timestamp",
    )
    r = status.active_branches(ev).first()
    assert (r.active_branches, r.protected_branches) == (4, 1)


@pytest.mark.parametrize("states,overall", [(["TERMINATED/SUCCESS"] * 2, "completed"), (["TERMINATED/SUCCESS", "RUNNING/"], "running"), (["TERMINATED/SUCCESS", "TERMINATED/FAILED"], "failed"), (["SKIPPED/"], "failed"), (["BLOCKED/", "TERMINATED/FAILED"], "running")])
def test_runs(spark, states, overall):
    df = spark.createDataFrame([(1, *s.split("/")) for s in states], "job int, life_cycle string, result string")
    assert status.run_rollup(df, ["job"]).first()["overall"] == overall
