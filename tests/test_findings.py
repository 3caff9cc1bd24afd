"""Findings and health metrics on one small catalog snapshot with answers worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opslens.operators import alerts, findings, history

KEY = {"project_id": "p", "branch_id": "main"}
K = "project_id string, branch_id string, "


def frame(spark, ddl, rows):
    return spark.createDataFrame([("p", "main", *r) for r in rows], K + ddl)


@pytest.fixture(scope="module")
def tables(spark):
    return frame(
        spark,
        "relname string, n_live_tup bigint, n_dead_tup bigint, seq_scan bigint, idx_scan bigint, seq_tup_read bigint",
        [("orders", 5_000_000, 800_000, 150, 45_000, 10), ("events", 20_000_000, 5_000_000, 500, 1_000, 10), ("users", 100_000, 500, 10, 80_000, 10)],
    )


@pytest.fixture(scope="module")
def indexes(spark):
    mb = 1024 * 1024
    return frame(
        spark,
        "indexrelid bigint, table_name string, index_name string, idx_scan bigint, index_size_bytes bigint, indisunique boolean, indisprimary boolean, indkey string",
        [
            (1, "orders", "idx_orders_customer_id", 45_000, 100 * mb, False, False, "2"),
            (2, "orders", "idx_orders_old_status", 0, 50 * mb, False, False, "3"),
            (3, "events", "idx_events_type", 1_000, 200 * mb, False, False, "2"),
            (4, "orders", "idx_orders_customer_2", 70, 1 * mb, False, False, "2"),
            (5, "orders", "orders_pkey", 0, 80 * mb, True, True, "1"),
            (6, "orders", "orders_pkey_2", 9, 1 * mb, True, True, "1"),
        ],
    )


def meta(indexes):
    return indexes.drop("indisunique", "indisprimary"), indexes.select("project_id", "branch_id", "indexrelid", "indisunique", "indisprimary")


def test_unused(indexes):
    r = findings.unused_indexes(*meta(indexes)).collect()
    assert [(x.index_name, x.size_mb, x.confidence) for x in r] == [("idx_orders_old_status", 50.0, "high")]


def test_bloated_is_strict(indexes):
    rows = findings.bloated_indexes(indexes.where("NOT indisprimary")).collect()
    assert rows == []  # 50 MB is not over 50 MB


def test_missing(tables):
    assert findings.missing_indexes(tables).count() == 0  # 500 is not over 10 x 1000
    more = tables.withColumn("idx_scan", F.when(F.col("relname") == "events", 49).otherwise(F.col("idx_scan")))
    assert [r.relname for r in findings.missing_indexes(more).collect()] == ["events"]


def test_duplicates_skip_primary_and_name_each_copy_once(spark, indexes):
    d = findings.duplicate_indexes(indexes, ["table_name"]).collect()
    assert [(r.keep_index, r.drop_index) for r in d] == [(1, 4)]
    many = spark.range(200).selectExpr("id AS indexrelid", "'t' AS table_name", "'1' AS indkey", "false AS indisprimary", "id AS index_size_bytes")
    assert findings.duplicate_indexes(many, ["table_name"]).count() == 199


def test_unindexed_foreign_key(spark):
    con = spark.createDataFrame([("a", 1, [2, 3]), ("b", 1, [3, 2]), ("c", 9, [2])], "conname string, conrelid bigint, conkey array<bigint>")
    idx = spark.createDataFrame([(1, [2]), (1, [5, 2])], "indrelid bigint, indkey array<bigint>")
    assert sorted(r.conname for r in findings.unindexed_foreign_keys(con, idx).collect()) == ["b", "c"]


def test_unindexed_columns(spark):
    """Each (table, column) once with its constraints, a row per name, in parts that do not depend on the size."""
    con = spark.createDataFrame([("a", 1, [2, 3]), ("b", 1, [3, 2]), ("b", 1, [3]), ("c", 9, [2]), ("d", None, [2]), ("e", 1, [None])], "conname string, conrelid bigint, conkey array<bigint>")
    idx = spark.createDataFrame([(1, [2]), (1, [5, 2]), (None, [2]), (9, None)], "indrelid bigint, indkey array<bigint>")
    att = spark.createDataFrame([(1, 2, "x"), (1, 3, "y"), (1, 3, "z"), (9, 2, None), (None, 2, "n"), (8, 1, "w")], "attrelid bigint, attnum bigint, attname string")
    out = findings.unindexed_columns(con, idx, att)
    got = [(r.conrelid, r.column_number, r.column_name, r.constraints) for r in out.collect()]
    assert sorted(got, key=str) == [(1, 3, "y", 2), (1, 3, "z", 2), (9, 2, None, 1)]
    assert out.rdd.getNumPartitions() == findings.PARTS


def test_health_score(spark, indexes):
    u = findings.unused_indexes(*meta(indexes))
    lots = findings.union_findings(*[u] * 12)
    clean = spark.createDataFrame([("p", "clean")], "project_id string, branch_id string")
    scores = {r.branch_id: (r.total_issues, r.health_score) for r in findings.index_health(lots, clean).collect()}
    assert scores.pop("clean") == (0, 100) and set(scores.values()) == {(12, 0)}


def test_all_detectors_score_together(spark, indexes):
    """An unused index, a table read by full scans, and a foreign key without index; no branch of its own is lost."""
    keys = spark.createDataFrame([("p", "b", "orders", "customer_id"), ("p", "b", "orders", "customer_id")], "project_id string, branch_id string, table_name string, column_name string")
    read = spark.createDataFrame([("p", "b", "events", 500, 3, 50_000, 9), ("p", "b", "small", 500, 3, 10, 9)], "project_id string, branch_id string, relname string, seq_scan bigint, idx_scan bigint, n_live_tup bigint, seq_tup_read bigint")
    doubled = spark.createDataFrame([("p", "b", "t", f"i{n}", n, "1 2", False, 1048576) for n in range(3)], "project_id string, branch_id string, table_name string, index_name string, indexrelid bigint, indkey string, indisprimary boolean, index_size_bytes bigint")
    found = {
        "drop_unused": findings.unused_indexes(*meta(indexes)), "reindex_bloated": findings.bloated_indexes(indexes), "create_missing": findings.missing_findings(read),
        "drop_duplicate": findings.duplicate_findings(doubled), "create_fk_index": findings.foreign_key_findings(keys),
    }
    rows = findings.union_findings(*found.values()).collect()
    assert {k: sum(r.recommendation_type == k for r in rows) for k in found} == {k: f.count() for k, f in found.items()}
    assert len({r.recommendation_id for r in rows}) == len(rows)
    assert [(r.index_name, r.size_mb, r.ddl_statement) for r in rows if r.recommendation_type == "drop_duplicate"] == [(f"i{n}", 1.0, f"DROP INDEX CONCURRENTLY i{n}") for n in (1, 2)]
    three = findings.union_findings(*[found[k].limit(1).withColumns({"project_id": F.lit("p"), "branch_id": F.lit("b")}) for k in ("drop_unused", "create_missing", "create_fk_index")])
    assert [(r.total_issues, r.health_score) for r in findings.index_health(three, three).collect()] == [(3, 70)]


def test_vacuum(tables):
    got = {r.relname: (round(r.dead_pct, 2), r.action) for r in findings.vacuum_candidates(tables).collect()}
    assert got == {"orders": (13.79, "VACUUM ANALYZE"), "events": (20.0, "VACUUM ANALYZE")}


@pytest.mark.parametrize("age,risk", [(300_000_000, "safe"), (500_000_000, "safe"), (500_000_001, "warning"), (1_000_000_000, "warning"), (1_000_000_001, "critical")])
def test_xid(spark, age, risk):
    r = findings.xid_risk(frame(spark, "xid_age bigint", [(age,)])).first()
    assert r.risk == risk and r.pct_to_wraparound == pytest.approx(age / 2e9 * 100)


def test_autovacuum(tables):
    got = {r.relname: (r.scale_factor, r.vacuum_threshold) for r in findings.autovacuum_tuning(tables).collect()}
    assert got == {"orders": (0.01, 50_000), "events": (0.01, 200_000)}


def test_health_metrics(spark, tables):
    db = frame(spark, "numbackends bigint, blks_read bigint, blks_hit bigint, deadlocks bigint, xid_age bigint", [(15, 100_000, 9_900_000, 1, 300_000_000)])
    sessions = frame(spark, "state string", [("active",), ("idle",), ("idle in transaction",)])
    locks = frame(spark, "granted boolean", [(True,)])
    io = frame(spark, "backend_type string, reads bigint, hits bigint, read_time double, write_time double", [("client backend", 150_000, 9_800_000, 1.0, 2.0)])
    wal = frame(spark, "wal_bytes bigint, wal_buffers_full bigint, wal_write_time double", [(6_400_000_000, 50, 3.0)])
    r = alerts.health_metrics(db, sessions, tables, locks, io, wal).first()
    assert r.cache_hit_ratio == pytest.approx(0.99) and r.deadlocks == 1 and r.active_connections == 15
    assert r.connection_utilization == pytest.approx(0.03) and r.idle_connections == 1 and r.idle_in_transaction == 1 and r.active_queries == 1
    assert r.max_dead_tuple_ratio == pytest.approx(0.2) and r.worst_dead_tuple_table == "events"
    assert r.waiting_locks == 0 and r.txid_age == 3e8 and r.io_hit_ratio == pytest.approx(9.8e6 / 9.95e6)
    long = history.unpivot_metrics(alerts.health_metrics(db, sessions, tables, locks, io, wal), ["project_id", "branch_id"])
    assert "worst_dead_tuple_table" not in {x.metric_name for x in long.collect()}


def test_health_metrics_without_blocks(spark, tables):
    db = frame(spark, "numbackends bigint, blks_read bigint, blks_hit bigint, deadlocks bigint, xid_age bigint", [(0, 0, 0, 0, 1)])
    empty = lambda ddl: frame(spark, ddl, [])
    r = alerts.health_metrics(
        db, empty("state string"), tables, empty("granted boolean"),
        empty("backend_type string, reads bigint, hits bigint, read_time double, write_time double"), empty("wal_bytes bigint, wal_buffers_full bigint, wal_write_time double"),
    ).first()
    assert r.cache_hit_ratio == 1.0


LEVELS = [
    ("cache_hit_ratio", 0.999, "normal"), ("cache_hit_ratio", 0.99, "normal"), ("cache_hit_ratio", 0.97, "warning"), ("cache_hit_ratio", 0.95, "warning"), ("cache_hit_ratio", 0.90, "critical"),
    ("connection_utilization", 0.30, "normal"), ("connection_utilization", 0.70, "normal"), ("connection_utilization", 0.85, "warning"), ("connection_utilization", 0.90, "critical"),
    ("max_dead_tuple_ratio", 0.05, "normal"), ("max_dead_tuple_ratio", 0.2, "warning"), ("max_dead_tuple_ratio", 0.30, "critical"),
    ("lock_wait_seconds", 30.0, "normal"), ("lock_wait_seconds", 31.0, "warning"), ("lock_wait_seconds", 121.0, "critical"),
    ("deadlocks_per_hour", 2.0, "normal"), ("deadlocks_per_hour", 3.0, "warning"), ("deadlocks_per_hour", 6.0, "critical"),
    ("slow_query_seconds", 5.1, "warning"), ("slow_query_seconds", 30.1, "critical"),
    ("txid_age", 1e8, "normal"), ("txid_age", 6e8, "warning"), ("txid_age", 1.5e9, "critical"),
    ("replication_lag_seconds", 11.0, "warning"), ("replication_lag_seconds", 61.0, "critical"),
    ("unheard_of", 1.0, "none"),
]


def test_levels(spark):
    rows = [(i, m, v) for i, (m, v, _) in enumerate(LEVELS)] + [(len(LEVELS), "txid_age", None)]
    df = spark.createDataFrame(rows, "i int, metric_name string, metric_value double")
    got = {r.i: r.threshold_level for r in alerts.evaluate(df, alerts.thresholds(spark)).collect()}
    assert got == {i: lv for i, (_, _, lv) in enumerate(LEVELS)}


def test_routing_and_dedup(spark):
    t = [datetime(2024, 1, 1, h) for h in (3, 1, 2)] + [datetime(2024, 1, 2)]
    df = spark.createDataFrame([("m", "critical", x) for x in t] + [("m", "info", t[0])], "metric string, severity string, ts timestamp")
    out = alerts.route(alerts.dedup_alerts(df, ["metric", "severity"], "ts")).collect()
    assert sorted((r.severity, r.ts.hour, r.occurrences, tuple(r.channels_sent)) for r in out) == [
        ("critical", 0, 1, ("slack", "pagerduty", "log")), ("critical", 1, 3, ("slack", "pagerduty", "log")), ("info", 3, 1, ("log",)),
    ]


def test_rules_fire_only_in_their_look_back(spark):
    now = datetime(2024, 1, 1, 12)
    df = spark.createDataFrame(
        [("p", "b", "cache_hit_ratio", 0.94, datetime(2024, 1, 1, 11, 55)), ("p", "b", "txid_age", 9e8, datetime(2024, 1, 1, 11, 49)), ("p", "b", "freshness_lag_seconds", 4000.0, datetime(2024, 1, 1, 11, 31))],
        "project_id string, branch_id string, metric_name string, metric_value double, snapshot_timestamp timestamp",
    )
    schema = "source_table string, target_table string, freshness_lag_seconds double, validated_at timestamp"
    late = spark.createDataFrame([("s", "t", 4000.0, datetime(2024, 1, 1, 11, 31)), ("s", "t", 10.0, datetime(2024, 1, 1, 11, 59))], schema)
    early = spark.createDataFrame([("s", "t", 4000.0, datetime(2024, 1, 1, 11, 29))], schema)
    assert {r.rule for r in alerts.alert_rules(df, early, now).where("fires").collect()} == {"cache_hit_ratio_warning", "cache_hit_ratio_critical"}
    fired = {r.rule for r in alerts.alert_rules(df, late, now).where("fires").collect()}
    assert fired == {"cache_hit_ratio_warning", "cache_hit_ratio_critical", "sync_freshness_warning"}


def test_decisions(spark):
    df = spark.createDataFrame([("VACUUM ANALYZE t", "low"), ("Terminate idle", "low"), ("drop", "low"), ("vacuum", "medium"), ("vacuum", None)], "action string, risk_level string")
    assert [r.decision for r in alerts.heal_decision(df).collect()] == ["remediated", "remediated", "unknown_action", "escalated", "escalated"]


def test_null_keys_meet(spark):
    """An unused index and two equal ones of a branch without a name, and metrics of it."""
    schema = "project_id string, branch_id string, indexrelid bigint, table_name string, index_name string, idx_scan bigint, index_size_bytes bigint, indisunique boolean, indisprimary boolean, indkey string"
    rows = spark.createDataFrame([("p", None, i, "t", f"i{i}", 0, 100, False, False, "a") for i in (1, 2)], schema)
    m = rows.select("project_id", "branch_id", "indexrelid", "indisunique", "indisprimary")
    assert findings.unused_indexes(rows.drop("indisunique", "indisprimary"), m).count() == 2
    assert [(r.keep_index, r.drop_index) for r in findings.duplicate_indexes(rows, ["project_id", "branch_id", "table_name"]).collect()] == [(1, 2)]
    assert findings.duplicate_findings(rows).count() == 1


def test_metrics_of_a_null_branch(spark, tables):
    db = spark.createDataFrame([("p", None, 9, 1, 0, 1, 5)], K + "blks_hit bigint, blks_read bigint, deadlocks bigint, numbackends bigint, xid_age bigint")
    sessions = spark.createDataFrame([("p", None, "idle")], K + "state string")
    locks = spark.createDataFrame([("p", None, False)], K + "granted boolean")
    io = spark.createDataFrame([("p", None, "client backend", 1, 3, 0.0, 0.0)], K + "backend_type string, reads bigint, hits bigint, read_time double, write_time double")
    wal = spark.createDataFrame([("p", None, 7, 0, 0.0)], K + "wal_bytes bigint, wal_buffers_full bigint, wal_write_time double")
    r = alerts.health_metrics(db, sessions, tables.withColumn("branch_id", F.lit(None).cast("string")), locks, io, wal).first()
    assert (r.idle_connections, r.waiting_locks, r.io_hit_ratio, r.wal_bytes_generated, r.worst_dead_tuple_table) == (1.0, 1.0, 0.75, 7.0, "events")


def test_orphans_with_a_null_key(spark):
    from opslens.operators import scd2

    open_ = spark.createDataFrame([("a", True), (None, True), ("b", True), ("c", False)], "k string, is_current boolean")
    source = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r.k for r in scd2.orphans(open_, source, ["k"]).collect()] == ["b"]
