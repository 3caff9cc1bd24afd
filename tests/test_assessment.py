"""Scores, sizing and cost on single databases with known answers."""

import pytest
from pyspark.sql import functions as F

from opslens.operators import assessment as A
from opslens.operators import cost as M

BASE = {
    "db_id": "d", "source_engine": "aurora-postgresql", "region": "us-east-1", "size_gb": 1.86, "table_count": 10, "engine_version": "15.4",
    "extensions": [("pgcrypto", "1"), ("pg_trgm", "1")], "functions": [], "trigger_count": 0, "materialized_view_count": 0, "custom_type_count": 0,
    "has_logical_replication": False, "replication_slots": [], "event_trigger_count": 0, "large_object_count": 0, "non_default_collation_count": 0,
    "streams_enabled": None, "pitr_enabled": None, "ttl_enabled": None, "billing_mode": None, "gsi_count": None, "lsi_count": None, "item_size_avg_bytes": None,
    "regions": None, "change_feed_mode": None, "multi_region_writes": None, "consistency_level": None, "throughput_mode": None, "request_units": None,
    "autoscale_max_units": None, "partition_key_paths": None, "unindexed_containers": None, "backup_policy": None,
    "workload": (500.0, 900.0, 100.0, 5.0, 80.0, 20.0, 20, 50, "observed"),
}


def db(spark, **over):
    from pyspark.sql import types as T

    row = {**BASE, **over}
    schema = T.StructType.fromDDL(A.PROFILE_DDL)
    return spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema)


def score(spark, **over):
    return A.score(db(spark, **over)).first()


def test_clean(spark):
    r = score(spark)
    assert (r.overall_score, r.category, r.blocker_count, r.effort_days, r.risk_level) == (100.0, "ready", 0, 5.0, "low")
    envs = {e.env: (e.env_min, e.env_max) for e in A.sizing_by_env(A.sizing(db(spark))).collect()}
    assert envs == {"dev": (0.5, 1.0), "staging": (2.0, 6.0), "prod": (2.0, 4.0)}


def test_extensions(spark):
    fns = [(f"f{i}", "plpgsql", 20) for i in range(5)]
    r = score(spark, size_gb=46.6, table_count=30, extensions=[("pg_cron", "1"), ("aws_s3", "1"), ("PostGIS", "3")], functions=fns, workload=None)
    assert [r[n] for n in A.WEIGHTS] == [98.9, 33.3, 75.0, 100.0, 100.0, 85.0]
    assert (r.overall_score, r.category, r.effort_days, r.blocker_count) == (80.4, "ready", 8.0, 2)
    assert {b.severity for b in r.blockers} == {"medium"}


def test_oversized(spark):
    r = score(spark, size_gb=10_240.0)
    assert r.s_storage == 0 and r.category == "not_feasible"


def test_limits_are_strict(spark):
    assert score(spark, size_gb=8192.0).category != "not_feasible"
    assert score(spark, workload=(100_000.0, 0.0, 5000.0, 0.0, 0.0, 0.0, 1, 4000, "x")).blocker_count == 0


def test_high_load(spark):
    r = score(spark, workload=(150_000.0, 0.0, 100.0, 0.0, 0.0, 0.0, 1, 1, "x"))
    assert r.s_performance == 0 and r.category == "not_feasible"


def test_replication(spark):
    r = score(spark, has_logical_replication=True)
    assert r.category == "needs_rearchitecture" and r.s_replication == 60 and r.effort_days == 10.0
    slots = score(spark, replication_slots=["a", "b"])
    assert slots.s_replication == 90 and slots.blocker_count == 2 and slots.effort_days == 9.0


def test_procedural(spark):
    many = score(spark, functions=[(f"f{i}", "plpgsql", 5) for i in range(51)])
    assert many.category == "needs_rearchitecture" and many.s_complexity == 60
    assert score(spark, functions=[("long", "plpgsql", 201)]).s_complexity == 60
    assert score(spark, functions=[("long", "sql", 900)]).s_complexity == 100


def test_event_triggers(spark):
    assert score(spark, event_trigger_count=2).category == "not_feasible"


def test_document_engines(spark):
    d = score(spark, source_engine="dynamodb", streams_enabled=True, pitr_enabled=False, regions=["a", "b"], billing_mode="provisioned", gsi_count=6)
    assert (d.s_extensions, d.s_complexity, d.s_replication, d.s_operational) == (25.0, 80.0, 55.0, 85.0)
    assert d.effort_days == 15 + 5 * 2 + 3 + 5 + 3 + 0.5 + 3.0
    c = score(spark, source_engine="cosmosdb-nosql", change_feed_mode="AllVersionsAndDeletes", multi_region_writes=True, regions=["a", "b"], consistency_level="Strong")
    assert (c.s_extensions, c.s_replication, c.s_operational) == (0.0, 65.0, 85.0)


@pytest.mark.parametrize("need,snapped", [(0.1, 0.5), (0.75, 0.5), (0.76, 1), (1.5, 1), (11, 10), (11.1, 12), (20, 16), (20.1, 24), (99, 32)])
def test_ladder(spark, need, snapped):
    assert spark.range(1).select(A.snap(F.lit(float(need))).alias("s")).first()["s"] == snapped


@pytest.mark.parametrize("units,connections", [(0.5, 104), (8, 1678), (8.4, 1678), (32, 4000)])
def test_connections(spark, units, connections):
    assert spark.range(1).select(A.connections_of(F.lit(float(units))).alias("c")).first()["c"] == connections


def test_target_cost(spark):
    fixed = db(spark, size_gb=100.0).withColumn("unit_min", F.lit(4.0)).withColumn("unit_max", F.lit(4.0))
    p, e = M.target_cost(fixed).first(), M.target_cost(fixed, "enterprise").first()
    assert p.target_compute == pytest.approx(1168.0) and p.target_storage == pytest.approx(2.30)
    assert e.target_compute == pytest.approx(1518.4) and p.target_total_1_year == pytest.approx(1170.3 * 0.75)
    with pytest.raises(ValueError):
        M.target_cost(fixed, "gold")


def test_source_cost(spark):
    r = M.source_cost(db(spark, size_gb=100.0)).first()
    assert r.source_compute == pytest.approx(0.519 * 730) and r.source_storage == pytest.approx(10.0)
    assert r.source_io == pytest.approx(0.20 * 500 * 2.592)
    other = M.source_cost(db(spark, region="mars")).first()
    assert other.source_compute == pytest.approx(0.519 * 730)
    unknown = M.source_cost(db(spark, source_engine="new-engine", region="mars")).first()
    assert unknown.source_compute == pytest.approx(0.519 * 730)
    cosmos = M.source_cost(
        db(spark, source_engine="cosmosdb-nosql", region="eastus", size_gb=10.0, throughput_mode="autoscale", request_units=1000, autoscale_max_units=4000, regions=["a", "b", "c"], backup_policy="continuous")
    ).first()
    assert cosmos.source_compute == pytest.approx(24 * 0.08 * 730 * 2.0) and cosmos.source_storage == pytest.approx(7.5) and cosmos.source_io == pytest.approx(2.0)


@pytest.mark.parametrize(
    "over,strategy",
    [({}, "bulk_dump_restore"), ({"engine_version": "13.9"}, "cross_engine"), ({"engine_version": ""}, "bulk_dump_restore"), ({"size_gb": 501.0}, "hybrid"),
     ({"workload": (1.0, 1.0, 101.0, 0.0, 0.0, 0.0, 1, 1, "x")}, "hybrid"), ({"source_engine": "dynamodb"}, "cross_engine"), ({"workload": None}, "bulk_dump_restore")],
)
def test_strategy(spark, over, strategy):
    assert A.strategy(db(spark, **over)).first()["strategy"] == strategy


def test_phases(spark):
    p = {r.phase_name: r.duration_days for r in A.phases(A.strategy(A.score(db(spark, size_gb=1000.0)))).collect()}
    assert p == {"schema": 2.0, "data": 12.0, "application": 5.0, "go_live": 5.0}


def test_capacity_workload(spark):
    w = A.workload_from_capacity(db(spark, workload=None, request_units=1000, table_count=3)).first()["workload"]
    assert (w.avg_qps, w.peak_qps, w.avg_tps, w.connection_count_avg, w.connection_count_peak) == (pytest.approx(700), pytest.approx(2100), pytest.approx(300), 24, 75)
    assert A.workload_from_capacity(db(spark, request_units=1000)).first()["workload"].source == "observed"
