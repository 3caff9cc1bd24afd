"""Profiles from flat catalog frames, worked out by hand."""

import pytest
from pyspark.sql.types import StructType

from opslens.operators import assessment, catalog

FRAMES = {
    "databases": ("db_id bigint, source_engine string, region string, engine_version string", [(1, "rds-postgresql", "us-east-1", "15.1"), (2, "rds-postgresql", None, None)]),
    "objects": (
        "db_id bigint, schema_name string, kind string, name string, size_bytes bigint",
        [(1, "app", "tables", "t", 3 << 30), (1, "app", "partitioned_tables", "p", 1 << 30), (1, None, "tables", "u", None), (1, "pg_catalog", "tables", "pg_class", 9 << 30),
         (1, "sales", "triggers", "g", None), (1, "app", "publications", "pub", None), (7, "app", "tables", "of no database", 1)],
    ),
    "extensions": ("db_id bigint, name string, version string", [(1, "vector", "0.7"), (1, "plpgsql", "1.0"), (1, "hstore", None)]),
    "functions": (
        "db_id bigint, schema_name string, name string, language string, source string",
        [(1, "app", "f", "plpgsql", "a\nb\nc"), (1, "app", "e", "sql", ""), (1, "app", "n", "sql", None), (1, "app", "i", "internal", "x"), (1, "pg_catalog", "s", "sql", "x")],
    ),
    "slots": ("db_id bigint, slot_name string, slot_type string", [(1, "s2", "physical"), (1, "s1", "physical")]),
    "event_triggers": ("db_id bigint, name string", [(1, "et")]),
    "attributes": (
        "db_id bigint, table_name string, column_name string, attnum bigint, attisdropped boolean, collname string",
        [(1, "t", "a", 1, False, "de_DE"), (1, "t", "b", 2, True, "de_DE"), (1, "t", "c", 3, False, "C"), (1, "t", "d", -1, False, "de_DE"), (1, "t", "e", 4, None, "fr_FR"), (1, "t", "f", 5, False, None)],
    ),
}


def frames(spark, **changed):
    return {n: spark.createDataFrame(changed.get(n, rows), ddl) for n, (ddl, rows) in FRAMES.items()}


def test_profile(spark):
    one, two = catalog.database_profiles(**frames(spark)).orderBy("db_id").collect()
    assert (one.table_count, one.size_gb, one.trigger_count, one.publication_count, one.materialized_view_count) == (3, 4.0, 1, 1, 0)
    assert [tuple(e) for e in one.extensions] == [("hstore", None), ("vector", "0.7")]
    assert [tuple(f) for f in one.functions] == [("e", "sql", 0), ("f", "plpgsql", 3), ("n", "sql", 0)]
    assert (one.replication_slots, one.has_logical_replication, one.event_trigger_count, one.event_triggers) == (["s1", "s2"], True, 1, ["et"])
    assert (one.non_default_collation_count, [c.column_name for c in one.collations]) == (2, ["a", "e"])
    assert (one.schemas, one.partitioned_tables, one.engine_version, one.workload) == (["app", "sales"], ["app.p"], "15.1", None)
    assert (two.table_count, two.size_gb, two.extensions, two.schemas, two.has_logical_replication, two.region) == (0, 0.0, [], [], False, None)


def test_profile_is_scored(spark):
    scored = {r.db_id: r for r in assessment.score(catalog.database_profiles(**frames(spark))).collect()}
    assert scored["1"].category == "not_feasible"  # an event trigger blocks
    assert scored["2"].s_performance == 75.0 and scored["2"].blocker_count == 0


@pytest.mark.parametrize("empty", ["objects", "functions", "attributes", "databases"])
def test_profile_of_nothing(spark, empty):
    got = catalog.database_profiles(**frames(spark, **{empty: []}))
    assert got.count() == (0 if empty == "databases" else 2)
    assert got.columns == [*StructType.fromDDL(assessment.PROFILE_DDL).names, *catalog.MORE]


def test_one_shuffle(spark):
    plan = catalog.database_profiles(**frames(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
