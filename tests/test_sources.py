"""Readers, writers, retention and archiving."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens import schemas
from opslens.operators import archive, sync
from opslens.sources import tables, tiered, views

NOW = datetime(2024, 6, 1)


def samples(spark, n=10):
    return spark.range(n).selectExpr(
        "cast(id AS STRING) AS metric_id", "concat('p', id % 2) AS project_id", "'b' AS branch_id", "concat('m', id % 3) AS metric_name",
        "cast(id AS DOUBLE) AS metric_value", "cast(date_sub(DATE '2024-06-01', cast(id * 20 AS INT)) AS TIMESTAMP) AS snapshot_timestamp",
    )


def test_every_table_has_a_time_column(spark):
    assert set(schemas.EVENT_TIME) == set(schemas.DDL)
    for table, ts in schemas.EVENT_TIME.items():
        assert schemas.schema_of(table)[ts].dataType.typeName() == "timestamp"
    assert len(schemas.schema_of("query_stats_history")) == 22


def test_registry_is_repeatable(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS ops_test")
    first = tables.create_ops_tables(spark, str(tmp_path), "ops_test")
    assert tables.create_ops_tables(spark, str(tmp_path), "ops_test") == first
    assert {r.tableName for r in spark.sql("SHOW TABLES IN ops_test").collect()} == set(schemas.DDL)
    spark.sql("DROP DATABASE ops_test CASCADE")


def test_append_and_read(spark, tmp_path):
    base = str(tmp_path)
    assert tables.append_counted(samples(spark), base, "metric_samples", "w1") == 10
    tables.append(samples(spark, 5), base, "metric_samples")
    back = tables.read_ops(spark, base, "metric_samples")
    assert back.columns != [] and back.count() == 15 and back.schema.names == schemas.schema_of("metric_samples").names
    assert back.where("threshold_level IS NULL").count() == 15
    plan = back.where("metric_name = 'm0'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric_name" in plan
    late = tables.read_ops(spark, base, "metric_samples", since=NOW - timedelta(days=40))
    assert 0 < late.count() < 15 and late.where(F.col("snapshot_timestamp") < F.lit(NOW - timedelta(days=40))).count() == 0
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(snapshot_timestamp)" in plan
    with pytest.raises(ValueError):
        tables.append(samples(spark).withColumn("extra", F.lit(1)), base, "metric_samples")


def test_archive_schema_may_grow(spark, tmp_path):
    path = str(tmp_path / "a")
    for _ in range(2):  # a repeated batch does not double its rows
        tables.write_archive(spark.range(3), path, "a")
    tables.write_archive(spark.range(2).withColumn("note", F.lit("x")), path, "b")
    back = tables.read_archive(spark, path)
    assert back.count() == 5 and back.where("note IS NULL").count() == 3


def test_retention_is_inclusive(spark):
    kept = tables.apply_retention(samples(spark), "snapshot_timestamp", 40, NOW)
    assert sorted(int(r.metric_id) for r in kept.collect()) == [0, 1, 2]


def test_retention_drops_empty_partitions(spark, tmp_path):
    base, target = str(tmp_path / "now"), str(tmp_path / "next")
    tables.append(samples(spark), base, "metric_samples")
    tables.write_retained(spark, base, "metric_samples", target, NOW)
    kept = tables.read_ops(spark, target, "metric_samples")
    assert sorted(int(r.metric_id) for r in kept.collect()) == [0, 1, 2, 3, 4]
    assert tables.read_ops(spark, base, "metric_samples").count() == 10
    assert tables.retention_days("vacuum_history") == 365


def test_expired_days_are_dropped(spark, tmp_path):
    base = str(tmp_path)
    tables.append(samples(spark), base, "metric_samples")
    want = {int(r.metric_id) for r in samples(spark).collect() if r.snapshot_timestamp.date() >= (NOW - timedelta(days=90)).date()}
    gone = tables.drop_expired(spark, base, "metric_samples", NOW)
    assert gone and all(d < (NOW - timedelta(days=90)).date() for d in gone)
    assert {int(r.metric_id) for r in tables.read_ops(spark, base, "metric_samples").collect()} == want
    assert tables.drop_expired(spark, base, "metric_samples", NOW) == []


@pytest.mark.parametrize("table", sorted(t for t in schemas.DDL if schemas.PARTITIONS[t] == [schemas.MONTH]))
def test_expired_months_are_dropped(spark, tmp_path, table):
    base, ts = str(tmp_path), schemas.EVENT_TIME[table]
    key = schemas.schema_of(table).names[0]
    times = [NOW - timedelta(days=d) for d in (0, 364, 365, 366, 395, 396, 397, 430)]
    rows = spark.createDataFrame([*((str(i), t) for i, t in enumerate(times)), ("none", None)], f"{key} string, {ts} timestamp")
    tables.append(rows, base, table)
    # the retention ends on 2 June 2023 (366 days behind a leap day), so May 2023 and before go
    limit = (NOW - timedelta(days=365)).date()
    want = {str(i) for i, t in enumerate(times) if (t.year, t.month) >= (limit.year, limit.month)} | {"none"}
    gone = tables.drop_expired(spark, base, table, NOW)
    assert gone and all(d.day == 1 and d < limit for d in gone)
    assert {r[0] for r in tables.read_ops(spark, base, table).select(key).collect()} == want
    assert tables.drop_expired(spark, base, table, NOW) == []
    late = tables.read_ops(spark, base, table, since=NOW - timedelta(days=364))
    assert {r[0] for r in late.select(key).collect()} == {"0", "1"}
    assert "PartitionFilters: [isnotnull(event_month" in late._jdf.queryExecution().executedPlan().toString()


def test_stamp(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "x" * 5000, None, None), (2, "y", 7, t)], "queryid bigint, query string, calls bigint, snapshot_timestamp timestamp")
    rows = {r.queryid: r for r in tables.stamp_snapshot(df, "p", "b", NOW).collect()}
    assert len(rows[1].query) == 5000 and rows[1].calls == 0 and rows[1].snapshot_timestamp == NOW
    assert rows[2].calls == 7 and rows[2].snapshot_timestamp == t and rows[1].snapshot_id != rows[2].snapshot_id
    again = {r.queryid: r.snapshot_id for r in tables.stamp_snapshot(df, "p", "b", NOW).collect()}
    assert again[1] == rows[1].snapshot_id


def test_sql_parameters(spark):
    df = spark.range(100)
    out = views.run_sql(spark, "SELECT id FROM {t} WHERE id > :floor ORDER BY id LIMIT :limit", {"floor": 10, "limit": 3}, t=df)
    assert [r.id for r in out.collect()] == [11, 12, 13]
    limits = {"limit": (1, 500), "hours": (1, 168)}
    for bad in ({"limit": 0}, {"limit": 501}, {"limit": "1; DROP TABLE t"}, {"hours": 169}):
        with pytest.raises(ValueError):
            views.run_sql(spark, "SELECT 1", bad, limits)
    assert views.run_sql(spark, "SELECT :limit AS n", {"limit": 501}).first().n == 501


def test_jdbc_options():
    o = views.pg_view_options("jdbc:postgresql://h/db", "SELECT 1 AS a", "u")
    assert o["query"] == "SELECT 1 AS a" and "dbtable" not in o
    s = views.pg_view_options("jdbc:postgresql://h/db", "SELECT id FROM t", "u", partitionColumn="id", lowerBound="0", upperBound="9", numPartitions="3")
    assert s["dbtable"] == "(SELECT id FROM t) AS v" and s["numPartitions"] == "3" and "query" not in s
    with pytest.raises(ValueError):
        views.pg_view_options("jdbc:postgresql://h/db", "SELECT 1", "u", partitionColumn="id")


def test_collection(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("a", '{"id": 1, "tag": "x"}'), ("a", '{"id": 2}'), ("b", '{"k": {"n": 1}}')], "c string, body string").select("body").write.text(path)
    docs = views.read_collection(spark, path)
    assert set(docs.columns) == {"id", "tag", "k"}
    assert views.read_collection(spark, path, "id BIGINT").columns == ["id"]


def test_archive_keeps_every_row(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(25_000).selectExpr("id", "timestampadd(HOUR, -id, TIMESTAMP '2024-06-01') AS ts", "CASE WHEN id % 9 = 0 THEN NULL ELSE id END AS v").write.parquet(src)
    moved = tiered.TieredTable(spark, str(tmp_path / "t"), "x", "ts")
    moved.append(spark.read.parquet(src), "all")
    assert moved.archive(NOW, 90)["rows_archived"] == 25_000 - 90 * 24 - 1 and moved.read("hot").count() == 90 * 24 + 1
    whole = archive.unified_view(moved.read("hot"), moved.read("cold")).drop("tier")
    assert sync.checksum(whole, ["id", "ts", "v"]).first() == sync.checksum(spark.read.parquet(src), ["id", "ts", "v"]).first()


def test_rows_without_time_stay_hot(spark):
    df = spark.createDataFrame([(1, None), (2, NOW - timedelta(days=91))], "id int, ts timestamp")
    hot, cold = archive.split_cold(df, "ts", NOW)
    assert [r.id for r in hot.collect()] == [1] and [r.id for r in cold.collect()] == [2]


def test_checksum_ignores_order_and_sees_one_cell(spark):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")))
    a = sync.checksum(df, ["id", "v"]).first()
    assert a == sync.checksum(df.orderBy(F.desc("id")).repartition(7), ["id", "v"]).first()
    changed = df.withColumn("v", F.when(F.col("id") == 500, 1).otherwise(F.col("v")))
    assert a["checksum"] != sync.checksum(changed, ["id", "v"]).first()["checksum"]


def test_reconcile_counts_copies(spark):
    s = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (5, "e")], "id int, v string")
    t = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d"), (5, "e")], "id int, v string")
    got = {r.id: (r.difference, r.source_only_rows, r.target_only_rows) for r in sync.reconcile_rows(s, t, ["id"], ["id", "v"]).collect()}
    assert got == {1: ("source_only", 1, 0), 2: ("changed", 1, 1), 3: ("source_only", 1, 0), 4: ("target_only", 0, 1)}


def test_completeness_status_order(spark):
    def side(n, ts):
        return spark.createDataFrame([("x", n, ts)], "pair string, n bigint, max_ts timestamp")

    def status(n, lag):
        return sync.completeness(side(5000, NOW), side(n, NOW - timedelta(seconds=lag)), "pair").first()["status"]

    assert status(4000, 0) == "healthy" and status(3999, 0) == "drift_detected"
    assert status(3999, 3601) == "stale" and status(4000, 3600) == "healthy"


def test_bucketed_tables_join_without_shuffle(spark, sf_dir):
    orders, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tables.save_bucketed(orders.withColumnRenamed("o_orderkey", "k"), "t_orders", ["k"], 4)
    tables.save_bucketed(lines.withColumnRenamed("l_orderkey", "k"), "t_lines", ["k"], 4)
    joined = spark.table("t_lines").hint("merge").join(spark.table("t_orders"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and joined.count() == lines.join(orders, lines.l_orderkey == orders.o_orderkey).count()
    spark.sql("DROP TABLE t_orders")
    spark.sql("DROP TABLE t_lines")


def test_collection_schema_merges(spark):
    docs = spark.createDataFrame([("a", '{"id": 1}'), ("a", '{"id": 2, "tag": "x"}'), ("b", '{"n": {"m": 1.5}}')], "c string, body string")
    got = {r.c: r.item_schema for r in views.collection_schema(docs, "c", "body").collect()}
    assert got == {"a": "OBJECT<id: BIGINT, tag: STRING>", "b": "OBJECT<n: OBJECT<m: DECIMAL(2,1)>>"}
