"""Queries on scans, projections, history analytics and ordered series."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opslens.functions.exprs import case, mean, safe_ratio
from opslens.operators import history as H
from opslens.operators import sketches as K
from opslens.operators import series as S
from opslens.plans.bind import METRICS, Bind
from opslens.plans.registry import as_instant, query, sql_cells
from opslens.sources import tables, views
from opslens.sources.workdir import new_folder

MEAN = "CAST(sum({0}) AS DOUBLE) / count({0})"


def _mean(col: str) -> str:
    return MEAN.format(col)


# ---- scans, sources, sinks ----------------------------------------------------------------------------------------


@query(
    "q_scan_snapshot",
    "newest query_stats",
    "SELECT sha256(" + sql_cells(
        "'p-main'", "'b-main'", "CAST(event_id AS VARCHAR)",
        "(strftime(CASE WHEN event_id % 5 = 0 THEN (SELECT t FROM newest) ELSE snapshot_timestamp END, '%Y-%m-%d %H:%M:%S.')"
        " || rtrim(strftime(CASE WHEN event_id % 5 = 0 THEN (SELECT t FROM newest) ELSE snapshot_timestamp END, '%f'), '0'))",
    ) + ") AS snapshot_id,"
    " 'p-main' AS project_id, 'b-main' AS branch_id, event_id, query, coalesce(CASE WHEN calls % 10 = 0 THEN NULL ELSE calls END, 0) AS calls,"
    " CASE WHEN event_id % 5 = 0 THEN (SELECT t FROM newest) ELSE snapshot_timestamp END AS snapshot_timestamp FROM query_stats",
)
def scan_snapshot(b: Bind):
    raw = b.query_stats().selectExpr(
        "event_id", "query", "CASE WHEN calls % 10 = 0 THEN NULL ELSE calls END AS calls",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(snapshot_timestamp AS TIMESTAMP) END AS snapshot_timestamp",
    )
    out = tables.stamp_snapshot(raw, "p-main", "b-main", b.now(), key="event_id")
    return out.withColumn("snapshot_timestamp", F.col("snapshot_timestamp").cast("timestamp_ntz"))


@query("q_scan_parquet", "", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'")
def scan_parquet(b: Bind):
    li = b.table("lineitem")
    return li.where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "q_scan_documents", "",
    "SELECT event_type AS container, count(*) AS items, CAST(sum(octet_length(encode(props))) AS BIGINT) AS total_bytes,"
    " CAST(sum(octet_length(encode(props))) AS DOUBLE) / count(props) AS avg_item_bytes, CAST(max(octet_length(encode(props))) AS BIGINT) AS max_item_bytes,"
    " count(DISTINCT user_id) AS partition_keys FROM events GROUP BY ALL",
)
def scan_documents(b: Bind):
    return views.profile_collections(b.events("event_type AS container", "props", "user_id"), "container", "props", "user_id")


@query(
    "q_scan_document_paths", "",
    "SELECT container, path, count(*) AS items FROM (SELECT event_type AS container, unnest(json_keys(props)) AS path FROM events) GROUP BY ALL",
)
def scan_document_paths(b: Bind):
    return views.collection_paths(b.events("event_type AS container", "props"), "container", "props")


@query(
    "q_scan_document_schema", "",
    "SELECT event_type AS container, replace(replace(json_group_structure(props::JSON)::VARCHAR, '{\"k\":\"UBIGINT\"}', 'OBJECT<k: BIGINT>'), '{\"k\":\"BIGINT\"}', 'OBJECT<k: BIGINT>') AS item_schema FROM events GROUP BY ALL",
)
def scan_document_schema(b: Bind):
    return views.collection_schema(b.events("event_type AS container", "props"), "container", "props")


@query(
    "q_scan_billing", "billing",
    "SELECT CAST(usage_date AS TIMESTAMP) AS usage_date, instance_id, CAST(sum(usage_quantity) AS DOUBLE) AS total_units FROM billing GROUP BY ALL",
)
def scan_billing(b: Bind):
    u = b.usage(placed=False).select("usage_date", F.col("usage_metadata.database_instance_id").alias("instance_id"), "usage_quantity")
    return as_instant(u.groupBy("usage_date", "instance_id").agg(F.sum("usage_quantity").cast("double").alias("total_units")), "usage_date")


def _stored_samples(b: Bind, name: str) -> str:
    """Samples as an operational table in a folder of its own; gives the folder."""
    base = new_folder(b.spark, name)
    rows = b.metric_samples().withColumns({"metric_id": F.col("event_id").cast("string"), "snapshot_timestamp": F.col("snapshot_timestamp").cast("timestamp")})
    tables.append(rows.select("metric_id", "project_id", "branch_id", "metric_name", "metric_value", "snapshot_timestamp"), base, "metric_samples")
    return base


def _samples_back(df):
    return df.select("metric_id", "project_id", "branch_id", "metric_name", "metric_value", F.col("snapshot_timestamp").cast("timestamp_ntz").alias("snapshot_timestamp"))


_STORED = "SELECT CAST(event_id AS VARCHAR) AS metric_id, project_id, branch_id, metric_name, CAST(metric_value AS DOUBLE) AS metric_value, snapshot_timestamp FROM metric_samples"


@query("q_sink_append", "metric_samples", _STORED)
def sink_append(b: Bind):
    return _samples_back(tables.read_ops(b.spark, _stored_samples(b, "append"), "metric_samples"))


@query("q_scan_ops_since", "newest metric_samples", _STORED + " WHERE snapshot_timestamp >= (SELECT t FROM newest) - INTERVAL 3 DAY")
def scan_ops_since(b: Bind):
    return _samples_back(tables.read_ops(b.spark, _stored_samples(b, "since"), "metric_samples", since=b.now() - timedelta(days=3)))


@query("q_sink_retention", "newest metric_samples", _STORED + " WHERE CAST(snapshot_timestamp AS DATE) >= CAST((SELECT t FROM newest) - INTERVAL 10 DAY AS DATE)")
def sink_retention(b: Bind):
    base = _stored_samples(b, "retention")
    tables.drop_expired(b.spark, base, "metric_samples", b.now() + timedelta(days=tables.retention_days("metric_samples") - 10))
    return _samples_back(tables.read_ops(b.spark, base, "metric_samples"))


@query(
    "q_sink_retention_months", "newest operations",
    "WITH o AS (SELECT CAST(operation_id AS VARCHAR) AS operation_id, table_name, executed_at - INTERVAL 30 DAY * CAST(operation_id % 12 AS INT) AS executed_at FROM operations)"
    " SELECT * FROM o WHERE date_trunc('month', executed_at) + INTERVAL 1 MONTH > CAST((SELECT t FROM newest) - INTERVAL 100 DAY AS DATE)",
)
def sink_retention_months(b: Bind):
    """Operations dealt over a year, of which the last 100 days, by whole months, are kept."""
    base = new_folder(b.spark, "months")
    back = F.timestamp_add("DAY", (F.col("operation_id") % 12 * -30).cast("int"), F.col("executed_at").cast("timestamp"))
    rows = b.operations().select(F.col("operation_id").cast("string").alias("operation_id"), "table_name", back.alias("executed_at"))
    tables.append(rows, base, "vacuum_history")
    tables.drop_expired(b.spark, base, "vacuum_history", b.now() + timedelta(days=tables.retention_days("vacuum_history") - 100))
    return tables.read_ops(b.spark, base, "vacuum_history").select("operation_id", "table_name", F.col("executed_at").cast("timestamp_ntz").alias("executed_at"))


@query("q_sink_archive", "", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders")
def sink_archive(b: Bind):
    """Written twice, the second time with a column more."""
    path, orders = new_folder(b.spark, "archive"), b.table("orders")
    tables.write_archive(orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_totalprice"), path, "odd")
    tables.write_archive(orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "even")
    return tables.read_archive(b.spark, path).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(
    "q_sink_write_audit", "operations",
    "SELECT table_name AS \"table\", count(*) AS writes, CAST(sum(dead_tuples_before) AS BIGINT) AS records FROM operations GROUP BY ALL",
)
def sink_write_audit(b: Bind):
    return tables.write_audit(b.operations().selectExpr("table_name AS table", "dead_tuples_before AS records"))


@query(
    "q_sql_params", "query_stats",
    "SELECT queryid, CAST(sum(calls) AS BIGINT) AS calls FROM query_stats WHERE calls > 50 GROUP BY queryid ORDER BY calls DESC, queryid LIMIT 25",
)
def sql_params(b: Bind):
    text = "SELECT queryid, sum(calls) AS calls FROM {stats} WHERE calls > :floor GROUP BY queryid ORDER BY calls DESC, queryid LIMIT :limit"
    return views.run_sql(b.spark, text, {"floor": 50, "limit": 25}, stats=b.query_stats())


# The columns that each given table must have, and names of columns that no table may have.
REQUIRED = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
RETIRED = "password ssn card_number".split()


def _table_check(table: str, columns: list[str]) -> str:
    """Check: the row of one table, its columns as the other engine lists them."""
    there = f"(SELECT column_name FROM duckdb_columns() WHERE table_name = '{table}')"
    missing = f"(SELECT coalesce(string_agg(c, ',' ORDER BY c), '') FROM unnest({columns}) AS u(c) WHERE c NOT IN {there})"
    stale = f"(SELECT coalesce(string_agg(c, ',' ORDER BY c), '') FROM unnest({RETIRED}) AS u(c) WHERE c IN {there})"
    return f"SELECT '{table}' AS table_name, count(*) AS \"rows\", {missing} AS missing_columns, {stale} AS stale_columns, count(*) >= 1 AND {missing} = '' AND {stale} = '' AS passed FROM {table}"


@query("q_dq_table_checks", "", " UNION ALL ".join(_table_check(t, c.split()) for t, c in REQUIRED.items()))
def dq_table_checks(b: Bind):
    from opslens.operators.status import check_tables

    return check_tables({t: b.table(t) for t in REQUIRED}, {}, {t: c.split() for t, c in REQUIRED.items()}, {t: RETIRED for t in REQUIRED})


@query("q_dq_group_counts", "recommendations", "SELECT recommendation_type, count(*) AS n FROM recommendations GROUP BY ALL")
def dq_group_counts(b: Bind):
    return H.value_counts(b.recommendations(), "recommendation_type")


# ---- projections, filters ------------------------------------------------------------------------------------------


@query(
    "q_flt_window", "newest query_stats",
    "SELECT event_id, queryid, snapshot_timestamp FROM query_stats WHERE snapshot_timestamp > (SELECT t FROM newest) - INTERVAL 24 HOUR",
)
def flt_window(b: Bind):
    return H.since(b.query_stats(), "snapshot_timestamp", b.now(), hours=24).select("event_id", "queryid", "snapshot_timestamp")


@query(
    "q_flt_between", "newest query_stats",
    "SELECT event_id, queryid FROM query_stats WHERE snapshot_timestamp BETWEEN (SELECT t FROM newest) - INTERVAL 25 HOUR AND (SELECT t FROM newest) - INTERVAL 1 HOUR",
)
def flt_between(b: Bind):
    rows = H.between(b.query_stats(), "snapshot_timestamp", b.now(), timedelta(hours=25), timedelta(hours=1))
    return rows.select("event_id", "queryid")


@query(
    "q_flt_allowlist", "metric_samples",
    "SELECT event_id, metric_name FROM metric_samples WHERE metric_name IN ('cache_hit_ratio', 'txid_age')",
)
def flt_allowlist(b: Bind):
    return H.only_metrics(b.metric_samples(), ["cache_hit_ratio", "txid_age"]).select("event_id", "metric_name")


@query(
    "q_flt_exclude_flags", "index_stats",
    "SELECT indexrelid, index_name FROM index_stats WHERE NOT indisunique AND NOT indisprimary",
)
def flt_exclude_flags(b: Bind):
    return b.index_stats().where(~F.col("indisunique") & ~F.col("indisprimary")).select("indexrelid", "index_name")


@query(
    "q_flt_system_schemas", "classes namespaces",
    "SELECT c.oid, c.relname, n.nspname FROM classes c JOIN namespaces n ON n.oid = c.relnamespace"
    " WHERE n.nspname NOT IN ('pg_catalog', 'information_schema', 'pg_toast') AND c.relkind IN ('r', 'p')",
)
def flt_system_schemas(b: Bind):
    from opslens.operators.findings import user_tables
    from opslens.rules import SYSTEM_SCHEMAS

    return user_tables(b.classes(), b.namespaces(), SYSTEM_SCHEMAS).select("oid", "relname", "nspname")


@query(
    "q_flt_regex", "query_stats",
    "SELECT CASE WHEN regexp_matches(query, '(?i)^(SELECT|WITH)') THEN 'read' WHEN regexp_matches(query, '(?i)^(INSERT|UPDATE|DELETE)') THEN 'write'"
    " ELSE 'other' END AS kind, count(*) AS statements, CAST(sum(calls) AS BIGINT) AS calls FROM query_stats GROUP BY ALL",
)
def flt_regex(b: Bind):
    return b.query_stats().groupBy(H.statement_class(F.col("query")).alias("kind")).agg(
        F.count("*").alias("statements"), F.sum("calls").alias("calls")
    )


@query(
    "q_prj_case", "query_stats",
    "SELECT event_id, CASE WHEN mean_exec_time > 200 THEN 'REGRESSION' WHEN mean_exec_time > 150 THEN 'WARNING' ELSE 'STABLE' END AS status FROM query_stats",
)
def prj_case(b: Bind):
    m = F.col("mean_exec_time")
    return b.query_stats().select("event_id", case((m > 200, "REGRESSION"), (m > 150, "WARNING"), default="STABLE").alias("status"))


@query(
    "q_prj_null_safe_ratio", "query_stats",
    "SELECT event_id, CAST(shared_blks_hit AS DOUBLE) / nullif(CAST(calls AS DOUBLE), 0) AS hits_per_call,"
    " coalesce(CAST(shared_blks_hit AS DOUBLE) / nullif(CAST(calls AS DOUBLE), 0), 1.0) AS hits_or_one FROM query_stats",
)
def prj_null_safe_ratio(b: Bind):
    hit, calls = F.col("shared_blks_hit"), F.col("calls")
    return b.query_stats().select("event_id", safe_ratio(hit, calls).alias("hits_per_call"), safe_ratio(hit, calls, 1.0).alias("hits_or_one"))


@query("q_prj_nested", "billing", "SELECT instance_id, CAST(rate AS DOUBLE) AS rate, count(*) AS n FROM billing GROUP BY ALL")
def prj_nested(b: Bind):
    u = b.usage(placed=False).select(F.col("usage_metadata.database_instance_id").alias("instance_id"), F.col("rate").cast("double").alias("rate"))
    return u.groupBy("instance_id", "rate").agg(F.count("*").alias("n"))


@query(
    "q_prj_unpivot", "table_stats",
    "SELECT project_id, branch_id, relname, metric_name, metric_value FROM (SELECT project_id, branch_id, relname, CAST(n_live_tup AS DOUBLE) AS n_live_tup,"
    " CAST(n_dead_tup AS DOUBLE) AS n_dead_tup, CAST(seq_scan AS DOUBLE) AS seq_scan FROM table_stats)"
    " UNPIVOT (metric_value FOR metric_name IN (n_live_tup, n_dead_tup, seq_scan))",
)
def prj_unpivot(b: Bind):
    ids = ["project_id", "branch_id", "relname"]
    wide = b.table_stats().select(*ids, "n_live_tup", "n_dead_tup", "seq_scan", "last_autovacuum")
    return H.unpivot_metrics(wide, ids)


KPI = {"cache_hit_ratio": 0.99, "connection_utilization": 0.0, "max_dead_tuple_ratio": 0.0, "replication_lag_seconds": 0.0}


@query(
    "q_prj_lookup_pivot", "metric_samples",
    "SELECT project_id, branch_id, "
    + ", ".join(
        f"coalesce(CAST(max_by(metric_value, snapshot_timestamp) FILTER (metric_name = '{n}') AS DOUBLE), {d}) AS {n}" for n, d in KPI.items()
    )
    + " FROM metric_samples WHERE metric_name IN (" + ", ".join(f"'{n}'" for n in KPI) + ") GROUP BY ALL",
)
def prj_lookup_pivot(b: Bind):
    return H.kpi_row(b.metric_samples(), ["project_id", "branch_id"], KPI)


@query("q_flt_tenant_rows", "", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def flt_tenant_rows(b: Bind):
    return H.tenant_view(b.table("customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name", "c_mktsegment")


# ---- aggregates ----------------------------------------------------------------------------------------------------


@query(
    "q_agg_top_slow", "newest query_stats",
    f"SELECT query, queryid, CAST(sum(calls) AS BIGINT) AS total_calls, {_mean('mean_exec_time')} AS avg_exec_time_ms,"
    " CAST(sum(total_exec_time) AS DOUBLE) AS total_time_ms, CAST(sum(\"rows\") AS BIGINT) AS total_rows,"
    " CAST(sum(shared_blks_read) AS DOUBLE) * 8.0 / 1024 AS total_read_mb, max(snapshot_timestamp) AS last_seen FROM query_stats"
    " WHERE snapshot_timestamp > (SELECT t FROM newest) - INTERVAL 24 HOUR GROUP BY query, queryid ORDER BY total_time_ms DESC, queryid, query LIMIT 10",
)
def agg_top_slow(b: Bind):
    return H.top_slow(b.query_stats(), b.now())


@query(
    "q_join_regression", "newest query_stats",
    f"WITH recent AS (SELECT queryid, {_mean('mean_exec_time')} AS r FROM query_stats WHERE snapshot_timestamp > (SELECT t FROM newest) - INTERVAL 72 HOUR GROUP BY 1),"
    f" baseline AS (SELECT queryid, {_mean('mean_exec_time')} AS b FROM query_stats WHERE snapshot_timestamp BETWEEN (SELECT t FROM newest) - INTERVAL 480 HOUR"
    " AND (SELECT t FROM newest) - INTERVAL 24 HOUR GROUP BY 1)"
    " SELECT queryid, b AS baseline_ms, r AS recent_ms, (r - b) / b * 100 AS pct_change,"
    " CASE WHEN r > b * 2 THEN 'REGRESSION' WHEN r > b * 1.5 THEN 'WARNING' ELSE 'STABLE' END AS status FROM recent JOIN baseline USING (queryid) WHERE b > 0",
)
def join_regression(b: Bind):
    return H.regression(
        b.query_stats(), b.now(), timedelta(hours=72), (timedelta(hours=480), timedelta(hours=24)), limit=None
    )


@query(
    "q_regression_top", "newest query_stats",
    f"WITH recent AS (SELECT queryid, {_mean('mean_exec_time')} AS r FROM query_stats WHERE snapshot_timestamp > (SELECT t FROM newest) - INTERVAL 2 HOUR GROUP BY 1),"
    f" baseline AS (SELECT queryid, {_mean('mean_exec_time')} AS b FROM query_stats WHERE snapshot_timestamp BETWEEN (SELECT t FROM newest) - INTERVAL 25 HOUR"
    " AND (SELECT t FROM newest) - INTERVAL 1 HOUR GROUP BY 1)"
    " SELECT queryid, b AS baseline_ms, r AS recent_ms, (r - b) / b * 100 AS pct_change,"
    " CASE WHEN r > b * 2 THEN 'REGRESSION' WHEN r > b * 1.5 THEN 'WARNING' ELSE 'STABLE' END AS status FROM recent JOIN baseline USING (queryid)"
    " WHERE b > 0 ORDER BY pct_change DESC, queryid LIMIT 20",
)
def regression_top(b: Bind):
    return H.regression(b.query_stats(), b.now())


@query(
    "q_agg_hourly_trend", "newest metric_samples",
    f"SELECT metric_name, date_trunc('hour', snapshot_timestamp) AS hour, {_mean('metric_value')} AS avg_value, CAST(min(metric_value) AS DOUBLE) AS min_value,"
    " CAST(max(metric_value) AS DOUBLE) AS max_value FROM metric_samples WHERE snapshot_timestamp > (SELECT t FROM newest) - INTERVAL 720 HOUR GROUP BY ALL",
)
def agg_hourly_trend(b: Bind):
    return H.hourly_trend(b.metric_samples(), b.now(), hours=720)


@query(
    "q_agg_hourly_trend_named", "newest metric_samples",
    f"SELECT metric_name, date_trunc('hour', snapshot_timestamp) AS hour, {_mean('metric_value')} AS avg_value, CAST(min(metric_value) AS DOUBLE) AS min_value,"
    " CAST(max(metric_value) AS DOUBLE) AS max_value FROM metric_samples WHERE snapshot_timestamp > (SELECT t FROM newest) - INTERVAL 24 HOUR"
    " AND metric_name IN ('cache_hit_ratio', 'connection_utilization', 'max_dead_tuple_ratio') GROUP BY ALL",
)
def agg_hourly_trend_named(b: Bind):
    return H.hourly_trend(b.metric_samples(), b.now(), 24, ["cache_hit_ratio", "connection_utilization", "max_dead_tuple_ratio"])


@query(
    "q_agg_sync_trend", "newest sync_checks",
    f"SELECT source_table, date_trunc('hour', validated_at) AS hour, {_mean('freshness_lag_seconds')} AS avg_lag_seconds,"
    f" CAST(max(freshness_lag_seconds) AS DOUBLE) AS max_lag_seconds, {_mean('count_drift')} AS avg_count_drift FROM sync_checks"
    " WHERE validated_at > (SELECT t FROM newest) - INTERVAL 24 HOUR GROUP BY ALL",
)
def agg_sync_trend(b: Bind):
    return H.sync_trend(b.sync_checks(), b.now())


_READ = "CASE WHEN regexp_matches(query, '(?i)^(SELECT|WITH)') THEN calls ELSE 0 END"
_WRITE = "CASE WHEN regexp_matches(query, '(?i)^(INSERT|UPDATE|DELETE)') THEN calls ELSE 0 END"


@query(
    "q_agg_workload_profile", "query_stats",
    "WITH r AS (SELECT project_id, CAST(mean_exec_time AS DOUBLE) AS v, row_number() OVER (PARTITION BY project_id ORDER BY mean_exec_time) - 1 AS i, CAST(0.99 AS DOUBLE) * (count(*) OVER (PARTITION BY project_id) - 1) AS k FROM query_stats),"
    " p AS (SELECT project_id, max(v) FILTER (i = floor(k)) AS lo, max(v) FILTER (i = ceil(k)) AS hi, max(k) AS k FROM r GROUP BY 1)"
    " SELECT project_id, count(DISTINCT queryid) AS total_queries, CAST(sum(calls) AS BIGINT) AS total_calls, CAST(max(calls) AS DOUBLE) AS peak_qps,"
    f" CAST(sum({_READ}) AS DOUBLE) / nullif(CAST(sum(calls) AS DOUBLE), 0) * 100 AS reads_pct, CAST(sum({_WRITE}) AS DOUBLE) / nullif(CAST(sum(calls) AS DOUBLE), 0) * 100 AS writes_pct,"
    f" CAST(sum(calls) AS DOUBLE) / 2592000.0 AS avg_qps, CAST(sum({_WRITE}) AS DOUBLE) / 2592000.0 AS avg_tps,"
    " max(lo + (hi - lo) * (k - floor(k))) AS p99_latency_ms FROM query_stats JOIN p USING (project_id) GROUP BY project_id",
)
def agg_workload_profile(b: Bind):
    return H.workload_profile(b.query_stats(), ["project_id"], 2_592_000.0)


@query(
    "q_agg_distinct", "query_stats",
    "SELECT project_id, count(DISTINCT branch_id) AS branches, count(DISTINCT query) AS queries FROM query_stats GROUP BY ALL",
)
def agg_distinct(b: Bind):
    return H.distinct_counts(b.query_stats(), ["project_id"], {"branch_id": "branches", "query": "queries"})


@query("q_agg_distinct_regions", "fleet", "SELECT DISTINCT source_engine, region FROM fleet")
def agg_distinct_regions(b: Bind):
    return b.fleet().select("source_engine", "region").distinct()


@query(
    "q_agg_partial_final", "metric_samples",
    f"SELECT project_id, metric_name, date_trunc('day', snapshot_timestamp) AS day, count(*) AS n, CAST(sum(metric_value) AS DOUBLE) / count(metric_value) AS avg_value,"
    " CAST(min(metric_value) AS DOUBLE) AS min_value, CAST(max(metric_value) AS DOUBLE) AS max_value FROM metric_samples GROUP BY ALL",
)
def agg_partial_final(b: Bind):
    five = H.rollup_samples(b.metric_samples(), 300)
    hour = H.merge_rollup(five, ["project_id", "branch_id", "metric_name"], F.date_trunc("hour", F.col("slot")))
    day = H.merge_rollup(hour, ["project_id", "metric_name"], F.date_trunc("day", F.col("slot")).cast("timestamp_ntz"), "day")
    return H.finish_rollup(day)


@query(
    "q_agg_sketch_rollup", "query_stats",
    "SELECT project_id, date_trunc('day', snapshot_timestamp) AS slot, count(*) AS n, count(DISTINCT queryid) AS queries, true AS queries_within, true AS p99_within FROM query_stats GROUP BY ALL",
)
def agg_sketch_rollup(b: Bind):
    """Five minutes to hours to days by merging sketches; whether the answers are within their bounds of the exact ones."""
    keys, day = ["project_id"], F.date_trunc("day", F.col("slot")).cast("timestamp_ntz")
    rows = b.query_stats()
    five = K.rollup(rows, [*keys, "branch_id"], "snapshot_timestamp", 300, ["queryid"], ["mean_exec_time"])
    hour = K.merge(five, keys, F.date_trunc("hour", F.col("slot")).cast("timestamp_ntz"), ["queryid"], ["mean_exec_time"])
    answers = K.finish(K.merge(hour, keys, day, ["queryid"], ["mean_exec_time"]), keys, ["queryid"], {"mean_exec_time": [0.99]})
    at, p99 = F.date_trunc("day", "snapshot_timestamp").cast("timestamp_ntz"), F.col("mean_exec_time_p99")
    exact = rows.withColumn("slot", at).join(answers, [*keys, "slot"]).groupBy(*keys, "slot", "n", "queryid_distinct").agg(
        F.count_distinct("queryid").alias("queries"), F.avg((F.col("mean_exec_time") < p99).cast("int")).alias("below"), F.avg((F.col("mean_exec_time") <= p99).cast("int")).alias("upto")
    )
    within = F.abs(F.col("queryid_distinct") - F.col("queries")) <= F.greatest(F.lit(1.0), 0.07 * F.col("queries"))
    return exact.select(*keys, "slot", "n", "queries", within.alias("queries_within"), ((F.col("below") - 0.01 <= 0.99) & (F.col("upto") + 0.01 >= 0.99)).alias("p99_within"))


@query(
    "q_agg_io", "query_stats",
    "SELECT project_id, CAST(sum(shared_blks_read) AS BIGINT) AS total_reads, CAST(sum(shared_blks_hit) AS BIGINT) AS total_hits,"
    " CAST(sum(total_exec_time) AS DOUBLE) AS total_time_ms FROM query_stats GROUP BY ALL",
)
def agg_io(b: Bind):
    return b.query_stats().groupBy("project_id").agg(
        F.sum("shared_blks_read").alias("total_reads"), F.sum("shared_blks_hit").alias("total_hits"),
        F.sum("total_exec_time").cast("double").alias("total_time_ms"),
    )


@query(
    "q_agg_max_scalar", "table_stats query_stats",
    "SELECT (SELECT max(n_live_tup) FROM table_stats) AS max_live, (SELECT count(*) FROM query_stats WHERE calls < 10) AS waiting",
)
def agg_max_scalar(b: Bind):
    live = b.table_stats().agg(F.max("n_live_tup").alias("max_live")).withColumn("waiting", F.lit(None).cast("bigint"))
    waiting = b.query_stats().agg(F.count_if(F.col("calls") < 10).alias("waiting")).withColumn("max_live", F.lit(None).cast("bigint"))
    return live.unionByName(waiting).agg(F.max("max_live").alias("max_live"), F.max("waiting").alias("waiting"))


# ---- joins on latest rows, windows, ordering ----------------------------------------------------------------------


@query(
    "q_join_latest_correlated", "metric_samples",
    "SELECT project_id, branch_id, metric_name, CAST(metric_value AS DOUBLE) AS metric_value, snapshot_timestamp FROM metric_samples m"
    " WHERE snapshot_timestamp = (SELECT max(snapshot_timestamp) FROM metric_samples m2 WHERE m2.project_id = m.project_id AND m2.branch_id = m.branch_id"
    " AND m2.metric_name = m.metric_name)",
)
def join_latest_correlated(b: Bind):
    rows = b.metric_samples().select("project_id", "branch_id", "metric_name", F.col("metric_value").cast("double").alias("metric_value"), "snapshot_timestamp")
    return H.latest_per_key(rows, ["project_id", "branch_id", "metric_name"], "snapshot_timestamp")


@query(
    "q_win_latest", "",
    "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def win_latest(b: Bind):
    rows = b.table("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return H.latest_per_key(rows, ["o_custkey"], "o_orderdate", "one", ["o_orderkey"])


@query(
    "q_win_latest_ties", "",
    "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)",
)
def win_latest_ties(b: Bind):
    return H.latest_per_key(b.table("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


@query(
    "q_win_topk_per_key", "query_stats",
    "SELECT project_id, event_id, CAST(total_exec_time AS DOUBLE) AS total_exec_time, CAST(row_number() OVER (PARTITION BY project_id ORDER BY total_exec_time DESC, event_id) AS INTEGER) AS \"rank\""
    " FROM query_stats QUALIFY \"rank\" <= 5",
)
def win_topk_per_key(b: Bind):
    rows = H.top_k_per_key(b.query_stats(), ["project_id"], [F.desc("total_exec_time"), F.col("event_id")], 5)
    return rows.select("project_id", "event_id", F.col("total_exec_time").cast("double").alias("total_exec_time"), "rank")


@query(
    "q_win_keep_last_n", "operations",
    "SELECT project_id, operation_id, executed_at, CAST(row_number() OVER (PARTITION BY project_id ORDER BY executed_at DESC, operation_id DESC) AS INTEGER) AS place FROM operations QUALIFY place <= 50",
)
def win_keep_last_n(b: Bind):
    return H.keep_last_n(b.operations().select("project_id", "operation_id", "executed_at"), ["project_id"], "executed_at", 50, ["operation_id"])


@query(
    "q_win_counter_delta", "query_stats",
    "SELECT event_id, queryid, calls, CASE WHEN prev IS NULL THEN NULL WHEN calls < prev THEN calls ELSE calls - prev END AS delta FROM (SELECT event_id, queryid, calls,"
    " lag(calls) OVER (PARTITION BY queryid ORDER BY snapshot_timestamp, event_id) AS prev FROM query_stats)",
)
def win_counter_delta(b: Bind):
    rows = b.query_stats().select("event_id", "queryid", "calls", "snapshot_timestamp")
    return S.counter_delta(rows, ["queryid"], "snapshot_timestamp", ["event_id"], "calls").drop("snapshot_timestamp")


@query(
    "q_win_rolling_stats", "metric_samples",
    "WITH r AS (SELECT event_id, metric_name, CAST(metric_value AS DOUBLE) AS metric_value, avg(CAST(metric_value AS DOUBLE)) OVER w AS m, CASE WHEN count(metric_value) OVER w > 1 THEN"
    " stddev_samp(CAST(metric_value AS DOUBLE)) OVER w END AS d FROM metric_samples WINDOW w AS (PARTITION BY metric_name ORDER BY snapshot_timestamp, event_id"
    " ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT event_id, metric_name, metric_value, CAST(m AS FLOAT)::DOUBLE AS roll_mean, CAST(d AS FLOAT)::DOUBLE AS roll_std,"
    " CAST((metric_value - m) / nullif(d, 0) AS FLOAT)::DOUBLE AS z_score, coalesce(abs((metric_value - m) / nullif(d, 0)) > 3.0, false) AS is_anomaly FROM r",
)
def win_rolling_stats(b: Bind):
    rows = b.metric_samples().select("event_id", "metric_name", "metric_value", "snapshot_timestamp")
    out = S.rolling_stats(rows, ["metric_name"], "snapshot_timestamp", ["event_id"], "metric_value")
    # seven digits: the last ones depend on the order of a sum, which other engines choose in their own way
    rounded = {c: F.col(c).cast("float").cast("double") for c in ("roll_mean", "roll_std", "z_score")}
    return out.drop("snapshot_timestamp").withColumns({"metric_value": F.col("metric_value").cast("double"), **rounded})


@query(
    "q_win_rolling_seconds", "metric_samples",
    "WITH s AS (SELECT metric_name, CAST(floor(epoch_us(snapshot_timestamp) / 60000000) AS BIGINT) * 60 AS e, count(metric_value) AS n, sum(metric_value) AS v FROM metric_samples GROUP BY ALL)"
    " SELECT metric_name, make_timestamp(e * 1000000) AS slot, CAST(sum(n) OVER w AS BIGINT) AS rows_in_range, CAST(sum(v) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS mean_in_range FROM s"
    " WINDOW w AS (PARTITION BY metric_name ORDER BY e RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)",
)
def win_rolling_seconds(b: Bind):
    return S.rolling_seconds(b.metric_samples(), ["metric_name"], "snapshot_timestamp", "metric_value")


@query(
    "q_win_rolling_range", "metric_samples",
    "WITH r AS (SELECT event_id, metric_name, CAST(metric_value AS DOUBLE) AS metric_value, count(metric_value) OVER w AS n, avg(CAST(metric_value AS DOUBLE)) OVER w AS m,"
    " CASE WHEN count(metric_value) OVER w > 1 THEN stddev_samp(CAST(metric_value AS DOUBLE)) OVER w END AS d FROM metric_samples"
    " WINDOW w AS (PARTITION BY metric_name ORDER BY epoch_us(snapshot_timestamp) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING))"
    " SELECT event_id, metric_name, metric_value, n AS rows_in_range, CAST(m AS FLOAT)::DOUBLE AS range_mean, CAST(d AS FLOAT)::DOUBLE AS range_std,"
    " round((metric_value - m) / nullif(d, 0), 6) + 0.0 AS z_score, coalesce(abs((metric_value - m) / nullif(d, 0)) > 3.0, false) AS is_anomaly FROM r",
)
def win_rolling_range(b: Bind):
    rows = b.metric_samples().select("event_id", "metric_name", "metric_value", "snapshot_timestamp")
    out = S.rolling_range(rows, ["metric_name"], "snapshot_timestamp", "metric_value", seconds=86_400, parts=48)
    rounded = {c: F.col(c).cast("float").cast("double") for c in ("range_mean", "range_std")}
    # a value equal to its mean is as far from it as the last digits of a sum
    rounded["z_score"] = F.round("z_score", 6) + F.lit(0.0)
    return out.drop("snapshot_timestamp").withColumns({"metric_value": F.col("metric_value").cast("double"), **rounded})


_GAPS = (
    "WITH g AS (SELECT user_id, event_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS us FROM events)"
)


@query("q_win_idle_gaps", "", _GAPS + " SELECT user_id, event_id, us / 1e6 AS gap_seconds FROM g")
def win_idle_gaps(b: Bind):
    return S.idle_gaps(b.events("user_id", "event_id", "ts"), ["user_id"], "ts", ["event_id"]).drop("ts")


@query(
    "q_win_idle_timeout", "",
    _GAPS + ", r AS (SELECT user_id, us, us / 1e6 AS v, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS i,"
    " CAST(0.95 AS DOUBLE) * (count(*) OVER (PARTITION BY user_id) - 1) AS k FROM g WHERE us IS NOT NULL),"
    " p AS (SELECT user_id, count(*) AS gaps, CAST(sum(us) AS DOUBLE) / count(*) / 1e6 AS avg_gap_seconds, max(v) AS max_gap_seconds,"
    " max(v) FILTER (i = floor(k)) AS lo, max(v) FILTER (i = ceil(k)) AS hi, max(k) AS k FROM r GROUP BY user_id),"
    " q AS (SELECT *, lo + (hi - lo) * (k - floor(k)) AS gap_percentile FROM p)"
    " SELECT user_id, gaps, avg_gap_seconds, max_gap_seconds, gap_percentile, CAST(greatest(5, ceil(gap_percentile / 60)) AS BIGINT) AS timeout_minutes FROM q",
)
def win_idle_timeout(b: Bind):
    return S.idle_timeout(b.events("user_id", "event_id", "ts"), ["user_id"], "ts", ["event_id"])


@query(
    "q_win_period_delta", "metric_samples",
    f"WITH p AS (SELECT metric_name, date_trunc('week', snapshot_timestamp) AS period, {_mean('metric_value')} AS v FROM metric_samples GROUP BY ALL),"
    " d AS (SELECT metric_name, period, v AS current_value, lag(v) OVER (PARTITION BY metric_name ORDER BY period) AS previous_value FROM p)"
    " SELECT *, (current_value - previous_value) / nullif(previous_value, 0) * 100 AS pct_change, CASE WHEN current_value - previous_value > 0 THEN 'up'"
    " WHEN current_value - previous_value < 0 THEN 'down' ELSE 'flat' END AS direction FROM d WHERE previous_value IS NOT NULL",
)
def win_period_delta(b: Bind):
    period = F.date_trunc("week", F.col("snapshot_timestamp")).cast("timestamp_ntz")
    per = b.metric_samples().groupBy("metric_name", period.alias("period")).agg(mean(F.col("metric_value")).alias("v"))
    return S.period_delta(per, ["metric_name"], "period", "v")


@query(
    "q_ord_topk", "",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def ord_topk(b: Bind):
    return b.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(
    "q_ord_nulls", "slots",
    "SELECT slot_name, confirmed_flush_lsn FROM slots ORDER BY confirmed_flush_lsn ASC NULLS FIRST, slot_name DESC",
)
def ord_nulls(b: Bind):
    return b.slots().select("slot_name", "confirmed_flush_lsn").orderBy(F.asc_nulls_first("confirmed_flush_lsn"), F.desc("slot_name"))


@query(
    "q_ord_expr", "table_stats",
    "SELECT relname, n_tup_ins + n_tup_upd + n_tup_del AS writes, greatest(n_live_tup, n_dead_tup) AS most FROM table_stats"
    " ORDER BY n_tup_ins + n_tup_upd + n_tup_del DESC, greatest(n_live_tup, n_dead_tup) DESC, relname LIMIT 10",
)
def ord_expr(b: Bind):
    writes, most = F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del"), F.greatest("n_live_tup", "n_dead_tup")
    return b.table_stats().select("relname", writes.alias("writes"), most.alias("most")).orderBy(F.desc("writes"), F.desc("most"), "relname").limit(10)


@query("q_ord_page", "", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def ord_page(b: Bind):
    return H.page(b.events("event_id", "ts"), [F.desc("ts"), F.col("event_id")], 50, 100)


@query(
    "q_slow_statements", "query_stats",
    "SELECT event_id, queryid, CAST(mean_exec_time AS DOUBLE) AS mean_exec_time, CAST(total_exec_time AS DOUBLE) AS total_exec_time FROM query_stats WHERE mean_exec_time > 100"
    " ORDER BY query_stats.total_exec_time DESC, queryid, snapshot_timestamp LIMIT 10",
)
def slow_statements(b: Bind):
    return H.slow_statements(b.query_stats(), 100.0).select(
        "event_id", "queryid", F.col("mean_exec_time").cast("double").alias("mean_exec_time"), F.col("total_exec_time").cast("double").alias("total_exec_time")
    )


@query(
    "q_profile_top_queries", "query_stats",
    "SELECT event_id, query, calls, CAST(mean_exec_time AS DOUBLE) AS mean_ms FROM query_stats ORDER BY total_exec_time DESC, event_id LIMIT 10",
)
def profile_top_queries(b: Bind):
    top = b.query_stats().orderBy(F.desc("total_exec_time"), "event_id").limit(10)
    return top.select("event_id", "query", "calls", F.col("mean_exec_time").cast("double").alias("mean_ms"))


@query(
    "q_stats_eviction", "newest",
    "SELECT 'p' || (user_id % 5) AS project_id, 'b' || user_id AS branch_id, count(*) FILTER (event_type = 'error') AS dealloc, min(ts) AS stats_reset,"
    " count(*) FILTER (event_type = 'error') > 0 AS evicting, (epoch_us((SELECT t FROM newest)) - epoch_us(min(ts))) / 1e6 AS counter_age_seconds FROM events GROUP BY user_id",
)
def stats_eviction(b: Bind):
    info = b.table("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("dealloc"), F.min("ts").alias("stats_reset"))
    info = info.selectExpr("concat('p', user_id % 5) AS project_id", "concat('b', user_id) AS branch_id", "dealloc", "stats_reset")
    return H.stats_eviction(info, b.now())


@query(
    "q_capacity_forecast", "",
    "WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), f AS (SELECT l_suppkey, count(*) AS days, max(v) AS peak,"
    " max(datediff('day', DATE '2000-01-01', day)) AS x1, regr_slope(v, datediff('day', DATE '2000-01-01', day)) AS g, regr_intercept(v, datediff('day', DATE '2000-01-01', day)) AS b FROM d GROUP BY 1)"
    " SELECT l_suppkey, days, peak, round(g, 6) AS growth_per_day, round(b + g * x1 + g * 30, 6) AS projected,"
    " round((60.0 - peak) / 60.0 * 100, 6) AS headroom_pct, round(CASE WHEN g > 0 THEN greatest(0.0, (60.0 - (b + g * x1)) / g) END, 2) AS days_to_threshold FROM f",
)
def capacity_forecast(b: Bind):
    daily = b.table("lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("v"))
    out = S.capacity_forecast(daily, ["l_suppkey"], "day", "v", 60.0)
    digits = {"growth_per_day": 6, "projected": 6, "headroom_pct": 6, "days_to_threshold": 2}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


_CORR = [METRICS[0], METRICS[1], METRICS[2], METRICS[7]]
_PAIRS = [(x, y) for i, x in enumerate(sorted(_CORR)) for y in sorted(_CORR)[i + 1:]]


@query(
    "q_metric_correlation", "metric_samples",
    "WITH w AS (SELECT date_trunc('day', snapshot_timestamp) AS slot, "
    + ", ".join(f"avg(CAST(metric_value AS DOUBLE)) FILTER (metric_name = '{m}') AS {m}" for m in _CORR)
    + " FROM metric_samples GROUP BY ALL) "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS metric_a, '{y}' AS metric_b, count(*) AS slots, round(corr({x}, {y}), 6) AS correlation FROM w WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
        for x, y in _PAIRS
    ),
)
def metric_correlation(b: Bind):
    return S.metric_correlation(b.metric_samples(), _CORR, "day").withColumn("correlation", F.round("correlation", 6))


# ---- cost over usage ----------------------------------------------------------------------------------------------


@query(
    "q_agg_cost_daily", "billing",
    "SELECT CAST(usage_date AS TIMESTAMP) AS usage_date, sku_name, usage_type, instance_id, CAST(sum(usage_quantity) AS DOUBLE) AS total_units, CAST(sum(usage_quantity * rate) AS DOUBLE) AS estimated_cost FROM billing GROUP BY ALL",
)
def agg_cost_daily(b: Bind):
    u = b.usage(placed=False).withColumn("instance_id", F.col("usage_metadata.database_instance_id"))
    return as_instant(S.cost_daily(u, ["usage_date", "sku_name", "usage_type", "instance_id"], "usage_quantity", "rate"), "usage_date")


@query(
    "q_agg_cost_share", "billing",
    "WITH u AS (SELECT project_id, branch_id, sum(usage_quantity) AS u FROM billing GROUP BY ALL)"
    " SELECT project_id, branch_id, CAST(u AS DOUBLE) AS units, CAST(u AS DOUBLE) / CAST(sum(u) OVER (PARTITION BY project_id) AS DOUBLE) * 100 AS pct_of_project FROM u",
)
def agg_cost_share(b: Bind):
    return S.cost_share(b.usage(), "project_id", "branch_id", "usage_quantity")


@query(
    "q_agg_cost_rollup", "billing",
    "SELECT project_id, branch_id, CAST(sum(usage_quantity) AS DOUBLE) AS units, count(*) AS records, CAST(grouping_id(project_id, branch_id) AS BIGINT) AS level"
    " FROM billing GROUP BY ROLLUP (project_id, branch_id)",
)
def agg_cost_rollup(b: Bind):
    return S.cost_rollup(b.usage(), "project_id", "branch_id", "usage_quantity")
