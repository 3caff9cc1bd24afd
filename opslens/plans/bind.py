"""Operational shapes derived from the driver tables, once for Spark and once as SQL for the check.

The driver supplies no operational tables. Every shape here is a row-wise projection (or one aggregate) of a
driver table, so its size follows the data.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.exprs import latest_instant

METRICS = (
    "cache_hit_ratio", "connection_utilization", "max_dead_tuple_ratio", "lock_wait_seconds", "deadlocks_per_hour",
    "slow_query_seconds", "txid_age", "replication_lag_seconds",
)
BRANCH_NAMES = ("ci-pr-", "hotfix-", "perf-", "feat-", "dev-", "demo-", "qa-release-", "audit-", "ai-agent-", "development", "foo-", "Bad_")
COLUMN_NAMES = (
    "email", "phone_number", "id", "full_name", "created_at", "ssn", "amount", "address", "status", "IP_ADDRESS", "patient_id", "qty",
    "diagnosis_code", "note", "card_number", "price", "cvv", "kind", "bank_account", "city", "region", "routing_number", "sku", "mrn",
)
COLUMN_TYPES = ("bigint", "text", "numeric", "timestamptz")
OBJECT_KINDS = (
    "tables", "sequences", "custom_types", "foreign_keys", "materialized_views", "triggers", "functions", "rls_policies",
    "partitioned_tables", "large_objects", "exclusion_constraints", "custom_aggregates", "publications",
)
ENGINES = (
    "aurora-postgresql", "aurora-postgresql-io", "rds-postgresql", "cloud-sql-postgresql", "azure-postgresql",
    "alloydb-postgresql", "supabase-postgresql", "unknown-postgresql", "dynamodb", "cosmosdb-nosql",
)
REGIONS = ("us-east-1", "eu-west-1", "eastus", "us-central1", "westeurope", "elsewhere")
EXTENSIONS = (
    "pgcrypto", "pg_cron", "PostGIS", "aws_s3", "hstore", "timescaledb", "citext", "azure_ai", "pg_trgm", "homegrown", "vector", "pglogical",
)
CATALOG_SCHEMAS = ("public", "app", "pg_catalog", "sales")
ENGINE_VERSIONS = ("13.4", "14.2", "15.1", "16.0", "17.1")
DDL_TEXTS = (
    "CREATE TABLE t{} (id INT);", "CREATE TABLE IF NOT EXISTS t{} (id INT);", "DROP TABLE t{};", "drop table if exists t{};",
    "DROP INDEX i{};", "TRUNCATE t{};", "CREATE OR REPLACE VIEW v{} AS SELECT 1;", "ALTER TABLE t{} ADD COLUMN IF NOT EXISTS c INT;",
    "INSERT INTO t{} VALUES (1);", "UPDATE t{} SET x = 1;", "SELECT {};", "  create index i{} on t (a);",
)


def _lits(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def pick(values, index: str) -> str:
    """Spark: the value at a 0-based index."""
    return f"get(array({_lits(values)}), cast({index} AS INT))"


def sql_pick(values, index: str) -> str:
    """Check: the value at a 0-based index."""
    return f"([{_lits(values)}])[({index}) + 1]"


K = "k"  # the payload's number, parsed once per row by Bind.events
SQL_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
V = "cast(value AS DECIMAL(18,2))"
KEYS = ["concat('p', user_id % 5) AS project_id", "concat('b', user_id) AS branch_id"]
SQL_KEYS = "'p' || (user_id % 5) AS project_id, 'b' || user_id AS branch_id"

QUERY_TEXT = (
    "CASE event_type WHEN 'view' THEN 'SELECT * FROM pages' WHEN 'click' THEN 'with c as (select 1) select * from c'"
    " WHEN 'purchase' THEN 'INSERT INTO sales VALUES (1)' WHEN 'signup' THEN 'update users set n = 1' ELSE 'VACUUM log' END"
)


class Bind:
    """Driver tables of one directory as operational shapes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def now(self, table: str = "events", ts: str = "ts") -> datetime:
        """As-of time: the newest time of a table (any time will do for an empty one)."""
        return latest_instant(self.table(table), ts) or datetime(1970, 1, 1)

    def events(self, *exprs: str) -> DataFrame:
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).selectExpr(*exprs)

    def query_stats(self) -> DataFrame:
        return self.events(
            "event_id", *KEYS, "user_id AS queryid", f"{QUERY_TEXT} AS query", f"{K} AS calls",
            f"{V} AS mean_exec_time", f"cast({V} * {K} AS DECIMAL(24,2)) AS total_exec_time", f"{K} + user_id % 7 AS rows",
            f"{K} * 100 AS shared_blks_hit", f"{K} * 10 + event_id % 7 AS shared_blks_read", "ts AS snapshot_timestamp",
        )

    def metric_samples(self) -> DataFrame:
        m = "cast(event_id % 8 AS INT)"
        return self.events(
            "event_id", *KEYS, f"{pick(METRICS, 'event_id % 8')} AS metric_name",
            f"cast(CASE {m} WHEN 0 THEN 0.9 + {K} / 1000.0 WHEN 1 THEN {K} / 100.0 WHEN 2 THEN {K} / 250.0 WHEN 4 THEN {K} % 8"
            f" WHEN 5 THEN {V} / 10 WHEN 6 THEN {K} * 20000000 ELSE {V} END AS DECIMAL(20,4)) AS metric_value",
            "ts AS snapshot_timestamp",
        )

    def branch_events(self) -> DataFrame:
        return self.events(
            "event_id", KEYS[0], f"concat({pick(BRANCH_NAMES, 'user_id % 12')}, user_id) AS branch_id",
            "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'protected'"
            " ELSE 'reset' END AS event_type",
            "event_type = 'purchase' AND user_id % 3 = 0 AS is_protected", f"concat('u', {K} % 10) AS actor",
            f"{pick(('human', 'agent', 'ci', 'robot'), 'user_id % 4')} AS creator_type", "ts AS event_timestamp",
        )

    def sessions(self) -> DataFrame:
        return self.events(
            "event_id AS pid", *KEYS,
            f"{pick(('active', 'idle', 'idle in transaction', 'disabled'), K + ' % 4')} AS state",
            f"CASE WHEN {K} % 10 = 0 THEN 'autovacuum worker' ELSE 'client backend' END AS backend_type", "ts AS state_change",
        )

    def table_stats(self) -> DataFrame:
        q, flag = F.col("l_quantity"), F.col("l_returnflag")
        return (
            self.table("lineitem")
            .groupBy("l_suppkey")
            .agg(
                F.sum(q).cast("bigint").alias("qty"),
                F.sum(F.when(flag == "R", q).otherwise(0)).cast("bigint").alias("returned"),
                F.count_if(F.col("l_linestatus") == "O").alias("o"),
                F.count_if(F.col("l_linestatus") == "F").alias("f"),
                F.count_if(flag == "N").alias("n_tup_ins"),
                F.count_if(flag == "A").alias("n_tup_upd"),
                F.count_if(flag == "R").alias("n_tup_del"),
                F.max("l_shipdate").alias("last_autovacuum"),
            )
            .selectExpr(
                "concat('p', l_suppkey % 5) AS project_id", "concat('b', l_suppkey % 10) AS branch_id",
                "concat('t', l_suppkey) AS relname", "qty * (1 + l_suppkey % 5 * 40) AS n_live_tup",
                "returned * (l_suppkey % 4) AS n_dead_tup", "o AS seq_scan", "f * (l_suppkey % 3) AS idx_scan",
                "qty * 100 AS seq_tup_read", "n_tup_ins", "n_tup_upd", "n_tup_del", "last_autovacuum",
            )
        )

    def index_stats(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('p', p_partkey % 5) AS project_id", "concat('b', p_partkey % 10) AS branch_id", "p_partkey AS indexrelid",
            "p_brand AS table_name", "concat('idx_', p_partkey) AS index_name",
            "CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_partkey * 37 % 300 END AS idx_scan",
            "cast(p_size AS BIGINT) * 2000000 AS index_size_bytes", "p_partkey % 7 = 0 AS indisunique",
            "p_partkey % 11 = 0 AS indisprimary", "concat(p_name, ',', p_type) AS indkey",
        )

    def constraints(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "concat('fk_', o_orderkey) AS conname", "o_custkey AS conrelid",
            "array(o_orderkey % 6 + 1, o_orderkey % 4 + 1) AS conkey",
        )

    def index_keys(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey AS indrelid", "array(cast(p_size AS BIGINT) % 6 + 1, p_partkey % 5 + 1) AS indkey")

    def attributes(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey", "explode(sequence(1L, 6L)) AS i").selectExpr(
            "c_custkey AS attrelid", "i AS attnum", f"{pick(COLUMN_NAMES, '(c_custkey * 5 + i) % 24')} AS attname",
            f"{pick(COLUMN_TYPES, '(c_custkey + i) % 4')} AS atttype", "i = 1 AS attnotnull",
            "(c_custkey + i) % 17 = 0 AS attisdropped", "CASE WHEN (c_custkey + i) % 9 = 0 THEN 'de_DE' ELSE 'default' END AS collname",
        )

    def namespaces(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "n_nationkey AS oid", f"{pick(('pg_catalog', 'information_schema', 'public', 'app', 'public'), 'n_nationkey % 5')} AS nspname"
        )

    def classes(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS oid", "concat('t_', c_custkey) AS relname", f"{pick(('r', 'p', 'i', 'S', 'v', 'm'), 'c_custkey % 6')} AS relkind",
            "c_nationkey AS relnamespace",
        )

    def attrdefs(self) -> DataFrame:
        return self.table("customer").where("c_custkey % 3 = 0").selectExpr(
            "c_custkey AS adrelid", "c_custkey % 6 + 1 AS adnum", "concat('nextval(', c_custkey, ')') AS adbin"
        )

    def catalog_objects(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_custkey AS db_id", "concat('s', o_orderkey % 3) AS schema_name", f"{pick(OBJECT_KINDS, 'o_orderkey % 13')} AS kind",
            "cast(floor(o_totalprice) AS BIGINT) AS size_bytes", f"{pick(('plpgsql', 'sql', 'c', 'plpython3u'), 'o_orderkey % 4')} AS language",
        )

    def catalogs(self) -> dict[str, DataFrame]:
        """Flat catalog frames of a fleet: a database per customer, its objects from its orders."""
        c, o = self.table("customer"), self.table("orders")
        objects = o.selectExpr(
            "o_custkey AS db_id", f"{pick(CATALOG_SCHEMAS, 'o_orderkey % 4')} AS schema_name", f"{pick(OBJECT_KINDS, 'o_orderkey % 13')} AS kind",
            "concat('o', o_orderkey) AS name", "cast(floor(o_totalprice) * 100000 AS BIGINT) AS size_bytes",
        )
        return {
            "databases": c.selectExpr(
                "c_custkey AS db_id", f"{pick(ENGINES[:8], 'c_custkey % 8')} AS source_engine", f"{pick(REGIONS, 'c_custkey % 6')} AS region",
                f"{pick(ENGINE_VERSIONS, 'c_custkey % 5')} AS engine_version",
            ),
            "objects": objects.where("kind != 'functions'"),
            "extensions": c.selectExpr("c_custkey AS db_id", "explode(slice(sequence(0, 3), 1, cast(c_custkey % 5 AS INT))) AS i").selectExpr(
                "db_id", f"CASE WHEN i = 3 THEN 'plpgsql' ELSE {pick(EXTENSIONS, '(db_id * 7 + i * 5) % 12')} END AS name", "concat('1.', i) AS version"
            ),
            "functions": o.where("o_orderkey % 2 = 0").selectExpr(
                "o_custkey AS db_id", f"{pick(CATALOG_SCHEMAS, 'o_orderkey % 4')} AS schema_name", "concat('f', o_orderkey) AS name",
                f"{pick(('plpgsql', 'sql', 'plpgsql', 'internal'), 'o_orderkey div 2 % 4')} AS language", "repeat('x\n', cast(o_orderkey % 230 AS INT)) AS source",
            ),
            "slots": c.where("c_custkey % 5 = 0").selectExpr("c_custkey AS db_id", "concat('slot_', c_custkey) AS slot_name", "CASE WHEN c_custkey % 10 = 0 THEN 'logical' ELSE 'physical' END AS slot_type"),
            "event_triggers": c.where("c_custkey % 20 = 0").selectExpr("c_custkey AS db_id", "concat('et_', c_custkey) AS name"),
            "attributes": self.attributes().selectExpr("attrelid % 100 * 3 AS db_id", "concat('t', attrelid) AS table_name", "attname AS column_name", "attnum", "attisdropped", "collname"),
        }

    def sync_checks(self) -> DataFrame:
        lag, drift = f"{V} * 20", "user_id % 13 * 100"
        return self.events(
            "event_id AS validation_id", "event_type AS source_table", "concat('copy_', event_type) AS target_table",
            "CASE WHEN user_id % 2 = 0 THEN 'continuous' ELSE 'batch' END AS sync_type", f"{K} * 100 AS source_count",
            f"{K} * 100 - {drift} AS target_count", f"{drift} AS count_drift", f"cast({lag} AS DECIMAL(20,2)) AS freshness_lag_seconds",
            f"CASE WHEN {lag} > 3600 THEN 'stale' WHEN {drift} > 1000 THEN 'drift_detected' ELSE 'healthy' END AS status",
            "ts AS validated_at",
        )

    def operations(self) -> DataFrame:
        return self.events(
            "event_id AS operation_id", *KEYS, "concat('t', user_id) AS table_name",
            f"{pick(('VACUUM', 'ANALYZE', 'VACUUM FULL'), K + ' % 3')} AS operation_type", f"{K} * 100 AS dead_tuples_before",
            f"{K} * (user_id % 5) AS dead_tuples_after", f"{V} AS duration_seconds", "ts AS executed_at",
            f"CASE WHEN {K} % 5 = 0 THEN 'failed' ELSE 'success' END AS status",
        )

    def archive_log(self) -> DataFrame:
        return self.events(
            *KEYS, "event_type AS source_table", f"{K} * 1000 AS rows_archived", f"{K} * 512000 + user_id AS bytes_reclaimed",
            "ts AS archived_at", f"CASE WHEN {K} % 4 = 0 THEN 'failed' ELSE 'success' END AS status",
        )

    def recommendations(self) -> DataFrame:
        return self.events(
            "event_id AS recommendation_id", KEYS[0],
            f"{pick(('drop_unused', 'reindex_bloated', 'create_missing', 'drop_duplicate', 'create_fk'), 'user_id % 5')} AS recommendation_type",
            f"{pick(('high', 'medium', 'low'), K + ' % 3')} AS confidence",
            f"{pick(('pending_review', 'approved', 'executed', 'rejected'), 'event_id % 4')} AS status", "ts AS created_at",
        )

    def alerts(self) -> DataFrame:
        return self.events(
            "event_id AS alert_id", *KEYS, f"{pick(METRICS, 'event_id % 8')} AS metric_name",
            f"{pick(('info', 'warning', 'critical'), K + ' % 3')} AS severity", f"{K} % 7 = 0 AS auto_remediated", "ts AS sent_at",
        )

    def tasks(self) -> DataFrame:
        return self.events(
            "event_id AS task_id", "event_type AS agent", "user_id",
            f"{pick(('success', 'failed', 'pending', 'success', 'success'), K + ' % 5')} AS status",
        )

    def runs(self) -> DataFrame:
        return self.events(
            "event_id AS run_id", "user_id AS job_id",
            f"{pick(('TERMINATED', 'TERMINATED', 'TERMINATED', 'RUNNING', 'PENDING', 'SKIPPED', 'INTERNAL_ERROR', 'BLOCKED'), K + ' % 8')} AS life_cycle",
            "CASE WHEN event_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS result",
        )

    def senders(self) -> DataFrame:
        return self.events(
            "event_id", *KEYS, "event_type AS source_table", "event_id * 1000 + 500 AS sent_lsn", f"event_id * 1000 + 500 - {K} * 7 AS replay_lsn",
            f"{V} AS replay_lag_seconds", "ts AS checked_at",
        )

    def slots(self) -> DataFrame:
        return self.events(
            "event_id AS slot_name", "event_id * 1000 + 900 AS current_lsn", f"event_id * 1000 - {K} * 3 AS restart_lsn",
            f"CASE WHEN {K} % 10 = 0 THEN NULL ELSE event_id * 1000 + {K} END AS confirmed_flush_lsn", f"{K} % 2 = 0 AS active",
        )

    def usage(self, placed: bool = True) -> DataFrame:
        """Billing rows; project and branch come from other tables, which are only read if `placed`."""
        lines = self.table("lineitem")
        money = [
            F.to_date("l_shipdate").alias("usage_date"), F.col("l_returnflag").alias("usage_type"),
            F.col("l_linestatus").alias("sku_name"), F.col("l_quantity").cast("decimal(18,2)").alias("usage_quantity"),
            F.when(F.col("l_linestatus") == "O", F.lit("0.40")).otherwise("0.52").cast("decimal(6,2)").alias("rate"),
            F.struct(F.col("l_suppkey").alias("database_instance_id")).alias("usage_metadata"),
        ]
        if not placed:
            return lines.select(*money)
        place = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("n_name").alias("branch_id"), F.col("r_name").alias("project_id"))
        )
        return lines.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select("project_id", "branch_id", *money)

    def status_changes(self) -> DataFrame:
        return self.table("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")

    def policies(self) -> DataFrame:
        """Masking policies per branch: one row per customer table column."""
        a = self.attributes()
        return a.selectExpr(
            "concat('b', attrelid % 50) AS branch_id", "concat('t', attrelid) AS table_name", "lower(attname) AS column_name",
            "concat('mask_', attnum % 3) AS function", "attrelid", "attnum",
        )

    def branch_requests(self) -> DataFrame:
        return self.events(
            "event_id", f"CASE WHEN event_id % 50 = 0 THEN 'production' WHEN event_id % 41 = 0 THEN 'AB' WHEN event_id % 37 = 0 THEN"
            f" rpad('feat-long', 70, 'x') ELSE concat({pick(BRANCH_NAMES, 'user_id % 12')}, user_id) END AS name",
            f"{pick(('human', 'agent', 'ci', 'robot'), 'user_id % 4')} AS creator_type", f"{K} * 6 AS current_count", f"{K} % 12 AS unarchived",
            f"{pick(('delete', 'reset', 'migrate'), 'event_id % 3')} AS operation",
            f"{pick(('production', 'staging', 'dev'), K + ' % 3')} AS source_branch",
        ).withColumn("target", F.expr("CASE event_id % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'development' ELSE name END"))

    def fleet(self) -> DataFrame:
        q = "(c_custkey div 10)"
        return self.table("customer").selectExpr(
            "cast(c_custkey AS STRING) AS db_id", f"{pick(ENGINES, 'c_custkey % 10')} AS source_engine",
            f"{pick(REGIONS, q + ' % 6')} AS region", "abs(c_acctbal) AS size_gb", f"cast({q} % 130 AS INT) AS table_count",
            f"{pick(('13.4', '14.2', '15.1', '16.0', '17.1'), q + ' % 5')} AS engine_version",
            "transform(slice(array(0, 1, 2), 1, cast(c_custkey % 4 AS INT)), i ->"
            f" named_struct('name', {pick(EXTENSIONS, '(' + q + ' * 7 + i * 5) % 12')}, 'version', '1.0')) AS extensions",
            f"transform(slice(sequence(0, 59), 1, cast({q} % 60 AS INT)), i -> named_struct('name', concat('f', i),"
            f" 'language', CASE WHEN i % 9 = 8 THEN 'sql' ELSE 'plpgsql' END, 'line_count', cast(({q} * 13 + i * 7) % 203 AS INT))) AS functions",
            f"cast({q} % 30 AS INT) AS trigger_count", f"cast({q} % 15 AS INT) AS materialized_view_count",
            f"cast({q} % 25 AS INT) AS custom_type_count", f"{q} % 9 = 0 AS has_logical_replication",
            f"transform(slice(array(0, 1), 1, cast({q} % 3 AS INT)), i -> concat('slot_', i)) AS replication_slots",
            f"CASE WHEN {q} % 20 = 0 THEN 2 ELSE 0 END AS event_trigger_count", f"CASE WHEN {q} % 4 = 0 THEN 1 ELSE 0 END AS large_object_count",
            f"CASE WHEN {q} % 6 = 0 THEN 2 ELSE 0 END AS non_default_collation_count", f"{q} % 3 = 0 AS streams_enabled",
            f"{q} % 2 = 0 AS pitr_enabled", f"{q} % 5 = 0 AS ttl_enabled",
            f"CASE WHEN {q} % 2 = 0 THEN 'provisioned' ELSE 'on_demand' END AS billing_mode", f"cast({q} % 13 AS INT) AS gsi_count",
            f"cast({q} % 6 AS INT) AS lsi_count", f"{q} % 7 * 30000 AS item_size_avg_bytes",
            f"slice(array('r1', 'r2', 'r3'), 1, cast({q} % 4 AS INT)) AS regions",
            f"CASE {q} % 3 WHEN 0 THEN 'AllVersionsAndDeletes' WHEN 1 THEN 'LatestVersion' END AS change_feed_mode",
            f"{q} % 4 = 1 AS multi_region_writes", f"{pick(('Session', 'Strong', 'BoundedStaleness', 'Eventual'), q + ' % 4')} AS consistency_level",
            f"{pick(('provisioned', 'autoscale', 'serverless'), q + ' % 3')} AS throughput_mode", f"{q} * 50 + 400 AS request_units",
            f"CASE WHEN {q} % 2 = 0 THEN {q} * 100 + 1000 END AS autoscale_max_units",
            f"transform(sequence(0, cast({q} % 12 AS INT)), i -> concat('/k', i % 10)) AS partition_key_paths",
            f"cast({q} % 2 AS INT) AS unindexed_containers", f"CASE WHEN {q} % 2 = 0 THEN 'continuous' ELSE 'periodic' END AS backup_policy",
            f"CASE WHEN {q} % 4 <> 0 THEN named_struct('avg_qps', abs(c_acctbal) * 15, 'peak_qps', abs(c_acctbal) * 45,"
            f" 'avg_tps', cast({q} * 37 % 7000 AS DOUBLE), 'p99_latency_ms', cast({q} % 90 AS DOUBLE), 'reads_pct', cast({q} % 100 AS DOUBLE),"
            f" 'writes_pct', cast(100 - {q} % 100 AS DOUBLE), 'connection_count_avg', cast({q} * 53 % 900 AS INT),"
            f" 'connection_count_peak', cast({q} * 91 % 5000 AS INT), 'source', 'observed') END AS workload",
        )


SQ = "(c_custkey // 10)"
_SQL_LAG = "CAST(value AS DECIMAL(18,2)) * 20"

# The same shapes for the check engine.
SHAPES = {
    "newest": "SELECT max(ts) AS t FROM events",
    "query_stats": f"SELECT event_id, {SQL_KEYS}, user_id AS queryid, {QUERY_TEXT} AS query, {SQL_K} AS calls,"
    f" CAST(value AS DECIMAL(18,2)) AS mean_exec_time, CAST(CAST(value AS DECIMAL(18,2)) * {SQL_K} AS DECIMAL(24,2)) AS total_exec_time,"
    f' {SQL_K} + user_id % 7 AS "rows", {SQL_K} * 100 AS shared_blks_hit, {SQL_K} * 10 + event_id % 7 AS shared_blks_read,'
    " ts AS snapshot_timestamp FROM events",
    "metric_samples": f"SELECT event_id, {SQL_KEYS}, {sql_pick(METRICS, 'event_id % 8')} AS metric_name,"
    f" CASE event_id % 8 WHEN 0 THEN CAST(0.9 + {SQL_K} * 0.001 AS DECIMAL(20,4)) WHEN 1 THEN CAST({SQL_K} * 0.01 AS DECIMAL(20,4))"
    f" WHEN 2 THEN CAST({SQL_K} * 0.004 AS DECIMAL(20,4)) WHEN 4 THEN CAST({SQL_K} % 8 AS DECIMAL(20,4))"
    f" WHEN 5 THEN CAST(CAST(value AS DECIMAL(18,2)) * 0.1 AS DECIMAL(20,4)) WHEN 6 THEN CAST({SQL_K} * 20000000 AS DECIMAL(20,4))"
    " ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(20,4)) END AS metric_value, ts AS snapshot_timestamp FROM events",
    "branch_events": f"SELECT event_id, 'p' || (user_id % 5) AS project_id, {sql_pick(BRANCH_NAMES, 'user_id % 12')} || user_id AS branch_id,"
    " CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'protected' ELSE 'reset' END AS event_type,"
    f" event_type = 'purchase' AND user_id % 3 = 0 AS is_protected, 'u' || ({SQL_K} % 10) AS actor,"
    f" {sql_pick(('human', 'agent', 'ci', 'robot'), 'user_id % 4')} AS creator_type, ts AS event_timestamp FROM events",
    "sessions": f"SELECT event_id AS pid, {SQL_KEYS}, {sql_pick(('active', 'idle', 'idle in transaction', 'disabled'), SQL_K + ' % 4')} AS state,"
    f" CASE WHEN {SQL_K} % 10 = 0 THEN 'autovacuum worker' ELSE 'client backend' END AS backend_type, ts AS state_change FROM events",
    "table_stats": "SELECT 'p' || (l_suppkey % 5) AS project_id, 'b' || (l_suppkey % 10) AS branch_id, 't' || l_suppkey AS relname,"
    " CAST(sum(l_quantity) AS BIGINT) * (1 + l_suppkey % 5 * 40) AS n_live_tup,"
    " CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) * (l_suppkey % 4) AS n_dead_tup,"
    " count(*) FILTER (l_linestatus = 'O') AS seq_scan, count(*) FILTER (l_linestatus = 'F') * (l_suppkey % 3) AS idx_scan,"
    " CAST(sum(l_quantity) AS BIGINT) * 100 AS seq_tup_read, count(*) FILTER (l_returnflag = 'N') AS n_tup_ins,"
    " count(*) FILTER (l_returnflag = 'A') AS n_tup_upd, count(*) FILTER (l_returnflag = 'R') AS n_tup_del,"
    " max(l_shipdate) AS last_autovacuum FROM lineitem GROUP BY l_suppkey",
    "index_stats": "SELECT 'p' || (p_partkey % 5) AS project_id, 'b' || (p_partkey % 10) AS branch_id, p_partkey AS indexrelid,"
    " p_brand AS table_name, 'idx_' || p_partkey AS index_name,"
    " CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_partkey * 37 % 300 END AS idx_scan, CAST(p_size AS BIGINT) * 2000000 AS index_size_bytes,"
    " p_partkey % 7 = 0 AS indisunique, p_partkey % 11 = 0 AS indisprimary, p_name || ',' || p_type AS indkey FROM part",
    "constraints": "SELECT 'fk_' || o_orderkey AS conname, o_custkey AS conrelid, [o_orderkey % 6 + 1, o_orderkey % 4 + 1] AS conkey FROM orders",
    "index_keys": "SELECT p_partkey AS indrelid, [CAST(p_size AS BIGINT) % 6 + 1, p_partkey % 5 + 1] AS indkey FROM part",
    "attributes": f"SELECT c_custkey AS attrelid, i AS attnum, {sql_pick(COLUMN_NAMES, '(c_custkey * 5 + i) % 24')} AS attname,"
    f" {sql_pick(COLUMN_TYPES, '(c_custkey + i) % 4')} AS atttype, i = 1 AS attnotnull, (c_custkey + i) % 17 = 0 AS attisdropped,"
    " CASE WHEN (c_custkey + i) % 9 = 0 THEN 'de_DE' ELSE 'default' END AS collname FROM customer, range(1, 7) AS r(i)",
    "namespaces": f"SELECT n_nationkey AS oid, {sql_pick(('pg_catalog', 'information_schema', 'public', 'app', 'public'), 'n_nationkey % 5')} AS nspname FROM nation",
    "classes": f"SELECT c_custkey AS oid, 't_' || c_custkey AS relname, {sql_pick(('r', 'p', 'i', 'S', 'v', 'm'), 'c_custkey % 6')} AS relkind, c_nationkey AS relnamespace FROM customer",
    "attrdefs": "SELECT c_custkey AS adrelid, c_custkey % 6 + 1 AS adnum, 'nextval(' || c_custkey || ')' AS adbin FROM customer WHERE c_custkey % 3 = 0",
    "catalog_objects": f"SELECT o_custkey AS db_id, 's' || (o_orderkey % 3) AS schema_name, {sql_pick(OBJECT_KINDS, 'o_orderkey % 13')} AS kind,"
    f" CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, {sql_pick(('plpgsql', 'sql', 'c', 'plpython3u'), 'o_orderkey % 4')} AS language FROM orders",
    "cat_databases": f"SELECT c_custkey AS db_id, {sql_pick(ENGINES[:8], 'c_custkey % 8')} AS source_engine, {sql_pick(REGIONS, 'c_custkey % 6')} AS region,"
    f" {sql_pick(ENGINE_VERSIONS, 'c_custkey % 5')} AS engine_version FROM customer",
    "cat_objects": f"SELECT * FROM (SELECT o_custkey AS db_id, {sql_pick(CATALOG_SCHEMAS, 'o_orderkey % 4')} AS schema_name, {sql_pick(OBJECT_KINDS, 'o_orderkey % 13')} AS kind,"
    " 'o' || o_orderkey AS name, CAST(floor(o_totalprice) * 100000 AS BIGINT) AS size_bytes FROM orders) WHERE kind <> 'functions' AND schema_name <> 'pg_catalog'",
    "cat_extensions": f"SELECT c_custkey AS db_id, {sql_pick(EXTENSIONS, '(c_custkey * 7 + i * 5) % 12')} AS name, '1.' || i AS version FROM customer, range(0, 3) AS r(i) WHERE i < c_custkey % 5",
    "cat_functions": f"SELECT * FROM (SELECT o_custkey AS db_id, {sql_pick(CATALOG_SCHEMAS, 'o_orderkey % 4')} AS schema_name, 'f' || o_orderkey AS name,"
    f" {sql_pick(('plpgsql', 'sql', 'plpgsql', 'internal'), 'o_orderkey // 2 % 4')} AS language, CASE WHEN o_orderkey % 230 > 0 THEN o_orderkey % 230 + 1 ELSE 0 END AS lines"
    " FROM orders WHERE o_orderkey % 2 = 0) WHERE schema_name <> 'pg_catalog' AND language <> 'internal'",
    "cat_collations": "SELECT attrelid % 100 * 3 AS db_id, 't' || attrelid AS table_name, attname AS column_name, collname FROM attributes WHERE attnum > 0 AND NOT attisdropped AND collname <> 'default'",
    "sync_checks": "SELECT event_id AS validation_id, event_type AS source_table, 'copy_' || event_type AS target_table,"
    f" CASE WHEN user_id % 2 = 0 THEN 'continuous' ELSE 'batch' END AS sync_type, {SQL_K} * 100 AS source_count,"
    f" {SQL_K} * 100 - user_id % 13 * 100 AS target_count, user_id % 13 * 100 AS count_drift,"
    f" CAST({_SQL_LAG} AS DECIMAL(20,2)) AS freshness_lag_seconds, CASE WHEN {_SQL_LAG} > 3600 THEN 'stale'"
    " WHEN user_id % 13 * 100 > 1000 THEN 'drift_detected' ELSE 'healthy' END AS status, ts AS validated_at FROM events",
    "operations": f"SELECT event_id AS operation_id, {SQL_KEYS}, 't' || user_id AS table_name,"
    f" {sql_pick(('VACUUM', 'ANALYZE', 'VACUUM FULL'), SQL_K + ' % 3')} AS operation_type, {SQL_K} * 100 AS dead_tuples_before,"
    f" {SQL_K} * (user_id % 5) AS dead_tuples_after, CAST(value AS DECIMAL(18,2)) AS duration_seconds, ts AS executed_at,"
    f" CASE WHEN {SQL_K} % 5 = 0 THEN 'failed' ELSE 'success' END AS status FROM events",
    "archive_log": f"SELECT {SQL_KEYS}, event_type AS source_table, {SQL_K} * 1000 AS rows_archived, {SQL_K} * 512000 + user_id AS bytes_reclaimed,"
    f" ts AS archived_at, CASE WHEN {SQL_K} % 4 = 0 THEN 'failed' ELSE 'success' END AS status FROM events",
    "recommendations": "SELECT event_id AS recommendation_id, 'p' || (user_id % 5) AS project_id,"
    f" {sql_pick(('drop_unused', 'reindex_bloated', 'create_missing', 'drop_duplicate', 'create_fk'), 'user_id % 5')} AS recommendation_type,"
    f" {sql_pick(('high', 'medium', 'low'), SQL_K + ' % 3')} AS confidence,"
    f" {sql_pick(('pending_review', 'approved', 'executed', 'rejected'), 'event_id % 4')} AS status, ts AS created_at FROM events",
    "alerts": f"SELECT event_id AS alert_id, {SQL_KEYS}, {sql_pick(METRICS, 'event_id % 8')} AS metric_name,"
    f" {sql_pick(('info', 'warning', 'critical'), SQL_K + ' % 3')} AS severity, {SQL_K} % 7 = 0 AS auto_remediated, ts AS sent_at FROM events",
    "tasks": f"SELECT event_id AS task_id, event_type AS agent, user_id, {sql_pick(('success', 'failed', 'pending', 'success', 'success'), SQL_K + ' % 5')} AS status FROM events",
    "runs": "SELECT event_id AS run_id, user_id AS job_id,"
    f" {sql_pick(('TERMINATED', 'TERMINATED', 'TERMINATED', 'RUNNING', 'PENDING', 'SKIPPED', 'INTERNAL_ERROR', 'BLOCKED'), SQL_K + ' % 8')} AS life_cycle,"
    " CASE WHEN event_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS result FROM events",
    "senders": f"SELECT event_id, {SQL_KEYS}, event_type AS source_table, event_id * 1000 + 500 AS sent_lsn, event_id * 1000 + 500 - {SQL_K} * 7 AS replay_lsn,"
    " CAST(value AS DECIMAL(18,2)) AS replay_lag_seconds, ts AS checked_at FROM events",
    "slots": f"SELECT event_id AS slot_name, event_id * 1000 + 900 AS current_lsn, event_id * 1000 - {SQL_K} * 3 AS restart_lsn,"
    f" CASE WHEN {SQL_K} % 10 = 0 THEN NULL ELSE event_id * 1000 + {SQL_K} END AS confirmed_flush_lsn, {SQL_K} % 2 = 0 AS active FROM events",
    "billing": "SELECT r_name AS project_id, n_name AS branch_id, CAST(l_shipdate AS DATE) AS usage_date, l_returnflag AS usage_type,"
    " l_linestatus AS sku_name, CAST(l_quantity AS DECIMAL(18,2)) AS usage_quantity,"
    " CAST(CASE WHEN l_linestatus = 'O' THEN '0.40' ELSE '0.52' END AS DECIMAL(6,2)) AS rate, l_suppkey AS instance_id"
    " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "policies": "SELECT 'b' || (attrelid % 50) AS branch_id, 't' || attrelid AS table_name, lower(attname) AS column_name,"
    " 'mask_' || (attnum % 3) AS function, attrelid, attnum FROM attributes",
    "branch_requests": f"SELECT *, CASE event_id % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'development' ELSE name END AS target FROM ("
    f" SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'production' WHEN event_id % 41 = 0 THEN 'AB' WHEN event_id % 37 = 0 THEN"
    f" rpad('feat-long', 70, 'x') ELSE {sql_pick(BRANCH_NAMES, 'user_id % 12')} || user_id END AS name,"
    f" {sql_pick(('human', 'agent', 'ci', 'robot'), 'user_id % 4')} AS creator_type, {SQL_K} * 6 AS current_count, {SQL_K} % 12 AS unarchived,"
    f" {sql_pick(('delete', 'reset', 'migrate'), 'event_id % 3')} AS operation, {sql_pick(('production', 'staging', 'dev'), SQL_K + ' % 3')} AS source_branch FROM events)",
    "fleet": f"SELECT CAST(c_custkey AS VARCHAR) AS db_id, {SQ} AS q, {sql_pick(ENGINES, 'c_custkey % 10')} AS source_engine, {sql_pick(REGIONS, SQ + ' % 6')} AS region,"
    f" abs(c_acctbal) AS size_gb, {SQ} % 130 AS table_count, {sql_pick(('13.4', '14.2', '15.1', '16.0', '17.1'), SQ + ' % 5')} AS engine_version,"
    f" c_custkey % 4 AS n_ext, c_custkey, c_custkey % 10 AS e FROM customer",
    "fleet_ext": f"SELECT db_id, source_engine, lower({sql_pick(EXTENSIONS, '(q * 7 + i * 5) % 12')}) AS name"
    " FROM fleet, range(0, 3) AS r(i) WHERE i < n_ext",
}
DEPENDS = {"policies": ["attributes"], "cat_collations": ["attributes"], "fleet_ext": ["fleet"]}


def with_shapes(shapes: str, body: str) -> str:
    """SQL with the named shapes as common table expressions in front of the body."""
    order: list[str] = []
    for name in shapes.split():
        for n in [*DEPENDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    if not order:
        return body
    ctes = ", ".join(f"{n} AS ({SHAPES[n]})" for n in order)
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
