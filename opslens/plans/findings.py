"""Queries on index, vacuum and catalog findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens import rules
from opslens.operators import findings as G
from opslens.plans.bind import OBJECT_KINDS, Bind
from opslens.plans.registry import query, sql_cells

_MB = "1048576.0::DOUBLE"
_UNUSED = (
    "SELECT project_id, branch_id, table_name, index_name, 'drop_unused' AS recommendation_type, CASE WHEN index_size_bytes / {mb} > 10 THEN 'high' ELSE 'medium' END AS confidence,"
    " index_size_bytes / {mb} AS size_mb, 'DROP INDEX CONCURRENTLY IF EXISTS ' || index_name AS ddl_statement FROM index_stats WHERE idx_scan = 0 AND NOT indisunique AND NOT indisprimary"
).format(mb=_MB)
_BLOATED = (
    "SELECT project_id, branch_id, table_name, index_name, 'reindex_bloated' AS recommendation_type, 'medium' AS confidence, index_size_bytes / {mb} AS size_mb,"
    " 'REINDEX INDEX CONCURRENTLY ' || index_name AS ddl_statement FROM index_stats WHERE index_size_bytes / {mb} > 50 AND idx_scan < 100"
).format(mb=_MB)


def _meta(b: Bind):
    s = b.index_stats()
    key = ["project_id", "branch_id", "indexrelid"]
    return s.drop("indisunique", "indisprimary"), s.select(*key, "indisunique", "indisprimary")


@query("q_idx_unused", "index_stats", _UNUSED)
def idx_unused(b: Bind):
    return G.unused_indexes(*_meta(b))


@query(
    "q_join_stats_meta", "index_stats",
    "SELECT indexrelid, idx_scan, indisunique FROM index_stats",
)
def join_stats_meta(b: Bind):
    stats, meta = _meta(b)
    return stats.join(meta, ["project_id", "branch_id", "indexrelid"]).select("indexrelid", "idx_scan", "indisunique")


@query("q_idx_bloated", "index_stats", _BLOATED)
def idx_bloated(b: Bind):
    return G.bloated_indexes(b.index_stats())


@query(
    "q_idx_missing", "table_stats",
    "SELECT relname, seq_scan, idx_scan, n_live_tup, coalesce(CAST(seq_tup_read AS DOUBLE) / nullif(CAST(seq_scan AS DOUBLE), 0), 0.0) AS avg_tup_per_scan FROM table_stats"
    " WHERE seq_scan > 100 AND n_live_tup > 10000 AND (idx_scan = 0 OR seq_scan > idx_scan * 10)",
)
def idx_missing(b: Bind):
    return G.missing_indexes(b.table_stats()).select("relname", "seq_scan", "idx_scan", "n_live_tup", "avg_tup_per_scan")


_DUP = (
    "SELECT table_name, indkey, keep_index, keep_size, indexrelid AS drop_index, index_size_bytes AS drop_size FROM (SELECT *, min(indexrelid) OVER w AS keep_index,"
    " arg_min(index_size_bytes, indexrelid) OVER w AS keep_size FROM index_stats WHERE NOT indisprimary WINDOW w AS (PARTITION BY table_name, indkey)) WHERE indexrelid > keep_index"
)


@query("q_join_self_duplicates", "index_stats", _DUP)
def join_self_duplicates(b: Bind):
    return G.duplicate_indexes(b.index_stats(), ["table_name"])


@query(
    "q_idx_duplicate", "index_stats",
    f"WITH d AS ({_DUP}) SELECT table_name, count(*) AS duplicates, CAST(sum(drop_size) AS DOUBLE) / {_MB} AS reclaimable_mb FROM d GROUP BY ALL",
)
def idx_duplicate(b: Bind):
    d = G.duplicate_indexes(b.index_stats(), ["table_name"])
    return d.groupBy("table_name").agg(F.count("*").alias("duplicates"), (F.sum("drop_size").cast("double") / G.MB).alias("reclaimable_mb"))


@query(
    "q_join_anti_unindexed", "constraints index_keys",
    "SELECT conname, conrelid, conkey[1] AS column_number FROM constraints c WHERE NOT EXISTS (SELECT 1 FROM index_keys i WHERE i.indrelid = c.conrelid AND list_contains(i.indkey, c.conkey[1]))",
)
def join_anti_unindexed(b: Bind):
    return G.unindexed_foreign_keys(b.constraints(), b.index_keys()).select("conname", "conrelid", "column_number")


@query(
    "q_idx_missing_fk", "constraints index_keys attributes",
    "SELECT c.conrelid, a.attname AS column_name, count(*) AS constraints FROM constraints c JOIN attributes a ON a.attrelid = c.conrelid AND a.attnum = c.conkey[1]"
    " WHERE NOT EXISTS (SELECT 1 FROM index_keys i WHERE i.indrelid = c.conrelid AND list_contains(i.indkey, c.conkey[1])) GROUP BY ALL",
)
def idx_missing_fk(b: Bind):
    named = G.unindexed_columns(b.constraints(), b.index_keys(), b.attributes())
    return named.groupBy("conrelid", "column_name").agg(F.sum("constraints").alias("constraints"))


@query(
    "q_join_semi_member", "constraints attributes",
    "SELECT conname, conrelid, a.attnum, attname FROM (SELECT conname, conrelid, unnest(conkey) AS k FROM constraints) c JOIN attributes a ON a.attrelid = c.conrelid AND a.attnum = c.k",
)
def join_semi_member(b: Bind):
    return G.key_members(b.constraints(), b.attributes())


_SEQUENTIAL = (
    "SELECT project_id, branch_id, relname AS table_name, NULL AS index_name, 'create_missing' AS recommendation_type, 'medium' AS confidence, 0.0::DOUBLE AS size_mb, NULL AS ddl_statement FROM table_stats"
    " WHERE seq_scan > 100 AND n_live_tup > 10000 AND (idx_scan = 0 OR seq_scan > idx_scan * 10)"
)
_DOUBLED = (
    "SELECT project_id, branch_id, table_name, index_name, 'drop_duplicate' AS recommendation_type, 'high' AS confidence, index_size_bytes / {mb} AS size_mb, 'DROP INDEX CONCURRENTLY ' || index_name AS ddl_statement"
    " FROM index_stats WHERE NOT indisprimary QUALIFY row_number() OVER (PARTITION BY project_id, branch_id, table_name, indkey ORDER BY index_name) > 1"
).format(mb=_MB)
_FK = (
    "SELECT DISTINCT 'p' || (c.conrelid % 5) AS project_id, 'b' || (c.conrelid % 10) AS branch_id, 't_' || c.conrelid AS table_name, NULL AS index_name, 'create_fk_index' AS recommendation_type, 'high' AS confidence, 0.0::DOUBLE AS size_mb,"
    " 'CREATE INDEX CONCURRENTLY idx_t_' || c.conrelid || '_' || a.attname || ' ON t_' || c.conrelid || '(' || a.attname || ')' AS ddl_statement FROM constraints c JOIN attributes a ON a.attrelid = c.conrelid AND a.attnum = c.conkey[1]"
    " WHERE NOT EXISTS (SELECT 1 FROM index_keys i WHERE i.indrelid = c.conrelid AND list_contains(i.indkey, c.conkey[1]))"
)
_ALL = " UNION ALL ".join((_UNUSED, _BLOATED, _SEQUENTIAL, _DOUBLED, _FK))


def _findings(b: Bind):
    """What all five detectors find."""
    place = {"project_id": F.concat(F.lit("p"), F.col("conrelid") % 5), "branch_id": F.concat(F.lit("b"), F.col("conrelid") % 10), "table_name": F.concat(F.lit("t_"), F.col("conrelid"))}
    unindexed = G.unindexed_columns(b.constraints(), b.index_keys(), b.attributes()).withColumns(place)
    s = b.index_stats()
    return G.union_findings(G.unused_indexes(*_meta(b)), G.bloated_indexes(s), G.missing_findings(b.table_stats()), G.duplicate_findings(s), G.foreign_key_findings(unindexed))


@query(
    "q_set_union_findings", "index_stats table_stats constraints attributes index_keys",
    f"WITH u AS ({_ALL}) SELECT *, sha256({sql_cells('project_id', 'branch_id', 'table_name', 'index_name', 'recommendation_type', 'ddl_statement')}) AS recommendation_id FROM u",
)
def set_union_findings(b: Bind):
    return _findings(b)


@query(
    "q_idx_health_score", "index_stats table_stats constraints attributes index_keys query_stats",
    f"WITH u AS ({_ALL}), br AS (SELECT project_id, branch_id FROM query_stats UNION SELECT project_id, branch_id FROM u), n AS (SELECT project_id, branch_id, count(*) AS n FROM u GROUP BY ALL)"
    " SELECT project_id, branch_id, coalesce(n, 0) AS total_issues, greatest(0, 100 - coalesce(n, 0) * 10) AS health_score FROM br LEFT JOIN n USING (project_id, branch_id)",
)
def idx_health_score(b: Bind):
    return G.index_health(_findings(b), b.query_stats())


_PCT = "CAST(n_dead_tup AS DOUBLE) / nullif(CAST(n_live_tup + n_dead_tup AS DOUBLE), 0)"


@query(
    "q_vac_candidates", "table_stats",
    f"SELECT relname, n_dead_tup, {_PCT} * 100 AS dead_pct, CASE WHEN {_PCT} * 100 > 30 THEN 'VACUUM FULL' WHEN {_PCT} * 100 > 10 THEN 'VACUUM ANALYZE' ELSE 'none' END AS action FROM table_stats WHERE n_dead_tup > 1000",
)
def vac_candidates(b: Bind):
    return G.vacuum_candidates(b.table_stats()).select("relname", "n_dead_tup", "dead_pct", "action")


@query(
    "q_dead_tuple_top", "table_stats",
    f"SELECT project_id, branch_id, relname, coalesce({_PCT}, 0.0) AS dead_ratio, CAST(row_number() OVER (PARTITION BY project_id, branch_id ORDER BY n_dead_tup DESC, relname) AS INTEGER) AS place FROM table_stats QUALIFY place <= 5",
)
def dead_tuple_top(b: Bind):
    return G.dead_tuple_top(b.table_stats(), ["project_id", "branch_id"]).select("project_id", "branch_id", "relname", "dead_ratio", "place")


_XID = "xid AS (SELECT project_id, branch_id, relname, n_live_tup * 400 AS xid_age FROM table_stats)"
_RISK = "CASE WHEN xid_age > 1000000000 THEN 'critical' WHEN xid_age > 500000000 THEN 'warning' ELSE 'safe' END"


def _databases(b: Bind):
    return b.table_stats().select("project_id", "branch_id", "relname", (F.col("n_live_tup") * 400).alias("xid_age"))


@query("q_xid_risk", "table_stats", f"WITH {_XID} SELECT relname, xid_age, xid_age * 100.0::DOUBLE / 2e9 AS pct_to_wraparound, {_RISK} AS risk FROM xid")
def xid_risk(b: Bind):
    out = G.xid_risk(_databases(b)).select("relname", "xid_age", "pct_to_wraparound", "risk")
    return out.withColumn("pct_to_wraparound", F.col("pct_to_wraparound").cast("double"))


@query(
    "q_xid_risk_branch", "table_stats",
    f"WITH {_XID} SELECT project_id, branch_id, max(xid_age) AS max_xid_age, arg_max({_RISK}, xid_age) AS risk FROM xid GROUP BY ALL",
)
def xid_risk_branch(b: Bind):
    return G.xid_risk_by_branch(_databases(b), ["project_id", "branch_id"])


@query(
    "q_autovac_tune", "table_stats",
    "SELECT relname, n_live_tup, CASE WHEN n_live_tup > 1000000 THEN 0.01 ELSE 0.05 END::DOUBLE AS scale_factor, CAST(CASE WHEN n_live_tup > 1000000 THEN greatest(1000, floor(n_live_tup * 0.01::DOUBLE))"
    " ELSE greatest(500, floor(n_live_tup * 0.05::DOUBLE)) END AS BIGINT) AS vacuum_threshold FROM table_stats WHERE n_live_tup > 100000",
)
def autovac_tune(b: Bind):
    return G.autovacuum_tuning(b.table_stats()).select("relname", "n_live_tup", "scale_factor", "vacuum_threshold")


@query(
    "q_hot_tables", "table_stats",
    "SELECT project_id, relname, n_tup_ins + n_tup_upd + n_tup_del AS writes FROM table_stats ORDER BY writes DESC, project_id, relname LIMIT 10",
)
def hot_tables(b: Bind):
    return G.hot_tables(b.table_stats()).select("project_id", "relname", "writes")


@query(
    "q_join_left_default", "attributes attrdefs",
    "SELECT a.attrelid, a.attnum, a.attname, d.adbin FROM attributes a LEFT JOIN attrdefs d ON d.adrelid = a.attrelid AND d.adnum = a.attnum",
)
def join_left_default(b: Bind):
    d = b.attrdefs().selectExpr("adrelid AS attrelid", "adnum AS attnum", "adbin")
    return b.attributes().join(d, ["attrelid", "attnum"], "left").select("attrelid", "attnum", "attname", "adbin")


@query(
    "q_schema_snapshot", "classes namespaces attributes attrdefs",
    "SELECT c.relname AS table_name, a.attname AS column_name, a.atttype AS data_type, a.attnum AS ordinal_position, a.attnotnull AS not_null, d.adbin AS column_default FROM classes c"
    " JOIN namespaces n ON n.oid = c.relnamespace JOIN attributes a ON a.attrelid = c.oid LEFT JOIN attrdefs d ON d.adrelid = c.oid AND d.adnum = a.attnum"
    " WHERE n.nspname = 'public' AND c.relkind IN ('r', 'p') AND a.attnum > 0 AND NOT a.attisdropped",
)
def schema_snapshot(b: Bind):
    return G.schema_snapshot(b.classes(), b.namespaces(), b.attributes(), b.attrdefs())


@query(
    "q_join_scalar_counts", "classes namespaces attributes index_keys",
    "SELECT c.oid, c.relname, n.nspname, (SELECT count(*) FROM index_keys i WHERE i.indrelid = c.oid) AS index_count,"
    " (SELECT count(*) FROM attributes a WHERE a.attrelid = c.oid AND a.attnum > 0 AND NOT a.attisdropped) AS column_count FROM classes c JOIN namespaces n ON n.oid = c.relnamespace"
    " WHERE n.nspname NOT IN ('pg_catalog', 'information_schema', 'pg_toast') AND c.relkind IN ('r', 'p')",
)
def join_scalar_counts(b: Bind):
    t = G.table_inventory(b.classes(), b.namespaces(), b.attributes(), b.index_keys(), rules.SYSTEM_SCHEMAS)
    return t.select("oid", "relname", "nspname", "index_count", "column_count")


@query(
    "q_join_catalog_chain", "classes namespaces constraints",
    "SELECT n.nspname, c.relname, k.conname FROM constraints k JOIN classes c ON c.oid = k.conrelid JOIN namespaces n ON n.oid = c.relnamespace WHERE n.nspname <> 'pg_catalog'",
)
def join_catalog_chain(b: Bind):
    spaces = b.namespaces().where("nspname <> 'pg_catalog'").withColumnRenamed("oid", "relnamespace")
    tables = b.classes().join(spaces, "relnamespace").withColumnRenamed("oid", "conrelid")
    return b.constraints().join(tables, "conrelid").select("nspname", "relname", "conname")


@query(
    "q_agg_catalog_inventory", "catalog_objects",
    "SELECT c_custkey AS db_id, coalesce(schemas, 0) AS schemas, coalesce(total_bytes, 0) AS total_bytes, " + ", ".join(f"coalesce({k}, 0) AS {k}" for k in OBJECT_KINDS)
    + " FROM customer LEFT JOIN (SELECT db_id, count(DISTINCT schema_name) AS schemas, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in OBJECT_KINDS) + " FROM catalog_objects GROUP BY db_id) o ON o.db_id = c_custkey",
)
def agg_catalog_inventory(b: Bind):
    return G.catalog_inventory(b.catalog_objects(), b.table("customer").select(F.col("c_custkey").alias("db_id")), OBJECT_KINDS)


@query(
    "q_agg_function_languages", "catalog_objects",
    "SELECT db_id, count(*) AS functions, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM catalog_objects WHERE kind = 'functions' AND language <> 'internal' GROUP BY db_id",
)
def agg_function_languages(b: Bind):
    return G.functions_of(b.catalog_objects())


@query(
    "q_agg_collations", "attributes",
    "SELECT attrelid, count(*) AS columns FROM attributes WHERE attnum > 0 AND NOT attisdropped AND collname NOT IN ('default', 'C', 'POSIX', 'C.UTF-8', 'en_US.UTF-8') GROUP BY ALL",
)
def agg_collations(b: Bind):
    return G.non_default_collations(b.attributes(), rules.DEFAULT_COLLATIONS).groupBy("attrelid").agg(F.count("*").alias("columns"))


@query(
    "q_index_usage", "index_stats",
    "SELECT indexrelid, index_name, idx_scan, index_size_bytes FROM index_stats ORDER BY idx_scan DESC, indexrelid",
)
def index_usage(b: Bind):
    return G.index_usage(b.index_stats()).select("indexrelid", "index_name", "idx_scan", "index_size_bytes")


@query("q_database_size", "catalog_objects", "SELECT db_id, CAST(sum(size_bytes) AS BIGINT) AS db_size_bytes FROM catalog_objects GROUP BY db_id")
def database_size(b: Bind):
    return G.database_size(b.catalog_objects())
