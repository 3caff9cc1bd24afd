"""Queries on states, alerts and branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens import rules
from opslens.operators import alerts as A
from opslens.operators import branches as B
from opslens.operators import status as S
from opslens.plans.bind import Bind
from opslens.plans.registry import as_instant, query

_NOW = "(SELECT t FROM newest)"


@query(
    "q_agg_status_counts", "newest recommendations",
    "SELECT recommendation_type, confidence, count(*) AS n, count(*) FILTER (status = 'pending_review') AS pending_review, count(*) FILTER (status = 'approved') AS approved,"
    f" count(*) FILTER (status = 'executed') AS executed, count(*) FILTER (status = 'rejected') AS rejected FROM recommendations WHERE created_at > {_NOW} - INTERVAL 30 DAY GROUP BY ALL",
)
def agg_status_counts(b: Bind):
    return S.recommendation_status(b.recommendations(), b.now())


@query(
    "q_ord_case_rank", "recommendations",
    "SELECT recommendation_id, confidence, created_at, CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS place FROM recommendations WHERE status = 'pending_review'",
)
def ord_case_rank(b: Bind):
    return S.pending_actions(b.recommendations()).select("recommendation_id", "confidence", "created_at", "place")


@query(
    "q_agg_daily_ops", "newest operations",
    "SELECT CAST(CAST(executed_at AS DATE) AS TIMESTAMP) AS op_date, operation_type, count(*) AS operations, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed,"
    f" CAST(sum(duration_seconds) AS DOUBLE) / count(duration_seconds) AS avg_duration_s FROM operations WHERE executed_at > {_NOW} - INTERVAL 7 DAY GROUP BY ALL",
)
def agg_daily_ops(b: Bind):
    return as_instant(S.daily_operations(b.operations(), b.now()), "op_date")


@query(
    "q_vac_outcome", "operations",
    "SELECT table_name, operation_type, count(*) AS operations, CAST(sum(dead_tuples_before) AS BIGINT) AS dead_before, CAST(sum(dead_tuples_after) AS BIGINT) AS dead_after,"
    " coalesce(CAST(sum(dead_tuples_before) - sum(dead_tuples_after) AS DOUBLE) / nullif(CAST(sum(dead_tuples_before) AS DOUBLE), 0), 0.0) * 100 AS reclaimed_pct,"
    " CAST(sum(duration_seconds) AS DOUBLE) AS duration_seconds FROM operations GROUP BY ALL",
)
def vac_outcome(b: Bind):
    return S.operation_outcome(b.operations())


@query(
    "q_agg_branch_activity", "newest branch_events",
    "SELECT CAST(CAST(event_timestamp AS DATE) AS TIMESTAMP) AS event_date, event_type, count(*) AS events, count(DISTINCT branch_id) AS unique_branches FROM branch_events"
    f" WHERE event_timestamp > {_NOW} - INTERVAL 30 DAY GROUP BY ALL",
)
def agg_branch_activity(b: Bind):
    return as_instant(S.branch_activity(b.branch_events(), b.now()), "event_date")


@query(
    "q_agg_active_branches", "branch_events",
    "SELECT project_id, count(DISTINCT CASE WHEN event_type = 'created' THEN branch_id END) - count(DISTINCT CASE WHEN event_type = 'deleted' THEN branch_id END) AS active_branches,"
    " count(DISTINCT CASE WHEN is_protected THEN branch_id END) AS protected_branches, max(event_timestamp) AS last_activity FROM branch_events GROUP BY project_id",
)
def agg_active_branches(b: Bind):
    return S.active_branches(b.branch_events())


@query(
    "q_agg_archival", "archive_log",
    "SELECT CAST(CAST(archived_at AS DATE) AS TIMESTAMP) AS archive_date, source_table, CAST(sum(rows_archived) AS BIGINT) AS total_rows_archived, CAST(sum(bytes_reclaimed) AS BIGINT) AS total_bytes_reclaimed,"
    " CAST(sum(bytes_reclaimed) AS DOUBLE) / 1048576.0 AS mb_reclaimed, count(*) AS operations FROM archive_log WHERE status = 'success' GROUP BY ALL",
)
def agg_archival(b: Bind):
    return as_instant(S.archival_summary(b.archive_log()), "archive_date")


_STATES = (
    "count(*) AS total_connections, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'idle') AS idle,"
    " count(*) FILTER (state = 'idle in transaction') AS idle_in_transaction, count(*) / 100.0::DOUBLE AS utilisation"
)


@query(
    "q_agg_conn_states", "sessions",
    f"SELECT project_id, branch_id, {_STATES} FROM sessions WHERE backend_type = 'client backend' GROUP BY ALL",
)
def agg_conn_states(b: Bind):
    return S.session_states(b.sessions(), ["project_id", "branch_id"])


@query(
    "q_idle_sessions", "newest sessions",
    f"SELECT pid, project_id, branch_id, s AS idle_seconds, s / 60 AS idle_minutes FROM (SELECT *, (epoch_us({_NOW}) - epoch_us(state_change)) / 1e6 AS s FROM sessions WHERE state = 'idle') WHERE s > 1800",
)
def idle_sessions(b: Bind):
    return S.idle_sessions(b.sessions(), b.now()).select("pid", "project_id", "branch_id", "idle_seconds", "idle_minutes")


@query(
    "q_agg_alert_summary", "alerts",
    "SELECT project_id, count(*) AS total_alerts, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'critical') AS critical,"
    " count(*) FILTER (auto_remediated) AS auto_remediated, CAST(count(*) FILTER (auto_remediated) AS DOUBLE) / count(*) AS remediation_rate FROM alerts GROUP BY ALL",
)
def agg_alert_summary(b: Bind):
    return S.alert_summary(b.alerts(), ["project_id"])


@query(
    "q_agg_task_summary", "tasks",
    "SELECT agent, count(*) AS tasks, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,"
    " CAST(count(*) FILTER (status = 'success') AS DOUBLE) / count(*) AS success_rate FROM tasks GROUP BY ALL",
)
def agg_task_summary(b: Bind):
    return S.task_summary(b.tasks())


@query(
    "q_agg_run_rollup", "runs",
    "WITH s AS (SELECT job_id, run_id % 64 AS batch, CASE WHEN life_cycle IN ('PENDING', 'QUEUED', 'WAITING_FOR_RETRY') THEN 'pending' WHEN life_cycle IN ('RUNNING', 'TERMINATING') THEN 'running'"
    " WHEN life_cycle = 'TERMINATED' AND result = 'SUCCESS' THEN 'completed' WHEN life_cycle IN ('TERMINATED', 'SKIPPED', 'INTERNAL_ERROR') THEN 'failed' ELSE 'unknown' END AS status FROM runs)"
    " SELECT job_id, batch, count(*) AS runs, CASE WHEN NOT bool_and(status IN ('completed', 'failed', 'error')) THEN 'running' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'failed' END AS overall"
    " FROM s GROUP BY ALL",
)
def agg_run_rollup(b: Bind):
    return S.run_rollup(b.runs().withColumn("batch", F.col("run_id") % 64), ["job_id", "batch"])


@query(
    "q_agg_step_rollup", "tasks",
    "SELECT agent, user_id, count(*) AS steps, bool_and(status IN ('success', 'pending')) AS passed FROM tasks GROUP BY ALL",
)
def agg_step_rollup(b: Bind):
    return S.step_rollup(b.tasks(), ["agent", "user_id"])


@query(
    "q_agg_sync_rollup", "sync_checks",
    "SELECT source_table, count(*) AS pairs, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status <> 'healthy') AS issues FROM sync_checks GROUP BY ALL",
)
def agg_sync_rollup(b: Bind):
    return S.sync_rollup(b.sync_checks(), ["source_table"])


# ---- alerts --------------------------------------------------------------------------------------------------------


def _level(value: str = "metric_value") -> str:
    """CASE over the rule values for the check."""
    arms = []
    for metric, warning, critical, above in rules.THRESHOLDS:
        op = ">" if above else "<"
        arms.append(f"WHEN metric_name = '{metric}' THEN CASE WHEN {value} {op} {critical} THEN 'critical' WHEN {value} {op} {warning} THEN 'warning' ELSE 'normal' END")
    return f"CASE {' '.join(arms)} ELSE 'none' END"


_LEVELLED = f"lv AS (SELECT event_id, project_id, branch_id, metric_name, CAST(metric_value AS DOUBLE) AS metric_value, snapshot_timestamp, {_level('CAST(metric_value AS DOUBLE)')} AS threshold_level FROM metric_samples)"


def _evaluated(b: Bind):
    return A.evaluate(b.metric_samples().withColumn("metric_value", F.col("metric_value").cast("double")), A.thresholds(b.spark))


@query("q_threshold_eval", "metric_samples", f"WITH {_LEVELLED} SELECT event_id, metric_name, metric_value, threshold_level FROM lv")
def threshold_eval(b: Bind):
    return _evaluated(b).select("event_id", "metric_name", "metric_value", "threshold_level")


@query(
    "q_alert_route", "alerts",
    "SELECT alert_id, severity, CASE severity WHEN 'info' THEN 'log' WHEN 'warning' THEN 'slack,log' WHEN 'critical' THEN 'slack,pagerduty,log' END AS channels FROM alerts",
)
def alert_route(b: Bind):
    return A.route(b.alerts()).select("alert_id", "severity", F.array_join("channels_sent", ",").alias("channels"))


def _alert_rule_sql() -> str:
    parts = []
    for rule, metric, bound, above, severity, minutes in rules.ALERT_RULES:
        op = ">" if above else "<"
        parts.append(
            f"SELECT '{rule}' AS rule, '{severity}' AS severity, count(*) AS matching_rows, count(DISTINCT project_id || '/' || branch_id) AS branches, count(*) > 0 AS fires FROM metric_samples"
            f" WHERE metric_name = '{metric}' AND CAST(metric_value AS DOUBLE) {op} {bound} AND snapshot_timestamp > {_NOW} - INTERVAL {minutes} MINUTE"
        )
    rule, limit, severity, minutes = rules.FRESHNESS_RULE
    parts.append(
        f"SELECT '{rule}' AS rule, '{severity}' AS severity, count(*) AS matching_rows, count(DISTINCT source_table || '/' || target_table) AS branches, count(*) > 0 AS fires FROM sync_checks"
        f" WHERE freshness_lag_seconds > {limit} AND validated_at > {_NOW} - INTERVAL {minutes} MINUTE"
    )
    return " UNION ALL ".join(parts)


@query("q_alert_rules_sql", "newest metric_samples sync_checks", _alert_rule_sql())
def alert_rules_sql(b: Bind):
    return A.alert_rules(b.metric_samples(), b.sync_checks(), b.now())


@query(
    "q_alert_dedup", "metric_samples",
    f"WITH {_LEVELLED} SELECT project_id, branch_id, metric_name, threshold_level, arg_min(event_id, snapshot_timestamp) AS event_id, min(snapshot_timestamp) AS snapshot_timestamp, count(*) AS occurrences"
    " FROM lv WHERE threshold_level IN ('warning', 'critical') GROUP BY project_id, branch_id, metric_name, threshold_level, date_trunc('day', snapshot_timestamp)",
)
def alert_dedup(b: Bind):
    bad = _evaluated(b).where("threshold_level IN ('warning', 'critical')").select("project_id", "branch_id", "metric_name", "threshold_level", "event_id", "snapshot_timestamp")
    return A.dedup_alerts(bad, ["project_id", "branch_id", "metric_name", "threshold_level"], "snapshot_timestamp", tie="event_id")


@query(
    "q_root_cause", "metric_samples",
    f"WITH {_LEVELLED} SELECT event_id, metric_name, CASE metric_name WHEN 'cache_hit_ratio' THEN 3 WHEN 'max_dead_tuple_ratio' THEN 2 ELSE 0 END AS causes,"
    " CASE metric_name WHEN 'cache_hit_ratio' THEN 'add memory|index the scanned tables|prewarm the cache' WHEN 'max_dead_tuple_ratio' THEN"
    " 'vacuum and analyze the table|tune autovacuum|end old transactions' ELSE '' END AS actions, metric_name = 'max_dead_tuple_ratio' AS auto_fixable FROM lv WHERE threshold_level = 'critical'",
)
def root_cause(b: Bind):
    return A.root_cause(_evaluated(b)).select(
        "event_id", "metric_name", F.size("probable_causes").alias("causes"), F.array_join("recommended_actions", "|").alias("actions"), "auto_fixable"
    )


@query(
    "q_heal_decision", "operations",
    "SELECT operation_id, CASE WHEN coalesce(CASE operation_id % 4 WHEN 0 THEN 'high' WHEN 3 THEN NULL ELSE 'low' END, 'high') <> 'low' THEN 'escalated' WHEN contains(lower(operation_type), 'vacuum') THEN 'remediated' ELSE 'unknown_action' END AS decision FROM operations",
)
def heal_decision(b: Bind):
    plans = b.operations().selectExpr("operation_id", "operation_type AS action", "CASE operation_id % 4 WHEN 0 THEN 'high' WHEN 3 THEN NULL ELSE 'low' END AS risk_level")
    return A.heal_decision(plans).select("operation_id", "decision")


@query(
    "q_sop_choice", "metric_samples",
    f"WITH {_LEVELLED} SELECT event_id, CASE metric_name WHEN 'max_dead_tuple_ratio' THEN 'vacuum_analyze' WHEN 'connection_utilization' THEN 'terminate_idle_connections' WHEN 'txid_age' THEN 'vacuum_freeze'"
    " ELSE 'unknown' END AS action, CASE WHEN metric_name IN ('max_dead_tuple_ratio', 'connection_utilization', 'txid_age') THEN 'proposed' ELSE 'skipped' END AS action_status FROM lv WHERE threshold_level = 'critical'",
)
def sop_choice(b: Bind):
    return A.safe_action(_evaluated(b).where("threshold_level = 'critical'")).select("event_id", "action", "action_status")


_HEALTH = ["cache_hit_ratio", "deadlocks", "active_connections", "txid_age", "connection_utilization", "idle_connections", "idle_in_transaction", "active_queries", "max_dead_tuple_ratio", "waiting_locks", "io_hit_ratio", "io_read_time_ms", "io_write_time_ms", "wal_bytes_generated", "wal_buffers_full", "wal_write_time_ms"]


@query(
    "q_health_metrics", "query_stats sessions operations",
    "WITH db AS (SELECT project_id, branch_id, coalesce(CAST(sum(shared_blks_hit) AS DOUBLE) / nullif(CAST(sum(shared_blks_hit) + sum(shared_blks_read) AS DOUBLE), 0), 1.0) AS cache_hit_ratio,"
    " CAST(sum(event_id % 3) AS DOUBLE) AS deadlocks, CAST(sum(calls) AS DOUBLE) AS active_connections, CAST(max(calls * 20000000) AS DOUBLE) AS txid_age FROM query_stats GROUP BY ALL),"
    " c AS (SELECT project_id, branch_id, count(*) / 100.0::DOUBLE AS connection_utilization, CAST(count(*) FILTER (state = 'idle') AS DOUBLE) AS idle_connections, CAST(count(*) FILTER (state = 'idle in transaction') AS DOUBLE) AS idle_in_transaction,"
    " CAST(count(*) FILTER (state = 'active') AS DOUBLE) AS active_queries FROM sessions GROUP BY ALL),"
    " d AS (SELECT project_id, branch_id, max(coalesce(CAST(dead_tuples_after AS DOUBLE) / nullif(CAST(dead_tuples_before + dead_tuples_after AS DOUBLE), 0), 0.0)) AS max_dead_tuple_ratio,"
    " CAST(count(*) FILTER (status = 'failed') AS DOUBLE) AS waiting_locks FROM operations GROUP BY ALL),"
    " i AS (SELECT project_id, branch_id, coalesce(CAST(sum(shared_blks_hit) AS DOUBLE) / nullif(CAST(sum(shared_blks_hit) + sum(shared_blks_read) AS DOUBLE), 0), 1.0) AS io_hit_ratio, CAST(sum(total_exec_time) AS DOUBLE) AS io_read_time_ms,"
    " CAST(sum(mean_exec_time) AS DOUBLE) AS io_write_time_ms, CAST(sum(calls) AS DOUBLE) AS wal_bytes_generated, CAST(sum(\"rows\") AS DOUBLE) AS wal_buffers_full, CAST(sum(mean_exec_time) AS DOUBLE) AS wal_write_time_ms FROM query_stats GROUP BY ALL),"
    " w AS (SELECT * FROM db JOIN c USING (project_id, branch_id) JOIN d USING (project_id, branch_id) JOIN i USING (project_id, branch_id))"
    f" SELECT project_id, branch_id, metric_name, metric_value FROM w UNPIVOT (metric_value FOR metric_name IN ({', '.join(_HEALTH)}))",
)
def health_metrics(b: Bind):
    from opslens.operators.history import unpivot_metrics

    qs, ops = b.query_stats(), b.operations()
    key = ["project_id", "branch_id"]
    db = qs.select(*key, F.col("shared_blks_hit").alias("blks_hit"), F.col("shared_blks_read").alias("blks_read"), (F.col("event_id") % 3).alias("deadlocks"), F.col("calls").alias("numbackends"), (F.col("calls") * 20_000_000).alias("xid_age"))
    tables = ops.select(*key, F.col("table_name").alias("relname"), F.col("dead_tuples_before").alias("n_live_tup"), F.col("dead_tuples_after").alias("n_dead_tup"))
    locks = ops.select(*key, (F.col("status") != "failed").alias("granted"))
    io = qs.select(*key, F.lit("client backend").alias("backend_type"), F.col("shared_blks_read").alias("reads"), F.col("shared_blks_hit").alias("hits"), F.col("total_exec_time").alias("read_time"), F.col("mean_exec_time").alias("write_time"))
    wal = qs.select(*key, F.col("calls").alias("wal_bytes"), F.col("rows").alias("wal_buffers_full"), F.col("mean_exec_time").alias("wal_write_time"))
    return unpivot_metrics(A.health_metrics(db, b.sessions(), tables, locks, io, wal), key)


# ---- branches ------------------------------------------------------------------------------------------------------

_STATE = (
    "st AS (SELECT project_id, branch_id, max(event_timestamp) FILTER (event_type = 'created') AS created_at, arg_max(event_type, event_timestamp) FILTER (event_type IN ('created', 'deleted')) AS l,"
    " bool_or(event_type = 'protected') AS is_protected, count(*) FILTER (event_type = 'reset') AS resets, max(event_timestamp) AS last_activity, arg_max(actor, event_timestamp) AS last_actor FROM branch_events GROUP BY ALL),"
    " state AS (SELECT *, CASE l WHEN 'deleted' THEN 'deleted' WHEN 'created' THEN 'active' ELSE 'unknown' END AS state FROM st)"
)


def _ttl_case() -> str:
    arms = " ".join(f"WHEN starts_with(branch_id, '{p}') THEN {'NULL' if s is None else s}" for _, p, s in rules.TTL_RULES)
    return f"CAST(CASE {arms} ELSE NULL END AS BIGINT)"


@query("q_br_current_state", "branch_events", f"WITH {_STATE} SELECT project_id, branch_id, created_at, is_protected, resets, last_activity, last_actor, state FROM state")
def br_current_state(b: Bind):
    return B.current_state(b.branch_events())


_EXPIRY = f"ex AS (SELECT *, {_ttl_case()} AS ttl_seconds, (epoch_us({_NOW}) - epoch_us(created_at)) / 1e6 AS age_seconds FROM state)"


@query(
    "q_br_ttl_expired", "newest branch_events",
    f"WITH {_STATE}, {_EXPIRY} SELECT project_id, branch_id, ttl_seconds, age_seconds, CASE WHEN state = 'active' AND age_seconds > ttl_seconds AND NOT is_protected THEN 'delete' ELSE 'keep' END AS verdict FROM ex",
)
def br_ttl_expired(b: Bind):
    e = B.expired(B.current_state(b.branch_events()), "branch_id", b.now())
    return e.select("project_id", "branch_id", "ttl_seconds", "age_seconds", "verdict")


@query("q_join_prefix_theta", "branch_events", f"SELECT DISTINCT branch_id, {_ttl_case()} AS ttl_seconds FROM branch_events")
def join_prefix_theta(b: Bind):
    table = rules.rule_table(b.spark, "place int, prefix string, seconds bigint", rules.TTL_RULES)
    return B.ttl_by_rule_table(b.branch_events().select("branch_id").distinct(), "branch_id", ["branch_id"], table)


@query(
    "q_br_expiring_soon", "newest branch_events",
    f"WITH {_STATE}, {_EXPIRY} SELECT project_id, branch_id, CAST(floor(age_seconds / 86400) AS BIGINT) AS age_days, ttl_seconds / 86400.0::DOUBLE AS ttl_days FROM ex WHERE state = 'active' AND ttl_seconds IS NOT NULL"
    " AND floor(age_seconds / 86400) >= ttl_seconds / 86400.0::DOUBLE - 2",
)
def br_expiring_soon(b: Bind):
    e = B.expiring_soon(B.current_state(b.branch_events()), "branch_id", b.now())
    return e.select("project_id", "branch_id", "age_days", "ttl_days")


@query(
    "q_br_utilisation", "branch_events",
    f"WITH {_STATE} SELECT project_id, count(*) FILTER (state = 'active') AS live_branches, count(*) FILTER (state = 'active') * 100.0::DOUBLE / 10 AS utilisation_pct,"
    " CASE WHEN count(*) FILTER (state = 'active') * 10 >= 90 THEN 'critical' WHEN count(*) FILTER (state = 'active') * 10 >= 80 THEN 'warning' ELSE 'normal' END AS level FROM state GROUP BY ALL",
)
def br_utilisation(b: Bind):
    u = B.utilisation(B.current_state(b.branch_events()))
    return u.withColumn("utilisation_pct", F.col("utilisation_pct").cast("double"))


@query(
    "q_br_age_histogram", "newest branch_events",
    f"WITH {_STATE}, a AS (SELECT (epoch_us({_NOW}) - epoch_us(created_at)) / 1e6 / 86400 AS d FROM state WHERE state.state = 'active') SELECT CASE WHEN d < 1 THEN '0-1d' WHEN d < 7 THEN '1-7d' WHEN d < 14 THEN '7-14d'"
    " WHEN d < 30 THEN '14-30d' ELSE '30d+' END AS bucket, count(*) AS branches FROM a GROUP BY ALL",
)
def br_age_histogram(b: Bind):
    return B.age_histogram(B.current_state(b.branch_events()), b.now())


@query(
    "q_br_creation_rate", "branch_events",
    "SELECT CAST(CAST(event_timestamp AS DATE) AS TIMESTAMP) AS day, count(*) FILTER (event_type = 'created') AS created, count(*) FILTER (event_type = 'deleted') AS deleted FROM branch_events WHERE event_type IN ('created', 'deleted') GROUP BY ALL",
)
def br_creation_rate(b: Bind):
    return as_instant(B.creation_rate(b.branch_events()), "day")


@query(
    "q_br_ttl_compliance", "newest branch_events",
    f"WITH {_STATE}, {_EXPIRY} SELECT CASE WHEN ttl_seconds IS NULL THEN 'no_ttl' WHEN age_seconds > ttl_seconds THEN 'expired' ELSE 'compliant' END AS status, count(*) AS branches FROM ex WHERE ex.state = 'active' GROUP BY ALL",
)
def br_ttl_compliance(b: Bind):
    return B.ttl_compliance(B.current_state(b.branch_events()), "branch_id", b.now())


@query(
    "q_br_policy_check", "branch_requests",
    "WITH v AS (SELECT event_id, concat_ws(',', CASE WHEN length(name) > 63 THEN 'max_length' END, CASE WHEN length(name) < 3 THEN 'min_length' END,"
    " CASE WHEN NOT regexp_matches(name, '^[a-z][a-z0-9-]*[a-z0-9]$') THEN 'allowed_pattern' END, CASE WHEN unarchived >= 10 THEN 'max_unarchived_branches' END,"
    " CASE WHEN current_count >= 500 THEN 'max_branches_per_project' END, CASE WHEN creator_type NOT IN ('human', 'agent', 'ci') THEN 'valid_creator_types' END) AS violations,"
    " concat_ws(',', CASE WHEN NOT regexp_matches(name, '^(ci|hotfix|perf|feat|dev|demo|qa|audit|ai-agent)') AND name NOT IN ('production', 'staging') THEN 'prefixes' END,"
    " CASE WHEN unarchived = 9 THEN 'critical_threshold' WHEN unarchived = 8 OR unarchived >= 10 THEN 'warning_threshold' END) AS warnings FROM branch_requests)"
    " SELECT event_id, violations, warnings, violations = '' AS allowed FROM v",
)
def br_policy_check(b: Bind):
    return B.policy_check(b.branch_requests()).select(
        "event_id", F.array_join("violations", ",").alias("violations"), F.array_join("warnings", ",").alias("warnings"), "allowed"
    )


@query(
    "q_br_protection_check", "branch_requests",
    "WITH v AS (SELECT event_id, operation, target, CASE WHEN operation = 'delete' AND target IN ('production', 'staging') THEN 'prevent_deletion'"
    " WHEN operation = 'reset' AND ((target = 'staging' AND source_branch <> 'production') OR (target = 'development' AND source_branch <> 'staging')) THEN 'allowed_reset_sources'"
    " WHEN operation = 'migrate' AND target IN ('production', 'staging') THEN 'prevent_direct_migration' ELSE '' END AS violation FROM branch_requests)"
    " SELECT event_id, violation, operation = 'reset' AND target IN ('production', 'staging') AS needs_approval, violation = '' AS allowed FROM v",
)
def br_protection_check(b: Bind):
    r = b.branch_requests().select("event_id", F.col("target").alias("name"), "operation", "source_branch")
    return B.protection_check(r).select("event_id", "violation", "needs_approval", "allowed")


@query(
    "q_br_name_sanitise", "",
    "WITH n AS (SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(url), '[^a-z0-9-]', '-', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g'), 1, 63) AS name FROM pages) SELECT page_id, name, name = '' AS is_empty FROM n",
)
def br_name_sanitise(b: Bind):
    return B.sanitise(b.table("pages").select("page_id", "url"), "url").select("page_id", "name", "is_empty")


@query(
    "q_br_storage", "catalog_objects",
    "SELECT 'b' || (db_id % 40) AS branch_id, CAST(sum(size_bytes) AS DOUBLE) / 1048576.0 AS storage_mb, count(*) AS objects FROM catalog_objects GROUP BY ALL",
)
def br_storage(b: Bind):
    objects = b.catalog_objects().withColumn("branch_id", F.concat(F.lit("b"), F.col("db_id") % 40))
    return objects.groupBy("branch_id").agg((F.sum("size_bytes").cast("double") / 1048576.0).alias("storage_mb"), F.count("*").alias("objects"))


@query(
    "q_session_details", "newest sessions",
    f"SELECT pid, project_id, branch_id, state, state_change, (epoch_us({_NOW}) - epoch_us(state_change)) / 1e6 AS idle_seconds FROM sessions WHERE backend_type = 'client backend'",
)
def session_details(b: Bind):
    return S.session_details(b.sessions(), b.now()).select("pid", "project_id", "branch_id", "state", "state_change", "idle_seconds")
