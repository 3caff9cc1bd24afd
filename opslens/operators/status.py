"""Counts and rollups of states: recommendations, operations, branches, alerts, tasks, runs, sessions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import case, instant, mean, safe_ratio, seconds_between, total
from opslens.operators.history import since


def recommendation_status(recs: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Recommendations per type and confidence, by state."""
    states = ("pending_review", "approved", "executed", "rejected")
    return (
        since(recs, "created_at", as_of, days=days)
        .groupBy("recommendation_type", "confidence")
        .agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    )


def pending_actions(recs: DataFrame) -> DataFrame:
    """Recommendations to review: high confidence first, then medium, then the rest; newest first."""
    place = case((F.col("confidence") == "high", 1), (F.col("confidence") == "medium", 2), default=3)
    return recs.where(F.col("status") == "pending_review").withColumn("place", place).orderBy(
        "place", F.desc("created_at"), "recommendation_id"
    )


def daily_operations(ops: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Operations per day and kind."""
    return (
        since(ops, "executed_at", as_of, days=days)
        .groupBy(F.to_date("executed_at").alias("op_date"), "operation_type")
        .agg(
            F.count("*").alias("operations"),
            F.count_if(F.col("status") == "success").alias("successful"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            mean(F.col("duration_seconds")).alias("avg_duration_s"),
        )
    )


def operation_outcome(ops: DataFrame) -> DataFrame:
    """Dead rows removed and time per table and kind of operation."""
    before, after = F.sum("dead_tuples_before"), F.sum("dead_tuples_after")
    return ops.groupBy("table_name", "operation_type").agg(
        F.count("*").alias("operations"),
        before.alias("dead_before"),
        after.alias("dead_after"),
        (safe_ratio(before - after, before, 0.0) * 100).alias("reclaimed_pct"),
        total(F.col("duration_seconds")).alias("duration_seconds"),
    )


def branch_activity(events: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Events and distinct branches per day and kind."""
    return (
        since(events, "event_timestamp", as_of, days=days)
        .groupBy(F.to_date("event_timestamp").alias("event_date"), "event_type")
        .agg(F.count("*").alias("events"), F.count_distinct("branch_id").alias("unique_branches"))
    )


def active_branches(events: DataFrame) -> DataFrame:
    """Created less deleted, protected, and last activity per project.

    One row per branch first; then plain sums, so no row is expanded once per distinct count.
    """
    per_branch = events.groupBy("project_id", "branch_id").agg(
        F.bool_or(F.col("event_type") == "created").alias("c"),
        F.bool_or(F.col("event_type") == "deleted").alias("d"),
        F.bool_or("is_protected").alias("p"),
        F.max("event_timestamp").alias("t"),
    )
    return per_branch.groupBy("project_id").agg(
        (F.count_if(F.col("c")) - F.count_if(F.col("d"))).alias("active_branches"),
        F.count_if(F.col("p")).alias("protected_branches"),
        F.max("t").alias("last_activity"),
    )


def archival_summary(log: DataFrame) -> DataFrame:
    """Rows and bytes archived per day and table, successful operations only."""
    size = F.sum("bytes_reclaimed")
    return (
        log.where(F.col("status") == "success")
        .groupBy(F.to_date("archived_at").alias("archive_date"), "source_table")
        .agg(
            F.sum("rows_archived").alias("total_rows_archived"),
            size.alias("total_bytes_reclaimed"),
            (size / F.lit(1048576.0)).alias("mb_reclaimed"),
            F.count("*").alias("operations"),
        )
    )


def alert_summary(alerts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alerts in total, per severity, and the share that was remediated automatically."""
    auto = F.count_if(F.col("auto_remediated"))
    return alerts.groupBy(*keys).agg(
        F.count("*").alias("total_alerts"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "critical")],
        auto.alias("auto_remediated"),
        safe_ratio(auto, F.count("*")).alias("remediation_rate"),
    )


def task_summary(tasks: DataFrame) -> DataFrame:
    """Tasks, successes, failures and success rate per agent."""
    ok = F.count_if(F.col("status") == "success")
    return tasks.groupBy("agent").agg(
        F.count("*").alias("tasks"),
        ok.alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        safe_ratio(ok, F.count("*")).alias("success_rate"),
    )


def run_status(runs: DataFrame) -> DataFrame:
    """Simple status of a run from its life cycle and result."""
    life = F.col("life_cycle")
    return runs.withColumn(
        "status",
        case(
            (life.isin("PENDING", "QUEUED", "WAITING_FOR_RETRY"), "pending"),
            (life.isin("RUNNING", "TERMINATING"), "running"),
            ((life == "TERMINATED") & (F.col("result") == "SUCCESS"), "completed"),
            (life.isin("TERMINATED", "SKIPPED", "INTERNAL_ERROR"), "failed"),
            default="unknown",
        ),
    )


def run_rollup(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overall state of a set of runs: running until all have ended."""
    s = F.col("status")
    done = F.bool_and(s.isin("completed", "failed", "error"))
    return (
        run_status(runs)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("runs"),
            done.alias("_done"),
            F.bool_and(s == "completed").alias("_all_ok"),
        )
        .select(
            *keys,
            "runs",
            case((~F.col("_done"), "running"), (F.col("_all_ok"), "completed"), default="failed").alias("overall"),
        )
    )


def step_rollup(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Passed when every step is ok or still pending."""
    return steps.groupBy(*keys).agg(
        F.count("*").alias("steps"), F.every(F.col("status").isin("success", "pending")).alias("passed")
    )


def sync_rollup(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table pairs, healthy ones and ones with an issue."""
    return checks.groupBy(*keys).agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("status") == "healthy").alias("healthy"),
        F.count_if(F.col("status") != "healthy").alias("issues"),
    )


def session_states(sessions: DataFrame, keys: Sequence[str], limit: int = 100) -> DataFrame:
    """Sessions by state and the share of the connection limit in use."""
    s = F.col("state")
    return (
        sessions.where(F.col("backend_type") == "client backend")
        .groupBy(*keys)
        .agg(
            F.count("*").alias("total_connections"),
            F.count_if(s == "active").alias("active"),
            F.count_if(s == "idle").alias("idle"),
            F.count_if(s == "idle in transaction").alias("idle_in_transaction"),
        )
        .withColumn("utilisation", F.col("total_connections") / F.lit(float(limit)))
    )


def session_details(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Client sessions with the seconds since their last change of state."""
    idle = seconds_between(instant(sessions, "state_change", as_of), F.col("state_change"))
    return sessions.where(F.col("backend_type") == "client backend").withColumn("idle_seconds", idle)


def idle_sessions(sessions: DataFrame, as_of: datetime, max_idle_seconds: float = 1800.0) -> DataFrame:
    """Idle sessions past the limit, with their idle minutes."""
    idle = seconds_between(instant(sessions, "state_change", as_of), F.col("state_change"))
    return (
        sessions.where(F.col("state") == "idle")
        .withColumn("idle_seconds", idle)
        .where(F.col("idle_seconds") > max_idle_seconds)
        .withColumn("idle_minutes", F.col("idle_seconds") / 60)
    )


def check_tables(frames: dict[str, DataFrame], min_rows: dict[str, int], required: dict[str, Sequence[str]], forbidden: dict[str, Sequence[str]]) -> DataFrame:
    """One row per table: rows, missing columns, columns that should be gone, verdict."""
    parts = []
    for name, df in frames.items():
        missing = sorted(set(required.get(name, ())) - set(df.columns))
        stale = sorted(set(forbidden.get(name, ())) & set(df.columns))
        ok = (F.col("rows") >= min_rows.get(name, 1)) & F.lit(not missing and not stale)
        parts.append(
            df.agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("table_name"),
                "rows",
                F.lit(",".join(missing)).alias("missing_columns"),
                F.lit(",".join(stale)).alias("stale_columns"),
                ok.alias("passed"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
