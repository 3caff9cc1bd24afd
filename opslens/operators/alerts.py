"""Health metrics, threshold evaluation, routing and decisions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens import rules
from opslens.functions.exprs import case, instant, keyed_id, levels, safe_ratio
from opslens.functions.spread import same_keys


def health_metrics(db_stats: DataFrame, sessions: DataFrame, tables: DataFrame, locks: DataFrame, io: DataFrame, wal: DataFrame, connection_limit: int = 100) -> DataFrame:
    """All health metrics per branch, one wide row; every source is aggregated before the join.

    Cumulative counters are summed over the rows given, so pass one snapshot per branch.
    """
    key = ["project_id", "branch_id"]
    hit, read = F.sum("blks_hit"), F.sum("blks_read")
    db = db_stats.groupBy(*key).agg(
        safe_ratio(hit, hit + read, 1.0).alias("cache_hit_ratio"),
        F.sum("deadlocks").cast("double").alias("deadlocks"),
        F.sum("numbackends").cast("double").alias("active_connections"),
        F.max("xid_age").cast("double").alias("txid_age"),
    )
    state = F.col("state")
    conn = sessions.groupBy(*key).agg(
        (F.count("*") / F.lit(float(connection_limit))).alias("connection_utilization"),
        F.count_if(state == "idle").cast("double").alias("idle_connections"),
        F.count_if(state == "idle in transaction").cast("double").alias("idle_in_transaction"),
        F.count_if(state == "active").cast("double").alias("active_queries"),
    )
    ratio = safe_ratio(F.col("n_dead_tup"), F.col("n_live_tup") + F.col("n_dead_tup"), 0.0)
    dead = tables.withColumn("_r", ratio).groupBy(*key).agg(
        F.max("_r").alias("max_dead_tuple_ratio"),
        F.max_by("relname", F.struct("_r", "relname")).alias("worst_dead_tuple_table"),
    )
    lock = locks.groupBy(*key).agg(F.count_if(~F.col("granted")).cast("double").alias("waiting_locks"))
    reads, hits = F.sum("reads"), F.sum("hits")
    disk = io.where(F.col("backend_type") == "client backend").groupBy(*key).agg(
        safe_ratio(hits, hits + reads, 1.0).alias("io_hit_ratio"),
        F.sum("read_time").cast("double").alias("io_read_time_ms"),
        F.sum("write_time").cast("double").alias("io_write_time_ms"),
    )
    log = wal.groupBy(*key).agg(
        F.sum("wal_bytes").cast("double").alias("wal_bytes_generated"),
        F.sum("wal_buffers_full").cast("double").alias("wal_buffers_full"),
        F.sum("wal_write_time").cast("double").alias("wal_write_time_ms"),
    )
    out = db
    for part in (conn, dead, lock, disk, log):
        values = [c for c in part.columns if c not in key]
        out = out.alias("o").join(part.alias("p"), same_keys("o", "p", key), "left").select("o.*", *[f"p.{c}" for c in values])
    return out


def evaluate(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Level of each sample by its metric's thresholds; `none` where the metric has no rule, null values dropped."""
    value = F.col("metric_value").cast("double")
    return (
        samples.where(F.col("metric_value").isNotNull())
        .join(thresholds, "metric_name", "left")
        .withColumn(
            "threshold_level",
            F.when(F.col("warning").isNull(), "none").otherwise(
                levels(value, F.col("warning"), F.col("critical"), F.col("above"))
            ),
        )
        .drop("warning", "critical", "above")
    )


def thresholds(spark) -> DataFrame:
    return rules.rule_table(spark, "metric_name string, warning double, critical double, above boolean", rules.THRESHOLDS)


def route(alerts: DataFrame, severity: str = "severity") -> DataFrame:
    """Channels per alert by severity."""
    channels = rules.rule_table(alerts.sparkSession, f"{severity} string, channels_sent array<string>", rules.CHANNELS)
    return alerts.join(channels, severity, "left")


def alert_rules(samples: DataFrame, checks: DataFrame, as_of: datetime) -> DataFrame:
    """Stored alert rules over recent samples and sync checks: matching rows per rule, and whether it fires.

    All metric rules run in one join of samples and rules; only rows inside the longest look-back are read.
    """
    from opslens.operators.history import since

    spark = samples.sparkSession
    table = rules.rule_table(
        spark, "rule string, metric_name string, bound double, above boolean, severity string, minutes int", rules.ALERT_RULES
    )
    longest = max(r[5] for r in rules.ALERT_RULES)
    recent = since(samples, "snapshot_timestamp", as_of, minutes=longest)
    value = F.col("metric_value").cast("double")
    age = (F.unix_micros(instant(samples, "snapshot_timestamp", as_of).cast("timestamp")) - F.unix_micros(F.col("snapshot_timestamp").cast("timestamp"))) / 6e7
    hits = (
        recent.join(table, "metric_name")
        .where(F.when(F.col("above"), value > F.col("bound")).otherwise(value < F.col("bound")))
        .where(age < F.col("minutes"))
        .groupBy("rule")
        .agg(F.count("*").alias("matching_rows"), F.count_distinct("project_id", "branch_id").alias("branches"))
    )
    rule, limit, severity, minutes = rules.FRESHNESS_RULE
    late = since(checks, "validated_at", as_of, minutes=minutes).where(F.col("freshness_lag_seconds") > limit)
    late = late.agg(F.count("*").alias("matching_rows"), F.count_distinct("source_table", "target_table").alias("branches"))
    named = table.select("rule", "severity").unionByName(rules.rule_table(spark, "rule string, severity string", [(rule, severity)]))
    return (
        named
        .join(hits.unionByName(late.withColumn("rule", F.lit(rule))), "rule", "left")
        .na.fill(0, ["matching_rows", "branches"])
        .withColumn("fires", F.col("matching_rows") > 0)
    )


def dedup_alerts(alerts: DataFrame, keys: Sequence[str], ts: str, period: str = "day", tie: str | None = None) -> DataFrame:
    """First alert per key and calendar period, and how many it stands for; a map-side combined aggregate."""
    rest = [c for c in alerts.columns if c not in keys]
    order = F.struct(ts, *([tie] if tie else []))
    return (
        alerts.groupBy(*keys, F.date_trunc(period, F.col(ts)).alias("_period"))
        .agg(F.min_by(F.struct(*rest), order).alias("_first"), F.count("*").alias("occurrences"))
        .select(*keys, "_first.*", "occurrences")
    )


def root_cause(breaches: DataFrame) -> DataFrame:
    """Probable causes and actions of critical breaches; unknown metrics get empty lists."""
    table = rules.rule_table(
        breaches.sparkSession,
        "metric_name string, probable_causes array<string>, recommended_actions array<string>, auto_fixable boolean",
        rules.CAUSES,
    )
    empty = F.array().cast("array<string>")
    return (
        breaches.where(F.col("threshold_level") == "critical")
        .join(table, "metric_name", "left")
        .withColumn("probable_causes", F.coalesce("probable_causes", empty))
        .withColumn("recommended_actions", F.coalesce("recommended_actions", empty))
        .withColumn("auto_fixable", F.coalesce("auto_fixable", F.lit(False)))
    )


def heal_decision(plans: DataFrame) -> DataFrame:
    """Decision only: low-risk vacuum and terminate actions count as remediated, other risks escalate."""
    action = F.lower("action")
    return plans.withColumn(
        "decision",
        case(
            (F.coalesce(F.col("risk_level"), F.lit("high")) != "low", "escalated"),
            (action.contains("vacuum") | action.contains("terminate"), "remediated"),
            default="unknown_action",
        ),
    )


def safe_action(breaches: DataFrame) -> DataFrame:
    """Low-risk action per breached metric; others are skipped."""
    table = rules.rule_table(breaches.sparkSession, "metric_name string, action string", rules.SAFE_ACTIONS)
    return (
        breaches.join(table, "metric_name", "left")
        .withColumn("action_status", F.when(F.col("action").isNull(), "skipped").otherwise("proposed"))
        .withColumn("action", F.coalesce("action", F.lit("unknown")))
    )


def raise_alerts(evaluated: DataFrame) -> DataFrame:
    """Alert rows with id and channels from evaluated samples beyond a limit."""
    bad = evaluated.where(F.col("threshold_level").isin("warning", "critical")).withColumn("severity", F.col("threshold_level"))
    return route(bad).withColumn("alert_id", keyed_id("project_id", "branch_id", "metric_name", "snapshot_timestamp", "severity"))
