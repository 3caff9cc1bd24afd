"""Source and target reconciliation, freshness and replication lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import case, row_digest, seconds_between


def side_summary(df: DataFrame, pair: str, ts: str, key: str | None = None) -> DataFrame:
    """Rows (or distinct keys) and newest time per table pair."""
    n = F.count_distinct(key) if key else F.count("*")
    return df.groupBy(pair).agg(n.alias("n"), F.max(ts).alias("max_ts"))


def completeness(source: DataFrame, target: DataFrame, pair: str, max_drift: int = 1000, max_lag: float = 3600.0) -> DataFrame:
    """Counts, drift, lag and status per pair, from one summary row per pair and side.

    A pair that only one side has is missing_target or missing_source; stale wins over drift. Both sides are stacked and picked by side, so a
    null pair is a pair like any other.
    """
    return (
        _by_side(source, target, [pair], {"n": "count", "max_ts": "max_ts"})
        .na.fill(0, ["source_count", "target_count"])
        .withColumn("count_drift", F.abs(F.col("source_count") - F.col("target_count")))
        .withColumn("freshness_lag_seconds", seconds_between(F.col("source_max_ts"), F.col("target_max_ts")))
        .withColumn(
            "status",
            case(
                (F.col("has_target") == 0, "missing_target"),
                (F.col("has_source") == 0, "missing_source"),
                (F.col("freshness_lag_seconds") > max_lag, "stale"),
                (F.col("count_drift") > max_drift, "drift_detected"),
                default="healthy",
            ),
        )
        .withColumn("severity", case((F.col("status") == "healthy", "info"), (F.col("status") == "drift_detected", "warning"), default="critical"))
        .drop("has_source", "has_target")
    )


def _by_side(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """One row per key: each column of both sides as source_name and target_name, and has_source, has_target (0 or 1).

    Each side has one row per key; they are stacked and picked apart by an aggregate.
    """
    both = source.withColumn("side", F.lit("source")).unionByName(target.withColumn("side", F.lit("target")))
    sides = {s: F.col("side") == s for s in ("source", "target")}
    return both.groupBy(*keys).agg(
        *[F.max(F.when(is_side, F.col(c))).alias(f"{s}_{n}") for c, n in columns.items() for s, is_side in sides.items()],
        *[F.max(is_side.cast("int")).alias(f"has_{s}") for s, is_side in sides.items()],
    )


def both_totals(source: DataFrame, target: DataFrame) -> DataFrame:
    """Totals of both sides (n, max_ts) in one row: stacked and picked by side, so no join is needed."""
    both = source.withColumn("side", F.lit("source")).unionByName(target.withColumn("side", F.lit("target")))
    pick = [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{n}") for s in ("source", "target") for c, n in (("n", "count"), ("max_ts", "max_ts"))]
    return both.agg(*pick)


def checksum(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-free checksum and row count; a sum of row digests, so it combines on the map side."""
    return df.groupBy(*keys).agg(F.sum(row_digest(cols)).alias("checksum"), F.count("*").alias("rows"))


def integrity(source: DataFrame, target: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Checksums of both sides per key and whether they agree; a null key is a key like any other."""
    sides = _by_side(checksum(source, cols, keys), checksum(target, cols, keys), keys, {"checksum": "checksum", "rows": "rows"})
    return sides.drop("has_source", "has_target").withColumn("checksum_match", F.col("source_checksum").eqNullSafe(F.col("target_checksum")))


def reconcile_rows(source: DataFrame, target: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows only in the source, only in the target, or different, with duplicates respected.

    Both sides are stacked and counted per (key, digest) before anything is compared, so equal copies collapse on
    the map side and a hot key does not meet itself in a join.
    """
    def side(df: DataFrame, s: int, t: int) -> DataFrame:
        return df.select(*key, row_digest(cols).alias("digest"), F.lit(s).alias("s"), F.lit(t).alias("t"))

    per_row = (
        side(source, 1, 0)
        .unionByName(side(target, 0, 1))
        .groupBy(*key, "digest")
        .agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
        .where(F.col("s") != F.col("t"))
    )
    return (
        per_row.groupBy(*key)
        .agg(
            F.sum(F.greatest(F.col("s") - F.col("t"), F.lit(0))).alias("source_only_rows"),
            F.sum(F.greatest(F.col("t") - F.col("s"), F.lit(0))).alias("target_only_rows"),
        )
        .withColumn(
            "difference",
            case(
                (F.col("target_only_rows") == 0, "source_only"),
                (F.col("source_only_rows") == 0, "target_only"),
                default="changed",
            ),
        )
    )


def freshness(checks: DataFrame, continuous_hours: float = 1.0, batch_hours: float = 24.0) -> DataFrame:
    """Lag against the limit of the sync type."""
    limit = F.when(F.col("sync_type") == "continuous", continuous_hours * 3600).otherwise(batch_hours * 3600)
    return checks.withColumn("limit_seconds", limit).withColumn(
        "freshness", F.when(F.col("freshness_lag_seconds") > F.col("limit_seconds"), "stale").otherwise("fresh")
    )


def replication_lag(senders: DataFrame, warning: float = 60.0, critical: float = 300.0) -> DataFrame:
    """Bytes and seconds behind per replica, with a level."""
    lag = F.col("replay_lag_seconds")
    return senders.withColumn("sent_lag_bytes", F.col("sent_lsn") - F.col("replay_lsn")).withColumn(
        "status", case((lag > critical, "critical"), (lag > warning, "warning"), default="healthy")
    )


def receivers(senders: DataFrame) -> DataFrame:
    """Positions of each replica as reported."""
    return senders.select("project_id", "branch_id", "source_table", "sent_lsn", "replay_lsn", "checked_at")


def slot_retention(slots: DataFrame) -> DataFrame:
    """Retained and pending bytes per slot; a slot that never confirmed sorts last."""
    return slots.withColumn("retained_bytes", F.col("current_lsn") - F.col("restart_lsn")).withColumn(
        "pending_bytes", F.col("current_lsn") - F.col("confirmed_flush_lsn")
    )
