"""Streaming forms of the operators: each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opslens.functions.exprs import mean
from opslens.operators import alerts


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarked frame; a timestamp without zone is cast first, since watermarks need one with."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _samples() -> list:
    v = F.col("metric_value")
    return [
        F.count("*").alias("n"),
        mean(v).alias("avg_value"),
        F.min(v).cast("double").alias("min_value"),
        F.max(v).cast("double").alias("max_value"),
    ]


def tumbling_trend(samples: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Trend per metric and window; a window is final once the watermark passes its end."""
    w = F.window("snapshot_timestamp", width)
    out = event_time(samples, "snapshot_timestamp", delay).groupBy("metric_name", w.alias("w")).agg(*_samples())
    return out.select("metric_name", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "avg_value", "min_value", "max_value")


def sliding_mean(samples: DataFrame, width: str = "2 hours", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Recent mean per metric in overlapping windows.

    A row falls into width / slide windows. Rows are first combined into windows of one slide, so that each of these,
    and not each row, is copied.
    """
    per_slide = (
        event_time(samples, "snapshot_timestamp", delay)
        .groupBy("metric_name", F.window("snapshot_timestamp", slide).alias("s"))
        .agg(F.count("metric_value").alias("n"), F.sum("metric_value").alias("v"))
        .select("metric_name", "n", "v", F.window_time("s").alias("at"))
    )
    out = per_slide.groupBy("metric_name", F.window("at", width, slide).alias("w")).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return out.select(
        "metric_name", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
        (F.col("v").cast("double") / F.col("n")).alias("avg_value"),
    )


def activity_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Activity sessions that end after an idle gap."""
    out = event_time(events, ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def threshold_alerts(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Alert rows from samples by a stream-static broadcast join."""
    return alerts.raise_alerts(alerts.evaluate(samples, thresholds))


def dedup(alerts_stream: DataFrame, keys: Sequence[str], ts: str, period: str = "1 hour") -> DataFrame:
    """No second alert for a key inside the watermark period."""
    return event_time(alerts_stream, ts, period).dropDuplicatesWithinWatermark(list(keys))


def event_counts(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("events"))


def branch_state(events: DataFrame) -> DataFrame:
    """Running fold of lifecycle events; a built-in aggregation, so it combines before the shuffle."""
    from opslens.operators.branches import current_state

    return current_state(events)


def replication_lag(commits: DataFrame, arrivals: DataFrame, key: str, bound: str, delay: str = "10 minutes", salts: int = 1) -> DataFrame:
    """Commits joined to their arrivals within a bound.

    commits (key, committed_at) has one row per key, so the join cannot multiply a hot key. With `salts`, the arrivals
    of a key spread over that many tasks and each commit is copied to all of them.
    """
    c = event_time(commits, "committed_at", delay).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("c")
    a = event_time(arrivals, "arrived_at", delay).withColumnRenamed(key, "_key")
    a = a.withColumn("_salt", F.pmod(F.xxhash64(*a.columns), F.lit(salts)).cast("int")).alias("a")
    on = F.expr(
        f"c.{key} = a._key AND c._salt = a._salt AND a.arrived_at >= c.committed_at AND a.arrived_at <= c.committed_at + INTERVAL {bound}"
    )
    lag = F.unix_micros("arrived_at") - F.unix_micros("committed_at")
    return c.join(a, on).select(key, "committed_at", "arrived_at", (lag / F.lit(1e6)).alias("lag_seconds"))


EXPIRY_DDL = "branch_id string, created_at timestamp, expired_at timestamp"


def branch_expiry(events: DataFrame, ttl_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Branches that outlive their lifetime without being deleted, by an event-time timer per branch.

    A branch lives from its newest creation unless a newer deletion is known, so (newest creation, newest deletion) is
    all its state and merges in any order. Timers need a custom stateful operator; its input is reduced before the
    shuffle to one row per branch and Arrow batch, so a busy branch does not send its events through one Python task.
    No state outlives its branch.
    """
    at = F.unix_micros(F.col("event_timestamp").cast("timestamp"))
    marks = events.where(F.col("event_type").isin("created", "deleted")).select(
        "branch_id",
        F.when(F.col("event_type") == "created", at).otherwise(-1).alias("created"),
        F.when(F.col("event_type") == "deleted", at).otherwise(-1).alias("deleted"),
        at.alias("seen"),
    )

    def combine(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.groupby("branch_id", as_index=False).max()

    reduced = marks.mapInPandas(combine, "branch_id string, created bigint, deleted bigint, seen bigint")
    timed = event_time(reduced.withColumn("at", F.timestamp_micros("seen")).drop("seen"), "at", delay)

    def fold(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            created, deleted = state.get
            state.remove()
            if created <= deleted:
                return
            start = pd.Timestamp(created, unit="us")
            yield pd.DataFrame({"branch_id": [key[0]], "created_at": [start], "expired_at": [start + pd.Timedelta(seconds=ttl_seconds)]})
            return
        created, deleted = state.get if state.exists else (-1, -1)
        for batch in batches:
            created, deleted = max(created, int(batch["created"].max())), max(deleted, int(batch["deleted"].max()))
        state.update((created, deleted))
        # a deleted branch is kept until the watermark has passed its deletion, when no older creation can come any more
        due = -(-created // 1000) + ttl_seconds * 1000 if created > deleted else -(-deleted // 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return timed.groupBy("branch_id").applyInPandasWithState(
        fold, EXPIRY_DDL, "created bigint, deleted bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
