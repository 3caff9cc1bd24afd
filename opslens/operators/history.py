"""Analytics over the history tables: windows of time, top lists, trends, regressions, latest rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions.exprs import case, instant, mean, safe_ratio, total
from opslens.rules import ALLOWED_METRICS


def since(df: DataFrame, ts: str, as_of: datetime, **back: float) -> DataFrame:
    """Rows strictly later than as_of minus the given time."""
    return df.where(F.col(ts) > instant(df, ts, as_of - timedelta(**back)))


def between(df: DataFrame, ts: str, as_of: datetime, start: timedelta, end: timedelta) -> DataFrame:
    """Rows from as_of - start to as_of - end, both ends included."""
    return df.where(F.col(ts).between(instant(df, ts, as_of - start), instant(df, ts, as_of - end)))


def only_metrics(df: DataFrame, names: Sequence[str], allowed: Sequence[str] = ALLOWED_METRICS) -> DataFrame:
    """Rows of the named metrics; an unknown name is an error before anything runs."""
    unknown = sorted(set(names) - set(allowed))
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    return df.where(F.col("metric_name").isin(*names))


def tenant_view(df: DataFrame, tenant_col: str, tenant: object) -> DataFrame:
    """Rows of one tenant."""
    return df.where(F.col(tenant_col) == F.lit(tenant))


def statement_class(query: Column) -> Column:
    """read / write / other by the first word, in any case."""
    return case(
        (query.rlike("(?i)^(SELECT|WITH)"), "read"),
        (query.rlike("(?i)^(INSERT|UPDATE|DELETE)"), "write"),
        default="other",
    )


def top_slow(stats: DataFrame, as_of: datetime, hours: float = 24, limit: int = 10) -> DataFrame:
    """Queries with the largest total time in the last hours."""
    return (
        since(stats, "snapshot_timestamp", as_of, hours=hours)
        .groupBy("query", "queryid")
        .agg(
            F.sum("calls").alias("total_calls"),
            mean(F.col("mean_exec_time")).alias("avg_exec_time_ms"),
            total(F.col("total_exec_time")).alias("total_time_ms"),
            F.sum("rows").alias("total_rows"),
            (F.sum("shared_blks_read") * 8.0 / 1024).cast("double").alias("total_read_mb"),
            F.max("snapshot_timestamp").alias("last_seen"),
        )
        .orderBy(F.desc("total_time_ms"), "queryid", "query")
        .limit(limit)
    )


def regression(
    stats: DataFrame,
    as_of: datetime,
    recent: timedelta = timedelta(hours=2),
    baseline: tuple[timedelta, timedelta] = (timedelta(hours=25), timedelta(hours=1)),
    limit: int | None = 20,
) -> DataFrame:
    """Recent against baseline mean time per query.

    Both averages come from one scan and one aggregation; the two windows may overlap.
    """
    ts, value = "snapshot_timestamp", F.col("mean_exec_time")
    is_recent = F.col(ts) > instant(stats, ts, as_of - recent)
    is_base = F.col(ts).between(
        instant(stats, ts, as_of - baseline[0]), instant(stats, ts, as_of - baseline[1])
    )
    out = (
        stats.where(is_recent | is_base)
        .groupBy("queryid")
        .agg(
            mean(F.when(is_base, value)).alias("baseline_ms"),
            mean(F.when(is_recent, value)).alias("recent_ms"),
        )
        .where((F.col("baseline_ms") > 0) & F.col("recent_ms").isNotNull())
        .withColumn(
            "pct_change", (F.col("recent_ms") - F.col("baseline_ms")) / F.col("baseline_ms") * 100
        )
        .withColumn(
            "status",
            case(
                (F.col("recent_ms") > F.col("baseline_ms") * 2, "REGRESSION"),
                (F.col("recent_ms") > F.col("baseline_ms") * 1.5, "WARNING"),
                default="STABLE",
            ),
        )
    )
    return out if limit is None else out.orderBy(F.desc("pct_change"), "queryid").limit(limit)


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def hourly_trend(samples: DataFrame, as_of: datetime, hours: float = 24, names: Sequence[str] | None = None) -> DataFrame:
    """Average, least and largest value per metric and hour."""
    rows = since(samples, "snapshot_timestamp", as_of, hours=hours)
    if names:
        rows = rows.where(F.col("metric_name").isin(*names))
    v = F.col("metric_value")
    return rows.groupBy("metric_name", hour_of("snapshot_timestamp").alias("hour")).agg(
        mean(v).alias("avg_value"), F.min(v).cast("double").alias("min_value"), F.max(v).cast("double").alias("max_value")
    )


def sync_trend(checks: DataFrame, as_of: datetime, hours: float = 24) -> DataFrame:
    """Lag and drift per source table and hour."""
    lag = F.col("freshness_lag_seconds")
    return (
        since(checks, "validated_at", as_of, hours=hours)
        .groupBy("source_table", hour_of("validated_at").alias("hour"))
        .agg(
            mean(lag).alias("avg_lag_seconds"),
            F.max(lag).cast("double").alias("max_lag_seconds"),
            mean(F.col("count_drift")).alias("avg_count_drift"),
        )
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, ties: str = "keep", tie: Sequence[str] = ()) -> DataFrame:
    """Newest row per key; `keep` gives all rows at the newest time, `one` breaks ties by the largest `tie`.

    Newest times are found with a map-side combined aggregate. Rows are then matched on key and time, so the
    rows of a hot key spread over the tasks by their time; the matching side is broadcast when it turns out small.
    """
    if ties == "one":
        rest = [c for c in df.columns if c not in keys]
        picked = F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("_row")
        return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)
    newest = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    cond = F.lit(True)
    for c in [*keys, ts]:
        cond = cond & F.col(f"d.{c}").eqNullSafe(F.col(f"n.{c}"))
    return df.alias("d").join(newest.alias("n"), cond, "left_semi")


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key. Spark keeps k rows per task before the shuffle, so a hot key does not travel whole."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def keep_last_n(df: DataFrame, keys: Sequence[str], ts: str, n: int = 50, tie: Sequence[str] = ()) -> DataFrame:
    """Newest n rows per key, with their place."""
    return top_k_per_key(df, keys, [F.desc(ts), *[F.desc(c) for c in tie]], n, "place")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be from 1 to 500 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: dict[str, str], approximate: bool = False) -> DataFrame:
    """Distinct values of several columns per key (column -> name).

    The exact form expands a row once per column; the approximate one is a single pass over mergeable sketches.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*keys).agg(*[count(c).alias(n) for c, n in columns.items()])


def unpivot_metrics(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Wide metrics to (metric_name, metric_value); columns that are not numbers are dropped."""
    numeric = ("double", "float", "long", "integer", "short", "byte", "decimal")
    names = [f.name for f in wide.schema.fields if f.dataType.typeName() in numeric and f.name not in ids]
    return wide.select(*ids, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        list(ids), names, "metric_name", "metric_value"
    )


def kpi_row(samples: DataFrame, keys: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """Newest value of each named metric as one wide row per key; a default where a metric has no row."""
    newest = F.max_by("metric_value", F.struct("snapshot_timestamp", "metric_value")).cast("double")
    wide = (
        samples.where(F.col("metric_name").isin(*defaults)).groupBy(*keys).pivot("metric_name", list(defaults)).agg(newest)
    )
    return wide.select(*keys, *[F.coalesce(F.col(n), F.lit(d)).alias(n) for n, d in defaults.items()])


def rollup_samples(samples: DataFrame, seconds: int) -> DataFrame:
    """Mergeable partials per project, branch, metric and time slot."""
    v = F.col("metric_value")
    epoch = F.floor(F.unix_micros(F.col("snapshot_timestamp").cast("timestamp")) / F.lit(1_000_000 * seconds)) * seconds
    slot = F.timestamp_seconds(epoch).cast("timestamp_ntz")
    return samples.groupBy("project_id", "branch_id", "metric_name", slot.alias("slot")).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )


def merge_rollup(partials: DataFrame, keys: Sequence[str], slot: Column, name: str = "slot") -> DataFrame:
    """Coarser partials from finer ones."""
    return partials.groupBy(*keys, slot.alias(name)).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def finish_rollup(partials: DataFrame) -> DataFrame:
    """Average, least and largest value from partials."""
    keep = [c for c in partials.columns if c not in ("n", "s", "lo", "hi")]
    return partials.select(
        *keep,
        "n",
        safe_ratio(F.col("s"), F.col("n")).alias("avg_value"),
        F.col("lo").cast("double").alias("min_value"),
        F.col("hi").cast("double").alias("max_value"),
    )


def workload_profile(stats: DataFrame, keys: Sequence[str], uptime_seconds: float) -> DataFrame:
    """Distinct statements, calls, read and write share, rates and p99 of the mean time, per key (at least one)."""
    from opslens.functions.spread import percentile_exact, same_keys

    calls, kind = F.col("calls"), statement_class(F.col("query"))
    base = (
        stats.where(F.col("queryid").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count_distinct("queryid").alias("total_queries"),
            F.sum(calls).alias("total_calls"),
            F.sum(F.when(kind == "read", calls).otherwise(0)).alias("_reads"),
            F.sum(F.when(kind == "write", calls).otherwise(0)).alias("_writes"),
            F.max(calls).cast("double").alias("peak_qps"),
        )
        .withColumn("reads_pct", safe_ratio(F.col("_reads"), F.col("total_calls")) * 100)
        .withColumn("writes_pct", safe_ratio(F.col("_writes"), F.col("total_calls")) * 100)
        .withColumn("avg_qps", F.col("total_calls") / F.lit(float(uptime_seconds)))
        .withColumn("avg_tps", F.col("_writes") / F.lit(float(uptime_seconds)))
        .drop("_reads", "_writes")
    )
    p99 = percentile_exact(stats.where(F.col("queryid").isNotNull()), keys, "mean_exec_time", 0.99, "p99_latency_ms")
    return base.alias("b").join(p99.alias("p"), same_keys("b", "p", keys), "left").select("b.*", "p.p99_latency_ms")


def slow_statements(stats: DataFrame, over_ms: float = 5000.0, limit: int = 10) -> DataFrame:
    """Statements whose mean time is over the limit, largest total first."""
    return (
        stats.where(F.col("mean_exec_time") > over_ms)
        .orderBy(F.desc("total_exec_time"), "queryid", "snapshot_timestamp")
        .limit(limit)
    )


def stats_eviction(info: DataFrame, as_of: datetime) -> DataFrame:
    """Evicted statements and the age of the counters."""
    from opslens.functions.exprs import seconds_between

    return info.select(
        "project_id",
        "branch_id",
        "dealloc",
        "stats_reset",
        (F.col("dealloc") > 0).alias("evicting"),
        seconds_between(instant(info, "stats_reset", as_of), F.col("stats_reset")).alias("counter_age_seconds"),
    )
