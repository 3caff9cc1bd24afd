"""Ordered analytics per key: deltas, rolling statistics, gaps, timelines, forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions import spread
from opslens.functions.exprs import case, mean, micros, safe_ratio, total


def counter_delta(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], counter: str, name: str = "delta", **split) -> DataFrame:
    """Growth of a cumulative counter since the previous row; after a reset the new value counts whole."""
    value = F.col(counter)

    def cols(w):
        back = F.lag(value).over(w)
        return {name: case((back.isNull(), F.lit(None)), (value < back, value), default=value - back)}

    return spread.over_ordered(df, keys, ts, tie, cols, before=1, **split)


def rolling_stats(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], value: str, rows: int = 20, z_limit: float = 3.0, **split) -> DataFrame:
    """Mean and sample deviation of the previous rows, z-score and anomaly mark.

    In doubles; the rows of a frame are always summed in the same order. A deviation of 0 gives no z-score.
    """
    x = F.col(value).cast("double")

    def cols(w):
        frame = w.rowsBetween(-rows, -1)
        return {"roll_mean": F.avg(x).over(frame), "roll_std": F.when(F.count(x).over(frame) > 1, F.stddev_samp(x).over(frame))}

    out = spread.over_ordered(df, keys, ts, tie, cols, before=rows, **split)
    return out.withColumn("z_score", (x - F.col("roll_mean")) / F.nullif(F.col("roll_std"), F.lit(0.0))).withColumn(
        "is_anomaly", F.coalesce(F.abs("z_score") > z_limit, F.lit(False))
    )


def rolling_seconds(samples: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int = 3600, slot: int = 60) -> DataFrame:
    """Mean of the trailing seconds, at the grain of a time slot.

    Rows are first combined into (count, sum) per slot, so the ordered window only sees one row per key and slot.
    """
    at = (F.floor(micros(F.col(ts)) / F.lit(1_000_000 * slot)) * slot).cast("bigint")
    per_slot = samples.groupBy(*keys, at.alias("slot_epoch")).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    w = W.partitionBy(*keys).orderBy("slot_epoch").rangeBetween(-seconds, 0)
    return per_slot.select(
        *keys,
        F.timestamp_seconds("slot_epoch").cast("timestamp_ntz").alias("slot"),
        F.sum("n").over(w).alias("rows_in_range"),
        safe_ratio(F.sum("s").over(w), F.sum("n").over(w)).alias("mean_in_range"),
    )


def _moments(x: Column, frame: W | None = None) -> Column:
    """Mergeable moments of the values of a group or frame: n, sum, sum of squared distances from the mean, least and largest value."""
    def over(c: Column) -> Column:
        return c if frame is None else c.over(frame)

    n, added, m2 = over(F.count(x)).cast("double"), over(F.sum(x)), over(F.var_pop(x))
    return F.struct(n.alias("n"), F.coalesce(added, F.lit(0.0)).alias("s"), F.coalesce(m2 * n, F.lit(0.0)).alias("m2"), over(F.min(x)).alias("lo"), over(F.max(x)).alias("hi"))


def _merged(a: Column, b: Column) -> Column:
    """Moments of two sets of values together. Squares are never subtracted, so large values lose no digits."""
    both = (a["n"] > 0) & (b["n"] > 0)
    apart = F.when(both, b["s"] / b["n"] - a["s"] / a["n"]).otherwise(0.0)
    return F.struct(
        (a["n"] + b["n"]).alias("n"), (a["s"] + b["s"]).alias("s"),
        (a["m2"] + b["m2"] + F.when(both, apart * apart * a["n"] * b["n"] / (a["n"] + b["n"])).otherwise(0.0)).alias("m2"),
        F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"),
    )


def rolling_range(df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int = 3600, parts: int = 60, z_limit: float = 3.0) -> DataFrame:
    """df with rows_in_range, range_mean, range_std, z_score and is_anomaly: each row against the rows of its key in the `seconds` before its time.

    A frame holds the times from `seconds` before the row's, included, up to its own, left out, so rows of equal time do not see each other. It is the
    end of one time slot, some whole slots and the start of the row's own: whole slots are given by their merged moments, and the slot that a frame
    begins in is sent, shifted by `seconds`, to where the row is. So rows are shuffled twice at most, and a task holds two slots of a key, `seconds` / `parts`
    wide, however hot the key. Two values at least give a deviation, and equal values one of 0, which gives no z-score.

    Null values count in no frame and have no z-score; rows without a time have empty frames. A null key is a key like any other. All columns and rows
    of df stay, repeated ones too.
    """
    if seconds < 1 or parts < 1 or seconds * 1_000_000 % parts:
        raise ValueError("seconds must be a whole number of microseconds times parts")
    x, width = F.col("_x"), seconds * 1_000_000 // parts
    rows = df.withColumns({"_at": F.unix_micros(F.col(ts).cast("timestamp")), "_x": F.col(value).cast("double")})
    rows = rows.withColumn("_slot", ((F.col("_at") - F.pmod(F.col("_at"), F.lit(width))) / F.lit(width)).cast("bigint"))
    timed = rows.where(F.col("_at").isNotNull())
    shape = "struct<n: double, s: double, m2: double, lo: double, hi: double>"
    empty = F.lit(None).cast(shape)
    nothing = F.struct(*[F.lit(v).cast("double").alias(c) for c, v in (("n", 0), ("s", 0), ("m2", 0), ("lo", None), ("hi", None))])
    # one row per slot with the moments of the whole slots between
    between = W.partitionBy(*keys).orderBy("_slot").rangeBetween(-(parts - 1), -1)
    per_slot = timed.groupBy(*keys, "_slot").agg(_moments(x).alias("_m"))
    whole = F.aggregate(F.collect_list("_m").over(between), nothing, _merged) if parts > 1 else nothing
    front = per_slot.select(*keys, "_slot", whole.cast(shape).alias("_whole"), (F.col("_slot") * F.lit(width)).alias("_at"), F.lit("whole").alias("_kind"))
    lent = timed.select(*keys, (F.col("_slot") + parts).alias("_slot"), (F.col("_at") + F.lit(seconds * 1_000_000)).alias("_at"), "_x", F.lit("lent").alias("_kind"))
    own = rows.withColumns({"_whole": empty, "_kind": F.lit("own")})
    together = own.unionByName(lent, allowMissingColumns=True).unionByName(front, allowMissingColumns=True)
    here = W.partitionBy(*keys, "_slot")
    tail = here.orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, W.currentRow)
    head = here.orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    seen = together.withColumns({
        "_tail": _moments(F.when(F.col("_kind") == "lent", x), tail),
        "_head": _moments(F.when(F.col("_kind") == "own", x), head),
        "_whole": F.first("_whole", ignorenulls=True).over(here),
    }).where("_kind = 'own'")
    seen = seen.withColumn("_all", _merged(_merged(F.col("_tail"), F.col("_whole")), F.col("_head")))
    n = F.when(F.col("_at").isNull(), 0.0).otherwise(F.col("_all.n"))
    same = F.col("_all.lo") == F.col("_all.hi")
    avg = F.when(n > 0, F.when(same, F.col("_all.lo")).otherwise(F.col("_all.s") / n))
    std = F.when(n > 1, F.when(same, 0.0).otherwise(F.sqrt(F.col("_all.m2") / (n - 1))))
    out = seen.select(*[F.col(f"`{c}`") for c in df.columns], "_x", n.cast("bigint").alias("rows_in_range"), avg.alias("range_mean"), std.alias("range_std"))
    out = out.withColumn("z_score", (x - F.col("range_mean")) / F.nullif(F.col("range_std"), F.lit(0.0))).drop("_x")
    return out.withColumn("is_anomaly", F.coalesce(F.abs("z_score") > z_limit, F.lit(False)))


def idle_gaps(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], **split) -> DataFrame:
    """Gap in seconds between a row and the one before it."""
    def cols(w):
        return {"gap_seconds": (micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w)) / F.lit(1e6)}

    return spread.over_ordered(df, keys, ts, tie, cols, before=1, **split)


def idle_timeout(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], q: float = 0.95, **split) -> DataFrame:
    """Gap statistics and a recommended idle timeout: the q percentile of the gaps, in whole minutes, at least 5."""
    gaps = idle_gaps(df, keys, ts, tie, **split).where(F.col("gap_seconds").isNotNull())
    # gaps in microseconds are whole numbers, so their sum is exact
    whole = F.round(F.col("gap_seconds") * 1e6).cast("decimal(20,0)")
    stats = gaps.groupBy(*keys).agg(
        F.count("*").alias("gaps"),
        (F.sum(whole).cast("double") / F.count("*") / 1e6).alias("avg_gap_seconds"),
        F.max("gap_seconds").alias("max_gap_seconds"),
    )
    pct = spread.percentile_exact(gaps, keys, "gap_seconds", q, "gap_percentile")
    both = stats.alias("s").join(pct.alias("p"), spread.same_keys("s", "p", keys)).select("s.*", "p.gap_percentile")
    return both.withColumn("timeout_minutes", F.greatest(F.lit(5), F.ceil(F.col("gap_percentile") / 60)).cast("bigint"))


def timeline(phases: DataFrame, key: Sequence[str], order: str, days: str) -> DataFrame:
    """Start and end day of each phase by running sum; a plan has a handful of phases."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(days).over(w), F.lit(0.0))
    return phases.withColumn("start_day", start).withColumn("end_day", F.col("start_day") + F.col(days))


def period_delta(values: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Change against the previous period. Input is already one row per key and period."""
    w = W.partitionBy(*keys).orderBy(period)
    prev = F.lag(value).over(w)
    diff = F.col("current_value") - F.col("previous_value")
    return (
        values.select(*keys, period, F.col(value).alias("current_value"), prev.alias("previous_value"))
        .where(F.col("previous_value").isNotNull())
        .withColumn("pct_change", diff / F.nullif(F.col("previous_value"), F.lit(0.0)) * 100)
        .withColumn("direction", case((diff > 0, "up"), (diff < 0, "down"), default="flat"))
    )


def capacity_forecast(usage: DataFrame, keys: Sequence[str], day: str, value: str, threshold: float, horizon: int = 30) -> DataFrame:
    """Daily trend line: growth per day, projection, days until a threshold, peak and headroom.

    Input is one row per key and day. The fit uses sums only, so it is a plain aggregate.
    """
    x = F.datediff(F.col(day), F.lit("2000-01-01").cast("date")).cast("double")
    y = F.col(value).cast("double")
    fit = usage.groupBy(*keys).agg(
        F.count("*").alias("days"),
        F.max(x).alias("_x1"),
        F.max(y).alias("peak"),
        F.regr_slope(y, x).alias("growth_per_day"),
        F.regr_intercept(y, x).alias("_b"),
    )
    now = F.col("_b") + F.col("growth_per_day") * F.col("_x1")
    return fit.select(
        *keys,
        "days",
        "peak",
        "growth_per_day",
        (now + F.col("growth_per_day") * horizon).alias("projected"),
        F.when(F.col("growth_per_day") > 0, F.greatest(F.lit(0.0), (F.lit(float(threshold)) - now) / F.col("growth_per_day"))).alias("days_to_threshold"),
        ((F.lit(float(threshold)) - F.col("peak")) / F.lit(float(threshold)) * 100).alias("headroom_pct"),
    )


def metric_correlation(samples: DataFrame, metrics: Sequence[str], slot: str = "hour") -> DataFrame:
    """Correlation of every pair of the named metrics at aligned times.

    Metrics become columns of one row per time slot, so no self-join is needed; pairs are pairs of names.
    """
    wide = (
        samples.where(F.col("metric_name").isin(*metrics))
        .groupBy(F.date_trunc(slot, F.col("snapshot_timestamp")).alias("slot"))
        .pivot("metric_name", list(metrics))
        .agg(mean(F.col("metric_value")))
    )
    pairs = list(combinations(sorted(metrics), 2))
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    one = wide.agg(
        *[F.corr(F.when(ok, F.col(a)), F.when(ok, F.col(b))).alias(f"c{i}") for i, ((a, b), ok) in enumerate(zip(pairs, both))],
        *[F.count(F.when(ok, 1)).alias(f"n{i}") for i, ok in enumerate(both)],
    )
    rows = [
        F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"n{i}").alias("slots"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.inline(F.array(*rows)))


def cost_daily(usage: DataFrame, keys: Sequence[str], units: str, rate: str) -> DataFrame:
    """Units and cost per key; the rate comes with the row."""
    return usage.groupBy(*keys).agg(
        total(F.col(units)).alias("total_units"), total(F.col(units) * F.col(rate)).alias("estimated_cost")
    )


def cost_share(usage: DataFrame, project: str, branch: str, units: str) -> DataFrame:
    """Units per branch and their percent of the project. The window sees one row per branch."""
    per = usage.groupBy(project, branch).agg(F.sum(units).alias("_u"))
    w = W.partitionBy(project)
    return per.select(
        project,
        branch,
        F.col("_u").cast("double").alias("units"),
        (safe_ratio(F.col("_u"), F.sum("_u").over(w)) * 100).alias("pct_of_project"),
    )


def cost_rollup(usage: DataFrame, project: str, branch: str, units: str) -> DataFrame:
    """Totals per branch, per project and overall; `level` is 0, 1 or 3."""
    return (
        usage.rollup(project, branch)
        .agg(total(F.col(units)).alias("units"), F.count("*").alias("records"), F.grouping_id().cast("bigint").alias("level"))
    )
