"""Ordered work per key without one task per hot key.

A window over a key that holds a large share of all rows would run in one task. So windows here run over (key, time slot), at every
size of the data, and a slot gets from the others just what its rows need: some rows before and behind it, or one value carried
over. Tasks hold a slot of a key; only one row, or a few, per slot meet by key. `slot_seconds` is the width of a slot: choose it so
that the busiest key has some million rows in a slot at most. Building a plan starts no job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOT_SECONDS = 86_400
LOG_BINS = 64  # histogram bins per doubling of a value
STEPS = 4096  # equal steps that a histogram bin is cut into


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of the key columns of two aliases, so that a null key is a key like any other."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def slot(ts: str, slot_seconds: int) -> Column:
    """Number of the time slot; null for a null time, which sorts first as in any window."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000 * slot_seconds)).cast("long")


def with_neighbours(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], before: int, after: int, slot_seconds: int) -> DataFrame:
    """Rows with _slot and _own; each slot that has rows also gets the `before` rows of its key in front of it and the `after` rows behind it,
    with _own = false."""
    own = df.withColumn("_slot", slot(ts, slot_seconds))
    out = own.withColumn("_own", F.lit(True))
    for n, ends, order in ((before, [F.desc_nulls_last(c) for c in (ts, *tie)], [F.asc_nulls_first(c) for c in ("_slot", ts, *tie)]), (after, [F.asc_nulls_first(c) for c in (ts, *tie)], [F.desc_nulls_last(c) for c in ("_slot", ts, *tie)])):
        if not n:
            continue
        # the last (first) n rows of each slot; a slot needs those of them that are within n rows of its own first (last) one
        edge = own.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(*ends))).where(F.col("_n") <= n).drop("_n")
        near = F.collect_set(F.struct("_slot")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(1, n))
        given = edge.withColumn("_to", near).withColumn("_to", F.explode(F.array_except("_to", F.array(F.struct("_slot"))))).withColumn("_slot", F.col("_to._slot")).drop("_to")
        out = out.unionByName(given.withColumn("_own", F.lit(False)))
    return out


def over_ordered(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    columns: Callable[[W], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """df plus window columns that look at most `before` rows back and `after` rows ahead in their key.

    columns(window) gives the new columns for an ordered window.
    """
    rows = with_neighbours(df, keys, ts, tie, before, after, slot_seconds)
    return rows.withColumns(columns(W.partitionBy(*keys, "_slot").orderBy(ts, *tie))).where("_own").drop("_slot", "_own")


def carried(slotted: DataFrame, keys: Sequence[str], order: Column, value: str, forward: bool) -> DataFrame:
    """Per slot of a key, as column `value`: the last non-null value of earlier slots (forward), or the first of later slots.

    Slots are reduced to one row first, so the window sees the slots of a key and not its rows.
    """
    present = F.when(F.col(value).isNotNull(), order)
    if forward:
        edge, w = F.max_by(F.col(value), present), W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
        pick = F.last("_edge", ignorenulls=True)
    else:
        edge, w = F.min_by(F.col(value), present), W.partitionBy(*keys).orderBy("_slot").rowsBetween(1, W.unboundedFollowing)
        pick = F.first("_edge", ignorenulls=True)
    return slotted.groupBy(*keys, "_slot").agg(edge.alias("_edge")).withColumn(value, pick.over(w)).drop("_edge")


def fill_forward(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], value: str, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """df with `value` replaced by the last non-null value at or before the row in its key.

    The look-back is unbounded, so the slots of a key hand over only their last value, as one more row in front of the next ones.
    """
    slotted = df.withColumn("_slot", slot(ts, slot_seconds))
    front = carried(slotted, keys, F.struct(ts, *tie), value, forward=True)
    rows = slotted.withColumn("_own", F.lit(True)).unionByName(front.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    upto = W.partitionBy(*keys, "_slot").orderBy("_own", ts, *tie).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(upto)).where("_own").select(*df.columns)


def _bin(v: Column) -> Column:
    """Bin of a double that grows with it: LOG_BINS per doubling on both sides of zero, and one for the infinite."""
    size = F.when(F.abs(v) == float("inf"), 3_000_000).otherwise(F.floor(F.log2(F.abs(v)) * LOG_BINS).cast("int") + 1_000_000)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0)


def _holding_ranks(counts: DataFrame, keys: Sequence[str], bin_: str) -> DataFrame:
    """The counts in those bins of their group that hold the wanted ranks; _b0 grows by the rows of the group before the bin."""
    hist = counts.groupBy(*keys, bin_).agg(F.sum("_c").alias("_c"), F.first("_rank").alias("_rank"), F.first("_b0").alias("_start"))
    upto = W.partitionBy(*keys).orderBy(bin_).rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumn("_b0", F.col("_start") + F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    hist = hist.where((F.col("_b0") <= F.ceil("_rank")) & (F.col("_b0") + F.col("_c") > F.floor("_rank")))
    kept = [*keys, bin_]
    return counts.alias("r").join(hist.alias("h"), same_keys("r", "h", kept)).select(*[F.col(f"r.{c}") for c in kept], F.col("r._v"), F.col("r._c"), F.col("h._rank"), F.col("h._b0"))


def percentile_exact(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """One row per key with the interpolated percentile of its numbers, without holding a group's values in one place.

    Equal values are counted on the map side first. A histogram with bins of fixed relative width finds the bins that hold the wanted
    ranks, equal steps of such a bin the steps that do, and only their distinct values are ranked. The steps are always
    these three; nulls and NaN are left out, a key without numbers has no row.
    """
    v = F.col(value).cast("double")
    values = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    totals = values.groupBy(*keys, _bin(F.col("_v")).alias("_bin")).agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    all_rows = F.sum("_c").over(W.partitionBy(*keys))
    upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = totals.withColumns({"_rank": F.lit(float(q)) * (all_rows - 1), "_b0": F.coalesce(F.sum("_c").over(upto), F.lit(0))})
    bins = bins.where((F.col("_b0") <= F.ceil("_rank")) & (F.col("_b0") + F.col("_c") > F.floor("_rank"))).drop("_c")
    share = (F.col("_v") - F.col("h._lo")) / (F.col("h._hi") - F.col("h._lo"))
    step = F.when(F.col("h._hi") > F.col("h._lo"), F.floor(share * STEPS)).otherwise(0).cast("int")
    inside = (
        values.withColumn("_bin", _bin(F.col("_v")))
        .alias("r")
        .join(bins.alias("h"), same_keys("r", "h", [*keys, "_bin"]))
        .select("r.*", "h._rank", "h._b0", step.alias("_step"))
    )
    found = _holding_ranks(inside, [*keys, "_bin"], "_step")
    in_step = W.partitionBy(*keys, "_bin", "_step").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    ranked = found.withColumn("_r0", F.col("_b0") + F.coalesce(F.sum("_c").over(in_step), F.lit(0)))

    def at(r: Column) -> Column:
        return F.max(F.when((F.col("_r0") <= r) & (F.col("_r0") + F.col("_c") > r), F.col("_v")))

    picked = ranked.groupBy(*keys).agg(
        at(F.floor("_rank")).alias("_a"), at(F.ceil("_rank")).alias("_b"), F.max("_rank").alias("_rank")
    )
    a, b = F.col("_a"), F.col("_b")
    return picked.select(*keys, F.when(a == b, a).otherwise(a + (b - a) * (F.col("_rank") - F.floor("_rank"))).alias(name))
