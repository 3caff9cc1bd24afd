"""Rollups that keep distinct counts and percentiles mergeable, as sketches in columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct counts: 2 ** HLL_BITS registers, a relative standard error of 1.04 / sqrt(2 ** HLL_BITS), 1.6 %, at most a few KB each.
HLL_BITS = 12
#: Percentiles: the rank of an answer is off by about 2.3 / KLL_K ** 0.9 of all rows, 0.45 %.
KLL_K = 1000


def rollup(rows: DataFrame, keys: Sequence[str], ts: str, seconds: int, distinct: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """Partials per key and time slot of `seconds`: n, and per column of `distinct` a sketch x_distinct, per column of `values` x_n and a sketch x_values.

    All of it can be stored and merged later, in any order and any number of times. Nulls are not counted in sketches; a null key and a null time
    are a group like any other. Sketches are combined before the shuffle, so a hot key is no hot task.
    """
    epoch = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000 * seconds)) * seconds
    slot = F.timestamp_seconds(epoch).cast("timestamp_ntz").alias("slot")
    return rows.groupBy(*keys, slot).agg(
        F.count("*").alias("n"),
        *[F.hll_sketch_agg(F.col(c), F.lit(HLL_BITS)).alias(f"{c}_distinct") for c in distinct],
        *[F.count(c).alias(f"{c}_n") for c in values],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)).alias(f"{c}_values") for c in values],
    )


def merge(partials: DataFrame, keys: Sequence[str], slot: Column, distinct: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """Coarser partials from finer ones, with the same columns; `slot` is the coarser time of column slot."""
    return partials.groupBy(*keys, slot.alias("slot")).agg(
        F.sum("n").alias("n"),
        *[F.hll_union_agg(f"{c}_distinct").alias(f"{c}_distinct") for c in distinct],
        *[F.sum(f"{c}_n").alias(f"{c}_n") for c in values],
        *[F.kll_merge_agg_double(f"{c}_values", F.lit(KLL_K)).alias(f"{c}_values") for c in values],
    )


def finish(partials: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), quantiles: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Answers from partials: keys, slot, n, x_distinct as a number, and x_p<percent> per quantile; null where a column has no value."""
    def answer(c: str, q: float) -> Column:
        found = F.when(F.col(f"{c}_n") > 0, F.kll_sketch_get_quantile_double(F.col(f"{c}_values"), F.lit(q)))
        return found.alias(f"{c}_p{q * 100:g}".replace(".", "_"))

    return partials.select(
        *keys, "slot", "n", *[F.hll_sketch_estimate(f"{c}_distinct").alias(f"{c}_distinct") for c in distinct],
        *[answer(c, q) for c, qs in (quantiles or {}).items() for q in qs],
    )
