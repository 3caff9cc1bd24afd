"""Slowly changing history: build, check, and look up as of a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions import spread


def build(
    changes: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], attributes: Sequence[str], slot_seconds: int = spread.SLOT_SECONDS
) -> DataFrame:
    """Change rows to (valid_from, valid_to, is_current); consecutive equal rows collapse into the first.

    Both windows run over a time slot of a key, which gets the row before it; a slot's last version ends where the next slot
    with versions begins.
    """
    state = F.struct(*attributes)
    # the marker tells a first row from one whose predecessor holds nulls
    marked = F.struct(F.lit(True).alias("there"), state.alias("v"))
    rows = spread.with_neighbours(changes.select(*keys, ts, *tie, *attributes), keys, ts, tie, 1, 0, slot_seconds)
    inside = W.partitionBy(*keys, "_slot").orderBy(ts, *tie)
    versions = rows.withColumn("_prev", F.lag(marked).over(inside)).where(F.col("_own") & (F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(state))).drop("_prev")
    behind = spread.carried(versions, keys, F.struct(ts, *tie), ts, forward=False)
    closed = versions.unionByName(behind.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    # the row from later slots comes last
    upto = W.partitionBy(*keys, "_slot").orderBy(F.desc("_own"), ts, *tie)
    return closed.withColumn("valid_to", F.lead(ts).over(upto)).where("_own").select(
        *keys, *attributes, *tie, F.col(ts).alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current")
    )


def validate(history: DataFrame, keys: Sequence[str], tie: Sequence[str], **split) -> DataFrame:
    """Per key: versions, open rows, gaps, overlaps, zero-length versions, verdict."""
    rows = history.select(*keys, "valid_from", "valid_to", *tie)
    nxt = spread.over_ordered(rows, keys, "valid_from", tie, lambda w: {"_next": F.lead("valid_from").over(w)}, after=1, **split)
    return (
        nxt.groupBy(*keys)
        .agg(
            F.count("*").alias("versions"),
            F.count_if(F.col("valid_to").isNull()).alias("open_rows"),
            F.count_if(F.col("_next") > F.col("valid_to")).alias("gaps"),
            F.count_if((F.col("_next") < F.col("valid_to")) | (F.col("valid_to").isNull() & F.col("_next").isNotNull())).alias("overlaps"),
            F.count_if(F.col("valid_from") == F.col("valid_to")).alias("zero_length"),
        )
        .withColumn("valid", (F.col("open_rows") == 1) & (F.col("gaps") == 0) & (F.col("overlaps") == 0))
    )


def orphans(history: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open versions whose key the source no longer has; a null key is a key like any other."""
    there = source.select(*keys).distinct().alias("s")
    return history.where("is_current").alias("h").join(there, spread.same_keys("h", "s", keys), "left_anti")


def as_of_lookup(
    facts: DataFrame, history: DataFrame, keys: Sequence[str], fact_ts: str, fact_tie: str, attribute: str, version_tie: str, **split
) -> DataFrame:
    """Facts with the attribute valid at their time.

    Versions and facts are stacked and the last version is filled forward, which is linear in both; a range join would
    compare every fact of a key with every version of it. A version counts from its own instant on.
    """
    others = [c for c in facts.columns if c not in (*keys, fact_ts)]
    versions = history.select(
        *keys,
        F.col("valid_from").alias(fact_ts),
        *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in others],
        F.struct(F.col(attribute).alias("v")).alias("_version"),
        F.col(version_tie).alias("_order"),
        F.lit(0).alias("_side"),
    )
    marked = facts.select(
        *keys,
        fact_ts,
        *others,
        F.lit(None).cast(versions.schema["_version"].dataType).alias("_version"),
        F.lit(None).cast(versions.schema["_order"].dataType).alias("_order"),
        F.lit(1).alias("_side"),
    )
    filled = spread.fill_forward(
        versions.unionByName(marked), keys, fact_ts, ["_side", "_order", fact_tie], "_version", **split
    )
    return filled.where("_side = 1").select(*facts.columns, F.col("_version.v").alias(f"{attribute}_as_of"))


def latest_state(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    return history.where("is_current").drop("valid_from", "valid_to", "is_current")
