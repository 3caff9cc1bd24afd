"""Cold data: candidates, split, what a run has moved, one view over hot and cold rows. `sources.tiered` moves them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import instant


def cold_candidates(rows: DataFrame, keys: Sequence[str], ts: str, as_of: datetime, days: int = 90, min_rows: int = 100_000) -> DataFrame:
    """Large tables with their measured cold rows, coldest first (oldest newest-row first, nulls first)."""
    cold = F.col(ts) < instant(rows, ts, as_of - timedelta(days=days))
    return (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("live_rows"), F.count_if(cold).alias("cold_rows"), F.max(ts).alias("last_activity"))
        .where(F.col("live_rows") > min_rows)
        .withColumn("cold_pct", F.col("cold_rows") / F.col("live_rows") * 100)
        .orderBy(F.asc_nulls_first("last_activity"), *keys)
    )


def split_cold(rows: DataFrame, ts: str, as_of: datetime, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(hot, cold); rows without a time stay hot."""
    limit = instant(rows, ts, as_of - timedelta(days=days))
    is_cold = F.col(ts) < limit
    return rows.where(is_cold.isNull() | ~is_cold), rows.where(is_cold)


def unified_view(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """One view over live and archived rows; columns that only one side has are null on the other."""
    return hot.withColumn("tier", F.lit("hot")).unionByName(cold.withColumn("tier", F.lit("cold")), allowMissingColumns=True)


def archive_summary(rows: DataFrame, keys: Sequence[str], ts: str, size_cols: Sequence[str], as_of: datetime, days: int = 90) -> DataFrame:
    """Log rows of an archive run: rows and measured text bytes per table."""
    _, cold = split_cold(rows, ts, as_of, days)
    width = F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in size_cols]))
    return cold.groupBy(*keys).agg(F.count("*").alias("rows_archived"), F.sum(width).cast("bigint").alias("bytes_reclaimed"))
