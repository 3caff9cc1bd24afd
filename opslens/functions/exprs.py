"""Small column builders."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den as double; `default` (or null) where den is zero or null."""
    ratio = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    return ratio if default is None else F.coalesce(ratio, F.lit(float(default)))


def total(value: Column) -> Column:
    """Sum as double. A decimal input is summed exactly, so task order cannot change the result."""
    return F.sum(value).cast("double")


def mean(value: Column) -> Column:
    """Average as sum / count; exact in the sum for decimal input. Null for no rows."""
    return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))


def case(*branches: tuple[Column, object], default: object = None) -> Column:
    """First branch whose condition holds."""
    head, *rest = branches
    chain = F.when(head[0], head[1])
    for cond, value in rest:
        chain = chain.when(cond, value)
    return chain if default is None else chain.otherwise(default)


def step(cond: Column, points: float) -> Column:
    """`points` where the condition holds, else 0 (also for a null condition)."""
    return F.when(cond, F.lit(float(points))).otherwise(F.lit(0.0))


def cells(*cols: str | Column) -> Column:
    """All values of a row in one text that no other row has: each with its length in front, a null as a dash."""
    texts = [(c if isinstance(c, Column) else F.col(c)).cast("string") for c in cols]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def keyed_id(*cols: str | Column) -> Column:
    """Deterministic id of a row from its key columns: the whole SHA-256."""
    return F.sha2(cells(*cols), 256)


def row_digest(cols: Sequence[str]) -> Column:
    """60 bits of the md5 of the row as a number."""
    return F.conv(F.substring(F.md5(cells(*cols)), 1, 15), 16, 10).cast("decimal(38,0)")


def seconds_between(later: Column, earlier: Column) -> Column:
    """later - earlier in seconds, with microseconds."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def instant(df: DataFrame, ts: str, moment: datetime) -> Column:
    """`moment` as a literal of the type of column `ts`, so that the comparison reaches the scan."""
    return F.lit(moment.isoformat(sep=" ")).cast(df.schema[ts].dataType)


def latest_instant(df: DataFrame, ts: str) -> datetime:
    """Largest value of `ts`: one aggregated row comes back, read from one column."""
    return df.agg(F.max(ts).alias("m")).first()["m"]


def levels(value: Column, warning: Column, critical: Column, above: Column) -> Column:
    """normal / warning / critical; strict comparison, `above` tells which side is bad."""
    def beyond(limit: Column) -> Column:
        return (above & (value > limit)) | (~above & (value < limit))

    return case((beyond(critical), "critical"), (beyond(warning), "warning"), default="normal")
