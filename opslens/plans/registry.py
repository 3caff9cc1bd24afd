"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.plans.bind import Bind, with_shapes
from opslens.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def as_instant(df: DataFrame, *days: str) -> DataFrame:
    """Date columns as midnight, the one form of a day that every client reads alike."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in days})


def sql_cells(*texts: str) -> str:
    """Check: all values of a row in one text, each with its length in front, a null as a dash."""
    return " || ".join(f"coalesce(CAST(length({t}) AS VARCHAR) || ':' || {t}, '-')" for t in texts)


def query(name: str, shapes: str = "", sql: str | None = None):
    """Register a query over a Bind; `sql` computes the same from the driver tables in another engine."""

    def add(fn: Callable[[Bind], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Bind(tune(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_shapes(shapes, sql)
        return fn

    return add
