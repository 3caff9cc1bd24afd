"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.session import tune
from opslens.sources.workdir import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Texts reach Python tasks in batches of so many bytes, whatever their number.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`run`, and behind it the process gives back what memory it no longer uses: Python workers live on from task to task."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim is not None:
                trim(0)

    return task


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that bound the memory of tasks."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return tune(spark)


def query(name: str, sql: str | None = None):
    """Register a query over (spark, folder of the tables); `sql` computes the same in another engine."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_at(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Write to a new shared folder and read back, with the folder's path; `options` are the writer's.

    Cuts the lineage: a lost executor costs no recomputation, and everything later reads the same rows, also where the plan above
    is not repeatable (ties, sampled ranges).
    """
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    return stored_at(df, name, **options)[0]


#: Parts that the rows of one key are dealt into.
SALTS = 32


def looked_up(rows: DataFrame, values: DataFrame, on: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """Rows with the columns of `values`, which has one row per `on` at most; null meets null, rows without a partner get nulls.

    A key that holds many rows is dealt into `salts` parts by `spread`, which only goes over the rows; `values` first goes to the pairs of
    key and part that occur, at most `salts` per key, and these to the rows. So neither side has a hot key, whatever its size.
    """
    salt, key = "__salt", "__key"
    salted = rows.withColumn(salt, F.pmod(spread, F.lit(salts)).cast("int"))
    pairs = salted.select(F.col(on).alias(key), F.col(salt).alias(f"{salt}s")).distinct()
    others = [c for c in values.columns if c != on]
    found = pairs.join(values.select(F.col(on).alias(f"{key}s"), *others), F.col(key).eqNullSafe(F.col(f"{key}s")), "left")
    met = salted.join(found, salted[on].eqNullSafe(found[key]) & (salted[salt] == found[f"{salt}s"]), "left")
    return met.select(*[salted[c] for c in rows.columns], *[found[c] for c in others])


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, df: DataFrame) -> str:
    """`name`, or with underscores behind it if `df` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, all other characters stay; the built-in `lower` does so for texts of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
