"""Contiguous shards of nearly equal bytes, by prefix sums of sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.llm.common import column, query, stored, table

SHARDS = 24


def assign(rows: DataFrame, size: str, order: Sequence[str], shards: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """Put rows, in the order of `order`, into `shards` contiguous runs of nearly equal total `size`.

    Adds shard (int), slot (long, gapless from 0 in its shard) and start (long, sizes of all rows before). Rows are range-partitioned
    on `order`, each partition is summed, and the running sum over the few partition totals gives each partition its offset, so no
    task sees more than its range. A row goes where its first unit lies: shard = start * shards / total. Two shards differ by
    no more than the largest row does.

    Columns: all of `rows` come back; those called shard, slot or start are replaced. Nulls in `order` come first, a null or negative
    size counts as 0. Rows that agree in all of `order` are interchangeable and spread over ranges by a salt. An empty table gives an
    empty table. With fewer rows than shards, or only sizes of 0, some shards stay empty. The order columns should say which rows are
    equal: the ranges are written to the shared folder once, so that a lost task is read again and not drawn anew.
    """
    spark = rows.sparkSession
    hidden = {c: f"__{c}" for c in ("size", "salt", "range", "row", "before")}
    if set(hidden.values()) & set(rows.columns):
        raise ValueError(f"column names {sorted(hidden.values())} are used here")
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in rows.columns if c not in ("shard", "slot", "start")]
    ranged = stored(
        rows.withColumns(
            {
                hidden["size"]: F.greatest(F.coalesce(column(size).cast("bigint"), F.lit(0)), F.lit(0)),
                hidden["salt"]: F.monotonically_increasing_id(),
            }
        )
        .repartitionByRange(n, *[column(c).asc_nulls_first() for c in order], hidden["salt"])
        .withColumn(hidden["range"], F.spark_partition_id()),
        "shards",
    )
    totals = ranged.groupBy(hidden["range"]).agg(F.sum(hidden["size"]).alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy(hidden["range"]).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    offsets = totals.select(
        hidden["range"],
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy(hidden["range"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    inside = Window.partitionBy(hidden["range"]).orderBy(*[column(c).asc_nulls_first() for c in order], hidden["salt"])
    placed = (
        ranged.withColumns(
            {
                hidden["before"]: F.sum(hidden["size"]).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(hidden["size"]),
                hidden["row"]: F.row_number().over(inside) - 1,
            }
        )
        .join(F.broadcast(offsets), hidden["range"])
        .withColumn(hidden["before"], F.col(hidden["before"]) + F.col("bytes_before"))
        .withColumn(hidden["row"], F.col(hidden["row"]) + F.col("rows_before"))
        .withColumn("shard", F.when(F.col("all_bytes") > 0, F.least(F.lit(shards - 1), F.floor(F.col(hidden["before"]) * shards / F.col("all_bytes")))).otherwise(0).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min(hidden["row"]).alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        *map(column, kept), F.col("shard"), (F.col(hidden["row"]) - F.col("first_row")).alias("slot"), F.col(hidden["before"]).alias("start")
    )


def text_size(text: Column) -> Column:
    """UTF-8 bytes, none for null, and 8 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def write_shards(rows: DataFrame, path: str, size: str, order: Sequence[str], shards: int = SHARDS) -> None:
    """Write `rows` as folders shard=N. A shard may come in several files; its order is column slot."""
    assign(rows, size, order, shards).repartition("shard", F.floor(F.col("slot") / 1_000_000)).write.partitionBy("shard").parquet(path)


@query("op2_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of `documents` by bytes. A null text has no bytes and the checksum of the empty text."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.unhex(F.lit("")))).alias("text_crc32")
    )
    return assign(docs, "size", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start"
    )
