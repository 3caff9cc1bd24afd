"""Exact deduplication as a stream with disk-backed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opslens.llm.common import SALTS, ascii_lower, column, looked_up, query, stored, stored_at, table, unused
from opslens.sources.workdir import new_folder

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store takes some MB of disk in advance
}
GROUP = "digest binary, keeper struct<doc_id: bigint, locator: string>, n bigint"


def normalised(text: Column) -> Column:
    """A null text counts as empty; only A-Z are lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def place_of(docs: DataFrame) -> Column:
    """File and row that a row was read from. An AnalysisException if the rows do not come from files."""
    meta = docs.metadataColumn("_metadata")
    return F.concat_ws("#", meta["file_path"], meta["row_index"])


def filed(docs: DataFrame) -> DataFrame:
    """`docs` with a place in a file for each row: as it is if the rows are read from files, one row of a file once; else written first.

    Only a place in a file is the same whenever a plan is run again; a row's number behind a shuffle is not. Places are looked at by hash, and
    two places of one hash only mean that the rows are written.
    """
    try:
        places = docs.select(F.xxhash64(place_of(docs)).alias("place"))
        if places.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return docs
    except AnalysisException:
        pass
    return stored(docs, "dedup-rows")


def stream_groups(spark: SparkSession, source: str, schema: StructType, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """Run arrivals (doc_id, digest, locator) in the files of `source` through keyed state.

    Gives a row per digest: digest, keeper (doc_id and locator of the row that stays), n rows. State lives in RocksDB on the
    executors' disks, is saved with the checkpoint in `folder`, and never expires: called again with the same folders, the stream
    goes on with the files that came since. The largest doc_id stays, so later batches may state a group anew; the
    statement with most rows is the last one. A repeated batch overwrites its own folder only.
    """
    own = spark.newSession()
    for k, v in STATE.items():
        own.conf.set(k, v)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    groups = (
        own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("n"))
    )
    out = f"{folder}/groups"
    (
        groups.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    stated = spark.read.schema(GROUP).parquet(out)
    return stated.groupBy("digest").agg(F.max(F.struct("n", "keeper")).alias("last")).select("digest", "last.keeper", "last.n")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 10_000) -> DataFrame:
    """One row per row of `docs`: doc_id, locator, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the largest doc_id
    stays; a null doc_id is smaller than all others; of rows that repeat this doc_id the one with the last locator stays.
    The locator is file and row; rows that are not read from files are written to the shared folder first.
    Groups come from the stream, by digest. Rows of a digest that came more than once are hits: their full bytes are compared, by
    grouping, and a digest that has several texts is split by text. Rows of a hot digest meet its group, and bring their texts, in parts.
    An empty table gives an empty table. Columns of `docs` other than key and text are not read, whatever their names.
    """
    return _dedup(filed(docs.select(column(key).alias("doc_id"), column(text).alias("text"))), "doc_id", "text", digest, files_per_batch)


def _dedup(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 10_000) -> DataFrame:
    """`dedup` of rows that have places in files."""
    spark = docs.sparkSession
    rows = docs.select(column(key).cast("bigint").alias("doc_id"), place_of(docs).alias("locator"), normalised(column(text)).alias("text")).withColumn("digest", digest(F.col("text")))
    seen, path = stored_at(rows.select("doc_id", "digest", "locator", F.sha2("text", 256).alias("text_sha256")), "dedup-arrivals")
    groups = stored(stream_groups(spark, path, seen.schema, new_folder(spark, "dedup-stream"), files_per_batch), "dedup-groups")

    matched = stored(looked_up(seen, groups.where("n > 1"), "digest", F.xxhash64("locator")), "dedup-matched")
    part = F.pmod(F.xxhash64("locator"), F.lit(SALTS))
    parts = matched.where("n > 1").select(F.col("digest").alias("hit"), part.alias("hit_part")).distinct()
    hits = rows.join(parts, (F.col("digest") == F.col("hit")) & (part == F.col("hit_part")), "left_semi")
    by_text = hits.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("n"))
    split = stored(by_text.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-split")
    if split.isEmpty():  # always so, unless the digest collides
        return _verdicts(matched)
    apart = hits.join(split, "digest", "left_semi").withColumn("text_sha256", F.sha2("text", 256)).join(by_text, ["digest", "text"])
    return _verdicts(matched.join(split, "digest", "left_anti")).unionByName(_verdicts(apart))


def _verdicts(matched: DataFrame) -> DataFrame:
    """Rows without a group of several are alone."""
    return matched.select(
        "doc_id", "locator", F.coalesce("keeper.doc_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("keeper").isNull() | F.struct("doc_id", "locator").eqNullSafe(F.struct("keeper.doc_id", "keeper.locator"))).alias("kept"), "text_sha256",
    )


def keep_unique(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that `dedup` keeps, with all their columns, whatever their names."""
    docs = filed(docs)
    row = unused("__locator", docs)
    kept = _dedup(docs, key, text).where("kept").select(F.col("locator").alias(row))
    return docs.select(place_of(docs).alias(row), *map(column, docs.columns)).join(kept, row, "left_semi").drop(row)


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(s) AS text_sha256
FROM t WINDOW w AS (PARTITION BY s)
"""


@query("op10_exact_dedup", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts in `documents`."""
    return dedup(table(spark, sf_dir, "documents")).drop("locator")
