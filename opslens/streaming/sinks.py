"""Running streams into tables on the shared file system."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.functions.spread import same_keys
from opslens.operators import scd2


def read_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream, with the schema of those already there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_append(stream: DataFrame, folder: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process what is available into a Parquet table, exactly once; the table as a DataFrame.

    The checkpoint and the file log of the sink make a restarted run continue, not repeat.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table")
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def run_batches(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is available, batch by batch. `write` must give the same result when a batch is repeated."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()


def batch_folder(folder: str) -> Callable[[DataFrame, int], None]:
    """Writer that owns one folder per batch; a repeated batch replaces its own folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id:08d}")

    return write


def run_into_batches(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """run_batches with one folder per batch, read back with the batch number."""
    run_batches(stream, folder, batch_folder(folder), mode)
    return stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/table")


def repaired_trend(samples: DataFrame, folder: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Trend per metric and window that keeps late rows: process what is available, then merge the parts of all batches.

    A watermark drops rows behind it and holds back windows that are still open. Here each batch adds a part per window, and the
    batch pass over the parts repairs windows that got late rows and closes open ones. `late_rows` counts the rows whose
    window had ended, `delay` before the newest row of earlier batches: those a watermark would have lost.
    """
    v, ts = F.col("metric_value"), F.col("snapshot_timestamp").cast("timestamp")

    def write(df: DataFrame, batch_id: int) -> None:
        parts = df.groupBy("metric_name", F.window(ts, width).alias("w")).agg(
            F.count("*").alias("n"), F.count(v).alias("c"), F.sum(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.max(ts).alias("seen")
        )
        parts.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id:08d}")

    run_batches(samples, folder, write)
    parts = samples.sparkSession.read.parquet(f"{folder}/table")
    before = W.orderBy("batch").rowsBetween(W.unboundedPreceding, -1)  # one row per batch
    marks = parts.groupBy("batch").agg(F.max("seen").alias("seen")).select("batch", (F.max("seen").over(before) - F.expr(f"INTERVAL {delay}")).alias("mark"))
    return (
        parts.join(marks, "batch")
        .groupBy("metric_name", "w")
        .agg(
            F.sum("n").alias("n"), (F.sum("s").cast("double") / F.sum("c")).alias("avg_value"), F.min("lo").cast("double").alias("min_value"),
            F.max("hi").cast("double").alias("max_value"), F.sum(F.when(F.col("w.end") <= F.col("mark"), F.col("n")).otherwise(0)).alias("late_rows"),
        )
        .select("metric_name", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "avg_value", "min_value", "max_value", "late_rows")
    )


def last_batch(table: DataFrame) -> DataFrame:
    """Result of a stream in complete mode: what its last batch wrote."""
    return table.where(F.col("batch") == table.agg(F.max("batch")).scalar()).drop("batch")


def last_per_key(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result of a stream in update mode: the last row written for each key."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


class Scd2Store:
    """Slowly changing history kept by a change stream, without rewriting it.

    Append-only tables, one folder per batch, so a repeated batch replaces only its own folders:

    changes  every change row, by bucket of the key
    open     the open version of each key a batch touched, with the generation of the key
    closed   versions a batch closed, with the generation
    snapshot the open version of every key, every so many batches, so that a batch reads a bounded tail of `open`

    A batch reads the open versions of its own keys, continues their chains, and appends. Only a key that gets a change
    older than one it has seen is rebuilt from its changes, under the next generation; closed rows of earlier
    generations no longer count. Only batches with such keys look at earlier changes. A null key is a key like any other. The
    number of buckets is written with the first batch, and a store opened with another one refuses to write.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], ts: str, tie: Sequence[str], attributes: Sequence[str], buckets: int = 32, snapshot_every: int = 50):
        self.spark, self.folder, self.buckets, self.every = spark, folder, buckets, snapshot_every
        self.keys, self.ts, self.tie, self.attributes = list(keys), ts, list(tie), list(attributes)
        self.columns = [*self.keys, ts, *self.tie, *self.attributes]

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _put(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self._path(table)}/batch={batch_id:08d}")

    def _opened(self, before: int) -> DataFrame:
        """Open versions written before a batch: the last snapshot and what came after it."""
        last = before // self.every * self.every - 1
        log = self.spark.read.parquet(self._path("open")).where((F.col("batch") > last) & (F.col("batch") < before))
        if last < 0:
            return log
        kept = self.spark.read.parquet(f"{self._path('snapshot')}/batch={last:08d}").withColumn("batch", F.lit(last))
        return log.unionByName(kept)

    def _opened_with(self, batch_id: int) -> DataFrame:
        """_opened, and the batch itself."""
        own = self.spark.read.parquet(f"{self._path('open')}/batch={batch_id:08d}").withColumn("batch", F.lit(batch_id))
        return own if batch_id == 0 else own.unionByName(self._opened(batch_id))

    def _newest_open(self, opened: DataFrame) -> DataFrame:
        rest = [c for c in opened.columns if c not in (*self.keys, "batch")]
        return opened.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*self.keys, "r.*")

    def _versions(self, rows: DataFrame) -> DataFrame:
        return scd2.build(rows.select(*self.columns), self.keys, self.ts, self.tie, self.attributes)

    def _match(self, left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """left joined to right on the keys, nulls included, with the other columns of right."""
        joined = left.alias("l").join(right.alias("r"), same_keys("l", "r", self.keys), how)
        return joined.select("l.*") if how == "left_semi" else joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in self.keys])

    def _same_buckets(self, batch_id: int) -> None:
        if batch_id == 0:
            self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.mode("overwrite").parquet(self._path("layout"))
        written = self.spark.read.parquet(self._path("layout")).first()["buckets"]
        if written != self.buckets:
            raise ValueError(f"the store has {written} buckets and not {self.buckets}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        self._same_buckets(batch_id)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        log = self._path(f"changes/batch={batch_id:08d}")
        df.select(*self.columns).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(log)
        new = self.spark.read.schema(df.select(*self.columns).schema).parquet(log).select(*self.columns)
        order = F.struct(self.ts, *self.tie)
        touched = new.groupBy(*self.keys).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
        if batch_id == 0:
            built = self._match(self._versions(new), touched.select(*self.keys, F.lit(0).alias("generation"), F.col("_last").alias("seen")))
        else:
            opened = self._match(self._opened(batch_id), touched, "left_semi")
            state = self._match(touched, self._newest_open(opened), "left")
            # late against every change seen, not only against the start of the open version: an equal change in
            # between leaves no version, but a late change before it does
            state = state.withColumn("_late", F.coalesce(F.col("_first") < F.col("seen"), F.lit(False)))
            # read by the four branches below, and small: one row per key of this batch
            self._put(state, "state", batch_id)
            state = self.spark.read.parquet(f"{self._path('state')}/batch={batch_id:08d}")
            late, timely = state.where("_late"), state.where("NOT _late")
            resumed = timely.where(F.col("valid_from").isNotNull()).withColumn(self.ts, F.col("valid_from")).select(*self.columns)
            versions = self._versions(self._match(new, timely, "left_semi").unionByName(resumed))
            if not late.isEmpty():
                history = self.spark.read.parquet(self._path("changes")).where(F.col("batch") <= batch_id)
                late_keys = late.select(*self.keys).withColumn("bucket", bucket)
                again = history.alias("l").join(late_keys.alias("r"), same_keys("l", "r", self.keys) & (F.col("l.bucket") == F.col("r.bucket")), "left_semi")
                versions = versions.unionByName(self._versions(again))
            marks = state.select(
                *self.keys,
                (F.coalesce("generation", F.lit(0)) + F.col("_late").cast("int")).alias("generation"),
                F.greatest("_last", "seen").alias("seen"),
            )
            built = self._match(versions, marks)
        self._put(built, "built", batch_id)
        built = self.spark.read.parquet(f"{self._path('built')}/batch={batch_id:08d}")
        self._put(built.where("NOT is_current").drop("is_current", "seen"), "closed", batch_id)
        self._put(built.where("is_current").drop("is_current", "valid_to"), "open", batch_id)
        if (batch_id + 1) % self.every == 0:
            self._put(self._newest_open(self._opened_with(batch_id)), "snapshot", batch_id)

    def read(self) -> DataFrame:
        """The history as of the last batch."""
        opened = self._newest_open(self.spark.read.parquet(self._path("open")))
        closed = self.spark.read.parquet(self._path("closed")).drop("batch")
        same = same_keys("l", "r", [*self.keys, "generation"])
        valid = closed.alias("l").join(opened.select(*self.keys, "generation").alias("r"), same, "left_semi")
        current = opened.withColumn("valid_to", F.lit(None).cast(closed.schema["valid_to"].dataType))
        names = [*self.keys, *self.attributes, *self.tie, "valid_from", "valid_to"]
        return valid.select(*names).unionByName(current.select(*names)).withColumn("is_current", F.col("valid_to").isNull())


def run_scd2(
    changes: DataFrame, folder: str, keys: Sequence[str], ts: str, tie: Sequence[str], attributes: Sequence[str], buckets: int = 32, snapshot_every: int = 50
) -> DataFrame:
    """Change stream into slowly changing history; the history as a DataFrame."""
    store = Scd2Store(changes.sparkSession, folder, keys, ts, tie, attributes, buckets, snapshot_every)
    run_batches(changes, folder, store.write)
    return store.read()
