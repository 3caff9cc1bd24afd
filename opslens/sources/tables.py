"""Operational tables on a shared file system."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from opslens import schemas
from opslens.functions.exprs import instant, keyed_id


def path_of(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def folder_of(table: str) -> str:
    """The column by which a table has a folder per day or per month."""
    return schemas.PARTITIONS[table][0]


def read_ops(spark: SparkSession, base: str, table: str, since: datetime | None = None) -> DataFrame:
    """Operational table with its declared schema, in its order; no inference.

    With `since`, rows from that time on; only folders of those days or months are listed and opened.
    """
    schema, folder = schemas.schema_of(table), folder_of(table)
    rows = spark.read.schema(StructType([*schema.fields, StructField(folder, DateType())])).parquet(path_of(base, table))
    if since is not None:
        ts = schemas.EVENT_TIME[table]
        first = since.date() if folder == schemas.DAY else since.date().replace(day=1)
        rows = rows.where((F.col(ts) >= instant(rows, ts, since)) & (F.col(folder) >= F.lit(first)))
    return rows.select(*schema.names)


def create_ops_tables(spark: SparkSession, base: str, database: str = "default") -> list[str]:
    """Create all operational tables over `base`; safe to repeat."""
    for table, ddl in schemas.DDL.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{table} ({ddl}, {folder_of(table)} DATE) USING parquet"
            f" PARTITIONED BY ({', '.join(schemas.PARTITIONS[table])}) LOCATION '{path_of(base, table)}'"
        )
    return list(schemas.DDL)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the declared schema, in order; missing ones are null, unknown ones are an error."""
    schema = schemas.schema_of(table)
    unknown = set(df.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"{table} has no column {sorted(unknown)}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _placed(df: DataFrame, table: str) -> DataFrame:
    """Rows of the table's schema, rebalanced: a partition gets few files of a useful size and a large one several."""
    folder, ts = folder_of(table), schemas.EVENT_TIME[table]
    out = conform(df, table).withColumn(folder, F.to_date(ts) if folder == schemas.DAY else F.trunc(ts, "month"))
    return out.hint("rebalance", *schemas.PARTITIONS[table])


def _write(out: DataFrame, base: str, table: str, mode: str) -> None:
    out.write.mode(mode).partitionBy(*schemas.PARTITIONS[table]).parquet(path_of(base, table))


def append(df: DataFrame, base: str, table: str, mode: str = "append") -> None:
    """Write rows to an operational table."""
    _write(_placed(df, table), base, table, mode)


def append_counted(df: DataFrame, base: str, table: str, name: str) -> int:
    """append(), and the number of rows written.

    Rows are counted behind the rebalance, in the tasks that write, where a repeated task counts once.
    """
    seen = Observation(name)
    _write(_placed(df, table).observe(seen, F.count(F.lit(1)).alias("rows")), base, table, "append")
    return int(seen.get["rows"])


def save_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, mode: str = "overwrite") -> None:
    """Save as a table bucketed and sorted by keys, so that later joins and aggregates on them need no shuffle."""
    df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def write_archive(df: DataFrame, path: str, batch: str) -> None:
    """Add a batch to an archive whose schema follows its source. A batch that is written again replaces itself."""
    df.hint("rebalance").write.mode("overwrite").parquet(f"{path}/archive_batch={batch}")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).drop("archive_batch")


def stamp_snapshot(df: DataFrame, project_id: str, branch_id: str, as_of: datetime, key: str = "queryid") -> DataFrame:
    """Add snapshot id, project, branch and time; an existing time is kept, a null one filled.

    Absent counters become zero.
    """
    counters = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double") and f.name != key]
    stamp = F.lit(as_of.isoformat(sep=" ")).cast("timestamp")
    present = F.col("snapshot_timestamp") if "snapshot_timestamp" in df.columns else F.lit(None)
    out = (
        df.na.fill(0, counters)
        .withColumn("project_id", F.lit(project_id))
        .withColumn("branch_id", F.lit(branch_id))
        .withColumn("snapshot_timestamp", F.coalesce(present, stamp))
    )
    return out.withColumn("snapshot_id", keyed_id("project_id", "branch_id", key, "snapshot_timestamp"))


def apply_retention(df: DataFrame, ts: str, days: int, as_of: datetime) -> DataFrame:
    """Rows not older than `days`."""
    return df.where(F.col(ts) >= instant(df, ts, as_of - timedelta(days=days)))


def retention_days(table: str) -> int:
    """Measurements are kept shorter than what an audit may ask for."""
    return schemas.METRIC_RETENTION_DAYS if folder_of(table) == schemas.DAY else schemas.AUDIT_RETENTION_DAYS


def drop_expired(spark: SparkSession, base: str, table: str, as_of: datetime) -> list[date]:
    """Remove the folders of days or months that end before the table's retention, and name their first days. No row is read or rewritten.

    Rows of the day or month in which the retention ends stay until it is over; rows without a time stay.
    """
    limit = (as_of - timedelta(days=retention_days(table))).date()

    def after(first: date) -> date:
        return first + timedelta(days=1) if folder_of(table) == schemas.DAY else (first + timedelta(days=31)).replace(day=1)

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path_of(base, table))
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in store.listStatus(root):
        name, _, day = status.getPath().getName().partition("=")
        if name == folder_of(table) and day[:2].isdigit() and after(date.fromisoformat(day)) <= limit:
            store.delete(status.getPath(), True)
            gone.append(date.fromisoformat(day))
    return sorted(gone)


def write_retained(spark: SparkSession, base: str, table: str, target: str, as_of: datetime) -> None:
    """Rows of a table inside its retention, written under another base; the caller swaps the paths.

    Writing beside the table keeps it readable and whole until the new copy is complete, and also drops partitions
    that have no row left.
    """
    kept = apply_retention(read_ops(spark, base, table), schemas.EVENT_TIME[table], retention_days(table), as_of)
    append(kept, target, table, mode="overwrite")


def write_audit(log: DataFrame) -> DataFrame:
    """Writes and records per table from a log of writes (table, records)."""
    return log.groupBy("table").agg(
        F.count("*").alias("writes"), F.sum("records").cast("bigint").alias("records")
    )
