"""Readers for statistics views, document collections and parameterised SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def pg_view_options(url: str, query: str, user: str, fetch_size: int = 10_000, **split: str) -> dict[str, str]:
    """JDBC options for a view. `split` takes partitionColumn, lowerBound, upperBound and numPartitions."""
    options = {"url": url, "user": user, "driver": "org.postgresql.Driver", "fetchsize": str(fetch_size)}
    if split:
        missing = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"} - set(split)
        if missing:
            raise ValueError(f"a split read also needs {sorted(missing)}")
        return {**options, "dbtable": f"({query}) AS v", **{k: str(v) for k, v in split.items()}}
    return {**options, "query": query}


def read_pg_view(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def run_sql(spark: SparkSession, text: str, args: Mapping[str, object], limits: Mapping[str, tuple[int, int]] | None = None, **frames: DataFrame) -> DataFrame:
    """Run SQL with named parameters over the given frames ({name} in the text).

    `limits` names parameters that must be integers of a range; they are checked before anything runs.
    """
    for name, (low, high) in (limits or {}).items():
        if name in args and (not isinstance(args[name], int) or not low <= args[name] <= high):
            raise ValueError(f"{name} must be an integer from {low} to {high}")
    return spark.sql(text, args=dict(args), **frames)


def profile_collections(docs: DataFrame, container: str, body: str, partition_key: str) -> DataFrame:
    """Items, bytes, mean and largest item, and partition-key cardinality per document collection."""
    size = F.octet_length(F.col(body))
    return docs.groupBy(container).agg(
        F.count("*").alias("items"),
        F.sum(size).cast("bigint").alias("total_bytes"),
        (F.sum(size) / F.count(size)).alias("avg_item_bytes"),
        F.max(size).cast("bigint").alias("max_item_bytes"),
        F.count_distinct(F.col(partition_key)).alias("partition_keys"),
    )


def collection_paths(docs: DataFrame, container: str, body: str) -> DataFrame:
    """Top-level JSON paths per collection and how many items have them."""
    return (
        docs.select(container, F.explode(F.json_object_keys(body)).alias("path"))
        .groupBy(container, "path")
        .agg(F.count("*").alias("items"))
    )


def collection_schema(docs: DataFrame, container: str, body: str) -> DataFrame:
    """Merged schema of the JSON items of each collection, by a mergeable aggregate."""
    return docs.groupBy(container).agg(F.schema_of_variant_agg(F.parse_json(body)).alias("item_schema"))


def read_collection(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """JSON documents; give the schema in production, inference reads everything twice."""
    reader = spark.read.schema(ddl) if ddl else spark.read
    return reader.json(path)
