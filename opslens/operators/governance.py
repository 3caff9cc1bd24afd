"""Schema comparison, DDL rules, sensitive columns, masking and its compliance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens import rules
from opslens.functions.exprs import case
from opslens.functions.masks import mask


def schema_rows(df: DataFrame, table: str) -> DataFrame:
    """Schema snapshot of a DataFrame."""
    spark = df.sparkSession
    rows = [(table, f.name, f.dataType.simpleString(), i + 1, not f.nullable) for i, f in enumerate(df.schema.fields)]
    return rules.rule_table(spark, "table_name string, column_name string, data_type string, ordinal_position int, not_null boolean", rows)


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns added, removed or of another type, with whether the whole table is new or gone.

    A table's side is known from an aggregate of the joined rows, so both schemas are read once.
    """
    key = ["table_name", "column_name"]
    s = source.select(*key, F.col("data_type").alias("source_type"))
    t = target.select(*key, F.col("data_type").alias("target_type"))
    both = s.join(t, key, "full_outer")
    sides = both.groupBy("table_name").agg(
        F.bool_or(F.col("source_type").isNotNull()).alias("_in_source"), F.bool_or(F.col("target_type").isNotNull()).alias("_in_target")
    )
    change = case(
        (F.col("source_type").isNull(), "column_added"),
        (F.col("target_type").isNull(), "column_removed"),
        (F.col("source_type") != F.col("target_type"), "type_changed"),
    )
    table_change = case((~F.col("_in_source"), "table_added"), (~F.col("_in_target"), "table_removed"), default="table_kept")
    return (
        both.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .join(sides, "table_name")
        .withColumn("table_change", table_change)
        .drop("_in_source", "_in_target")
    )


def table_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables added, removed or common, from one union and aggregate."""
    both = source.select("table_name", F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        target.select("table_name", F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    sides = both.groupBy("table_name").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    return sides.select("table_name", case((F.col("s") == 0, "added"), (F.col("t") == 0, "removed"), default="common").alias("change"))


def is_repeatable(ddl: Column) -> Column:
    """Whether a statement may run again: guarded forms pass, bare drops, truncates and creates do not."""
    text = F.trim(F.upper(ddl))
    guarded = text.rlike("IF NOT EXISTS|IF EXISTS|OR REPLACE")
    destructive = text.rlike("DROP TABLE |DROP INDEX |TRUNCATE ")
    return case((guarded, True), (destructive, False), default=~text.startswith("CREATE"))


def inventory(spark: SparkSession) -> DataFrame:
    return rules.rule_table(
        spark, "classification string, column_name string, masking_function string, regulations string", rules.SENSITIVE_COLUMNS
    )


def sensitive_scan(columns: DataFrame) -> DataFrame:
    """Schema columns that are in the inventory, in any case."""
    inv = inventory(columns.sparkSession).withColumnRenamed("column_name", "_name")
    return columns.join(inv, F.lower("column_name") == F.col("_name")).drop("_name")


def mask_table(df: DataFrame, assigned: Mapping[str, str]) -> DataFrame:
    """df with the assigned masks applied (column -> mask)."""
    return df.withColumns({c: mask(name, c) for c, name in assigned.items()})


# What personal data looks like in text; the same patterns work in both regex dialects in use.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "phone": r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b",
}

# A cheaper test that every text with a match passes; most texts stop here.
PII_NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9]{4}", "phone": "[0-9]{3}"}


def pii_scan(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Rows and matches of each kind of personal data per group, over whole texts."""
    def matches(kind: str) -> Column:
        return F.when(F.col(text).rlike(PII_NEEDS[kind]), F.regexp_count(F.col(text), F.lit(PII_PATTERNS[kind]))).otherwise(0)

    hits = df.select(*keys, *[matches(k).alias(k) for k in PII_PATTERNS])
    return hits.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *[F.sum(k).cast("bigint").alias(f"{k}_matches") for k in PII_PATTERNS],
        *[F.count_if(F.col(k) > 0).alias(f"{k}_rows") for k in PII_PATTERNS],
    )


def _sides(parent: DataFrame, branch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of both, with p and b telling whether the parent and the branch have them.

    Rows are dealt out by all columns first: hardly any of them repeat on one side, so combining them in the tasks that read would gather whole files there and save no shuffling.
    """
    both = parent.select(*columns, F.lit(1).alias("p"), F.lit(0).alias("b")).unionByName(
        branch.select(*columns, F.lit(0).alias("p"), F.lit(1).alias("b"))
    )
    return both.repartition(*columns).groupBy(*columns).agg(F.max("p").alias("p"), F.max("b").alias("b"))


def policy_diff(parent: DataFrame, branch: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Policies missing on the branch or extra on it, one row each."""
    per = _sides(parent, branch, [*keys, *item])
    return per.where(F.col("p") != F.col("b")).select(*keys, *item, F.when(F.col("b") == 0, "missing").otherwise("extra").alias("difference"))


def mask_compliance(parent: DataFrame, branch: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Policy counts, missing and extra per branch, with their names; compliant when nothing is missing.

    A name is the parts of `item` joined by dots, a null part being empty; names are sorted, and only those of policies that differ are gathered. Repeated policies count once.
    """
    per = _sides(parent, branch, [*keys, *item])
    name = F.concat_ws(".", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in item])

    def names(side: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col(side) == 0, name))), ",")

    return (
        per.groupBy(*keys)
        .agg(
            F.sum("p").alias("parent_policy_count"),
            F.sum("b").alias("branch_policy_count"),
            F.count_if(F.col("b") == 0).alias("missing"),
            F.count_if(F.col("p") == 0).alias("extra"),
            names("b").alias("missing_policies"),
            names("p").alias("extra_policies"),
        )
        .withColumn("compliant", F.col("missing") == 0)
    )


def name_align(projects: DataFrame, project: str, catalogs: DataFrame, catalog: str) -> DataFrame:
    """Project names with hyphens against catalog names with underscores."""
    want = projects.select(F.col(project), F.replace(F.col(project), F.lit("-"), F.lit("_")).alias("expected_catalog")).distinct()
    have = catalogs.select(F.col(catalog).alias("expected_catalog"), F.lit(True).alias("_there")).distinct()
    return want.join(have, "expected_catalog", "left").select(
        project, "expected_catalog", F.coalesce("_there", F.lit(False)).alias("aligned")
    )
