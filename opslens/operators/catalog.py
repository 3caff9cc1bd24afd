"""One profile per database from flat catalog frames of a whole fleet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opslens import rules
from opslens.operators.assessment import PROFILE_DDL

#: Kinds of catalog objects and the column that counts them.
COUNTS = {
    "sequences": "sequence_count", "custom_types": "custom_type_count", "foreign_keys": "foreign_key_count", "materialized_views": "materialized_view_count",
    "triggers": "trigger_count", "rls_policies": "rls_policy_count", "large_objects": "large_object_count", "exclusion_constraints": "exclusion_constraint_count",
    "custom_aggregates": "custom_aggregate_count", "publications": "publication_count",
}
TABLES = ("tables", "partitioned_tables")
#: Columns of a profile beside those that scoring reads.
MORE = ["schemas", "partitioned_tables", "event_triggers", "collations", *[c for c in COUNTS.values() if f"{c} " not in PROFILE_DDL]]
GB = 1024.0**3
_STACKED = "db_id, part, schema_name, name, detail, amount"


def line_count(source: Column) -> Column:
    """Lines of a function's source, 0 for none."""
    breaks = F.char_length(source) - F.char_length(F.translate(source, "\n", ""))
    return F.when(F.coalesce(F.char_length(source), F.lit(0)) > 0, breaks + 1).otherwise(0).cast("int")


def _rows(df: DataFrame, part: Column, schema_name: Column | None = None, name: Column | None = None, detail: Column | None = None, amount: Column | None = None) -> DataFrame:
    text = F.lit(None).cast("string")
    cells = [text if c is None else c.cast("string") for c in (schema_name, name, detail)]
    return df.select(F.col("db_id").cast("string").alias("db_id"), part.alias("part"), *cells, (F.lit(None) if amount is None else amount).cast("bigint")).toDF(*_STACKED.split(", "))


def database_profiles(
    databases: DataFrame, objects: DataFrame, extensions: DataFrame, functions: DataFrame, slots: DataFrame, event_triggers: DataFrame, attributes: DataFrame,
    default_collations: Sequence[str] = rules.DEFAULT_COLLATIONS, system_schemas: Sequence[str] = rules.SYSTEM_SCHEMAS,
) -> DataFrame:
    """A row per database with all columns of PROFILE_DDL, as `assessment.score` reads them, and MORE.

    databases (db_id, source_engine, region, engine_version), objects (db_id, schema_name, kind, name, size_bytes), extensions (db_id, name, version),
    functions (db_id, schema_name, name, language, source), slots (db_id, slot_name, slot_type), event_triggers (db_id, name), and
    attributes (db_id, table_name, column_name, attnum, attisdropped, collname). Databases that nothing else names have counts of 0 and empty lists;
    rows of a database that `databases` lacks are left out. Objects and functions of system schemas and internal functions do not count, nor does the extension
    that every database has. What a catalog does not say (workload, what only document engines have) is null.

    All frames are stacked and folded by one aggregate, so they meet in one shuffle and no join. Lists are sorted. A list holds what one database has,
    which its catalog bounds; counts are combined before the shuffle.
    """
    own_schema = F.coalesce(~F.col("schema_name").isin(*system_schemas), F.lit(True))
    kept = ~F.coalesce(F.col("attisdropped"), F.lit(False)) & (F.col("attnum") > 0) & ~F.col("collname").isin(*default_collations)
    stacked = reduce(DataFrame.unionByName, [
        _rows(databases, F.lit("database"), F.col("engine_version"), F.col("source_engine"), F.col("region")),
        _rows(objects.where(own_schema), F.col("kind"), F.col("schema_name"), F.col("name"), amount=F.col("size_bytes")),
        _rows(extensions.where("name != 'plpgsql'"), F.lit("extension"), name=F.col("name"), detail=F.col("version")),
        _rows(functions.where(own_schema & (F.col("language") != "internal")), F.lit("function"), F.col("schema_name"), F.col("name"), F.col("language"), line_count(F.col("source"))),
        _rows(slots, F.lit("slot"), name=F.col("slot_name"), detail=F.col("slot_type")),
        _rows(event_triggers, F.lit("event_trigger"), name=F.col("name")),
        _rows(attributes.where(kept), F.lit("collation"), F.col("table_name"), F.col("column_name"), F.col("collname")),
    ])

    def of(part: str) -> Column:
        return F.col("part") == part

    def listed(part: str, value: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(of(part), value)))

    is_table = F.col("part").isin(*TABLES)
    head = F.max(F.when(of("database"), F.struct(F.col("name").alias("source_engine"), F.col("detail").alias("region"), F.col("schema_name").alias("engine_version"))))
    name, detail = F.col("name"), F.col("detail")
    folded = stacked.groupBy("db_id").agg(
        head.alias("head"),
        F.sum(F.when(is_table, F.col("amount"))).alias("bytes"),
        F.count_if(is_table).cast("int").alias("table_count"),
        *[F.count_if(of(k)).cast("int").alias(c) for k, c in COUNTS.items()],
        listed("extension", F.struct("name", detail.alias("version"))).alias("extensions"),
        listed("function", F.struct("name", detail.alias("language"), F.col("amount").cast("int").alias("line_count"))).alias("functions"),
        listed("slot", name).alias("replication_slots"),
        F.coalesce(F.bool_or(of("publications") | (of("slot") & (detail == "logical"))), F.lit(False)).alias("has_logical_replication"),
        listed("event_trigger", name).alias("event_triggers"),
        listed("collation", F.struct(F.col("schema_name").alias("table_name"), name.alias("column_name"), detail.alias("collname"))).alias("collations"),
        F.sort_array(F.collect_set(F.when(F.col("part").isin(*TABLES, *COUNTS), F.col("schema_name")))).alias("schemas"),
        listed("partitioned_tables", F.concat_ws(".", "schema_name", "name")).alias("partitioned_tables"),
        F.count(F.when(of("database"), 1)).alias("known"),
    ).where("known > 0")
    known = folded.withColumns({
        "source_engine": F.col("head.source_engine"), "region": F.col("head.region"), "engine_version": F.col("head.engine_version"),
        "size_gb": F.round(F.coalesce("bytes", F.lit(0)) / GB, 2), "event_trigger_count": F.size("event_triggers"), "non_default_collation_count": F.size("collations"),
    })
    fields = StructType.fromDDL(PROFILE_DDL).fields
    return known.select(*[(F.col(f.name) if f.name in known.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], *MORE)
