"""Index, vacuum and transaction-age findings over catalog snapshots of the whole fleet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions.exprs import case, keyed_id, safe_ratio
from opslens.functions.spread import same_keys

MB = 1024 * 1024
FINDING = ["project_id", "branch_id", "table_name", "index_name", "recommendation_type", "confidence", "size_mb", "ddl_statement"]


def _finding(df: DataFrame, kind: str, confidence, size, ddl) -> DataFrame:
    return df.select(
        "project_id",
        "branch_id",
        "table_name",
        "index_name",
        F.lit(kind).alias("recommendation_type"),
        confidence.alias("confidence"),
        size.cast("double").alias("size_mb"),
        ddl.alias("ddl_statement"),
    )


def unused_indexes(stats: DataFrame, meta: DataFrame, keys: Sequence[str] = ("project_id", "branch_id", "indexrelid")) -> DataFrame:
    """Never scanned indexes that are neither unique nor primary; high confidence above 10 MB. A null key is a key like any other."""
    plain = meta.where(~F.col("indisunique") & ~F.col("indisprimary")).select(*keys)
    rows = stats.where(F.col("idx_scan") == 0).alias("s").join(plain.alias("m"), same_keys("s", "m", keys), "left_semi")
    size = F.col("index_size_bytes") / MB
    return _finding(
        rows,
        "drop_unused",
        F.when(size > 10, "high").otherwise("medium"),
        size,
        F.concat(F.lit("DROP INDEX CONCURRENTLY IF EXISTS "), F.col("index_name")),
    )


def bloated_indexes(stats: DataFrame, min_mb: float = 50, max_scans: int = 100) -> DataFrame:
    """Large and rarely scanned indexes. No bloat ratio is invented: size and scans only."""
    size = F.col("index_size_bytes") / MB
    return _finding(
        stats.where((size > min_mb) & (F.col("idx_scan") < max_scans)),
        "reindex_bloated",
        F.lit("medium"),
        size,
        F.concat(F.lit("REINDEX INDEX CONCURRENTLY "), F.col("index_name")),
    )


def missing_indexes(tables: DataFrame) -> DataFrame:
    """Large tables that are read by full scans."""
    seq, idx = F.col("seq_scan"), F.col("idx_scan")
    return tables.where((seq > 100) & (F.col("n_live_tup") > 10_000) & ((idx == 0) | (seq > idx * 10))).withColumn(
        "avg_tup_per_scan", safe_ratio(F.col("seq_tup_read"), seq, 0.0)
    )


def duplicate_indexes(indexes: DataFrame, table: Sequence[str], columns: str = "indkey", index: str = "indexrelid") -> DataFrame:
    """Indexes of one table over the same columns: each later one beside the first.

    A group of n equal indexes gives n - 1 rows, which name every index to drop, and not n(n-1)/2 pairs.
    The first index comes from a map-side combined aggregate. A null key is a key like any other.
    """
    group = [*table, columns]
    usable = indexes.where(~F.col("indisprimary"))
    first = usable.groupBy(*group).agg(
        F.min(index).alias("keep_index"), F.min_by("index_size_bytes", index).alias("keep_size"), F.count("*").alias("copies")
    )
    return (
        usable.alias("u").join(first.where(F.col("copies") > 1).alias("f"), same_keys("u", "f", group))
        .where(F.col(index) > F.col("keep_index"))
        .select(*[f"u.{c}" for c in group], "keep_index", "keep_size", F.col(index).alias("drop_index"), F.col("index_size_bytes").alias("drop_size"))
    )


def unindexed_foreign_keys(constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """Foreign keys whose first column is in no index of the table.

    Index keys are exploded and reduced to distinct (table, column), so the test is a hash anti join.
    """
    covered = indexes.select("indrelid", F.explode("indkey").alias("attnum")).distinct()
    keyed = constraints.withColumn("_first", F.element_at("conkey", 1))
    return keyed.join(
        covered, (F.col("conrelid") == F.col("indrelid")) & (F.col("_first") == F.col("attnum")), "left_anti"
    ).withColumnRenamed("_first", "column_number")


#: Parts that columns of tables are dealt into, whatever their bytes: a task of the join below holds each of them in several maps and sorts.
PARTS = 64


def unindexed_columns(constraints: DataFrame, indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """conrelid, column_number and column_name of the first columns of foreign keys that are in no index of the table, with the number of such `constraints`.

    Foreign keys and index keys are stacked and folded in one aggregate. They are dealt out by table and column first, since hardly any repeat within the tasks
    that read them. A null table or column is in no index, and has no name.
    """
    key = ["conrelid", "column_number"]
    fk = constraints.select("conrelid", F.element_at("conkey", 1).alias("column_number"), F.lit(1).alias("n"))
    covered = indexes.select(F.col("indrelid").alias("conrelid"), F.explode("indkey").alias("column_number"), F.lit(0).alias("n"))
    keyed = fk.unionByName(covered).dropna(subset=key).repartition(PARTS, *key)
    per = keyed.groupBy(*key).agg(F.sum("n").alias("constraints"), F.min("n").alias("_least")).where(F.col("_least") > 0).drop("_least")
    names = attributes.select(F.col("attrelid").alias("conrelid"), F.col("attnum").alias("column_number"), F.col("attname").alias("column_name"))
    return per.join(names.dropna(subset=key).repartition(PARTS, *key), key)


def key_members(constraints: DataFrame, attributes: DataFrame) -> DataFrame:
    """Columns that belong to a constraint's key array."""
    members = constraints.select("conname", "conrelid", F.explode("conkey").alias("attnum"))
    return members.join(
        attributes, (F.col("conrelid") == F.col("attrelid")) & (members.attnum == attributes.attnum)
    ).select("conname", "conrelid", members.attnum, "attname")


def missing_findings(tables: DataFrame) -> DataFrame:
    """Findings for tables that are read by full scans; which columns to index must be read off the statements."""
    named = missing_indexes(tables).withColumn("table_name", F.col("relname")).withColumn("index_name", F.lit(None).cast("string"))
    return _finding(named, "create_missing", F.lit("medium"), F.lit(0), F.lit(None).cast("string"))


def duplicate_findings(indexes: DataFrame) -> DataFrame:
    """Findings for all but the first index, by name, over the same columns of a table."""
    found = duplicate_indexes(indexes, ["project_id", "branch_id", "table_name"], index="index_name").withColumn("index_name", F.col("drop_index"))
    return _finding(found, "drop_duplicate", F.lit("high"), F.col("drop_size") / MB, F.concat(F.lit("DROP INDEX CONCURRENTLY "), F.col("index_name")))


def foreign_key_findings(unindexed: DataFrame) -> DataFrame:
    """Findings for foreign keys without an index (project_id, branch_id, table_name, column_name), one per column."""
    per = unindexed.select("project_id", "branch_id", "table_name", "column_name").distinct().withColumn("index_name", F.lit(None).cast("string"))
    t, c = F.col("table_name"), F.col("column_name")
    ddl = F.concat(F.lit("CREATE INDEX CONCURRENTLY idx_"), t, F.lit("_"), c, F.lit(" ON "), t, F.lit("("), c, F.lit(")"))
    return _finding(per, "create_fk_index", F.lit("high"), F.lit(0), ddl)


def union_findings(*frames: DataFrame) -> DataFrame:
    """One recommendation list with deterministic ids."""
    out = reduce(DataFrame.unionByName, [f.select(*FINDING) for f in frames])
    return out.withColumn(
        "recommendation_id", keyed_id("project_id", "branch_id", "table_name", "index_name", "recommendation_type", "ddl_statement")
    )


def index_health(findings: DataFrame, branches: DataFrame, keys: Sequence[str] = ("project_id", "branch_id")) -> DataFrame:
    """Issues and score of every one of `branches`: 100 less 10 per issue, at least 0.

    Branches are stacked under the findings and counted with them, so one without findings scores 100.
    """
    marks = findings.select(*keys, F.lit(1).alias("issue")).unionByName(branches.select(*keys).withColumn("issue", F.lit(0)))
    return (
        marks.groupBy(*keys)
        .agg(F.sum("issue").alias("total_issues"))
        .withColumn("health_score", F.greatest(F.lit(0), F.lit(100) - F.col("total_issues") * 10))
    )


def vacuum_candidates(tables: DataFrame, min_dead: int = 1000) -> DataFrame:
    """Tables with many dead rows: over 30 percent full vacuum, over 10 percent vacuum and analyze."""
    dead, live = F.col("n_dead_tup"), F.col("n_live_tup")
    pct = safe_ratio(dead, live + dead) * 100
    return (
        tables.where(dead > min_dead)
        .withColumn("dead_pct", pct)
        .withColumn(
            "action", case((F.col("dead_pct") > 30, "VACUUM FULL"), (F.col("dead_pct") > 10, "VACUUM ANALYZE"), default="none")
        )
    )


def dead_tuple_top(tables: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """Tables with the most dead rows per branch."""
    w = W.partitionBy(*keys).orderBy(F.desc("n_dead_tup"), "relname")
    dead = F.col("n_dead_tup")
    return (
        tables.withColumn("dead_ratio", safe_ratio(dead, F.col("n_live_tup") + dead, 0.0))
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= k)
    )


def xid_risk(databases: DataFrame) -> DataFrame:
    """Transaction age against the wraparound horizon."""
    age = F.col("xid_age")
    return databases.withColumn("pct_to_wraparound", age * 100.0 / F.lit(2e9)).withColumn(
        "risk", case((age > 1_000_000_000, "critical"), (age > 500_000_000, "warning"), default="safe")
    )


def xid_risk_by_branch(databases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst level per branch."""
    rank = case((F.col("risk") == "critical", 2), (F.col("risk") == "warning", 1), default=0)
    return xid_risk(databases).groupBy(*keys).agg(
        F.max("xid_age").alias("max_xid_age"), F.max_by("risk", rank).alias("risk")
    )


def autovacuum_tuning(tables: DataFrame) -> DataFrame:
    """Scale factor and threshold for large tables."""
    live = F.col("n_live_tup")
    return (
        tables.where(live > 100_000)
        .withColumn("scale_factor", F.when(live > 1_000_000, 0.01).otherwise(0.05))
        .withColumn(
            "vacuum_threshold",
            F.when(live > 1_000_000, F.greatest(F.lit(1000), F.floor(live * 0.01))).otherwise(
                F.greatest(F.lit(500), F.floor(live * 0.05))
            ).cast("bigint"),
        )
    )


def hot_tables(tables: DataFrame, limit: int = 10) -> DataFrame:
    """Most written tables."""
    return (
        tables.withColumn("writes", F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del"))
        .orderBy(F.desc("writes"), "project_id", "relname")
        .limit(limit)
    )


def user_tables(classes: DataFrame, namespaces: DataFrame, system: Sequence[str]) -> DataFrame:
    """Ordinary and partitioned tables outside the system schemas."""
    spaces = namespaces.where(~F.col("nspname").isin(*system)).select(F.col("oid").alias("relnamespace"), "nspname")
    return classes.where(F.col("relkind").isin("r", "p")).join(spaces, "relnamespace")


def table_inventory(classes: DataFrame, namespaces: DataFrame, attributes: DataFrame, indexes: DataFrame, system: Sequence[str]) -> DataFrame:
    """Tables with their counts of columns and indexes; counts are taken before the join."""
    cols = (
        attributes.where((F.col("attnum") > 0) & ~F.col("attisdropped"))
        .groupBy(F.col("attrelid").alias("oid"))
        .agg(F.count("*").alias("column_count"))
    )
    idx = indexes.groupBy(F.col("indrelid").alias("oid")).agg(F.count("*").alias("index_count"))
    return (
        user_tables(classes, namespaces, system)
        .join(cols, "oid", "left")
        .join(idx, "oid", "left")
        .na.fill(0, ["column_count", "index_count"])
    )


def schema_snapshot(classes: DataFrame, namespaces: DataFrame, attributes: DataFrame, defaults: DataFrame, schema: str = "public") -> DataFrame:
    """Live columns of the tables of one schema with their defaults."""
    tables = classes.where(F.col("relkind").isin("r", "p")).join(
        namespaces.where(F.col("nspname") == schema).select(F.col("oid").alias("relnamespace")), "relnamespace", "left_semi"
    )
    live = attributes.where((F.col("attnum") > 0) & ~F.col("attisdropped"))
    return (
        tables.select(F.col("oid").alias("attrelid"), "relname")
        .join(live, "attrelid")
        .join(defaults.select(F.col("adrelid").alias("attrelid"), F.col("adnum").alias("attnum"), "adbin"), ["attrelid", "attnum"], "left")
        .select(
            F.col("relname").alias("table_name"),
            F.col("attname").alias("column_name"),
            F.col("atttype").alias("data_type"),
            F.col("attnum").alias("ordinal_position"),
            F.col("attnotnull").alias("not_null"),
            F.col("adbin").alias("column_default"),
        )
    )


def catalog_inventory(objects: DataFrame, databases: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Objects of each kind per database, zero where none, with the total size.

    `objects` has one row per catalog object (db_id, schema_name, kind, size_bytes).
    """
    counts = objects.groupBy("db_id").agg(
        F.count_distinct("schema_name").alias("schemas"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds],
        F.sum("size_bytes").cast("bigint").alias("total_bytes"),
    )
    return databases.select("db_id").join(counts, "db_id", "left").na.fill(0)


def functions_of(objects: DataFrame) -> DataFrame:
    """Function count and languages per database, without internal functions; the languages of a database are few."""
    return objects.where((F.col("kind") == "functions") & (F.col("language") != "internal")).groupBy("db_id").agg(
        F.count("*").alias("functions"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages")
    )


def index_usage(stats: DataFrame) -> DataFrame:
    """All indexes, the most scanned first."""
    return stats.orderBy(F.desc("idx_scan"), "indexrelid")


def database_size(objects: DataFrame) -> DataFrame:
    """Bytes per database."""
    return objects.groupBy("db_id").agg(F.sum("size_bytes").cast("bigint").alias("db_size_bytes"))


def non_default_collations(attributes: DataFrame, defaults: Sequence[str]) -> DataFrame:
    return attributes.where((F.col("attnum") > 0) & ~F.col("attisdropped") & ~F.col("collname").isin(*defaults))
