"""Fleet assessment: readiness scores, effort, sizing and plan, one row per database.

A score is 100 less points for what is found, at least 0. Findings that block or delay a move are kept as an array of
(category, severity, effort_days). All of it is column expressions over one row, so the fleet needs no shuffle here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import rules
from opslens.functions.exprs import case, step

BLOCKER = "array<struct<category:string,severity:string,effort_days:double>>"

PROFILE_DDL = (
    "db_id STRING, source_engine STRING, region STRING, size_gb DOUBLE, table_count INT, engine_version STRING,"
    " extensions ARRAY<STRUCT<name: STRING, version: STRING>>,"
    " functions ARRAY<STRUCT<name: STRING, language: STRING, line_count: INT>>, trigger_count INT,"
    " materialized_view_count INT, custom_type_count INT, has_logical_replication BOOLEAN,"
    " replication_slots ARRAY<STRING>, event_trigger_count INT, large_object_count INT,"
    " non_default_collation_count INT, streams_enabled BOOLEAN, pitr_enabled BOOLEAN, ttl_enabled BOOLEAN,"
    " billing_mode STRING, gsi_count INT, lsi_count INT, item_size_avg_bytes BIGINT, regions ARRAY<STRING>,"
    " change_feed_mode STRING, multi_region_writes BOOLEAN, consistency_level STRING, throughput_mode STRING,"
    " request_units BIGINT, autoscale_max_units BIGINT, partition_key_paths ARRAY<STRING>,"
    " unindexed_containers INT, backup_policy STRING,"
    " workload STRUCT<avg_qps: DOUBLE, peak_qps: DOUBLE, avg_tps: DOUBLE, p99_latency_ms: DOUBLE, reads_pct: DOUBLE,"
    " writes_pct: DOUBLE, connection_count_avg: INT, connection_count_peak: INT, source: STRING>"
)


def _zero() -> Column:
    return F.lit(0.0)



def _empty() -> Column:
    return F.array().cast(BLOCKER)


def _found(cond: Column, category: str, severity: str, days: float) -> Column:
    """One finding where the condition holds."""
    row = F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(float(days)).alias("effort_days"))
    return F.when(cond, F.array(row).cast(BLOCKER)).otherwise(_empty())


def _score(*points: Column) -> Column:
    out = F.lit(100.0)
    for p in points:
        out = out - p
    return F.greatest(F.lit(0.0), out)


def _is(engine: str) -> Column:
    return F.col("source_engine") == engine


def _document() -> Column:
    return F.col("source_engine").isin(*rules.DOCUMENT_ENGINES)


def _by_engine(relational: Column, dynamo: Column, cosmos: Column) -> Column:
    return F.when(_is("cosmosdb-nosql"), cosmos).when(_is("dynamodb"), dynamo).otherwise(relational)


def _n_regions() -> Column:
    return F.coalesce(F.size("regions"), F.lit(0))


def score_storage(db: DataFrame) -> DataFrame:
    """Size against the largest and the small tier."""
    gb = F.col("size_gb")
    score = case(
        (gb > rules.MAX_STORAGE_GB, F.lit(0.0)),
        (gb > rules.MAX_STORAGE_SMALL_TIER_GB, F.greatest(_zero(), 100 * (1 - gb / rules.MAX_STORAGE_GB))),
        default=F.round(F.greatest(_zero(), 100 * (1 - gb / rules.MAX_STORAGE_SMALL_TIER_GB * 0.5)), 1),
    )
    return db.withColumns({"s_storage": score, "b_storage": _found(gb > rules.MAX_STORAGE_GB, "storage", "blocker", 0)})


def _extension_names() -> Column:
    return F.transform(F.coalesce("extensions", F.array().cast("array<struct<name:string,version:string>>")), lambda e: F.lower(e["name"]))


def _among(names: Sequence[str]) -> Callable[[Column], Column]:
    """Test for one of fixed names; their array is one expression, parsed once."""
    known = F.expr("array(" + ", ".join(f"'{n}'" for n in names) + ")")
    return lambda n: F.array_contains(known, n)


def feature_support(engine: str) -> dict[str, int]:
    """Features of a document engine by status."""
    out = {"supported": 0, "workaround": 0, "unsupported": 0}
    for name, _, status in rules.ENGINE_FEATURES:
        if name == engine:
            out[status] += 1
    return out


def _feature_findings(engine: str) -> Column:
    n = feature_support(engine)
    return F.concat(
        F.array_repeat(F.struct(F.lit("feature_compatibility").alias("category"), F.lit("medium").alias("severity"), F.lit(2.0).alias("effort_days")), n["workaround"]),
        F.array_repeat(F.struct(F.lit("feature_compatibility").alias("category"), F.lit("high").alias("severity"), F.lit(3.0).alias("effort_days")), n["unsupported"]),
    ).cast(BLOCKER)


def _feature_points(engine: str) -> Column:
    n = feature_support(engine)
    return F.lit(8.0 * n["workaround"] + 15.0 * n["unsupported"])


def _feed(mode: str) -> Column:
    return F.coalesce(F.col("change_feed_mode") == mode, F.lit(False))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def score_extensions(db: DataFrame) -> DataFrame:
    """Share of supported extensions, or the feature table of a document engine."""
    names = _extension_names()
    is_supported, is_risky = _among(rules.SUPPORTED_EXTENSIONS), _among(rules.HIGH_RISK_EXTENSIONS)
    supported = F.filter(names, is_supported)
    unsupported = F.filter(names, lambda n: ~is_supported(n))
    total = F.size(names)
    relational = F.when(total > 0, F.round(F.size(supported) / total * 100, 1)).otherwise(100.0)
    findings = F.transform(
        unsupported,
        lambda n: F.struct(
            F.lit("extension").alias("category"),
            F.when(is_risky(n), "high").otherwise("medium").alias("severity"),
            F.when(is_risky(n), 2.0).otherwise(1.0).alias("effort_days"),
        ),
    ).cast(BLOCKER)
    many_regions = _n_regions() > 1
    dynamo = _score(_feature_points("dynamodb"), step(_flag("streams_enabled"), 5), step(many_regions, 15))
    cosmos = _score(
        _feature_points("cosmosdb-nosql"),
        step(_feed("AllVersionsAndDeletes"), 10),
        step(_feed("LatestVersion"), 3),
        step(_flag("multi_region_writes"), 15),
        step(F.col("consistency_level").isin("Strong", "BoundedStaleness"), 5),
    )
    b_dynamo = F.concat(_feature_findings("dynamodb"), _found(many_regions, "feature_compatibility", "high", 5))
    b_cosmos = F.concat(
        _feature_findings("cosmosdb-nosql"),
        _found(_feed("AllVersionsAndDeletes"), "feature_compatibility", "medium", 3),
        _found(_flag("multi_region_writes"), "feature_compatibility", "high", 5),
    )

    def not_supported(engine: str) -> Column:
        n = feature_support(engine)
        return F.lit(n["workaround"] + n["unsupported"])

    return db.withColumns(
        {
            "s_extensions": _by_engine(relational, dynamo, cosmos),
            "b_extensions": _by_engine(findings, b_dynamo, b_cosmos),
            "unsupported_count": _by_engine(F.size(unsupported), not_supported("dynamodb"), not_supported("cosmosdb-nosql")),
        }
    )


def score_performance(db: DataFrame) -> DataFrame:
    """Rates and connections against the platform limits; 75 when nothing is known."""
    qps, tps, peak = F.col("workload.avg_qps"), F.col("workload.avg_tps"), F.col("workload.connection_count_peak")
    start = case((qps > rules.MAX_QPS, F.lit(0.0)), (qps > rules.MAX_QPS * 0.7, F.lit(70.0)), default=F.lit(100.0))
    score = F.greatest(_zero(), start - step(tps > rules.MAX_TPS, 40) - step(peak > rules.MAX_CONNECTIONS, 20))
    findings = F.concat(
        _found(qps > rules.MAX_QPS, "performance", "blocker", 0),
        _found(tps > rules.MAX_TPS, "performance", "high", 0),
        _found(peak > rules.MAX_CONNECTIONS, "performance", "high", 2),
    )
    return db.withColumns({"s_performance": F.when(F.col("workload").isNull(), 75.0).otherwise(score), "b_performance": findings})


def score_complexity(db: DataFrame) -> DataFrame:
    """Procedural code, triggers, views, types; indexes and item size for document engines."""
    procedural = F.filter(F.coalesce("functions", F.array().cast("array<struct<name:string,language:string,line_count:int>>")), lambda f: f["language"] == "plpgsql")
    heavy = (F.size(procedural) > 50) | F.exists(procedural, lambda f: f["line_count"] > 200)
    triggers = F.col("trigger_count")
    relational = _score(
        step(heavy, 40),
        F.when(triggers > 20, 15.0).when(triggers > 5, 5.0).otherwise(0.0),
        step(F.col("materialized_view_count") > 10, 10),
        step(F.col("custom_type_count") > 20, 10),
        step(F.col("event_trigger_count") > 0, 30),
        step(F.col("large_object_count") > 0, 5),
        step(F.col("non_default_collation_count") > 0, 5),
    )
    gsi = F.coalesce("gsi_count", F.lit(0))
    dynamo = _score(
        F.lit(15.0),
        F.when(gsi > 10, 15.0).when(gsi > 5, 5.0).otherwise(0.0),
        step(F.col("lsi_count") > 3, 5),
        step(F.col("item_size_avg_bytes") > 100_000, 10),
    )
    containers = F.col("table_count")
    cosmos = _score(
        F.lit(15.0),
        F.when(containers > 15, 10.0).when(containers > 8, 5.0).otherwise(0.0),
        step(F.size(F.array_distinct("partition_key_paths")) > 8, 5),
        step(F.col("unindexed_containers") > 0, 5),
    )
    findings = F.concat(_found(heavy, "complexity", "high", 10), _found(F.col("event_trigger_count") > 0, "event_triggers", "blocker", 3))
    return db.withColumns({"s_complexity": _by_engine(relational, dynamo, cosmos), "b_complexity": F.when(_document(), _empty()).otherwise(findings)})


def score_replication(db: DataFrame) -> DataFrame:
    """Logical replication and slots; streams, recovery and regions for document engines."""
    slots = F.coalesce(F.size("replication_slots"), F.lit(0))
    logical = _flag("has_logical_replication")
    slot_row = F.struct(F.lit("replication").alias("category"), F.lit("medium").alias("severity"), F.lit(2.0).alias("effort_days"))
    relational = _score(step(logical, 40), step(slots > 0, 10))
    b_relational = F.concat(_found(logical, "replication", "high", 5), F.array_repeat(slot_row, slots).cast(BLOCKER))
    streams, no_recovery = _flag("streams_enabled"), ~_flag("pitr_enabled")
    dynamo = _score(step(streams, 15), step(no_recovery, 10), step(_n_regions() > 1, 20))
    b_dynamo = F.concat(_found(streams, "replication", "medium", 3), _found(no_recovery, "replication", "medium", 0.5))
    multi = _flag("multi_region_writes")
    cosmos = _score(
        step(_feed("AllVersionsAndDeletes"), 15), step(_feed("LatestVersion"), 5), step(multi, 20), step(~multi & (_n_regions() > 1), 10)
    )
    b_cosmos = F.concat(_found(_feed("AllVersionsAndDeletes"), "replication", "medium", 3), _found(multi, "replication", "high", 5))
    return db.withColumns({"s_replication": _by_engine(relational, dynamo, cosmos), "b_replication": _by_engine(b_relational, b_dynamo, b_cosmos)})


def score_operational(db: DataFrame) -> DataFrame:
    """Vendor extensions, schedulers and connection counts; billing and throughput modes for document engines."""
    names = F.array_distinct(_extension_names())

    def has(name: str) -> Column:
        return F.array_contains(names, name)

    vendor = F.size(F.filter(names, lambda n: n.rlike("^(aws_|google_|azure_)")))
    relational = _score(
        step(has("pg_cron"), 10),
        vendor * 5.0,
        step(has("age"), 5),
        step(has("timescaledb"), 10),
        step(has("citus"), 10),
        step(has("pglogical"), 5),
        step(F.col("workload.connection_count_avg") > 500, 5),
    )
    fast_writes = step(F.col("workload.avg_tps") > rules.MAX_TPS, 15)
    dynamo = _score(F.lit(10.0), step(F.col("billing_mode") == "provisioned", 5), step(_flag("ttl_enabled"), 5), fast_writes)
    cosmos = _score(F.lit(10.0), step(F.col("throughput_mode") == "provisioned", 5), step(F.col("consistency_level") != "Session", 5), fast_writes)
    return db.withColumn("s_operational", _by_engine(relational, dynamo, cosmos))


WEIGHTS = {
    "s_storage": 0.20,
    "s_extensions": 0.20,
    "s_performance": 0.15,
    "s_complexity": 0.15,
    "s_replication": 0.15,
    "s_operational": 0.15,
}


def score(db: DataFrame) -> DataFrame:
    """All dimensions, overall score, category, effort and risk."""
    for dimension in (score_storage, score_extensions, score_performance, score_complexity, score_replication, score_operational):
        db = dimension(db)
    db = db.withColumn("blockers", F.concat("b_storage", "b_extensions", "b_performance", "b_complexity", "b_replication"))
    weighted = F.lit(0).cast("decimal(14,6)")
    for name, weight in WEIGHTS.items():
        weighted = weighted + F.col(name).cast("decimal(10,4)") * F.lit(str(weight)).cast("decimal(4,2)")

    def worst(severity: str) -> Column:
        return F.exists("blockers", lambda b: b["severity"] == severity)

    return effort(
        db.withColumn("_overall", weighted)
        .withColumn("overall_score", F.round("_overall", 1).cast("double"))
        .withColumn(
            "category",
            case(
                (worst("blocker"), "not_feasible"),
                (worst("high") | (F.col("_overall") < 40), "needs_rearchitecture"),
                (F.col("_overall") < 70, "ready_with_workarounds"),
                default="ready",
            ),
        )
        .withColumn("blocker_count", F.size("blockers"))
        .withColumn("risk_level", case((F.col("blocker_count") == 0, "low"), (F.col("blocker_count") <= 3, "medium"), default="high"))
        .drop("_overall", "b_storage", "b_extensions", "b_performance", "b_complexity", "b_replication")
    )


def effort(db: DataFrame) -> DataFrame:
    """Days of work from the findings and the size of the database."""
    days = F.aggregate("blockers", F.lit(0.0), lambda acc, b: acc + b["effort_days"])
    gsi = F.coalesce("gsi_count", F.lit(0))
    relational = (
        F.lit(5.0) + days + F.col("unsupported_count") * 0.5
        + step(F.col("table_count") > 100, 3) + step(F.col("size_gb") > 500, 5) + step(F.size("functions") > 20, 5)
    )
    document = (
        F.lit(15.0) + days + step(F.col("table_count") > 20, 5) + step(F.col("size_gb") > 500, 10)
        + F.when(gsi > 5, gsi * 0.5).otherwise(0.0)
    )
    return db.withColumn("effort_days", F.when(_document(), document).otherwise(relational))


def workload_from_capacity(db: DataFrame) -> DataFrame:
    """Workload estimated from provisioned request units where none was measured."""
    u, containers = F.col("request_units").cast("double"), F.col("table_count")
    guess = F.struct(
        (u * 0.7).alias("avg_qps"),
        (u * 0.7 * 3).alias("peak_qps"),
        (u * 0.3).alias("avg_tps"),
        F.lit(10.0).alias("p99_latency_ms"),
        F.lit(70.0).alias("reads_pct"),
        F.lit(30.0).alias("writes_pct"),
        (containers * 8).cast("int").alias("connection_count_avg"),
        (containers * 25).cast("int").alias("connection_count_peak"),
        F.lit("heuristic").alias("source"),
    )
    return db.withColumn("workload", F.coalesce("workload", F.when(F.col("request_units").isNotNull(), guess)))


def snap(units: Column) -> Column:
    """Nearest size on offer; the lower one wins a tie."""
    ladder = F.array(*[F.lit(float(v)) for v in rules.UNIT_LADDER])
    return F.array_min(F.transform(ladder, lambda v: F.struct(F.abs(v - units).alias("d"), v.alias("v"))))["v"]


def connections_of(units: Column) -> Column:
    return case(*[(units >= float(u), F.lit(n)) for u, n in reversed(rules.UNIT_CONNECTIONS)], default=F.lit(104))


def sizing(db: DataFrame) -> DataFrame:
    """Production range of compute units from connections, memory and rate."""
    one = F.lit(1.0)
    need = F.greatest(
        one,
        F.coalesce(F.col("workload.connection_count_peak") / rules.CONNECTIONS_PER_UNIT, one),
        F.col("size_gb") / 2,
        F.coalesce(F.col("workload.avg_qps") / 2000, one),
    )
    db = db.withColumn("_need", need).withColumn("_lo", F.greatest(F.lit(2.0), F.col("_need") * 0.6))
    db = db.withColumn("_hi", F.least(F.lit(32.0), F.greatest(F.col("_lo") + 2, F.col("_need") * 1.4))).withColumn("_lo", F.least(F.lit(32.0), F.col("_lo")))
    db = db.withColumn("_hi", F.least(F.col("_hi"), F.col("_lo") + 16))
    db = db.withColumn("unit_min", snap(F.col("_lo"))).withColumn("_max", snap(F.col("_hi")))
    return db.withColumn(
        "unit_max", F.when(F.col("_max") <= F.col("unit_min"), snap(F.col("unit_min") + 2)).otherwise(F.col("_max"))
    ).drop("_need", "_lo", "_hi", "_max")


def sizing_by_env(db: DataFrame, keep: Sequence[str] = ("db_id",)) -> DataFrame:
    """Dev, staging and production rows per database."""
    lo, hi = F.col("unit_min"), F.col("unit_max")
    db = db.withColumn("_dl", snap(F.greatest(F.lit(0.5), lo / 4))).withColumn("_sl", snap(F.greatest(F.lit(1.0), lo)))
    db = db.withColumn("_dh", snap(F.greatest(F.col("_dl") + 1, lo / 2))).withColumn("_sh", snap(F.greatest(F.col("_sl") + 2, lo + 4)))
    dev_hi = F.when(F.col("_dh") <= F.col("_dl"), snap(F.col("_dl") + 1)).otherwise(F.col("_dh"))
    stg_hi = case(
        (F.col("_sh") <= F.col("_sl"), snap(F.col("_sl") + 2)),
        (F.col("_sh") - F.col("_sl") > 16, snap(F.col("_sl") + 16)),
        default=F.col("_sh"),
    )

    def env(name: str, low: Column, high: Column, to_zero: bool) -> Column:
        return F.struct(F.lit(name).alias("env"), low.alias("env_min"), high.alias("env_max"), F.lit(to_zero).alias("scale_to_zero"))

    rows = F.array(env("dev", F.col("_dl"), dev_hi, True), env("staging", F.col("_sl"), stg_hi, True), env("prod", lo, hi, False))
    return (
        db.select(*keep, F.inline(rows))
        .withColumn("max_connections", connections_of(F.col("env_max")))
        .withColumn("ram_gb", F.col("env_max") * 2)
    )


def matrix(db: DataFrame) -> DataFrame:
    """Extensions (or features of a document engine) per database with their status."""
    spark = db.sparkSession
    status = rules.rule_table(
        spark, "name string, status string",
        [(n, "supported") for n in rules.SUPPORTED_EXTENSIONS] + [(n, "workaround") for n in rules.WORKAROUND_EXTENSIONS],
    )
    ext = (
        db.where(~_document())
        .select("db_id", F.explode("extensions").alias("e"))
        .select("db_id", F.lower("e.name").alias("name"))
        .join(status, "name", "left")
        .select("db_id", F.lit("extension").alias("matrix_type"), "name", F.coalesce("status", F.lit("unsupported")).alias("status"))
    )
    features = rules.rule_table(spark, "source_engine string, name string, status string", rules.ENGINE_FEATURES)
    doc = db.where(_document()).select("db_id", "source_engine").join(features, "source_engine").select("db_id", F.lit("feature").alias("matrix_type"), "name", "status")
    return ext.unionByName(doc)


def matrix_order() -> list[Column]:
    """Supported first, then workaround, then the rest; by name inside."""
    return [case((F.col("status") == "supported", 0), (F.col("status") == "workaround", 1), default=2), F.col("name")]


def matrix_summary(rows: DataFrame) -> DataFrame:
    statuses = ["supported", "workaround", "unsupported"]
    return rows.groupBy("db_id").pivot("status", statuses).count().na.fill(0, statuses)


def strategy(db: DataFrame) -> DataFrame:
    """How to move: another engine, hybrid with change capture, or a bulk copy."""
    version = F.col("engine_version")
    cross = _document() | (version.isNotNull() & (version != "") & ~version.rlike("^1[4567]"))
    hybrid = F.coalesce(F.col("workload.avg_tps") > 100, F.lit(False)) | (F.col("size_gb") > 500)
    return db.withColumn("strategy", case((cross, "cross_engine"), (hybrid, "hybrid"), default="bulk_dump_restore"))


def phases(db: DataFrame, keep: Sequence[str] = ("db_id", "strategy", "risk_level")) -> DataFrame:
    """Four phases per database with their days; needs score() and strategy()."""
    gb, gsi = F.col("size_gb"), F.coalesce("gsi_count", F.lit(0))
    schema_days = _by_engine(
        F.greatest(F.lit(2.0), F.col("unsupported_count") * 0.5 + 2),
        F.greatest(F.lit(5.0), gsi * 0.5 + 5),
        F.greatest(F.lit(5.0), F.col("table_count") * 0.5 + 3),
    )
    data_days = case(
        (F.col("strategy") == "cross_engine", F.greatest(F.lit(10.0), gb / 50 + 5)),
        (F.col("strategy") == "hybrid", F.greatest(F.lit(3.0), gb / 100 + 2)),
        default=F.greatest(F.lit(1.0), gb / 100),
    )
    app_days = F.when(_document(), 10.0).otherwise(5.0)
    plan = [("schema", schema_days), ("data", F.round(data_days, 1)), ("application", app_days), ("go_live", F.lit(5.0))]
    rows = [F.struct(F.lit(i + 1).alias("phase"), F.lit(n).alias("phase_name"), d.alias("duration_days")) for i, (n, d) in enumerate(plan)]
    return db.select(*keep, F.inline(F.array(*rows)))
