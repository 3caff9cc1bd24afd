"""Monthly cost of source and target, with fallback rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import rules
from opslens.operators.assessment import sizing_by_env

RATE_COLUMNS = ("compute_rate", "storage_rate", "io_rate", "write_rate", "read_rate")


def with_source_rates(db: DataFrame) -> DataFrame:
    """Rates of (engine, region), else the engine's default row, else the default row of the fallback engine."""
    spark = db.sparkSession
    ddl = "source_engine string, region string, " + ", ".join(f"{c} double" for c in RATE_COLUMNS)
    exact = rules.rule_table(spark, ddl, rules.SOURCE_RATES)
    default = exact.where(F.col("region") == "default").drop("region")
    named = F.broadcast(exact.select("source_engine", "region", F.struct(*RATE_COLUMNS).alias("_exact")))
    by_engine = F.broadcast(default.select("source_engine", F.struct(*RATE_COLUMNS).alias("_engine")))
    fallback = next(r[2:] for r in rules.SOURCE_RATES if r[:2] == (rules.FALLBACK_ENGINE, "default"))
    last = F.struct(*[F.lit(v).cast("double").alias(c) for c, v in zip(RATE_COLUMNS, fallback)])
    return (
        db.join(named, ["source_engine", "region"], "left")
        .join(by_engine, "source_engine", "left")
        .withColumn("rates", F.coalesce("_exact", "_engine", last))
        .drop("_exact", "_engine")
    )


def source_cost(db: DataFrame) -> DataFrame:
    """Compute, storage and request cost of the source per month."""
    gb = F.col("size_gb")
    qps = F.coalesce(F.col("workload.avg_qps"), F.lit(1000.0))
    millions = qps * rules.SECONDS_PER_MONTH / 1_000_000

    def pct(name: str, default: float) -> Column:
        given = F.col(f"workload.{name}")
        return F.when(given > 0, given).otherwise(default) / 100

    requests = millions * pct("writes_pct", 30.0) * F.coalesce("rates.write_rate", F.lit(1.25)) + millions * pct("reads_pct", 70.0) * F.coalesce("rates.read_rate", F.lit(0.25))
    n = F.greatest(F.lit(1), F.coalesce(F.size("regions"), F.lit(0)))
    given = F.coalesce("request_units", F.lit(1000)).cast("double")
    units = F.when(F.col("throughput_mode") == "autoscale", F.coalesce(F.col("autoscale_max_units").cast("double"), given) * 0.6).otherwise(given)
    multiplier = F.when(F.coalesce("multi_region_writes", F.lit(False)), n.cast("double")).otherwise(1 + (n - 1) * 0.5)
    provisioned = units / 100 * F.col("rates.compute_rate") * rules.HOURS_PER_MONTH * multiplier
    backup = F.when(F.col("backup_policy") == "continuous", gb * 0.20).otherwise(0.0)
    engine = F.col("source_engine")
    out = with_source_rates(db)
    compute = F.when(engine == "cosmosdb-nosql", provisioned).when(engine == "dynamodb", 0.0).otherwise(F.col("rates.compute_rate") * rules.HOURS_PER_MONTH)
    storage = F.col("rates.storage_rate") * gb * F.when(engine == "cosmosdb-nosql", n).otherwise(1)
    io = F.when(engine == "cosmosdb-nosql", backup).when(engine == "dynamodb", requests).otherwise(F.col("rates.io_rate") * millions)
    return (
        out.withColumn("source_compute", compute)
        .withColumn("source_storage", storage)
        .withColumn("source_io", io)
        .withColumn("source_total", F.col("source_compute") + F.col("source_storage") + F.col("source_io"))
        .drop("rates")
    )


def with_target_rates(db: DataFrame, tier: str = "premium") -> DataFrame:
    """Target rates of the cloud region that matches the source, else the default row."""
    if tier not in ("premium", "enterprise"):
        raise ValueError("tier must be premium or enterprise")
    spark = db.sparkSession
    cloud = rules.rule_table(spark, "source_engine string, _cloud string", rules.ENGINE_CLOUD)
    place = 1 if tier == "premium" else 2
    rates = rules.rule_table(spark, "_key string, _unit double, _gb double", [(r[0], r[place], r[3]) for r in rules.TARGET_RATES])
    default = rules.TARGET_RATES[-1]
    key = F.concat_ws("-", F.coalesce("_cloud", F.lit("aws")), F.col("region"))
    return (
        db.join(cloud, "source_engine", "left")
        .withColumn("_key", key)
        .join(rates, "_key", "left")
        .withColumn("unit_rate", F.coalesce("_unit", F.lit(default[place])))
        .withColumn("gb_rate", F.coalesce("_gb", F.lit(default[3])))
        .drop("_cloud", "_key", "_unit", "_gb")
    )


def target_cost(db: DataFrame, tier: str = "premium") -> DataFrame:
    """Target compute and storage per month from the recommended range, with commitments; needs sizing().

    Without a recommendation the units follow from the average connections, from 1 to 128.
    """
    guess = F.greatest(F.lit(1.0), F.least(F.lit(128.0), F.coalesce(F.col("workload.connection_count_avg"), F.lit(50)) / rules.CONNECTIONS_PER_UNIT))
    low, high = F.floor("unit_min"), F.floor("unit_max")
    units = F.when(low > 0, (low + high) / 2).otherwise(guess)
    out = (
        with_target_rates(db, tier)
        .withColumn("units", units)
        .withColumn("target_compute", F.col("units") * F.col("unit_rate") * rules.HOURS_PER_MONTH)
        .withColumn("target_storage", F.col("gb_rate") * F.col("size_gb"))
        .withColumn("target_total", F.col("target_compute") + F.col("target_storage"))
    )
    for name, off in rules.COMMITMENT_DISCOUNT.items():
        out = out.withColumn(f"target_total_{name}", F.col("target_total") * (1 - off))
    return out


def savings(db: DataFrame) -> DataFrame:
    """Percent and amount saved; needs source_cost() and target_cost()."""
    src, tgt = F.col("source_total"), F.col("target_total")
    return db.withColumn("savings_pct", F.when(src > 0, (1 - tgt / src) * 100).otherwise(0.0)).withColumn("savings_monthly", src - tgt)


def env_cost(db: DataFrame, tier: str = "premium") -> DataFrame:
    """Cost per environment; those that scale to zero are billed by their usual share of use."""
    rows = sizing_by_env(with_target_rates(db, tier), ("db_id", "size_gb", "unit_rate", "gb_rate"))
    share = F.create_map(*[F.lit(x) for kv in rules.ENV_UTILISATION.items() for x in kv])
    avg_units = (F.col("env_min") + F.col("env_max")) / 2
    return (
        rows.withColumn("avg_units", avg_units)
        .withColumn("compute", F.col("avg_units") * F.col("unit_rate") * rules.HOURS_PER_MONTH * F.element_at(share, F.col("env")))
        .withColumn("storage", F.col("gb_rate") * F.col("size_gb"))
        .withColumn("total", F.col("compute") + F.col("storage"))
        .select("db_id", "env", "env_min", "env_max", "avg_units", "scale_to_zero", "compute", "storage", "total")
    )


def price_age(rates: DataFrame, verified: str, as_of, max_days: int = 90) -> DataFrame:
    """Whether a price is older than the limit."""
    age = F.datediff(F.lit(as_of.date().isoformat()).cast("date"), F.col(verified))
    return rates.withColumn("age_days", age).withColumn("is_stale", F.col("age_days") > max_days)
