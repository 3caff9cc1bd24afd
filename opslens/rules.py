"""Rule tables. All of them are fixed, small, and safe to broadcast."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW = {
    "string": pa.string(),
    "double": pa.float64(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
}


def rule_table(spark: SparkSession, ddl: str, rows: Sequence[tuple]) -> DataFrame:
    """A local relation marked for broadcast."""
    fields = T.StructType.fromDDL(ddl).fields
    arrays = [
        pa.array([row[i] for row in rows], _ARROW[f.dataType.simpleString()]) for i, f in enumerate(fields)
    ]
    return F.broadcast(spark.createDataFrame(pa.table(arrays, names=[f.name for f in fields])))


# Metric thresholds (metric, warning, critical, bad side is above).
THRESHOLDS = [
    ("cache_hit_ratio", 0.99, 0.95, False),
    ("connection_utilization", 0.70, 0.85, True),
    ("max_dead_tuple_ratio", 0.10, 0.25, True),
    ("lock_wait_seconds", 30.0, 120.0, True),
    ("deadlocks_per_hour", 2.0, 5.0, True),
    ("slow_query_seconds", 5.0, 30.0, True),
    ("txid_age", 500_000_000.0, 1_000_000_000.0, True),
    ("replication_lag_seconds", 10.0, 60.0, True),
]

# Metrics that may be asked for by name; those with thresholds are called as they are stored.
ALLOWED_METRICS = (
    "cache_hit_ratio",
    "connection_utilization",
    "max_dead_tuple_ratio",
    "lock_wait_seconds",
    "deadlocks_per_hour",
    "slow_query_seconds",
    "txid_age",
    "replication_lag_seconds",
    "buffer_cache_hit",
    "connections_active",
    "connections_idle",
    "connections_total",
    "disk_usage_gb",
    "temp_files",
    "wal_bytes",
)

# Channels per severity.
CHANNELS = [
    ("info", ["log"]),
    ("warning", ["slack", "log"]),
    ("critical", ["slack", "pagerduty", "log"]),
]

# Stored alerts (rule, metric, limit, bad side is above, severity, look-back minutes).
ALERT_RULES = [
    ("cache_hit_ratio_warning", "cache_hit_ratio", 0.99, False, "warning", 10),
    ("cache_hit_ratio_critical", "cache_hit_ratio", 0.95, False, "critical", 10),
    ("dead_tuple_ratio_critical", "max_dead_tuple_ratio", 0.25, True, "critical", 10),
    ("connection_utilization_warning", "connection_utilization", 0.70, True, "warning", 10),
    ("txid_age_warning", "txid_age", 500_000_000.0, True, "warning", 10),
]

# Fixed value: the stored alert over sync checks (rule, limit in seconds, severity, look-back minutes).
FRESHNESS_RULE = ("sync_freshness_warning", 3600.0, "warning", 30)

# Diagnosis per metric and level; causes and actions are in our own words.
CAUSES = [
    (
        "cache_hit_ratio",
        ["working set larger than the buffer cache", "full scans without an index", "cold cache after a restart"],
        ["add memory", "index the scanned tables", "prewarm the cache"],
        False,
    ),
    (
        "max_dead_tuple_ratio",
        ["autovacuum behind the update rate", "old transactions hold back cleanup"],
        ["vacuum and analyze the table", "tune autovacuum", "end old transactions"],
        True,
    ),
]

# Safe action per breached metric.
SAFE_ACTIONS = [
    ("max_dead_tuple_ratio", "vacuum_analyze"),
    ("connection_utilization", "terminate_idle_connections"),
    ("txid_age", "vacuum_freeze"),
]

# Branch lifetime by name prefix, in match order (order, prefix, seconds).
TTL_RULES = [
    (1, "ci", 14_400),
    (2, "hotfix", 86_400),
    (3, "perf", 172_800),
    (4, "feat", 604_800),
    (5, "dev", 604_800),
    (6, "demo", 1_209_600),
    (7, "qa", 1_209_600),
    (8, "audit", 2_592_000),
    (9, "ai-agent", 3_600),
    (10, "production", None),
    (11, "staging", None),
]
# Rules for branch names, protected branches, allowed reset sources (target, source), creators.
NAME_PREFIXES = ("ci", "hotfix", "perf", "feat", "dev", "demo", "qa", "audit", "ai-agent")
NAME_MIN, NAME_MAX = 3, 63
NAME_PATTERN = "^[a-z][a-z0-9-]*[a-z0-9]$"
PROTECTED_BRANCHES = ("production", "staging")
RESET_SOURCES = [("staging", "production"), ("development", "staging")]
CREATOR_TYPES = ("human", "agent", "ci")
MAX_BRANCHES, MAX_UNARCHIVED = 500, 10
WARN_PCT, CRITICAL_PCT = 80, 90

# Sensitive columns (classification, column, mask, regulations).
SENSITIVE_COLUMNS = [
    ("PII", "email", "mask_email", "GDPR,CCPA"),
    ("PII", "phone_number", "mask_phone", "GDPR,CCPA"),
    ("PII", "full_name", "mask_name", "GDPR,CCPA"),
    ("PII", "first_name", "mask_name", "GDPR,CCPA"),
    ("PII", "last_name", "mask_name", "GDPR,CCPA"),
    ("PII", "ssn", "mask_ssn", "GDPR,CCPA"),
    ("PII", "date_of_birth", "mask_dob", "GDPR,CCPA"),
    ("PII", "address", "mask_address", "GDPR,CCPA"),
    ("PII", "ip_address", "mask_ip", "GDPR,CCPA"),
    ("PHI", "patient_id", "mask_patient_id", "HIPAA"),
    ("PHI", "mrn", "mask_mrn", "HIPAA"),
    ("PHI", "diagnosis_code", "mask_diagnosis", "HIPAA"),
    ("PHI", "treatment_notes", "mask_freetext", "HIPAA"),
    ("PHI", "prescription", "mask_freetext", "HIPAA"),
    ("PHI", "lab_results", "mask_freetext", "HIPAA"),
    ("PHI", "insurance_id", "mask_insurance", "HIPAA"),
    ("PCI", "card_number", "mask_card_number", "PCI-DSS"),
    ("PCI", "cvv", "mask_redact", "PCI-DSS"),
    ("PCI", "card_expiry", "mask_card_expiry", "PCI-DSS"),
    ("PCI", "bank_account", "mask_bank_account", "PCI-DSS"),
    ("PCI", "routing_number", "mask_routing", "PCI-DSS"),
]

# Schemas and collations that belong to the system.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
DEFAULT_COLLATIONS = ("default", "C", "POSIX", "C.UTF-8", "en_US.UTF-8")

# Platform limits used in scoring.
MAX_STORAGE_GB = 8192.0
MAX_STORAGE_SMALL_TIER_GB = 2048.0
MAX_QPS = 100_000.0
MAX_TPS = 5_000.0
MAX_CONNECTIONS = 4_000

# Extensions the target platform supports. One vendor-own name is left out.
SUPPORTED_EXTENSIONS = (
    "pg_stat_statements", "pgvector", "postgis", "pg_trgm", "pgcrypto", "pg_hint_plan", "pg_prewarm", "uuid-ossp",
    "hstore", "citext", "ltree", "intarray", "tablefunc", "earthdistance", "cube", "fuzzystrmatch", "unaccent",
    "btree_gin", "btree_gist", "pg_graphql", "pg_jsonschema", "vector", "postgis_topology", "postgis_raster",
    "address_standardizer", "pg_visibility", "pgrowlocks", "pg_buffercache", "sslinfo", "xml2", "dict_int",
    "dict_xsyn", "pg_surgery", "bool_plperl", "jsonb_plperl", "hstore_plperl", "seg", "isn", "lo", "tcn",
    "tsm_system_rows", "tsm_system_time", "bloom",
)

# Unsupported extensions with a known replacement.
WORKAROUND_EXTENSIONS = (
    "aws_s3", "aws_lambda", "google_ml_integration", "pg_squeeze", "azure_storage", "azure_ai", "age", "pg_cron",
    "pg_partman", "pg_repack", "pglogical", "wal2json", "decoderbufs", "pgaudit", "pg_stat_kcache",
    "pg_wait_sampling", "pg_qualstats", "citus", "timescaledb", "pgbouncer", "pg_tle", "pgjwt", "supautils",
)
# Extensions that make a migration risky.
HIGH_RISK_EXTENSIONS = ("pglogical", "citus", "timescaledb")

# Features of the two document engines (engine, feature, status).
ENGINE_FEATURES = [
    ("dynamodb", "Transactions (TransactWriteItems)", "supported"),
    ("dynamodb", "Conditional writes", "supported"),
    ("dynamodb", "Batch operations (BatchWriteItem)", "supported"),
    ("dynamodb", "TTL (time-to-live)", "supported"),
    ("dynamodb", "Encryption at rest", "supported"),
    ("dynamodb", "DynamoDB Streams", "workaround"),
    ("dynamodb", "Global Tables (multi-region)", "workaround"),
    ("dynamodb", "DAX (DynamoDB Accelerator)", "unsupported"),
    ("dynamodb", "PartiQL over DynamoDB", "workaround"),
    ("dynamodb", "On-demand capacity scaling", "workaround"),
    ("dynamodb", "Single-table design patterns", "workaround"),
    ("cosmosdb-nosql", "Transactions (multi-document ACID)", "supported"),
    ("cosmosdb-nosql", "Conditional operations (ETag-based)", "supported"),
    ("cosmosdb-nosql", "Batch operations (TransactionalBatch)", "supported"),
    ("cosmosdb-nosql", "TTL (time-to-live)", "supported"),
    ("cosmosdb-nosql", "Encryption at rest", "supported"),
    ("cosmosdb-nosql", "RBAC (Entra ID / data-plane)", "supported"),
    ("cosmosdb-nosql", "Change Feed", "workaround"),
    ("cosmosdb-nosql", "Multi-region writes", "workaround"),
    ("cosmosdb-nosql", "Consistency levels (Session/Eventual)", "workaround"),
    ("cosmosdb-nosql", "Stored procedures / UDFs (JavaScript)", "workaround"),
    ("cosmosdb-nosql", "Hierarchical partition keys", "workaround"),
    ("cosmosdb-nosql", "Integrated cache", "unsupported"),
    ("cosmosdb-nosql", "Synapse Link", "unsupported"),
    ("cosmosdb-nosql", "Materialized views (CosmosDB)", "unsupported"),
    ("cosmosdb-nosql", "Per-partition throughput redistribution", "unsupported"),
]
# The two document engines.
DOCUMENT_ENGINES = ("dynamodb", "cosmosdb-nosql")

# Compute units on offer and the connections each one allows.
UNIT_LADDER = (0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 24, 28, 32)
UNIT_CONNECTIONS = [
    (0.5, 104), (1, 209), (2, 419), (3, 629), (4, 839), (5, 1049), (6, 1258), (7, 1468), (8, 1678), (9, 1888),
    (10, 2098), (12, 2517), (14, 2937), (16, 3357), (24, 4000), (28, 4000), (32, 4000),
]

# Source rates (engine, region, compute per hour, storage per GB month, per million requests, per
# million write units, per million read units).
SOURCE_RATES = [
    ("aurora-postgresql", "us-east-1", 0.519, 0.10, 0.20, None, None),
    ("aurora-postgresql", "us-west-2", 0.519, 0.10, 0.20, None, None),
    ("aurora-postgresql", "eu-west-1", 0.573, 0.11, 0.22, None, None),
    ("aurora-postgresql", "ap-southeast-1", 0.605, 0.11, 0.22, None, None),
    ("aurora-postgresql", "default", 0.519, 0.10, 0.20, None, None),
    ("aurora-postgresql-io", "us-east-1", 0.675, 0.225, 0.0, None, None),
    ("aurora-postgresql-io", "us-west-2", 0.675, 0.225, 0.0, None, None),
    ("aurora-postgresql-io", "eu-west-1", 0.744, 0.248, 0.0, None, None),
    ("aurora-postgresql-io", "ap-southeast-1", 0.786, 0.248, 0.0, None, None),
    ("aurora-postgresql-io", "default", 0.675, 0.225, 0.0, None, None),
    ("rds-postgresql", "us-east-1", 0.45, 0.115, 0.0, None, None),
    ("rds-postgresql", "us-west-2", 0.45, 0.115, 0.0, None, None),
    ("rds-postgresql", "eu-west-1", 0.497, 0.127, 0.0, None, None),
    ("rds-postgresql", "ap-southeast-1", 0.525, 0.133, 0.0, None, None),
    ("rds-postgresql", "default", 0.45, 0.115, 0.0, None, None),
    ("cloud-sql-postgresql", "us-central1", 0.31, 0.17, 0.0, None, None),
    ("cloud-sql-postgresql", "us-east1", 0.31, 0.17, 0.0, None, None),
    ("cloud-sql-postgresql", "europe-west1", 0.34, 0.19, 0.0, None, None),
    ("cloud-sql-postgresql", "asia-southeast1", 0.36, 0.20, 0.0, None, None),
    ("cloud-sql-postgresql", "default", 0.33, 0.17, 0.0, None, None),
    ("azure-postgresql", "eastus", 0.356, 0.115, 0.0, None, None),
    ("azure-postgresql", "westus2", 0.356, 0.115, 0.0, None, None),
    ("azure-postgresql", "westeurope", 0.404, 0.127, 0.0, None, None),
    ("azure-postgresql", "southeastasia", 0.423, 0.133, 0.0, None, None),
    ("azure-postgresql", "default", 0.356, 0.115, 0.0, None, None),
    ("alloydb-postgresql", "us-central1", 0.62, 0.20, 0.0, None, None),
    ("alloydb-postgresql", "us-east1", 0.62, 0.20, 0.0, None, None),
    ("alloydb-postgresql", "europe-west1", 0.68, 0.22, 0.0, None, None),
    ("alloydb-postgresql", "asia-southeast1", 0.72, 0.23, 0.0, None, None),
    ("alloydb-postgresql", "default", 0.64, 0.20, 0.0, None, None),
    ("supabase-postgresql", "default", 0.068, 0.125, 0.0, None, None),
    ("self-managed-postgresql", "us-east-1", 0.20, 0.08, 0.0, None, None),
    ("self-managed-postgresql", "us-west-2", 0.20, 0.08, 0.0, None, None),
    ("self-managed-postgresql", "eu-west-1", 0.22, 0.09, 0.0, None, None),
    ("self-managed-postgresql", "default", 0.21, 0.08, 0.0, None, None),
    ("dynamodb", "us-east-1", 0.0, 0.25, 0.0, 1.25, 0.25),
    ("dynamodb", "us-west-2", 0.0, 0.25, 0.0, 1.25, 0.25),
    ("dynamodb", "eu-west-1", 0.0, 0.28, 0.0, 1.394, 0.279),
    ("dynamodb", "default", 0.0, 0.25, 0.0, 1.25, 0.25),
    ("cosmosdb-nosql", "eastus", 0.08, 0.25, 0.0, None, None),
    ("cosmosdb-nosql", "westus2", 0.08, 0.25, 0.0, None, None),
    ("cosmosdb-nosql", "westeurope", 0.096, 0.28, 0.0, None, None),
    ("cosmosdb-nosql", "southeastasia", 0.10, 0.30, 0.0, None, None),
    ("cosmosdb-nosql", "default", 0.08, 0.25, 0.0, None, None),
]
# Fixed value: rates of this engine stand in for unknown ones.
FALLBACK_ENGINE = "aurora-postgresql"

# Cloud prefix of each engine's regions in the target price list.
ENGINE_CLOUD = [
    ("aurora-postgresql", "aws"),
    ("aurora-postgresql-io", "aws"),
    ("rds-postgresql", "aws"),
    ("cloud-sql-postgresql", "gcp"),
    ("azure-postgresql", "azure"),
    ("alloydb-postgresql", "gcp"),
    ("supabase-postgresql", "aws"),
    ("self-managed-postgresql", "aws"),
    ("dynamodb", "aws"),
    ("cosmosdb-nosql", "azure"),
]

# Target rates (region, premium per unit hour, enterprise per unit hour, storage per GB month).
TARGET_RATES = [
    ("aws-us-east-1", 0.40, 0.52, 0.023),
    ("aws-us-west-2", 0.40, 0.52, 0.023),
    ("aws-eu-west-1", 0.44, 0.57, 0.025),
    ("aws-ap-southeast-1", 0.47, 0.61, 0.027),
    ("gcp-us-central1", 0.40, 0.52, 0.023),
    ("gcp-us-east1", 0.40, 0.52, 0.023),
    ("gcp-europe-west1", 0.44, 0.57, 0.025),
    ("gcp-asia-southeast1", 0.47, 0.61, 0.027),
    ("azure-eastus", 0.46, 0.60, 0.023),
    ("azure-westus2", 0.46, 0.60, 0.023),
    ("azure-westeurope", 0.51, 0.66, 0.025),
    ("azure-southeastasia", 0.54, 0.70, 0.027),
    ("default", 0.40, 0.52, 0.023),
]
# Month lengths, connections per unit, discounts and utilisation used in cost and sizing.
HOURS_PER_MONTH = 730
SECONDS_PER_MONTH = 2_592_000
CONNECTIONS_PER_UNIT = 209
COMMITMENT_DISCOUNT = {"1_year": 0.25, "3_year": 0.40}
ENV_UTILISATION = {"dev": 0.35, "staging": 0.60, "prod": 1.0}
