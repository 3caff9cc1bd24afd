"""Schemas and partition layouts of the operational tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of each operational table, as Spark DDL.
DDL = {
    "query_stats_history": (
        "snapshot_id STRING, project_id STRING, branch_id STRING, queryid BIGINT, query STRING, calls BIGINT,"
        " total_exec_time DOUBLE, mean_exec_time DOUBLE, rows BIGINT, shared_blks_hit BIGINT,"
        " shared_blks_read BIGINT, temp_blks_written BIGINT, temp_blks_read BIGINT, wal_records BIGINT,"
        " wal_fpi BIGINT, wal_bytes BIGINT, jit_functions BIGINT, jit_generation_time DOUBLE,"
        " jit_inlining_time DOUBLE, jit_optimization_time DOUBLE, jit_emission_time DOUBLE,"
        " snapshot_timestamp TIMESTAMP"
    ),
    "index_recommendations": (
        "recommendation_id STRING, project_id STRING, branch_id STRING, table_name STRING, schema_name STRING,"
        " recommendation_type STRING, index_name STRING, suggested_columns STRING, confidence STRING,"
        " estimated_impact STRING, ddl_statement STRING, status STRING, created_at TIMESTAMP,"
        " reviewed_at TIMESTAMP, reviewed_by STRING"
    ),
    "vacuum_history": (
        "operation_id STRING, project_id STRING, branch_id STRING, table_name STRING, schema_name STRING,"
        " operation_type STRING, dead_tuples_before BIGINT, dead_tuples_after BIGINT, duration_seconds DOUBLE,"
        " executed_at TIMESTAMP, status STRING"
    ),
    "metric_samples": (
        "metric_id STRING, project_id STRING, branch_id STRING, metric_name STRING, metric_value DOUBLE,"
        " threshold_level STRING, snapshot_timestamp TIMESTAMP"
    ),
    "sync_validation_history": (
        "validation_id STRING, source_table STRING, target_table STRING, source_count BIGINT,"
        " target_count BIGINT, count_drift BIGINT, source_max_ts TIMESTAMP, target_max_ts TIMESTAMP,"
        " freshness_lag_seconds DOUBLE, checksum_match BOOLEAN, status STRING, validated_at TIMESTAMP"
    ),
    "branch_lifecycle": (
        "event_id STRING, project_id STRING, branch_id STRING, event_type STRING, source_branch STRING,"
        " ttl_seconds INT, is_protected BOOLEAN, actor STRING, reason STRING, creator_type STRING,"
        " event_timestamp TIMESTAMP"
    ),
    "data_archival_history": (
        "archival_id STRING, project_id STRING, branch_id STRING, source_table STRING, archive_table STRING,"
        " rows_archived BIGINT, bytes_reclaimed BIGINT, cold_threshold_days INT, archived_at TIMESTAMP,"
        " status STRING"
    ),
    "cdc_pipelines": (
        "pipeline_id STRING, project_id STRING, branch_id STRING, source_table STRING, target_table STRING,"
        " sync_mode STRING, scd_type INT, status STRING, created_at TIMESTAMP"
    ),
    "cdc_lag_checks": (
        "check_id STRING, project_id STRING, branch_id STRING, lag_bytes BIGINT, lag_seconds DOUBLE,"
        " status STRING, checked_at TIMESTAMP"
    ),
    "cdc_scd2_checks": (
        "check_id STRING, project_id STRING, source_table STRING, target_table STRING, open_rows BIGINT,"
        " broken_keys BIGINT, gaps BIGINT, overlaps BIGINT, status STRING, checked_at TIMESTAMP"
    ),
    "masking_compliance_results": (
        "run_id STRING, project_id STRING, branch_id STRING, parent_branch_id STRING, compliant BOOLEAN,"
        " parent_policy_count BIGINT, branch_policy_count BIGINT, missing_policies BIGINT,"
        " validated_at TIMESTAMP"
    ),
    "assessment_history": (
        "profile_id STRING, source_engine STRING, database STRING, size_gb DOUBLE, overall_score DOUBLE,"
        " category STRING, strategy STRING, total_effort_days DOUBLE, risk_level STRING, timestamp TIMESTAMP"
    ),
}

# Time comes first: look-backs and retention then touch the folders of their days, or months of the smaller tables, only. Branches
# come and go, and are no folders.
DAY, MONTH = "event_date", "event_month"
PARTITIONS = {
    "query_stats_history": [DAY, "project_id"],
    "metric_samples": [DAY, "metric_name"],
}
PARTITIONS |= {table: [MONTH] for table in DDL if table not in PARTITIONS}

# Timestamp column by which a table is windowed and kept, and days of retention.
EVENT_TIME = {
    "query_stats_history": "snapshot_timestamp",
    "index_recommendations": "created_at",
    "vacuum_history": "executed_at",
    "metric_samples": "snapshot_timestamp",
    "sync_validation_history": "validated_at",
    "branch_lifecycle": "event_timestamp",
    "data_archival_history": "archived_at",
    "cdc_pipelines": "created_at",
    "cdc_lag_checks": "checked_at",
    "cdc_scd2_checks": "checked_at",
    "masking_compliance_results": "validated_at",
    "assessment_history": "timestamp",
}
METRIC_RETENTION_DAYS = 90
AUDIT_RETENTION_DAYS = 365


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])
