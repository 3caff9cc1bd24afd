"""Masking functions, as column builders and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _tail(prefix: str) -> str:
    return f"concat('{prefix}', right(val, 4))"


def _fixed(text: str) -> str:
    return f"'{text}'"


# What each mask leaves of a text `val`.
MASKS = {
    "mask_email": "concat(left(val, 1), '***@', split_part(val, '@', 2))",
    "mask_phone": _tail("***-***-"),
    "mask_name": "concat(left(val, 1), repeat('*', length(val) - 1))",
    "mask_ssn": _tail("***-**-"),
    "mask_dob": "cast(date_trunc('year', cast(val AS TIMESTAMP)) AS STRING)",
    "mask_address": _fixed("[REDACTED]"),
    "mask_ip": "regexp_replace(val, '[0-9]+[.][0-9]+$', '*.*')",
    "mask_patient_id": _tail("PAT-"),
    "mask_mrn": _tail("MRN-"),
    "mask_diagnosis": "left(val, 3)",
    "mask_freetext": _fixed("[REDACTED]"),
    "mask_insurance": _tail("***"),
    "mask_card_number": _tail("****-****-****-"),
    "mask_redact": _fixed("***"),
    "mask_card_expiry": _fixed("**/**"),
    "mask_bank_account": _tail("****"),
    "mask_routing": _fixed("*********"),
}


def mask(name: str, column: str) -> Column:
    """Masked text of a column; stays null for null, also for the fixed masks."""
    text = MASKS[name].replace("val", f"cast(`{column}` AS STRING)")
    return F.when(F.col(column).isNotNull(), F.expr(text))


def register_masks(spark: SparkSession) -> None:
    """Make every mask callable from SQL in this session."""
    for name, body in MASKS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(val STRING) RETURNS STRING"
            f" RETURN CASE WHEN val IS NOT NULL THEN {body} END"
        )
