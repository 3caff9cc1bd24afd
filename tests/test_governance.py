"""DDL rules, names, policies, masks, schema comparison."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens import rules
from opslens.functions.masks import MASKS, mask, register_masks
from opslens.operators import branches as B
from opslens.operators import governance as V

DDL = [
    ("CREATE TABLE t (id INT);", False), ("CREATE TABLE IF NOT EXISTS t (id INT);", True), ("DROP TABLE users;", False), ("DROP TABLE IF EXISTS users;", True),
    ("DROP INDEX idx_old;", False), ("TRUNCATE orders;", False), ("CREATE OR REPLACE VIEW v AS SELECT 1;", True), ("ALTER TABLE t ADD COLUMN IF NOT EXISTS c INT;", True),
    ("INSERT INTO t VALUES (1);", True), ("UPDATE t SET x = 1 WHERE id = 2;", True), ("SELECT 1;", True), ("  create index i on t (a)", False), ("ALTER TABLE t RENAME TO u", True),
]


def test_ddl(spark):
    df = spark.createDataFrame(DDL, "ddl string, want boolean")
    assert df.where(V.is_repeatable(F.col("ddl")) != F.col("want")).count() == 0


def check(spark, name, creator="human", unarchived=0, count=0):
    df = spark.createDataFrame([(name, creator, count, unarchived)], "name string, creator_type string, current_count int, unarchived int")
    r = B.policy_check(df).first()
    return r.allowed, list(r.violations), list(r.warnings)


def test_policy(spark):
    assert check(spark, "ci-pr-42") == (True, [], [])
    assert check(spark, "AB") == (False, ["min_length", "allowed_pattern"], ["prefixes"])
    assert check(spark, "feat-" + "x" * 59)[1] == ["max_length"]
    assert check(spark, "feat-" + "x" * 58)[1] == []
    assert check(spark, "foo-bar") == (True, [], ["prefixes"])
    assert check(spark, "production") == (True, [], [])
    assert check(spark, "ci-1", unarchived=10) == (False, ["max_unarchived_branches"], ["warning_threshold"])
    assert check(spark, "ci-1", unarchived=9) == (True, [], ["critical_threshold"])
    assert check(spark, "ci-1", unarchived=8) == (True, [], ["warning_threshold"])
    assert check(spark, "ci-1", unarchived=7) == (True, [], [])
    assert check(spark, "ci-1", count=500)[1] == ["max_branches_per_project"]
    assert check(spark, "ci-1", creator="robot")[1] == ["valid_creator_types"]
    assert check(spark, "ci-1", creator=None)[1] == ["valid_creator_types"]


def test_protection(spark):
    rows = [("production", "delete", None, False), ("feat-1", "delete", None, True), ("staging", "reset", "production", True), ("staging", "reset", "dev", False),
            ("development", "reset", "staging", True), ("development", "reset", None, False), ("staging", "migrate", None, False), ("feat-1", "reset", "x", True)]
    df = spark.createDataFrame(rows, "name string, operation string, source_branch string, want boolean")
    assert B.protection_check(df).where("allowed <> want").count() == 0


def test_ttl_order(spark):
    names = ["development", "dev-a", "ci-pr-1", "production", "ai-agent-x", "other"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = {"development": 604_800, "dev-a": 604_800, "ci-pr-1": 14_400, "production": None, "ai-agent-x": 3_600, "other": None}
    assert {r.name: r.ttl_seconds for r in B.ttl_of(df, "name").collect()} == want
    table = rules.rule_table(spark, "place int, prefix string, seconds bigint", rules.TTL_RULES)
    assert {r.name: r.ttl_seconds for r in B.ttl_by_rule_table(df, "name", ["name"], table).collect()} == want


def test_expiry_boundary(spark):
    now = datetime(2024, 1, 2)
    rows = [("ci-a", now - timedelta(seconds=14_400), False), ("ci-b", now - timedelta(seconds=14_401), False), ("ci-c", now - timedelta(days=9), True), ("production", now - timedelta(days=99), False)]
    df = spark.createDataFrame(rows, "name string, created_at timestamp, is_protected boolean")
    assert {r.name: r.verdict for r in B.expired(df, "name", now).collect()} == {"ci-a": "keep", "ci-b": "delete", "ci-c": "keep", "production": "keep"}


@pytest.mark.parametrize("ref,name", [("feature/JIRA-123-Add_users", "feature-jira-123-add-users"), ("--a//b--", "a-b"), ("!!!", ""), ("x" * 80, "x" * 63)])
def test_sanitise(spark, ref, name):
    r = B.sanitise(spark.createDataFrame([(ref,)], "ref string"), "ref").first()
    assert (r.name, r.is_empty) == (name, name == "")


MASKED = {
    "mask_email": ("jane@x.org", "j***@x.org"), "mask_phone": ("555-123-4567", "***-***-4567"), "mask_name": ("Jane", "J***"), "mask_ssn": ("123-45-6789", "***-**-6789"),
    "mask_dob": ("1990-05-06", "1990-01-01 00:00:00"), "mask_address": ("1 Road", "[REDACTED]"), "mask_ip": ("10.1.2.3", "10.1.*.*"), "mask_patient_id": ("A12345", "PAT-2345"),
    "mask_mrn": ("A12345", "MRN-2345"), "mask_diagnosis": ("E11.9", "E11"), "mask_freetext": ("long", "[REDACTED]"), "mask_insurance": ("XX998877", "***8877"),
    "mask_card_number": ("4111111111111234", "****-****-****-1234"), "mask_redact": ("123", "***"), "mask_card_expiry": ("12/29", "**/**"), "mask_bank_account": ("998877", "****8877"), "mask_routing": ("021000021", "*********"),
}


def test_masks(spark):
    assert set(MASKED) == set(MASKS) and len(MASKS) == 17
    register_masks(spark)
    for name, (plain, masked) in MASKED.items():
        df = spark.createDataFrame([(plain,), (None,)], "v string")
        rows = df.select(mask(name, "v").alias("a"), F.expr(f"{name}(v)").alias("b")).collect()
        assert [tuple(r) for r in rows] == [(masked, masked), (None, None)], name


def test_schema_diff(spark):
    s = spark.createDataFrame([("a", "x", "int"), ("a", "y", "int"), ("gone", "z", "int")], "table_name string, column_name string, data_type string")
    t = spark.createDataFrame([("a", "x", "bigint"), ("a", "n", "int"), ("new", "z", "int")], "table_name string, column_name string, data_type string")
    got = sorted((r.table_name, r.column_name, r.change, r.table_change) for r in V.schema_diff(s, t).collect())
    assert got == [("a", "n", "column_added", "table_kept"), ("a", "x", "type_changed", "table_kept"), ("a", "y", "column_removed", "table_kept"),
                   ("gone", "z", "column_removed", "table_removed"), ("new", "z", "column_added", "table_added")]
    assert V.schema_diff(s, s).count() == 0
    assert [r.column_name for r in V.schema_rows(s, "s").collect()] == s.columns


def test_compliance(spark):
    p = spark.createDataFrame([("b", "email", "mask_email"), ("b", "ssn", "mask_ssn")], "branch string, c string, f string")
    q = spark.createDataFrame([("b", "email", "mask_email"), ("b", "ssn", "mask_name")], "branch string, c string, f string")
    r = V.mask_compliance(p, q, ["branch"], ["c", "f"]).first()
    assert (r.parent_policy_count, r.branch_policy_count, r.missing, r.extra, r.compliant) == (2, 2, 1, 1, False)
    assert (r.missing_policies, r.extra_policies) == ("ssn.mask_ssn", "ssn.mask_name")
    same = V.mask_compliance(p, p.unionByName(p), ["branch"], ["c", "f"]).first()
    assert same["compliant"] and (same.missing_policies, same.extra_policies) == ("", "")
    none = V.mask_compliance(p, q.limit(0), ["branch"], ["c", "f"]).first()
    assert (none.branch_policy_count, none.missing_policies) == (0, "email.mask_email,ssn.mask_ssn")


def test_policies_are_not_combined_where_they_are_read(spark):
    """A reading task would hold every policy of its files."""
    p = spark.createDataFrame([("b", "t", "c", "f"), ("b", "t", "c", "f"), (None, "t", "d", None)], "branch_id string, table_name string, column_name string, function string")
    item = ["table_name", "column_name", "function"]
    diff = V.policy_diff(p, p.where("branch_id = 'b'"), ["branch_id"], item)
    assert [tuple(r) for r in diff.collect()] == [(None, "t", "d", None, "missing")]
    got = {r.branch_id: (r.parent_policy_count, r.branch_policy_count, r.missing_policies) for r in V.mask_compliance(p, p.where("branch_id = 'b'"), ["branch_id"], item).collect()}
    assert got == {"b": (1, 1, ""), None: (1, 0, "t.d.")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = V.policy_diff(p, p, ["branch_id"], item)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange") :]
