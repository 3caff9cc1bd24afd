"""Cases that the driver tables do not hold: lives of branches, cells with separators, null keys, missing sides."""

from datetime import datetime

import pytest

from opslens.functions.exprs import keyed_id, row_digest
from opslens.operators import branches, findings, sync

NOW = datetime(2024, 1, 10)


@pytest.fixture(scope="module")
def states(spark):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [
        ("gone", "created", day(1)), ("gone", "deleted", day(2)),
        ("back", "created", day(1)), ("back", "deleted", day(9, 23)), ("back", "created", day(9, 23)),
        ("old", "created", day(1)),
        ("kept", "created", day(1)), ("kept", "protected", day(2)),
        ("odd", "reset", day(3)),
    ]
    events = spark.createDataFrame([("p", f"ci-pr-{b}", k, t, i, "a") for i, (b, k, t) in enumerate(rows)], "project_id string, branch_id string, event_type string, event_timestamp timestamp, event_id bigint, actor string")
    return branches.current_state(events)


def test_verdicts_over_lives(states):
    got = {r.branch_id.removeprefix("ci-pr-"): (r.state, r.verdict) for r in branches.expired(states, "branch_id", NOW).collect()}
    assert got == {"gone": ("deleted", "keep"), "back": ("active", "keep"), "old": ("active", "delete"), "kept": ("active", "keep"), "odd": ("unknown", "keep")}


def test_only_live_branches_count(states):
    assert {r.branch_id for r in branches.expiring_soon(states, "branch_id", NOW).collect()} <= {"ci-pr-back", "ci-pr-old", "ci-pr-kept"}
    assert {r.bucket: r.branches for r in branches.age_histogram(states, NOW).collect()} == {"0-1d": 1, "7-14d": 2}
    assert sum(r.branches for r in branches.ttl_compliance(states, "branch_id", NOW).collect()) == 3


def test_prefix_rules_as_a_join(spark):
    rules = spark.createDataFrame([(0, "ci-pr-", 10), (1, "ci-", 20), (2, "", 30), (3, "c", None)], "place int, prefix string, seconds bigint")
    names = spark.createDataFrame([("ci-pr-1",), ("ci-x",), ("cx",), ("",), (None,)], "name string")
    plan = branches.ttl_by_rule_table(names, "name", ["name"], rules)
    assert {r.name: r.ttl_seconds for r in plan.collect()} == {"ci-pr-1": 10, "ci-x": 20, "cx": 30, "": 30, None: None}
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


CELLS = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("\\N", "x"), ("", "x"), ("-", "x"), ("1:a", ""), ("", "1:a")]


def test_digests_tell_cells_apart(spark):
    df = spark.createDataFrame(CELLS, "a string, b string")
    got = df.select(keyed_id("a", "b").alias("i"), row_digest(["a", "b"]).alias("d")).distinct()
    assert got.count() == len(CELLS) and got.select("d").distinct().count() == len(CELLS)
    assert all(len(r.i) == 64 for r in got.collect())


def test_reconciliation_sees_moved_separators(spark):
    one, two = (spark.createDataFrame([(1, *c)], "id int, a string, b string") for c in CELLS[:2])
    assert [r.difference for r in sync.reconcile_rows(one, two, ["id"], ["a", "b"]).collect()] == ["changed"]
    assert not sync.integrity(one, two, ["a", "b"], ["id"]).first().checksum_match


def test_null_groups_meet(spark):
    df = spark.createDataFrame([(None, "x"), ("g", "y")], "g string, v string")
    rows = sync.integrity(df, df, ["g", "v"], ["g"]).collect()
    assert len(rows) == 2 and all(r.checksum_match and r.source_rows == r.target_rows == 1 for r in rows)


def test_a_missing_side_is_no_health(spark):
    schema = "pair string, n bigint, max_ts timestamp"
    source = spark.createDataFrame([("a", 500, NOW), (None, 1, NOW)], schema)
    target = spark.createDataFrame([("b", 3, NOW), (None, 1, NOW)], schema)
    got = {r.pair: (r.status, r.severity) for r in sync.completeness(source, target, "pair").collect()}
    assert got == {"a": ("missing_target", "critical"), "b": ("missing_source", "critical"), None: ("healthy", "info")}


def test_functions_are_functions(spark):
    df = spark.createDataFrame([("d", "tables", None), ("d", "functions", "sql"), ("d", "functions", "internal")], "db_id string, kind string, language string")
    assert [(r.functions, r.languages) for r in findings.functions_of(df).collect()] == [(1, "sql")]
