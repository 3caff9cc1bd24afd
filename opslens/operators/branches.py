"""Branch lifecycle: current state, expiry, utilisation, naming and protection rules."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import rules
from opslens.functions.exprs import case, instant, seconds_between
from opslens.functions.spread import same_keys

DAY = 86_400.0


def current_state(events: DataFrame, keys: Sequence[str] = ("project_id", "branch_id"), tie: str = "event_id") -> DataFrame:
    """Lifecycle events folded to one row per branch by map-side combined aggregates.

    created_at is the newest creation: a branch that is deleted and created again lives from then on.
    """
    at = F.struct("event_timestamp", tie)
    kind = F.col("event_type")
    lifecycle = kind.isin("created", "deleted")
    return (
        events.groupBy(*keys)
        .agg(
            F.max(F.when(kind == "created", F.col("event_timestamp"))).alias("created_at"),
            F.max_by(F.when(lifecycle, kind), F.when(lifecycle, at)).alias("_last"),
            F.coalesce(F.bool_or(kind == "protected"), F.lit(False)).alias("is_protected"),
            F.count_if(kind == "reset").alias("resets"),
            F.max("event_timestamp").alias("last_activity"),
            F.max_by("actor", at).alias("last_actor"),
        )
        .withColumn("state", case((F.col("_last") == "deleted", "deleted"), (F.col("_last") == "created", "active"), default="unknown"))
        .drop("_last")
    )


def ttl_of(branches: DataFrame, name: str) -> DataFrame:
    """Lifetime by name prefix; the first match in declared order wins.

    A chain of conditions from the fixed rule list, so there is no join and the order is kept.
    """
    chain = case(*[(F.col(name).startswith(prefix), F.lit(seconds).cast("bigint")) for _, prefix, seconds in rules.TTL_RULES])
    return branches.withColumn("ttl_seconds", chain)


def ttl_by_rule_table(branches: DataFrame, name: str, key: Sequence[str], table: DataFrame) -> DataFrame:
    """Same lookup for a rule table of any size given as data (place, prefix, seconds): an equi join on the prefix, then first by place.

    Each name is looked up with all of its prefixes, which are as many as it has characters.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.substring(F.col(name), F.lit(1), n))
    named = branches.where(F.col(name).isNotNull()).select(*key, F.explode(prefixes).alias("prefix"))
    found = named.join(table, "prefix").groupBy(*key).agg(F.min_by("seconds", "place").alias("ttl_seconds"))
    return branches.alias("b").join(found.alias("f"), same_keys("b", "f", key), "left").select("b.*", "f.ttl_seconds")


def expired(branches: DataFrame, name: str, as_of: datetime) -> DataFrame:
    """Every branch with its age, lifetime and verdict: delete a live branch past its lifetime, keep all others.

    Live are those whose `state` is active; a list without states is one of live branches.
    """
    live = F.col("state") == "active" if "state" in branches.columns else F.lit(True)
    age = seconds_between(instant(branches, "created_at", as_of), F.col("created_at"))
    return (
        ttl_of(branches, name)
        .withColumn("age_seconds", age)
        .withColumn(
            "verdict",
            F.when(live & (F.col("age_seconds") > F.col("ttl_seconds")) & ~F.col("is_protected"), "delete").otherwise("keep"),
        )
    )


def expiring_soon(branches: DataFrame, name: str, as_of: datetime, days_ahead: int = 2) -> DataFrame:
    """Live branches whose age in whole days is within days_ahead of their lifetime."""
    age = F.floor(seconds_between(instant(branches, "created_at", as_of), F.col("created_at")) / DAY)
    return (
        ttl_of(branches.where(F.col("state") == "active"), name)
        .withColumn("age_days", age)
        .withColumn("ttl_days", F.col("ttl_seconds") / DAY)
        .where(F.col("ttl_days").isNotNull() & (F.col("age_days") >= F.col("ttl_days") - days_ahead))
    )


def utilisation(branches: DataFrame, keys: Sequence[str] = ("project_id",), limit: int = rules.MAX_UNARCHIVED) -> DataFrame:
    """Live branches against the limit."""
    pct = F.col("live_branches") * 100.0 / limit
    return (
        branches.groupBy(*keys)
        .agg(F.count_if(F.col("state") == "active").alias("live_branches"))
        .withColumn("utilisation_pct", pct)
        .withColumn("level", case((pct >= rules.CRITICAL_PCT, "critical"), (pct >= rules.WARN_PCT, "warning"), default="normal"))
    )


def age_bucket(age_days: Column) -> Column:
    return case((age_days < 1, "0-1d"), (age_days < 7, "1-7d"), (age_days < 14, "7-14d"), (age_days < 30, "14-30d"), default="30d+")


def age_histogram(branches: DataFrame, as_of: datetime) -> DataFrame:
    """Live branches per age bucket."""
    age = seconds_between(instant(branches, "created_at", as_of), F.col("created_at")) / DAY
    return branches.where(F.col("state") == "active").groupBy(age_bucket(age).alias("bucket")).agg(F.count("*").alias("branches"))


def creation_rate(events: DataFrame) -> DataFrame:
    """Created and deleted branches per day."""
    kind = F.col("event_type")
    return (
        events.where(kind.isin("created", "deleted"))
        .groupBy(F.to_date("event_timestamp").alias("day"))
        .agg(F.count_if(kind == "created").alias("created"), F.count_if(kind == "deleted").alias("deleted"))
    )


def ttl_compliance(branches: DataFrame, name: str, as_of: datetime) -> DataFrame:
    """Live branches within, past, or without a lifetime."""
    e = expired(branches.where(F.col("state") == "active"), name, as_of)
    status = case((F.col("ttl_seconds").isNull(), "no_ttl"), (F.col("age_seconds") > F.col("ttl_seconds"), "expired"), default="compliant")
    return e.groupBy(status.alias("status")).agg(F.count("*").alias("branches"))


def policy_check(requests: DataFrame) -> DataFrame:
    """Naming, limit and creator rules for branch requests (name, creator_type, current_count, unarchived)."""
    name, live, count = F.col("name"), F.col("unarchived"), F.col("current_count")
    used = live * 100.0 / rules.MAX_UNARCHIVED
    known = F.lit(False)
    for p in rules.NAME_PREFIXES:
        known = known | name.startswith(p)

    def rule(cond: Column, text: str) -> Column:
        return F.when(cond, F.lit(text))

    violations = F.array_compact(
        F.array(
            rule(F.length(name) > rules.NAME_MAX, "max_length"),
            rule(F.length(name) < rules.NAME_MIN, "min_length"),
            rule(~name.rlike(rules.NAME_PATTERN), "allowed_pattern"),
            rule(live >= rules.MAX_UNARCHIVED, "max_unarchived_branches"),
            rule(count >= rules.MAX_BRANCHES, "max_branches_per_project"),
            rule(~F.coalesce(F.col("creator_type").isin(*rules.CREATOR_TYPES), F.lit(False)), "valid_creator_types"),
        )
    )
    near = (used >= rules.CRITICAL_PCT) & (live < rules.MAX_UNARCHIVED)
    warnings = F.array_compact(
        F.array(
            rule(~known & ~name.isin(*rules.PROTECTED_BRANCHES), "prefixes"),
            rule(near, "critical_threshold"),
            rule(~near & (used >= rules.WARN_PCT), "warning_threshold"),
        )
    )
    return requests.withColumn("violations", violations).withColumn("warnings", warnings).withColumn(
        "allowed", F.size("violations") == 0
    )


def protection_check(requests: DataFrame) -> DataFrame:
    """Delete, reset and migration requests (name, operation, source_branch) against the protection rules."""
    name, op = F.col("name"), F.col("operation")
    guarded = name.isin(*rules.PROTECTED_BRANCHES)
    expected = case(*[(name == target, source) for target, source in rules.RESET_SOURCES])
    wrong_source = expected.isNotNull() & ~F.col("source_branch").eqNullSafe(expected)
    violation = case(
        ((op == "delete") & guarded, "prevent_deletion"),
        ((op == "reset") & wrong_source, "allowed_reset_sources"),
        ((op == "migrate") & guarded, "prevent_direct_migration"),
        default="",
    )
    return (
        requests.withColumn("violation", violation)
        .withColumn("needs_approval", (op == "reset") & guarded)
        .withColumn("allowed", F.col("violation") == "")
    )


def sanitise_name(ref: Column) -> Column:
    """Git ref to a branch name: lower case, other characters become one hyphen, trimmed, at most 63 characters."""
    dashed = F.regexp_replace(F.lower(ref), "[^a-z0-9-]+", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", ""), 1, rules.NAME_MAX)


def sanitise(refs: DataFrame, ref: str) -> DataFrame:
    return refs.withColumn("name", sanitise_name(F.col(ref))).withColumn("is_empty", F.col("name") == "")
