"""Queries on schema comparison, masking, compliance, and the scalar function groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens import rules
from opslens.functions.masks import mask, register_masks
from opslens.operators import governance as V
from opslens.plans.bind import DDL_TEXTS, Bind, pick, sql_pick
from opslens.plans.registry import as_instant, query

_SOURCE = "SELECT 't' || attrelid AS table_name, attname AS column_name, atttype AS data_type FROM attributes WHERE attrelid % 10 <> 4"
_TARGET = (
    "SELECT 't' || attrelid AS table_name, CASE WHEN attnum = 6 AND attrelid % 7 = 0 THEN attname || '_new' ELSE attname END AS column_name,"
    " CASE WHEN attrelid % 13 = 0 THEN 'varchar' ELSE atttype END AS data_type FROM attributes WHERE attrelid % 10 <> 5"
)


def _schemas(b: Bind):
    a = b.attributes()
    source = a.where("attrelid % 10 <> 4").selectExpr("concat('t', attrelid) AS table_name", "attname AS column_name", "atttype AS data_type")
    target = a.where("attrelid % 10 <> 5").selectExpr(
        "concat('t', attrelid) AS table_name", "CASE WHEN attnum = 6 AND attrelid % 7 = 0 THEN concat(attname, '_new') ELSE attname END AS column_name",
        "CASE WHEN attrelid % 13 = 0 THEN 'varchar' ELSE atttype END AS data_type",
    )
    return source, target


_BOTH = (
    f"WITH s AS ({_SOURCE}), t AS ({_TARGET}), j AS (SELECT coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.column_name, t.column_name) AS column_name, s.data_type AS source_type, t.data_type AS target_type"
    " FROM s FULL JOIN t ON s.table_name = t.table_name AND s.column_name = t.column_name)"
)


@query("q_join_full_outer_diff", "attributes", _BOTH + " SELECT table_name, column_name, source_type, target_type FROM j")
def join_full_outer_diff(b: Bind):
    s, t = _schemas(b)
    key = ["table_name", "column_name"]
    return s.withColumnRenamed("data_type", "source_type").join(t.withColumnRenamed("data_type", "target_type"), key, "full_outer")


@query(
    "q_schema_diff", "attributes",
    _BOTH + " SELECT *, CASE WHEN table_name NOT IN (SELECT table_name FROM s) THEN 'table_added' WHEN table_name NOT IN (SELECT table_name FROM t) THEN 'table_removed' ELSE 'table_kept' END AS table_change,"
    " CASE WHEN source_type IS NULL THEN 'column_added' WHEN target_type IS NULL THEN 'column_removed' ELSE 'type_changed' END AS change FROM j WHERE source_type IS DISTINCT FROM target_type",
)
def schema_diff(b: Bind):
    return V.schema_diff(*_schemas(b))


@query(
    "q_set_table_diff", "attributes",
    f"WITH s AS (SELECT DISTINCT table_name FROM ({_SOURCE})), t AS (SELECT DISTINCT table_name FROM ({_TARGET}))"
    " SELECT table_name, 'added' AS change FROM (SELECT * FROM t EXCEPT SELECT * FROM s) UNION ALL SELECT table_name, 'removed' FROM (SELECT * FROM s EXCEPT SELECT * FROM t) UNION ALL SELECT table_name, 'common' FROM (SELECT * FROM s INTERSECT SELECT * FROM t)",
)
def set_table_diff(b: Bind):
    return V.table_diff(*_schemas(b))


_DDL = f"SELECT event_id, replace({sql_pick(DDL_TEXTS, 'event_id % 12')}, '{{}}', CAST(user_id AS VARCHAR)) AS statement FROM events"


@query(
    "q_ddl_idempotent", "",
    f"WITH d AS ({_DDL}), u AS (SELECT *, upper(trim(statement)) AS x FROM d) SELECT event_id, statement, CASE WHEN contains(x, 'IF NOT EXISTS') OR contains(x, 'IF EXISTS') OR contains(x, 'OR REPLACE') THEN true"
    " WHEN contains(x, 'DROP TABLE ') OR contains(x, 'DROP INDEX ') OR contains(x, 'TRUNCATE ') THEN false WHEN starts_with(x, 'CREATE') THEN false ELSE true END AS accepted FROM u",
)
def ddl_idempotent(b: Bind):
    d = b.events("event_id", f"replace({pick(DDL_TEXTS, 'event_id % 12')}, '{{}}', cast(user_id AS STRING)) AS statement")
    return d.withColumn("accepted", V.is_repeatable(F.col("statement")))


_INVENTORY = ", ".join(f"('{c}', '{n}', '{m}', '{r}')" for c, n, m, r in rules.SENSITIVE_COLUMNS)


@query(
    "q_sensitive_scan", "attributes",
    f"SELECT attrelid, attnum, attname AS column_name, classification, masking_function, regulations FROM attributes JOIN (VALUES {_INVENTORY}) v(classification, n, masking_function, regulations) ON lower(attname) = n",
)
def sensitive_scan(b: Bind):
    return V.sensitive_scan(b.attributes().select("attrelid", "attnum", F.col("attname").alias("column_name")))


@query(
    "q_mask_table", "",
    "SELECT c_custkey, left(c_name, 1) || repeat('*', length(c_name) - 1) AS c_name, '***-***-' || right(CAST(c_acctbal AS VARCHAR), 4) AS c_acctbal, '[REDACTED]' AS c_mktsegment FROM customer",
)
def mask_table(b: Bind):
    # the balance is shown with two digits in both engines by way of its shortest text
    rows = b.table("customer").drop("c_nationkey")
    return V.mask_table(rows, {"c_name": "mask_name", "c_acctbal": "mask_phone", "c_mktsegment": "mask_address"})


@query(
    "q_fn_mask", "",
    "WITH m AS (SELECT event_id, 'user' || user_id || '@example.com' AS email, '10.0.' || (user_id % 256) || '.' || (event_id % 256) AS ip, '4111-1111-1111-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') AS card, event_type FROM events)"
    " SELECT event_id, left(email, 1) || '***@' || split_part(email, '@', 2) AS email, regexp_replace(ip, '[0-9]+\\.[0-9]+$', '*.*') AS ip, '****-****-****-' || right(card, 4) AS card, left(event_type, 3) AS code, 'MRN-' || right(card, 4) AS mrn, '***' AS cvv FROM m",
)
def fn_mask(b: Bind):
    m = b.events(
        "event_id", "concat('user', user_id, '@example.com') AS email", "concat('10.0.', user_id % 256, '.', event_id % 256) AS ip",
        "concat('4111-1111-1111-', lpad(cast(event_id % 10000 AS STRING), 4, '0')) AS card", "event_type",
    )
    return m.select(
        "event_id", mask("mask_email", "email").alias("email"), mask("mask_ip", "ip").alias("ip"), mask("mask_card_number", "card").alias("card"),
        mask("mask_diagnosis", "event_type").alias("code"), mask("mask_mrn", "card").alias("mrn"), mask("mask_redact", "card").alias("cvv"),
    )


@query(
    "q_fn_mask_sql", "",
    "SELECT c_custkey, left(c_name, 1) || repeat('*', length(c_name) - 1) AS name, '***-**-' || right(c_name, 4) AS ssn, '****' || right(c_name, 4) AS account FROM customer",
)
def fn_mask_sql(b: Bind):
    register_masks(b.spark)
    return b.table("customer").selectExpr("c_custkey", "mask_name(c_name) AS name", "mask_ssn(c_name) AS ssn", "mask_bank_account(c_name) AS account")


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


@query(
    "q_pii_text_scan", "",
    "WITH h AS (SELECT source, " + ", ".join(f"{_count(p)} AS {k}" for k, p in V.PII_PATTERNS.items()) + ' FROM documents) SELECT source, count(*) AS "rows", '
    + ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}_matches, count(*) FILTER ({k} > 0) AS {k}_rows" for k in V.PII_PATTERNS) + " FROM h GROUP BY ALL",
)
def pii_text_scan(b: Bind):
    return V.pii_scan(b.table("documents"), "text", ["source"])


_PARENT = "par AS (SELECT branch_id, table_name, column_name, function FROM policies WHERE attnum <> 5), bra AS (SELECT branch_id, table_name, column_name, CASE WHEN attrelid % 29 = 0 THEN 'mask_other' ELSE function END AS function FROM policies WHERE attrelid % 31 <> 0 AND (attnum <> 5 OR attrelid % 3 = 0))"
_ITEM = ["table_name", "column_name", "function"]


def _policy_sides(b: Bind):
    p = b.policies()
    parent = p.where("attnum <> 5").select("branch_id", *_ITEM)
    branch = p.where("attrelid % 31 <> 0 AND (attnum <> 5 OR attrelid % 3 = 0)").withColumn("function", F.when(F.col("attrelid") % 29 == 0, "mask_other").otherwise(F.col("function")))
    return parent, branch.select("branch_id", *_ITEM)


@query(
    "q_set_policy_diff", "policies",
    f"WITH {_PARENT} SELECT *, 'missing' AS difference FROM (SELECT * FROM par EXCEPT SELECT * FROM bra) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM bra EXCEPT SELECT * FROM par)",
)
def set_policy_diff(b: Bind):
    return V.policy_diff(*_policy_sides(b), ["branch_id"], _ITEM)


_NAMES = "string_agg(" + " || '.' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _ITEM) + ", ',' ORDER BY " + " || '.' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _ITEM) + ") AS names"


@query(
    "q_mask_compliance", "policies",
    f"WITH {_PARENT}, p AS (SELECT DISTINCT * FROM par), q AS (SELECT DISTINCT * FROM bra), m AS (SELECT branch_id, count(*) AS n, {_NAMES} FROM (SELECT * FROM p EXCEPT SELECT * FROM q) GROUP BY 1), x AS (SELECT branch_id, count(*) AS n, {_NAMES} FROM (SELECT * FROM q EXCEPT SELECT * FROM p) GROUP BY 1),"
    " a AS (SELECT branch_id, count(*) AS n FROM p GROUP BY 1), c AS (SELECT branch_id, count(*) AS n FROM q GROUP BY 1)"
    " SELECT a.branch_id, a.n AS parent_policy_count, coalesce(c.n, 0) AS branch_policy_count, coalesce(m.n, 0) AS missing, coalesce(x.n, 0) AS extra, coalesce(m.names, '') AS missing_policies, coalesce(x.names, '') AS extra_policies, m.n IS NULL AS compliant FROM a LEFT JOIN c USING (branch_id) LEFT JOIN m USING (branch_id) LEFT JOIN x USING (branch_id)",
)
def mask_compliance(b: Bind):
    return V.mask_compliance(*_policy_sides(b), ["branch_id"], _ITEM)


@query(
    "q_name_align", "",
    "SELECT DISTINCT 'proj-' || o_custkey AS project, 'proj_' || o_custkey AS expected_catalog, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS aligned FROM orders",
)
def name_align(b: Bind):
    projects = b.table("orders").select(F.concat(F.lit("proj-"), "o_custkey").alias("project"))
    catalogs = b.table("customer").where("c_acctbal > 0").select(F.concat(F.lit("proj_"), "c_custkey").alias("catalog"))
    return V.name_align(projects, "project", catalogs, "catalog")


# ---- scalar function groups ------------------------------------------------------------------------------------------


@query(
    "q_fn_string", "",
    "SELECT page_id, substr(url, 1, 20) AS cut, lower(url) AS low, upper(url) AS up, starts_with(url, 'https') AS secure, contains(url, 'example') AS has, list_extract(string_split(url, '/'), -1) AS last_part, replace(url, '-', '_') AS under, CAST(length(url) AS INTEGER) AS n,"
    " regexp_matches(url, '^https?://') AS ok FROM pages",
)
def fn_string(b: Bind):
    u = F.col("url")
    return b.table("pages").select(
        "page_id", F.substring(u, 1, 20).alias("cut"), F.lower(u).alias("low"), F.upper(u).alias("up"), u.startswith("https").alias("secure"), u.contains("example").alias("has"),
        F.element_at(F.split(u, "/"), -1).alias("last_part"), F.replace(u, F.lit("-"), F.lit("_")).alias("under"), F.length(u).alias("n"), u.rlike("^https?://").alias("ok"),
    )


@query(
    "q_fn_time", "newest",
    "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d, date_trunc('hour', ts) AS h, date_trunc('year', ts) AS y, (epoch_us((SELECT t FROM newest)) - epoch_us(ts)) / 1e6 AS age_seconds,"
    " CAST(floor((epoch_us((SELECT t FROM newest)) - epoch_us(ts)) / 1e6 / 86400) AS BIGINT) AS age_days, datediff('day', CAST(ts AS DATE), CAST((SELECT t FROM newest) AS DATE)) > 20 AS stale FROM events",
)
def fn_time(b: Bind):
    from opslens.functions.exprs import instant, seconds_between

    events = b.table("events")
    now = instant(events, "ts", b.now())
    age = seconds_between(now, F.col("ts"))
    out = events.select(
        "event_id", F.to_date("ts").alias("d"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), F.date_trunc("year", "ts").cast("timestamp_ntz").alias("y"),
        age.alias("age_seconds"), F.floor(age / 86400).alias("age_days"), (F.datediff(now, "ts") > 20).alias("stale"),
    )
    return as_instant(out, "d")


_LADDER = ", ".join(f"{float(u)}" for u in rules.UNIT_LADDER)


@query(
    "q_fn_math", "",
    "SELECT event_id, round(CAST(value AS DECIMAL(18,2)), 1)::DOUBLE AS r1, abs(value - 50) AS a, greatest(value, 10.0::DOUBLE) AS hi, least(value, 10.0::DOUBLE) AS lo, CAST(floor(value) AS BIGINT) AS f, 100.0::DOUBLE * value / 7 AS pct,"
    f" (SELECT v FROM (SELECT unnest([{_LADDER}]::DOUBLE[]) AS v) ORDER BY abs(v - value / 10), v LIMIT 1) AS snapped FROM events",
)
def fn_math(b: Bind):
    from opslens.operators.assessment import snap

    v = F.col("value")
    return b.table("events").select(
        "event_id", F.round(v.cast("decimal(18,2)"), 1).cast("double").alias("r1"), F.abs(v - 50).alias("a"), F.greatest(v, F.lit(10.0)).alias("hi"), F.least(v, F.lit(10.0)).alias("lo"),
        F.floor(v).alias("f"), (100.0 * v / 7).alias("pct"), snap(v / 10).alias("snapped"),
    )


@query(
    "q_fn_array", "constraints",
    "SELECT conname, list_contains(conkey, 3) AS has3, conkey[1] AS first, array_to_string(list_sort(conkey), ',') AS sorted, CAST(len([x for x in conkey if x > 2]) AS INTEGER) AS over2, CAST(len(conkey) AS INTEGER) AS n, conkey = [1, 1] AS is_one FROM constraints",
)
def fn_array(b: Bind):
    k = F.col("conkey")
    return b.constraints().select(
        "conname", F.array_contains(k, 3).alias("has3"), F.element_at(k, 1).alias("first"), F.array_join(F.array_sort(k).cast("array<string>"), ",").alias("sorted"),
        F.size(F.filter(k, lambda x: x > 2)).alias("over2"), F.size(k).alias("n"), (k == F.array(F.lit(1).cast("bigint"), F.lit(1).cast("bigint"))).alias("is_one"),
    )


@query(
    "q_fn_map", "",
    "SELECT event_id, 'ops' AS owner, event_type AS tier, CAST(user_id AS VARCHAR) AS \"user\", 3 AS tags FROM events",
)
def fn_map(b: Bind):
    """Default tags overridden by tags of the row."""
    tags = F.create_map(F.lit("owner"), F.lit("ops"), F.lit("tier"), F.lit("standard"))
    own = F.create_map(F.lit("tier"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    merged = F.map_zip_with(tags, own, lambda k, base, over: F.coalesce(over, base))
    rows = b.table("events").select("event_id", merged.alias("m"))
    return rows.select("event_id", *[F.col("m")[k].alias(k) for k in ("owner", "tier", "user")], F.size("m").alias("tags"))


@query(
    "q_fn_json", "",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(split_part('documentsSize=' || (event_id * 3), '=', 2) AS BIGINT) AS size FROM events",
)
def fn_json(b: Bind):
    header = F.concat(F.lit("collectionSize="), F.col("event_id"), F.lit(";documentsSize="), F.col("event_id") * 3)
    return b.table("events").select(
        "event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), F.element_at(F.str_to_map(header, F.lit(";"), F.lit("=")), "documentsSize").cast("bigint").alias("size")
    )
