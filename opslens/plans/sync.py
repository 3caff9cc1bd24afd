"""Queries on reconciliation, change history, replication and archiving."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.functions.exprs import case
from opslens.operators import archive as R
from opslens.operators import digests as D
from opslens.operators import scd2 as C
from opslens.operators import sync as Y
from opslens.operators.history import latest_per_key
from opslens.plans.bind import Bind
from opslens.plans.registry import query, sql_cells
from opslens.sources import tables
from opslens.sources.tiered import TieredTable
from opslens.sources.workdir import new_folder

_SIDES = (
    "WITH s AS (SELECT o_orderkey % 4 AS pair, count(*) AS source_count, max(o_orderdate) AS source_max_ts FROM orders GROUP BY 1),"
    " t AS (SELECT l_orderkey % 4 AS pair, count(DISTINCT l_orderkey) AS target_count, max(l_shipdate) AS target_max_ts FROM lineitem WHERE l_orderkey % 4 <> 2 OR l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1),"
    " j AS (SELECT coalesce(s.pair, t.pair) AS pair, coalesce(source_count, 0) AS source_count, coalesce(target_count, 0) AS target_count, source_max_ts, target_max_ts FROM s FULL JOIN t ON s.pair = t.pair),"
    " r AS (SELECT *, abs(source_count - target_count) AS count_drift, (epoch_us(source_max_ts) - epoch_us(target_max_ts)) / 1e6 AS freshness_lag_seconds FROM j),"
    " z AS (SELECT *, CASE WHEN target_count = 0 THEN 'missing_target' WHEN source_count = 0 THEN 'missing_source' WHEN freshness_lag_seconds > 3600 THEN 'stale' WHEN count_drift > 40 THEN 'drift_detected' ELSE 'healthy' END AS status FROM r)"
)


def _completeness(b: Bind):
    source = Y.side_summary(b.table("orders").select((F.col("o_orderkey") % 4).alias("pair"), "o_orderdate"), "pair", "o_orderdate")
    lines = b.table("lineitem").select((F.col("l_orderkey") % 4).alias("pair"), "l_orderkey", "l_shipdate")
    late = (F.col("pair") != 2) | (F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return Y.completeness(source, Y.side_summary(lines.where(late), "pair", "l_shipdate", "l_orderkey"), "pair", max_drift=40)


@query("q_sync_completeness", "", _SIDES + " SELECT *, CASE status WHEN 'healthy' THEN 'info' WHEN 'drift_detected' THEN 'warning' ELSE 'critical' END AS severity FROM z")
def sync_completeness(b: Bind):
    return _completeness(b)


@query("q_sync_all_pairs", "", _SIDES + " SELECT status, count(*) AS pairs, CAST(sum(count_drift) AS BIGINT) AS drift FROM z GROUP BY ALL")
def sync_all_pairs(b: Bind):
    return _completeness(b).groupBy("status").agg(F.count("*").alias("pairs"), F.sum("count_drift").alias("drift"))


@query(
    "q_join_source_target", "",
    "SELECT (SELECT count(*) FROM orders) AS source_count, (SELECT max(o_orderdate) FROM orders) AS source_max_ts, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS target_count,"
    " (SELECT max(l_shipdate) FROM lineitem) AS target_max_ts",
)
def join_source_target(b: Bind):
    s = b.table("orders").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("max_ts"))
    t = b.table("lineitem").agg(F.count_distinct("l_orderkey").alias("n"), F.max("l_shipdate").alias("max_ts"))
    return Y.both_totals(s, t)


_DIGEST = "CAST(('0x' || substr(md5(" + sql_cells("CAST(o_orderkey AS VARCHAR)", "({status})", "o_orderpriority") + "), 1, 15)) AS BIGINT)"
_CHANGED = "CASE WHEN o_orderkey % 997 = 5 THEN 'X' ELSE o_orderstatus END"
_COLS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


def _target_orders(b: Bind):
    status = F.when(F.col("o_orderkey") % 997 == 5, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    return b.table("orders").where(F.col("o_orderkey") % 499 != 3).select("o_custkey", "o_orderkey", status, "o_orderpriority")


@query(
    "q_sync_integrity", "",
    f"WITH s AS (SELECT o_orderpriority, sum({_DIGEST.format(status='o_orderstatus')}) AS c, count(*) AS n FROM orders GROUP BY 1),"
    f" t AS (SELECT o_orderpriority, sum({_DIGEST.format(status=_CHANGED)}) AS c, count(*) AS n FROM orders WHERE o_orderkey % 499 <> 3 GROUP BY 1)"
    " SELECT s.o_orderpriority, CAST(s.c AS VARCHAR) AS source_checksum, s.n AS source_rows, CAST(t.c AS VARCHAR) AS target_checksum, t.n AS target_rows, s.c = t.c AS checksum_match FROM s JOIN t USING (o_orderpriority)",
)
def sync_integrity(b: Bind):
    out = Y.integrity(b.table("orders").select(*_COLS), _target_orders(b).select(*_COLS), _COLS, ["o_orderpriority"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("source_checksum", "target_checksum")})


@query(
    "q_fn_hash", "",
    "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS m, sha256(" + sql_cells("CAST(o_orderkey AS VARCHAR)", "o_orderstatus") + ") AS id,"
    f" {_DIGEST.format(status='o_orderstatus')} AS digest FROM orders",
)
def fn_hash(b: Bind):
    from opslens.functions.exprs import keyed_id, row_digest

    return b.table("orders").select(
        "o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("m"), keyed_id("o_orderkey", "o_orderstatus").alias("id"), row_digest(_COLS).cast("bigint").alias("digest")
    )


_RECONCILED = (
    f"WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders), t AS (SELECT o_custkey, o_orderkey, {_CHANGED} AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 499 <> 3),"
    " a AS (SELECT * FROM s EXCEPT ALL SELECT * FROM t), c AS (SELECT * FROM t EXCEPT ALL SELECT * FROM s),"
    " x AS (SELECT o_orderkey, count(*) AS n FROM a GROUP BY 1), y AS (SELECT o_orderkey, count(*) AS n FROM c GROUP BY 1)"
    " SELECT coalesce(x.o_orderkey, y.o_orderkey) AS o_orderkey, coalesce(x.n, 0) AS source_only_rows, coalesce(y.n, 0) AS target_only_rows,"
    " CASE WHEN y.n IS NULL THEN 'source_only' WHEN x.n IS NULL THEN 'target_only' ELSE 'changed' END AS difference FROM x FULL JOIN y ON x.o_orderkey = y.o_orderkey"
)


@query("q_set_reconcile_rows", "", _RECONCILED)
def set_reconcile_rows(b: Bind):
    return Y.reconcile_rows(b.table("orders"), _target_orders(b), ["o_orderkey"], ["o_custkey", *_COLS])


@query("q_sync_digest_tree", "", _RECONCILED)
def sync_digest_tree(b: Bind):
    """The same rows, found from the roots of two digest trees."""
    return D.reconcile_tree(b.table("orders"), _target_orders(b), ["o_orderkey"], ["o_custkey", *[c for c in _COLS if c != "o_orderkey"]])


@query(
    "q_sync_freshness", "sync_checks",
    "SELECT validation_id, sync_type, CASE WHEN sync_type = 'continuous' THEN 3600.0 ELSE 86400.0 END::DOUBLE AS limit_seconds, CASE WHEN freshness_lag_seconds > CASE WHEN sync_type = 'continuous' THEN 3600 ELSE 86400 END"
    " THEN 'stale' ELSE 'fresh' END AS freshness FROM sync_checks",
)
def sync_freshness(b: Bind):
    return Y.freshness(b.sync_checks()).select("validation_id", "sync_type", "limit_seconds", "freshness")


@query(
    "q_cdc_lag", "senders",
    "SELECT event_id, source_table, sent_lsn - replay_lsn AS sent_lag_bytes, CASE WHEN replay_lag_seconds > 300 THEN 'critical' WHEN replay_lag_seconds > 60 THEN 'warning' ELSE 'healthy' END AS status FROM senders",
)
def cdc_lag(b: Bind):
    return Y.replication_lag(b.senders()).select("event_id", "source_table", "sent_lag_bytes", "status")


@query("q_cdc_receivers", "senders", "SELECT project_id, branch_id, source_table, sent_lsn, replay_lsn, checked_at FROM senders")
def cdc_receivers(b: Bind):
    return Y.receivers(b.senders())


@query(
    "q_cdc_slots", "slots",
    "SELECT slot_name, active, current_lsn - restart_lsn AS retained_bytes, current_lsn - confirmed_flush_lsn AS pending_bytes FROM slots",
)
def cdc_slots(b: Bind):
    return Y.slot_retention(b.slots()).select("slot_name", "active", "retained_bytes", "pending_bytes")


@query(
    "q_cdc_latest_status", "senders",
    "SELECT project_id, source_table, event_id, checked_at, CASE WHEN replay_lag_seconds > 300 THEN 'critical' WHEN replay_lag_seconds > 60 THEN 'warning' ELSE 'healthy' END AS status FROM senders"
    " QUALIFY row_number() OVER (PARTITION BY project_id, source_table ORDER BY checked_at DESC, event_id DESC) = 1",
)
def cdc_latest_status(b: Bind):
    rows = Y.replication_lag(b.senders()).select("project_id", "source_table", "event_id", "checked_at", "status")
    return latest_per_key(rows, ["project_id", "source_table"], "checked_at", "one", ["event_id"])


@query(
    "q_current_sync_status", "sync_checks",
    "SELECT source_table, target_table, validation_id, CAST(freshness_lag_seconds AS DOUBLE) / 60.0 AS lag_minutes, status, validated_at FROM sync_checks s"
    " WHERE validated_at = (SELECT max(validated_at) FROM sync_checks x WHERE x.source_table = s.source_table)",
)
def current_sync_status(b: Bind):
    newest = latest_per_key(b.sync_checks(), ["source_table"], "validated_at")
    return newest.select(
        "source_table", "target_table", "validation_id", (F.col("freshness_lag_seconds").cast("double") / 60.0).alias("lag_minutes"), "status", "validated_at"
    )


# ---- slowly changing history ---------------------------------------------------------------------------------------

_HISTORY = (
    "ch AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER w AS prev, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),"
    " hi AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM ch WHERE rn = 1 OR prev <> o_orderstatus)"
)


def _history(b: Bind):
    return C.build(b.status_changes(), ["o_custkey"], "o_orderdate", ["o_orderkey"], ["o_orderstatus"])


@query("q_win_scd2_build", "", f"WITH {_HISTORY} SELECT *, valid_to IS NULL AS is_current FROM hi")
def win_scd2_build(b: Bind):
    return _history(b)


@query(
    "q_win_scd2_validate", "",
    f"WITH {_HISTORY}, br AS (SELECT o_custkey, o_orderkey, valid_from, CASE WHEN o_custkey % 50 = 3 AND valid_to IS NULL THEN TIMESTAMP '2002-01-01' WHEN o_custkey % 50 = 7 AND valid_to IS NOT NULL THEN valid_to + INTERVAL 1 DAY ELSE valid_to END AS valid_to FROM hi),"
    " nx AS (SELECT *, lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from, o_orderkey) AS nf FROM br),"
    " ag AS (SELECT o_custkey, count(*) AS versions, count(*) FILTER (valid_to IS NULL) AS open_rows, count(*) FILTER (nf > valid_to) AS gaps, count(*) FILTER (nf < valid_to OR (valid_to IS NULL AND nf IS NOT NULL)) AS \"overlaps\","
    " count(*) FILTER (valid_from = valid_to) AS zero_length FROM nx GROUP BY 1) SELECT *, open_rows = 1 AND gaps = 0 AND \"overlaps\" = 0 AS valid FROM ag",
)
def win_scd2_validate(b: Bind):
    broken = _history(b).withColumn(
        "valid_to",
        case(
            ((F.col("o_custkey") % 50 == 3) & F.col("valid_to").isNull(), F.lit("2002-01-01").cast("timestamp_ntz")),
            ((F.col("o_custkey") % 50 == 7) & F.col("valid_to").isNotNull(), F.col("valid_to") + F.expr("INTERVAL 1 DAY")),
            default=F.col("valid_to"),
        ),
    )
    return C.validate(broken, ["o_custkey"], ["o_orderkey"])


@query(
    "q_scd2_orphans", "",
    f"WITH {_HISTORY} SELECT o_custkey, o_orderstatus, valid_from FROM hi WHERE valid_to IS NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def scd2_orphans(b: Bind):
    source = b.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return C.orphans(_history(b), source, ["o_custkey"]).select("o_custkey", "o_orderstatus", "valid_from")


@query(
    "q_scd2_latest_state", "",
    "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1",
)
def scd2_latest_state(b: Bind):
    return C.latest_state(_history(b), ["o_custkey"]).select("o_custkey", "o_orderstatus")


@query(
    "q_join_asof_scd2", "",
    f"WITH {_HISTORY}, f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, o_custkey, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
    " SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_extendedprice, f.o_custkey, f.l_shipdate, h.o_orderstatus AS o_orderstatus_as_of FROM f LEFT JOIN hi h ON h.o_custkey = f.o_custkey"
    " AND h.valid_from <= f.l_shipdate AND (h.valid_to IS NULL OR f.l_shipdate < h.valid_to)",
)
def join_asof_scd2(b: Bind):
    orders = b.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    facts = b.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").join(orders, "l_orderkey")
    return C.as_of_lookup(facts, _history(b), ["o_custkey"], "l_shipdate", "l_orderkey", "o_orderstatus", "o_orderkey")


# ---- archive -------------------------------------------------------------------------------------------------------

_ORDERS_NOW = "(SELECT max(o_orderdate) FROM orders)"


def _orders(b: Bind):
    return b.table("orders"), b.now("orders", "o_orderdate")


@query(
    "q_cold_candidates", "",
    f"SELECT o_orderpriority, count(*) AS live_rows, count(*) FILTER (o_orderdate < {_ORDERS_NOW} - INTERVAL 365 DAY) AS cold_rows, max(o_orderdate) AS last_activity,"
    f" CAST(count(*) FILTER (o_orderdate < {_ORDERS_NOW} - INTERVAL 365 DAY) AS DOUBLE) / count(*) * 100 AS cold_pct FROM orders GROUP BY 1 HAVING count(*) > 100",
)
def cold_candidates(b: Bind):
    orders, now = _orders(b)
    return R.cold_candidates(orders, ["o_orderpriority"], "o_orderdate", now, 365, 100)


@query(
    "q_archive_split", "",
    f"SELECT o_orderpriority, count(*) AS rows_archived, CAST(sum(octet_length(encode(CAST(o_orderkey AS VARCHAR) || o_orderstatus || o_orderpriority))) AS BIGINT) AS bytes_reclaimed FROM orders WHERE o_orderdate < {_ORDERS_NOW} - INTERVAL 90 DAY GROUP BY 1",
)
def archive_split(b: Bind):
    """Moved by a run, and logged over what the run has written."""
    orders, now = _orders(b)
    return R.archive_summary(_archived(b, orders, now).read("cold"), ["o_orderpriority"], "o_orderdate", _COLS, now)


def _archived(b: Bind, orders, now):
    """Orders in two batches, with what is older than 90 days moved."""
    t = TieredTable(b.spark, new_folder(b.spark, "archive-run"), "orders", "o_orderdate", "p0", "main", grain="month")
    for i in (0, 1):
        t.append(orders.where(F.col("o_orderkey") % 2 == i), f"batch-{i}")
    t.archive(now, 90)
    return t


@query(
    "q_archive_tiers", "",
    f"SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate < {_ORDERS_NOW} - INTERVAL 90 DAY THEN 'cold' ELSE 'hot' END AS tier FROM orders",
)
def archive_tiers(b: Bind):
    """Every row of both tiers, as readers see them after a run that was repeated."""
    orders, now = _orders(b)
    t = _archived(b, orders, now)
    t.archive(now, 90)
    return t.read().select("o_orderkey", "o_totalprice", "tier")


@query(
    "q_archive_log", "",
    f"SELECT 'p0' AS project_id, 'main' AS branch_id, 'orders' AS source_table, 'orders_cold' AS archive_table, count(*) AS rows_archived, 90 AS cold_threshold_days, {_ORDERS_NOW} AS archived_at, 'success' AS status"
    f" FROM orders WHERE o_orderdate < {_ORDERS_NOW} - INTERVAL 90 DAY",
)
def archive_log(b: Bind):
    """The row that a run leaves in data_archival_history, read back from there; written twice, there once."""
    orders, now = _orders(b)
    t, ops = _archived(b, orders, now), new_folder(b.spark, "archive-log")
    t.write_log(ops)
    t.write_log(ops)
    return tables.read_ops(b.spark, ops, "data_archival_history").drop("archival_id", "bytes_reclaimed")


@query(
    "q_set_union_hot_cold", "",
    f"SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate < {_ORDERS_NOW} - INTERVAL 90 DAY THEN 'cold' ELSE 'hot' END AS tier, CASE WHEN o_orderdate < {_ORDERS_NOW} - INTERVAL 90 DAY THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders",
)
def set_union_hot_cold(b: Bind):
    orders, now = _orders(b)
    hot, cold = R.split_cold(orders, "o_orderdate", now)
    cols = ["o_orderkey", "o_orderstatus"]
    return R.unified_view(hot.select(*cols, "o_totalprice"), cold.select(*cols))


@query(
    "q_unified_view", "",
    f"SELECT tier, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM (SELECT CASE WHEN o_orderdate < {_ORDERS_NOW} - INTERVAL 90 DAY THEN 'cold' ELSE 'hot' END AS tier, o_totalprice FROM orders) GROUP BY 1",
)
def unified_view(b: Bind):
    orders, now = _orders(b)
    view = R.unified_view(*R.split_cold(orders, "o_orderdate", now))
    return view.groupBy("tier").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))
