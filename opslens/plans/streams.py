"""Queries that run a stream over the driver tables to its end and read the result table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opslens.operators import alerts as A
from opslens.plans.bind import Bind
from opslens.plans.registry import query
from opslens.plans.status import _LEVELLED, _STATE
from opslens.plans.sync import _HISTORY
from opslens.sources.workdir import new_folder
from opslens.streaming import sinks, stateful, transforms


class Stream(Bind):
    """The same shapes over a streaming read."""

    def table(self, name: str):
        # a glob, because a file source takes a folder or a glob and the table may be one file
        return sinks.read_files(self.spark, f"{self.dir}/[{name[0]}]{name[1:]}.parquet")


def _stream(b: Bind) -> Stream:
    return Stream(b.spark, b.dir)


def _ntz(df, *cols: str):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query(
    "q_st_ingest", "metric_samples",
    "SELECT event_id, project_id, branch_id, metric_name, CAST(metric_value AS DOUBLE) AS metric_value, snapshot_timestamp FROM metric_samples",
)
def st_ingest(b: Bind):
    rows = _stream(b).metric_samples().withColumn("metric_value", F.col("metric_value").cast("double"))
    return sinks.run_append(rows, new_folder(b.spark, "ingest"), ["metric_name"])


_LATE = "(time_bucket(INTERVAL 5 MINUTE, snapshot_timestamp) + INTERVAL 5 MINUTE <= CASE event_id % 3 WHEN 1 THEN first - INTERVAL 10 MINUTE WHEN 2 THEN greatest(first, second) - INTERVAL 10 MINUTE END)"


@query(
    "q_st_late", "metric_samples",
    "WITH e AS (SELECT max(snapshot_timestamp) FILTER (event_id % 3 = 0) AS first, max(snapshot_timestamp) FILTER (event_id % 3 = 1) AS second FROM metric_samples),"
    f" w AS (SELECT metric_name, metric_value, time_bucket(INTERVAL 5 MINUTE, snapshot_timestamp) AS window_start, coalesce({_LATE}, false) AS late FROM metric_samples, e)"
    " SELECT metric_name, window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS n, CAST(sum(metric_value) AS DOUBLE) / count(metric_value) AS avg_value, CAST(min(metric_value) AS DOUBLE) AS min_value,"
    " CAST(max(metric_value) AS DOUBLE) AS max_value, count(*) FILTER (late) AS late_rows FROM w GROUP BY metric_name, window_start",
)
def st_late(b: Bind):
    """A third of the samples arrives at a time, so most of the second and third are late."""
    base = new_folder(b.spark, "late")
    for i in range(3):
        b.metric_samples().where(F.col("event_id") % 3 == i).write.mode("append").parquet(f"{base}/source")
        out = sinks.repaired_trend(sinks.read_files(b.spark, f"{base}/source"), f"{base}/trend")
    return _ntz(out, "window_start", "window_end")


_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
_AGG = "count(*) AS n, CAST(sum(metric_value) AS DOUBLE) / count(metric_value) AS avg_value"


@query(
    "q_st_tumbling", "metric_samples",
    f"WITH w AS (SELECT metric_name, time_bucket(INTERVAL 5 MINUTE, snapshot_timestamp) AS window_start, {_AGG}, CAST(min(metric_value) AS DOUBLE) AS min_value, CAST(max(metric_value) AS DOUBLE) AS max_value FROM metric_samples GROUP BY ALL)"
    f" SELECT *, window_start + INTERVAL 5 MINUTE AS window_end FROM w WHERE window_start + INTERVAL 5 MINUTE <= {_MARK}",
)
def st_tumbling(b: Bind):
    out = sinks.run_append(transforms.tumbling_trend(_stream(b).metric_samples()), new_folder(b.spark, "tumbling"))
    return _ntz(out, "window_start", "window_end")


@query(
    "q_st_sliding", "metric_samples",
    "WITH c AS (SELECT metric_name, metric_value, time_bucket(INTERVAL 5 MINUTE, snapshot_timestamp) - i * INTERVAL 5 MINUTE AS window_start FROM metric_samples, range(0, 24) r(i)),"
    f" w AS (SELECT metric_name, window_start, {_AGG} FROM c GROUP BY ALL) SELECT *, window_start + INTERVAL 2 HOUR AS window_end FROM w WHERE window_start + INTERVAL 2 HOUR <= {_MARK}",
)
def st_sliding(b: Bind):
    out = sinks.run_append(transforms.sliding_mean(_stream(b).metric_samples()), new_folder(b.spark, "sliding"))
    return _ntz(out, "window_start", "window_end")


@query(
    "q_st_session", "",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),"
    " n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),"
    " a AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM n GROUP BY user_id, k)"
    f" SELECT * FROM a WHERE session_end <= {_MARK}",
)
def st_session(b: Bind):
    events = _stream(b).events("user_id", "ts")
    out = sinks.run_append(transforms.activity_sessions(events, "user_id", "ts"), new_folder(b.spark, "session"))
    return _ntz(out, "session_start", "session_end")


@query(
    "q_st_alerts", "metric_samples",
    f"WITH {_LEVELLED} SELECT event_id, metric_name, threshold_level AS severity, CASE threshold_level WHEN 'warning' THEN 'slack,log' ELSE 'slack,pagerduty,log' END AS channels FROM lv WHERE threshold_level IN ('warning', 'critical')",
)
def st_alerts(b: Bind):
    rows = transforms.threshold_alerts(_stream(b).metric_samples(), A.thresholds(b.spark))
    out = sinks.run_into_batches(rows.select("event_id", "metric_name", "severity", F.array_join("channels_sent", ",").alias("channels")), new_folder(b.spark, "alerts"))
    return out.drop("batch")


@query(
    "q_st_alert_dedup", "metric_samples",
    f"WITH {_LEVELLED} SELECT DISTINCT project_id, branch_id, metric_name, threshold_level AS severity FROM lv WHERE threshold_level IN ('warning', 'critical')",
)
def st_alert_dedup(b: Bind):
    """One file is one batch here, and inside a batch a key passes once."""
    keys = ["project_id", "branch_id", "metric_name", "severity"]
    rows = transforms.threshold_alerts(_stream(b).metric_samples(), A.thresholds(b.spark)).select(*keys, "snapshot_timestamp")
    return sinks.run_append(transforms.dedup(rows, keys, "snapshot_timestamp"), new_folder(b.spark, "dedup")).select(*keys)


@query(
    "q_st_branch_state", "branch_events",
    f"WITH {_STATE} SELECT project_id, branch_id, created_at, is_protected, resets, last_activity, last_actor, state FROM state",
)
def st_branch_state(b: Bind):
    keys = ["project_id", "branch_id"]
    table = sinks.run_into_batches(transforms.branch_state(_stream(b).branch_events()), new_folder(b.spark, "branches"), "update")
    return sinks.last_per_key(table, keys)


@query(
    "q_st_branch_expiry", "branch_events",
    "WITH m AS (SELECT branch_id, max(event_timestamp) FILTER (event_type = 'created') AS c, max(event_timestamp) FILTER (event_type = 'deleted') AS d FROM branch_events GROUP BY 1)"
    " SELECT branch_id, c AS created_at, c + INTERVAL 1 DAY AS expired_at FROM m WHERE c IS NOT NULL AND (d IS NULL OR c > d) AND c + INTERVAL 1 DAY <= (SELECT max(event_timestamp) - INTERVAL 10 MINUTE FROM branch_events WHERE event_type IN ('created', 'deleted'))",
)
def st_branch_expiry(b: Bind):
    events = _stream(b).branch_events().select("branch_id", "event_type", "event_timestamp")
    out = sinks.run_append(transforms.branch_expiry(events, 86_400), new_folder(b.spark, "expiry"))
    return _ntz(out, "created_at", "expired_at")


@query("q_st_scd2", "", f"WITH {_HISTORY} SELECT *, valid_to IS NULL AS is_current FROM hi")
def st_scd2(b: Bind):
    return sinks.run_scd2(_stream(b).status_changes(), new_folder(b.spark, "scd2"), ["o_custkey"], "o_orderdate", ["o_orderkey"], ["o_orderstatus"])


@query("q_st_event_counts", "", "SELECT event_type, count(*) AS events FROM events GROUP BY ALL")
def st_event_counts(b: Bind):
    counts = transforms.event_counts(_stream(b).events("event_type"), "event_type")
    return sinks.last_batch(sinks.run_into_batches(counts, new_folder(b.spark, "counts"), "complete"))


@query(
    "q_st_lag_join", "",
    "SELECT o_orderkey, o_orderdate AS committed_at, l_shipdate AS arrived_at, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS lag_seconds FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
    " AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY",
)
def st_lag_join(b: Bind):
    s = _stream(b)
    commits = s.table("orders").select("o_orderkey", F.col("o_orderdate").alias("committed_at"))
    arrivals = s.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("arrived_at"))
    out = sinks.run_append(transforms.replication_lag(commits, arrivals, "o_orderkey", "90 DAYS"), new_folder(b.spark, "lag"))
    return _ntz(out, "committed_at", "arrived_at")


_PASSED = "project_id, metric_name, severity"


@query(
    "q_st_alert_period", "metric_samples",
    f"WITH {_LEVELLED}, al AS (SELECT DISTINCT project_id, metric_name, threshold_level AS severity, snapshot_timestamp FROM lv WHERE threshold_level IN ('warning', 'critical')),"
    " ok AS (SELECT * FROM al WHERE snapshot_timestamp <= (SELECT max(snapshot_timestamp) - INTERVAL 10 MINUTE FROM al))"
    f" SELECT * FROM (WITH RECURSIVE p AS (SELECT {_PASSED}, min(snapshot_timestamp) AS snapshot_timestamp FROM ok GROUP BY ALL"
    f" UNION ALL SELECT p.project_id, p.metric_name, p.severity, min(ok.snapshot_timestamp) FROM p JOIN ok USING ({_PASSED}) WHERE ok.snapshot_timestamp >= p.snapshot_timestamp + INTERVAL 6 HOUR GROUP BY 1, 2, 3)"
    " SELECT * FROM p)",
)
def st_alert_period(b: Bind):
    """Alerts at least six hours apart per project, metric and level, whatever batches they come in."""
    rows = transforms.threshold_alerts(_stream(b).metric_samples(), A.thresholds(b.spark)).select("project_id", "metric_name", "severity", "snapshot_timestamp")
    passed = stateful.quiet(rows, ["project_id", "metric_name", "severity"], "snapshot_timestamp", 6 * 3600)
    return _ntz(sinks.run_append(passed, new_folder(b.spark, "quiet")), "snapshot_timestamp")


@query(
    "q_st_live_branches", "branch_events",
    "WITH m AS (SELECT branch_id, max(event_timestamp) FILTER (event_type = 'created') AS created, max(event_timestamp) FILTER (event_type = 'deleted') AS deleted, count(*) FILTER (event_type = 'reset') AS resets,"
    " bool_or(event_type = 'protected') AS is_protected, max(event_timestamp) AS last FROM branch_events GROUP BY 1)"
    " SELECT branch_id, coalesce(epoch_us(created), -1) AS created, coalesce(epoch_us(deleted), -1) AS deleted, resets, is_protected, epoch_us(last) AS last FROM m"
    " WHERE NOT (deleted IS NOT NULL AND deleted >= coalesce(created, deleted) AND last <= (SELECT max(event_timestamp) - INTERVAL 10 MINUTE FROM branch_events))",
)
def st_live_branches(b: Bind):
    """What the state of the stream holds at its end: deleted branches have left it."""
    folder = new_folder(b.spark, "live-branches")
    sinks.run_into_batches(stateful.live_branches(_stream(b).branch_events()), folder, "update")
    return stateful.state_of(b.spark, folder)


_FINAL = "least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 60 DAY"


@query(
    "q_st_commit_lag", "",
    "SELECT o_orderkey, o_orderdate AS committed_at, count(l_shipdate) AS arrivals, min(l_shipdate) AS first_arrival, (epoch_us(min(l_shipdate)) - epoch_us(o_orderdate)) / 1e6 AS lag_seconds,"
    " CASE WHEN count(l_shipdate) > 0 THEN 'arrived' ELSE 'lost' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY"
    f" WHERE o_orderdate < {_FINAL} GROUP BY o_orderkey, o_orderdate",
)
def st_commit_lag(b: Bind):
    """A row per commit whose bound of 30 days is over for certain, lost ones among them."""
    s = _stream(b)
    commits = s.table("orders").select("o_orderkey", F.col("o_orderdate").alias("committed_at"))
    arrivals = s.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("arrived_at"))
    out = _ntz(sinks.run_append(stateful.commit_lag(commits, arrivals, "o_orderkey", "30 DAYS"), new_folder(b.spark, "commit-lag")), "committed_at", "first_arrival")
    final = min(b.now("orders", "o_orderdate"), b.now("lineitem", "l_shipdate")) - timedelta(days=60)
    return out.where(F.col("committed_at") < F.lit(final.isoformat(sep=" ")).cast("timestamp_ntz"))
