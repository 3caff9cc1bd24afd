"""Queries on fleet assessment: scores, effort, sizing, plan and cost, one row per database."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens import rules
from opslens.operators import assessment as A
from opslens.operators import catalog as C
from opslens.operators import cost as M
from opslens.operators import series as S
from opslens.operators.history import keep_last_n
from opslens.plans.bind import Bind
from opslens.plans.registry import query

# SQL of the same scores. Flags of the derived fleet follow from q, the tens of the customer key.
_WL = "q % 4 <> 0"
_QPS, _TPS = "size_gb * 15", "q * 37 % 7000"
_PEAK, _AVGC = "q * 91 % 5000", "q * 53 % 900"
_FEED_FULL, _FEED_LATEST = "q % 3 = 0", "q % 3 = 1"
_STREAMS, _PITR, _TTL, _MULTI = "q % 3 = 0", "q % 2 = 0", "q % 5 = 0", "q % 4 = 1"
_NREG, _GSI, _LSI = "q % 4", "q % 13", "q % 6"
_STRONG = "q % 4 IN (1, 2)"
_NFUN = "q % 60"
_LIST = ", ".join(f"'{n}'" for n in rules.SUPPORTED_EXTENSIONS)
_HIGH = ", ".join(f"'{n}'" for n in rules.HIGH_RISK_EXTENSIONS)


def _iif(cond: str, points: float) -> str:
    return f"CASE WHEN {cond} THEN {points} ELSE 0 END"


def _pg(*parts: str) -> str:
    return f"greatest(0.0::DOUBLE, 100.0::DOUBLE - {' - '.join(f'({p})' for p in parts)})"


def _engine(relational: str, dynamo: str, cosmos: str) -> str:
    return f"CASE source_engine WHEN 'cosmosdb-nosql' THEN {cosmos} WHEN 'dynamodb' THEN {dynamo} ELSE {relational} END"


_DYN, _COS = A.feature_support("dynamodb"), A.feature_support("cosmosdb-nosql")


def _features(n: dict) -> str:
    return str(8 * n["workaround"] + 15 * n["unsupported"])


_EXT = (
    f"xt AS (SELECT db_id, count(*) AS total, count(*) FILTER (name IN ({_LIST})) AS ok, count(*) FILTER (name NOT IN ({_LIST})) AS bad, count(*) FILTER (name IN ({_HIGH})) AS high,"
    " bool_or(name = 'pg_cron') AS cron, count(DISTINCT name) FILTER (regexp_matches(name, '^(aws_|google_|azure_)')) AS vendor, bool_or(name = 'age') AS age, bool_or(name = 'timescaledb') AS tsdb,"
    " bool_or(name = 'citus') AS citus, bool_or(name = 'pglogical') AS pgl FROM fleet_ext GROUP BY 1),"
    " fx AS (SELECT f.*, coalesce(total, 0) AS total, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad, coalesce(high, 0) AS high, coalesce(cron, false) AS cron, coalesce(vendor, 0) AS vendor,"
    " coalesce(age, false) AS age, coalesce(tsdb, false) AS tsdb, coalesce(citus, false) AS citus, coalesce(pgl, false) AS pgl, len([i for i in range(0, q % 60) if i % 9 <> 8]) AS plp,"
    " len([i for i in range(0, q % 60) if i % 9 <> 8 and (q * 13 + i * 7) % 203 > 200]) > 0 AS longf FROM fleet f LEFT JOIN xt USING (db_id))"
)
_HEAVY = "(plp > 50 OR longf)"
_S_STORAGE = "CASE WHEN size_gb > 8192 THEN 0.0::DOUBLE WHEN size_gb > 2048 THEN greatest(0.0::DOUBLE, 100 * (1 - size_gb / 8192)) ELSE round(greatest(0.0::DOUBLE, 100 * (1 - size_gb / 2048 * 0.5::DOUBLE)), 1) END"
_S_EXT = _engine(
    "CASE WHEN total > 0 THEN round(CAST(ok AS DOUBLE) / total * 100, 1) ELSE 100.0 END",
    _pg(_features(_DYN), _iif(_STREAMS, 5), _iif(f"{_NREG} > 1", 15)),
    _pg(_features(_COS), _iif(_FEED_FULL, 10), _iif(_FEED_LATEST, 3), _iif(_MULTI, 15), _iif(_STRONG, 5)),
)
_S_PERF = (
    f"CASE WHEN NOT ({_WL}) THEN 75.0::DOUBLE ELSE greatest(0.0::DOUBLE, CASE WHEN {_QPS} > 100000 THEN 0 WHEN {_QPS} > 70000 THEN 70 ELSE 100 END - ({_iif(_TPS + ' > 5000', 40)}) - ({_iif(_PEAK + ' > 4000', 20)})) END"
)
_S_COMPLEX = _engine(
    _pg(_iif(_HEAVY, 40), "CASE WHEN q % 30 > 20 THEN 15 WHEN q % 30 > 5 THEN 5 ELSE 0 END", _iif("q % 15 > 10", 10), _iif("q % 25 > 20", 10), _iif("q % 20 = 0", 30), _iif("q % 4 = 0", 5), _iif("q % 6 = 0", 5)),
    _pg("15", f"CASE WHEN {_GSI} > 10 THEN 15 WHEN {_GSI} > 5 THEN 5 ELSE 0 END", _iif(f"{_LSI} > 3", 5), _iif("q % 7 * 30000 > 100000", 10)),
    _pg("15", "CASE WHEN table_count > 15 THEN 10 WHEN table_count > 8 THEN 5 ELSE 0 END", _iif("least(q % 12 + 1, 10) > 8", 5), _iif("q % 2 > 0", 5)),
)
_S_REPL = _engine(
    _pg(_iif("q % 9 = 0", 40), _iif("q % 3 > 0", 10)),
    _pg(_iif(_STREAMS, 15), _iif(f"NOT ({_PITR})", 10), _iif(f"{_NREG} > 1", 20)),
    _pg(_iif(_FEED_FULL, 15), _iif(_FEED_LATEST, 5), _iif(_MULTI, 20), _iif(f"NOT ({_MULTI}) AND {_NREG} > 1", 10)),
)
_FAST = _iif(f"{_WL} AND {_TPS} > 5000", 15)
_S_OPS = _engine(
    _pg(_iif("cron", 10), "vendor * 5", _iif("age", 5), _iif("tsdb", 10), _iif("citus", 10), _iif("pgl", 5), _iif(f"{_WL} AND {_AVGC} > 500", 5)),
    _pg("10", _iif("q % 2 = 0", 5), _iif(_TTL, 5), _FAST),
    _pg("10", _iif("q % 3 = 0", 5), _iif("q % 4 <> 0", 5), _FAST),
)
# findings by severity and their days
_PG_BLOCK = f"({_iif('q % 20 = 0', 1)})"
_PERF_HIGH = f"({_iif(f'{_WL} AND {_TPS} > 5000', 1)}) + ({_iif(f'{_WL} AND {_PEAK} > 4000', 1)})"
_N_BLOCK = f"({_iif('size_gb > 8192', 1)}) + ({_iif(f'{_WL} AND {_QPS} > 100000', 1)}) + ({_engine(_PG_BLOCK, '0', '0')})"
_N_HIGH = f"{_PERF_HIGH} + " + "(" + _engine(
    f"high + ({_iif(_HEAVY, 1)}) + ({_iif('q % 9 = 0', 1)})",
    f"{_DYN['unsupported']} + ({_iif(f'{_NREG} > 1', 1)})",
    f"{_COS['unsupported']} + ({_iif(_MULTI, 2)})",
) + ")"
_N_MEDIUM = "(" + _engine(
    "(bad - high) + q % 3",
    f"{_DYN['workaround']} + ({_iif(_STREAMS, 1)}) + ({_iif(f'NOT ({_PITR})', 1)})",
    f"{_COS['workaround']} + ({_iif(_FEED_FULL, 2)})",
) + ")"
_DAYS = f"({_iif(f'{_WL} AND {_PEAK} > 4000', 2)}) + (" + _engine(
    f"bad + high + ({_iif(_HEAVY, 10)}) + ({_iif('q % 20 = 0', 3)}) + ({_iif('q % 9 = 0', 5)}) + 2 * (q % 3)",
    f"{2 * _DYN['workaround'] + 3 * _DYN['unsupported']} + ({_iif(f'{_NREG} > 1', 5)}) + ({_iif(_STREAMS, 3)}) + ({_iif(f'NOT ({_PITR})', 0.5)})",
    f"{2 * _COS['workaround'] + 3 * _COS['unsupported']} + ({_iif(_FEED_FULL, 6)}) + ({_iif(_MULTI, 10)})",
) + ")"
_UNSUPPORTED = _engine("bad", str(_DYN["workaround"] + _DYN["unsupported"]), str(_COS["workaround"] + _COS["unsupported"]))
_DOC_EFFORT = f"15 + days + ({_iif('table_count > 20', 5)}) + ({_iif('size_gb > 500', 10)}) + CASE WHEN {_GSI} > 5 THEN {_GSI} * 0.5 ELSE 0 END"
_EFFORT = _engine(f"5 + days + unsupported_count * 0.5 + ({_iif('table_count > 100', 3)}) + ({_iif('size_gb > 500', 5)}) + ({_iif(_NFUN + ' > 20', 5)})", _DOC_EFFORT, _DOC_EFFORT)
_WEIGHTED = " + ".join(f"CAST({n} AS DECIMAL(10,4)) * CAST({w} AS DECIMAL(4,2))" for n, w in A.WEIGHTS.items())
_SCORES = (
    _EXT
    + f", sc AS (SELECT *, {_S_STORAGE} AS s_storage, {_S_EXT} AS s_extensions, {_S_PERF} AS s_performance, {_S_COMPLEX} AS s_complexity, {_S_REPL} AS s_replication, {_S_OPS} AS s_operational,"
    f" {_N_BLOCK} AS n_block, {_N_HIGH} AS n_high, {_N_MEDIUM} AS n_medium, CAST({_DAYS} AS DOUBLE) AS days, {_UNSUPPORTED} AS unsupported_count FROM fx),"
    f" ov AS (SELECT *, {_WEIGHTED} AS w, CAST({_EFFORT} AS DOUBLE) AS effort_days FROM sc),"
    " fin AS (SELECT *, CAST(round(w, 1) AS DOUBLE) AS overall_score, CASE WHEN n_block > 0 THEN 'not_feasible' WHEN n_high > 0 OR w < 40 THEN 'needs_rearchitecture' WHEN w < 70 THEN 'ready_with_workarounds' ELSE 'ready' END AS category,"
    " n_block + n_high + n_medium AS blocker_count, CASE WHEN n_block + n_high + n_medium = 0 THEN 'low' WHEN n_block + n_high + n_medium <= 3 THEN 'medium' ELSE 'high' END AS risk_level FROM ov)"
)


def _dimension(name: str, key: str, column: str, fn):
    @query(name, "fleet_ext", f"WITH {_SCORES} SELECT db_id, source_engine, {column} FROM fin")
    def run(b: Bind):
        return fn(b.fleet()).select("db_id", "source_engine", column)

    return run


_dimension("q_as_storage", "storage", "s_storage", A.score_storage)
_dimension("q_as_extensions", "extensions", "s_extensions", A.score_extensions)
_dimension("q_as_performance", "performance", "s_performance", A.score_performance)
_dimension("q_as_complexity", "complexity", "s_complexity", A.score_complexity)
_dimension("q_as_replication", "replication", "s_replication", A.score_replication)
_dimension("q_as_operational", "operational", "s_operational", A.score_operational)


@query(
    "q_as_features", "fleet_ext",
    f"WITH {_SCORES} SELECT db_id, source_engine, s_extensions, CAST(unsupported_count AS INTEGER) AS unsupported_count FROM fin WHERE source_engine IN ('dynamodb', 'cosmosdb-nosql')",
)
def as_features(b: Bind):
    docs = b.fleet().where(F.col("source_engine").isin(*rules.DOCUMENT_ENGINES))
    return A.score_extensions(docs).select("db_id", "source_engine", "s_extensions", "unsupported_count")


@query("q_as_overall", "fleet_ext", f"WITH {_SCORES} SELECT db_id, overall_score, category, CAST(blocker_count AS INTEGER) AS blocker_count, risk_level FROM fin")
def as_overall(b: Bind):
    return A.score(b.fleet()).select("db_id", "overall_score", "category", "blocker_count", "risk_level")


@query("q_as_effort", "fleet_ext", f"WITH {_SCORES} SELECT db_id, CAST(unsupported_count AS INTEGER) AS unsupported_count, effort_days FROM fin")
def as_effort(b: Bind):
    return A.score(b.fleet()).select("db_id", "unsupported_count", "effort_days")


@query(
    "q_as_fleet_summary", "fleet_ext",
    f"WITH {_SCORES} SELECT source_engine, category, count(*) AS databases, CAST(sum(effort_days) AS DOUBLE) AS effort_days FROM fin GROUP BY ALL",
)
def as_fleet_summary(b: Bind):
    return A.score(b.fleet()).groupBy("source_engine", "category").agg(F.count("*").alias("databases"), F.sum("effort_days").alias("effort_days"))


@query(
    "q_agg_workload_from_capacity", "fleet",
    "SELECT db_id, CASE WHEN q % 4 <> 0 THEN 'observed' ELSE 'heuristic' END AS source, CASE WHEN q % 4 <> 0 THEN size_gb * 15 ELSE CAST(q * 50 + 400 AS DOUBLE) * 0.7::DOUBLE END AS avg_qps,"
    " CASE WHEN q % 4 <> 0 THEN CAST(q * 37 % 7000 AS DOUBLE) ELSE CAST(q * 50 + 400 AS DOUBLE) * 0.3::DOUBLE END AS avg_tps, CAST(CASE WHEN q % 4 <> 0 THEN q * 91 % 5000 ELSE table_count * 25 END AS INTEGER) AS connection_count_peak FROM fleet",
)
def agg_workload_from_capacity(b: Bind):
    w = A.workload_from_capacity(b.fleet())
    return w.select("db_id", "workload.source", "workload.avg_qps", "workload.avg_tps", "workload.connection_count_peak")


def _snap(x: str) -> str:
    best = " ".join(
        f"WHEN {x} <= {(float(a) + float(c)) / 2}::DOUBLE THEN {float(a)}" for a, c in zip(rules.UNIT_LADDER, rules.UNIT_LADDER[1:])
    )
    return f"(CASE {best} ELSE 32.0 END)::DOUBLE"


_ONE = "1.0::DOUBLE"
_SIZING = (
    f"n0 AS (SELECT *, greatest({_ONE}, CASE WHEN {_WL} THEN CAST({_PEAK} AS DOUBLE) / 209 ELSE 1 END, size_gb / 2, CASE WHEN {_WL} THEN {_QPS} / 2000 ELSE 1 END) AS need FROM fleet),"
    " n1 AS (SELECT *, greatest(2.0::DOUBLE, need * 0.6::DOUBLE) AS lo0 FROM n0), n2 AS (SELECT *, least(32.0::DOUBLE, lo0) AS lo, least(32.0::DOUBLE, greatest(lo0 + 2, need * 1.4::DOUBLE)) AS hi0 FROM n1),"
    " n3 AS (SELECT *, least(hi0, lo + 16) AS hi FROM n2),"
    f" n4 AS (SELECT *, {_snap('lo')} AS unit_min, {_snap('hi')} AS um FROM n3), sz AS (SELECT *, CASE WHEN um <= unit_min THEN {_snap('unit_min + 2')} ELSE um END AS unit_max FROM n4)"
)
_ENVS = (
    f"e0 AS (SELECT *, {_snap('greatest(0.5::DOUBLE, unit_min / 4)')} AS dl, {_snap('greatest(1.0::DOUBLE, unit_min)')} AS sl FROM sz),"
    f" e1 AS (SELECT *, {_snap('greatest(dl + 1, unit_min / 2)')} AS dh0, {_snap('greatest(sl + 2, unit_min + 4)')} AS sh0 FROM e0),"
    f" e2 AS (SELECT *, CASE WHEN dh0 <= dl THEN {_snap('dl + 1')} ELSE dh0 END AS dh, CASE WHEN sh0 <= sl THEN {_snap('sl + 2')} WHEN sh0 - sl > 16 THEN {_snap('sl + 16')} ELSE sh0 END AS sh FROM e1),"
    " env AS (SELECT db_id, size_gb, source_engine, region, 'dev' AS env, dl AS env_min, dh AS env_max, true AS scale_to_zero FROM e2 UNION ALL SELECT db_id, size_gb, source_engine, region, 'staging', sl, sh, true FROM e2"
    " UNION ALL SELECT db_id, size_gb, source_engine, region, 'prod', unit_min, unit_max, false FROM e2)"
)
_CONN = "CASE env_max " + " ".join(f"WHEN {float(u)} THEN {n}" for u, n in rules.UNIT_CONNECTIONS) + " END"


@query("q_as_sizing", "fleet", f"WITH {_SIZING}, {_ENVS} SELECT db_id, env, env_min, env_max, scale_to_zero, {_CONN} AS max_connections, env_max * 2 AS ram_gb FROM env")
def as_sizing(b: Bind):
    return A.sizing_by_env(A.sizing(b.fleet()))


_WORKAROUND = ", ".join(f"'{n}'" for n in rules.WORKAROUND_EXTENSIONS)
_FEATURES = ", ".join(f"('{e}', '{n}', '{s}')" for e, n, s in rules.ENGINE_FEATURES)
_MATRIX = (
    f"mx AS (SELECT db_id, 'extension' AS matrix_type, name, CASE WHEN name IN ({_LIST}) THEN 'supported' WHEN name IN ({_WORKAROUND}) THEN 'workaround' ELSE 'unsupported' END AS status FROM fleet_ext"
    f" WHERE source_engine NOT IN ('dynamodb', 'cosmosdb-nosql') UNION ALL SELECT db_id, 'feature', name, status FROM fleet JOIN (VALUES {_FEATURES}) v(engine, name, status) ON engine = source_engine)"
)


@query("q_as_matrix", "fleet_ext", f"WITH {_MATRIX} SELECT * FROM mx")
def as_matrix(b: Bind):
    return A.matrix(b.fleet())


@query("q_join_rule_table", "fleet_ext", f"WITH {_MATRIX} SELECT name, status, count(*) AS databases FROM mx GROUP BY ALL")
def join_rule_table(b: Bind):
    return A.matrix(b.fleet()).groupBy("name", "status").agg(F.count("*").alias("databases"))


@query(
    "q_agg_matrix_summary", "fleet_ext",
    f"WITH {_MATRIX} SELECT db_id, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'workaround') AS workaround, count(*) FILTER (status = 'unsupported') AS unsupported FROM mx GROUP BY ALL",
)
def agg_matrix_summary(b: Bind):
    return A.matrix_summary(A.matrix(b.fleet()))


@query(
    "q_ord_status_name", "fleet_ext",
    f"WITH {_MATRIX} SELECT db_id, name, status FROM mx ORDER BY CASE status WHEN 'supported' THEN 0 WHEN 'workaround' THEN 1 ELSE 2 END, name, db_id",
)
def ord_status_name(b: Bind):
    return A.matrix(b.fleet()).select("db_id", "name", "status").orderBy(*A.matrix_order(), "db_id")


_STRATEGY = (
    f"CASE WHEN source_engine IN ('dynamodb', 'cosmosdb-nosql') OR engine_version = '13.4' THEN 'cross_engine' WHEN ({_WL} AND {_TPS} > 100) OR size_gb > 500 THEN 'hybrid' ELSE 'bulk_dump_restore' END"
)


@query("q_as_strategy", "fleet", f"SELECT db_id, source_engine, {_STRATEGY} AS strategy FROM fleet")
def as_strategy(b: Bind):
    return A.strategy(b.fleet()).select("db_id", "source_engine", "strategy")


_PHASES = (
    f"sg AS (SELECT *, {_STRATEGY} AS strategy FROM fin),"
    " ph AS (SELECT db_id, strategy, risk_level, 1 AS phase, 'schema' AS phase_name, CAST(" + _engine("greatest(2.0, unsupported_count * 0.5 + 2)", f"greatest(5.0, {_GSI} * 0.5 + 5)", "greatest(5.0, table_count * 0.5 + 3)") + " AS DOUBLE) AS duration_days FROM sg"
    " UNION ALL SELECT db_id, strategy, risk_level, 2, 'data', round(CASE strategy WHEN 'cross_engine' THEN greatest(10.0::DOUBLE, size_gb / 50 + 5) WHEN 'hybrid' THEN greatest(3.0::DOUBLE, size_gb / 100 + 2) ELSE greatest(1.0::DOUBLE, size_gb / 100) END, 1) FROM sg"
    " UNION ALL SELECT db_id, strategy, risk_level, 3, 'application', CASE WHEN source_engine IN ('dynamodb', 'cosmosdb-nosql') THEN 10.0 ELSE 5.0 END FROM sg UNION ALL SELECT db_id, strategy, risk_level, 4, 'go_live', 5.0 FROM sg)"
)


def _phases(b: Bind):
    return A.phases(A.strategy(A.score(b.fleet())))


@query("q_as_phases", "fleet_ext", f"WITH {_SCORES}, {_PHASES} SELECT * FROM ph")
def as_phases(b: Bind):
    return _phases(b)


@query(
    "q_win_cumulative_timeline", "fleet_ext",
    f"WITH {_SCORES}, {_PHASES}, tl AS (SELECT db_id, phase, phase_name, duration_days, coalesce(sum(duration_days) OVER (PARTITION BY db_id ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ph)"
    " SELECT db_id, phase, phase_name, round(duration_days, 4) AS duration_days, round(s, 4) AS start_day, round(s + duration_days, 4) AS end_day FROM tl",
)
def win_cumulative_timeline(b: Bind):
    t = S.timeline(_phases(b), ["db_id"], "phase", "duration_days")
    return t.select("db_id", "phase", "phase_name", *[F.round(c, 4).alias(c) for c in ("duration_days", "start_day", "end_day")])


# ---- cost ----------------------------------------------------------------------------------------------------------


def _null(v) -> str:
    return "NULL" if v is None else f"{v}::DOUBLE"


_RATES = ", ".join(f"('{r[0]}', '{r[1]}', {', '.join(_null(v) for v in r[2:])})" for r in rules.SOURCE_RATES)
_RATED = (
    f"sr AS (SELECT * FROM (VALUES {_RATES}) v(engine, reg, cr, gr, ir, wr, rr)),"
    " rt AS (SELECT f.*, r.* FROM fleet f, LATERAL (SELECT cr, gr, ir, wr, rr FROM sr WHERE (engine = f.source_engine AND reg IN (f.region, 'default')) OR (engine = 'aurora-postgresql' AND reg = 'default')"
    " ORDER BY CASE WHEN engine = f.source_engine AND reg = f.region THEN 0 WHEN engine = f.source_engine THEN 1 ELSE 2 END LIMIT 1) r)"
)
_ML = f"(CASE WHEN {_WL} THEN {_QPS} ELSE 1000.0::DOUBLE END * 2592000 / 1000000)"
_RPCT = "CASE WHEN q % 4 <> 0 AND q % 100 > 0 THEN CAST(q % 100 AS DOUBLE) ELSE 70.0::DOUBLE END / 100"
_WPCT = "CASE WHEN q % 4 <> 0 THEN CAST(100 - q % 100 AS DOUBLE) ELSE 30.0::DOUBLE END / 100"
_NR = "greatest(1, q % 4)"
_UNITS = "CASE WHEN q % 3 = 1 THEN CAST(coalesce(CASE WHEN q % 2 = 0 THEN q * 100 + 1000 END, q * 50 + 400) AS DOUBLE) * 0.6::DOUBLE ELSE CAST(q * 50 + 400 AS DOUBLE) END"
_MULTIPLIER = f"CASE WHEN {_MULTI} THEN CAST({_NR} AS DOUBLE) ELSE 1 + ({_NR} - 1) * 0.5::DOUBLE END"
_COST = (
    _RATED
    + ", cs AS (SELECT *, " + _engine("cr * 730", "0.0::DOUBLE", f"{_UNITS} / 100 * cr * 730 * {_MULTIPLIER}") + " AS source_compute, "
    + _engine("gr * size_gb * 1", "gr * size_gb * 1", f"gr * size_gb * {_NR}") + " AS source_storage, "
    + _engine(f"ir * {_ML}", f"{_ML} * ({_WPCT}) * coalesce(wr, 1.25::DOUBLE) + {_ML} * ({_RPCT}) * coalesce(rr, 0.25::DOUBLE)", "CASE WHEN q % 2 = 0 THEN size_gb * 0.2::DOUBLE ELSE 0.0::DOUBLE END") + " AS source_io FROM rt),"
    " ct AS (SELECT *, source_compute + source_storage + source_io AS source_total FROM cs)"
)
_CLOUD = "CASE source_engine " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in rules.ENGINE_CLOUD) + " ELSE 'aws' END"


def _target_rate(place: int) -> str:
    arms = " ".join(f"WHEN '{r[0]}' THEN {r[place]}" for r in rules.TARGET_RATES[:-1])
    return f"(CASE {_CLOUD} || '-' || region {arms} ELSE {rules.TARGET_RATES[-1][place]} END)::DOUBLE"


_PARTS = ("source_compute", "source_storage", "source_io", "source_total")


@query("q_as_cost_source", "fleet", f"WITH {_COST} SELECT db_id, source_engine, region, {", ".join(_PARTS)} FROM ct")
def as_cost_source(b: Bind):
    return M.source_cost(b.fleet()).select("db_id", "source_engine", "region", *_PARTS)


@query(
    "q_join_default_fallback", "fleet",
    f"WITH {_RATED} SELECT db_id, source_engine, region, cr AS compute_rate, gr AS storage_rate, ir AS io_rate FROM rt",
)
def join_default_fallback(b: Bind):
    r = M.with_source_rates(b.fleet())
    return r.select("db_id", "source_engine", "region", "rates.compute_rate", "rates.storage_rate", "rates.io_rate")


_TARGET = f"tg AS (SELECT *, (floor(unit_min) + floor(unit_max)) / 2 AS units, {_target_rate(1)} AS ur, {_target_rate(3)} AS gr2 FROM sz), tc AS (SELECT *, units * ur * 730 AS target_compute, gr2 * size_gb AS target_storage FROM tg)"


@query(
    "q_as_cost_target", "fleet",
    f"WITH {_SIZING}, {_TARGET} SELECT db_id, units, target_compute AS target_compute, target_storage AS target_storage, target_compute + target_storage AS target_total,"
    " (target_compute + target_storage) * 0.75::DOUBLE AS target_total_1_year, (target_compute + target_storage) * 0.6::DOUBLE AS target_total_3_year FROM tc",
)
def as_cost_target(b: Bind):
    cols = ["target_compute", "target_storage", "target_total", "target_total_1_year", "target_total_3_year"]
    return M.target_cost(A.sizing(b.fleet())).select("db_id", "units", *cols)


@query(
    "q_as_cost_savings", "fleet",
    f"WITH {_COST}, {_SIZING}, {_TARGET} SELECT ct.db_id, (1 - (target_compute + target_storage) / source_total) * 100 AS savings_pct, source_total - (target_compute + target_storage) AS savings_monthly FROM ct JOIN tc USING (db_id)",
)
def as_cost_savings(b: Bind):
    out = M.savings(M.target_cost(A.sizing(M.source_cost(b.fleet()))))
    return out.select("db_id", "savings_pct", "savings_monthly")


@query(
    "q_as_cost_env", "fleet",
    f"WITH {_SIZING}, {_ENVS}, ec AS (SELECT *, (env_min + env_max) / 2 AS avg_units, {_target_rate(2)} AS ur, {_target_rate(3)} AS g FROM env)"
    " SELECT db_id, env, avg_units, avg_units * ur * 730 * CASE env WHEN 'dev' THEN 0.35 WHEN 'staging' THEN 0.6 ELSE 1.0 END::DOUBLE AS compute, g * size_gb AS storage FROM ec",
)
def as_cost_env(b: Bind):
    return M.env_cost(A.sizing(b.fleet()), "enterprise").select("db_id", "env", "avg_units", "compute", "storage")


@query(
    "q_as_history", "fleet_ext",
    f"WITH {_SCORES} SELECT source_engine, db_id, overall_score, CAST(row_number() OVER (PARTITION BY source_engine ORDER BY CAST(db_id AS BIGINT) DESC) AS INTEGER) AS place FROM fin QUALIFY place <= 50",
)
def as_history(b: Bind):
    scored = A.score(b.fleet()).select("source_engine", "db_id", "overall_score", F.col("db_id").cast("bigint").alias("seq"))
    return keep_last_n(scored, ["source_engine"], "seq", 50).drop("seq")


@query(
    "q_price_age", "",
    "SELECT o_orderkey, CAST(datediff('day', CAST(o_orderdate AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS INTEGER) AS age_days, datediff('day', CAST(o_orderdate AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) > 90 AS is_stale FROM orders",
)
def price_age(b: Bind):
    return M.price_age(b.table("orders"), "o_orderdate", b.now("orders", "o_orderdate")).select("o_orderkey", "age_days", "is_stale")




# ---- from the catalog ----------------------------------------------------------------------------------------------

_CATALOG = "attributes cat_databases cat_objects cat_extensions cat_functions cat_collations"


def _n(kind: str, column: str) -> str:
    return f"count(*) FILTER (kind = '{kind}') AS {column}"


_PROFILE = (
    "ob AS (SELECT db_id, count(*) FILTER (kind IN ('tables', 'partitioned_tables')) AS table_count, sum(size_bytes) FILTER (kind IN ('tables', 'partitioned_tables')) AS bytes, "
    + ", ".join(_n(k, c) for k, c in C.COUNTS.items())
    + ", string_agg(DISTINCT schema_name, ',' ORDER BY schema_name) AS schemas,"
    " string_agg(schema_name || '.' || name, ',' ORDER BY schema_name || '.' || name) FILTER (kind = 'partitioned_tables') AS partitioned_tables FROM cat_objects GROUP BY db_id),"
    " ex AS (SELECT db_id, string_agg(name || ' ' || version, ',' ORDER BY name, version) AS extensions FROM cat_extensions GROUP BY db_id),"
    " fu AS (SELECT db_id, count(*) AS n_functions, string_agg(name || ' ' || language || ' ' || lines, ',' ORDER BY name) AS functions, count(*) FILTER (language = 'plpgsql') AS plp,"
    " coalesce(bool_or(language = 'plpgsql' AND lines > 200), false) AS longf FROM cat_functions GROUP BY db_id),"
    " co AS (SELECT db_id, count(*) AS n_collations, string_agg(table_name || '.' || column_name, ',' ORDER BY table_name, column_name) AS collations FROM cat_collations GROUP BY db_id),"
    " pf AS (SELECT d.*, coalesce(table_count, 0) AS table_count, round(CAST(coalesce(bytes, 0) AS DOUBLE) / 1073741824, 2) AS size_gb, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in C.COUNTS.values())
    + ", coalesce(schemas, '') AS schemas, coalesce(partitioned_tables, '') AS partitioned_tables, coalesce(extensions, '') AS extensions, coalesce(functions, '') AS functions, coalesce(n_functions, 0) AS n_functions,"
    " coalesce(plp, 0) AS plp, coalesce(longf, false) AS longf, coalesce(n_collations, 0) AS n_collations, coalesce(collations, '') AS collations, CASE WHEN d.db_id % 5 = 0 THEN 1 ELSE 0 END AS n_slots,"
    " d.db_id % 10 = 0 OR coalesce(publication_count, 0) > 0 AS logical, CASE WHEN d.db_id % 20 = 0 THEN 1 ELSE 0 END AS n_events"
    " FROM cat_databases d LEFT JOIN ob USING (db_id) LEFT JOIN ex USING (db_id) LEFT JOIN fu USING (db_id) LEFT JOIN co USING (db_id))"
)


def _catalog_profiles(b: Bind):
    return C.database_profiles(**b.catalogs())


@query(
    "q_agg_catalog_profile", _CATALOG,
    f"WITH {_PROFILE} SELECT CAST(db_id AS VARCHAR) AS db_id, source_engine, region, engine_version, table_count, size_gb, {', '.join(C.COUNTS.values())}, schemas, partitioned_tables, extensions, functions, collations,"
    " CASE WHEN n_slots > 0 THEN 'slot_' || db_id ELSE '' END AS slots, logical AS has_logical_replication, CASE WHEN n_events > 0 THEN 'et_' || db_id ELSE '' END AS event_triggers, n_collations AS non_default_collation_count FROM pf",
)
def agg_catalog_profile(b: Bind):
    p = _catalog_profiles(b)
    return p.select(
        "db_id", "source_engine", "region", "engine_version", "table_count", "size_gb", *C.COUNTS.values(), "has_logical_replication", "non_default_collation_count",
        *[F.array_join(c, ",").alias(c) for c in ("schemas", "partitioned_tables", "event_triggers")], F.array_join("replication_slots", ",").alias("slots"),
        F.array_join(F.transform("extensions", lambda e: F.concat_ws(" ", e["name"], e["version"])), ",").alias("extensions"),
        F.array_join(F.transform("functions", lambda f: F.concat_ws(" ", f["name"], f["language"], f["line_count"])), ",").alias("functions"),
        F.array_join(F.transform("collations", lambda c: F.concat_ws(".", c["table_name"], c["column_name"])), ",").alias("collations"),
    )


_CAT_HEAVY = "(plp > 50 OR longf)"
_CAT_SCORES = (
    _PROFILE
    + f", xl AS (SELECT db_id, lower(name) AS name FROM cat_extensions), xt AS (SELECT db_id, count(*) AS total, count(*) FILTER (name IN ({_LIST})) AS ok, count(*) FILTER (name NOT IN ({_LIST})) AS bad,"
    f" count(*) FILTER (name IN ({_HIGH})) AS high, bool_or(name = 'pg_cron') AS cron, count(DISTINCT name) FILTER (regexp_matches(name, '^(aws_|google_|azure_)')) AS vendor, bool_or(name = 'timescaledb') AS tsdb,"
    " bool_or(name = 'pglogical') AS pgl FROM xl GROUP BY 1),"
    " fx AS (SELECT p.*, coalesce(total, 0) AS total, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad, coalesce(high, 0) AS high, coalesce(cron, false) AS cron, coalesce(vendor, 0) AS vendor, coalesce(tsdb, false) AS tsdb,"
    " coalesce(pgl, false) AS pgl FROM pf p LEFT JOIN xt USING (db_id)),"
    f" sc AS (SELECT *, {_S_STORAGE} AS s_storage, CASE WHEN total > 0 THEN round(CAST(ok AS DOUBLE) / total * 100, 1) ELSE 100.0 END AS s_extensions, 75.0::DOUBLE AS s_performance, "
    + _pg(_iif(_CAT_HEAVY, 40), "CASE WHEN trigger_count > 20 THEN 15 WHEN trigger_count > 5 THEN 5 ELSE 0 END", _iif("materialized_view_count > 10", 10), _iif("custom_type_count > 20", 10), _iif("n_events > 0", 30),
          _iif("large_object_count > 0", 5), _iif("n_collations > 0", 5)) + " AS s_complexity, "
    + _pg(_iif("logical", 40), _iif("n_slots > 0", 10)) + " AS s_replication, " + _pg(_iif("cron", 10), "vendor * 5", _iif("tsdb", 10), _iif("pgl", 5)) + " AS s_operational,"
    f" ({_iif('size_gb > 8192', 1)}) + n_events AS n_block, high + ({_iif(_CAT_HEAVY, 1)}) + ({_iif('logical', 1)}) AS n_high, bad - high + n_slots AS n_medium,"
    f" CAST(bad + high + ({_iif(_CAT_HEAVY, 10)}) + ({_iif('n_events > 0', 3)}) + ({_iif('logical', 5)}) + 2 * n_slots AS DOUBLE) AS days FROM fx),"
    f" ov AS (SELECT *, {_WEIGHTED} AS w, CAST(5 + days + bad * 0.5 + ({_iif('table_count > 100', 3)}) + ({_iif('size_gb > 500', 5)}) + ({_iif('n_functions > 20', 5)}) AS DOUBLE) AS effort_days FROM sc),"
    " fin AS (SELECT *, CAST(round(w, 1) AS DOUBLE) AS overall_score, CASE WHEN n_block > 0 THEN 'not_feasible' WHEN n_high > 0 OR w < 40 THEN 'needs_rearchitecture' WHEN w < 70 THEN 'ready_with_workarounds' ELSE 'ready' END AS category,"
    " n_block + n_high + n_medium AS blocker_count, CASE WHEN engine_version = '13.4' THEN 'cross_engine' WHEN size_gb > 500 THEN 'hybrid' ELSE 'bulk_dump_restore' END AS strategy,"
    f" greatest({_ONE}, size_gb / 2) AS need FROM ov)"
)
_CAT_SIZING = _SIZING[_SIZING.index("n1 AS"):].replace("FROM n0", "FROM fin")
_CAT_SOURCE = (
    _RATED.replace("FROM fleet f", "FROM tc f")
    + ", ct AS (SELECT *, cr * 730 AS source_compute, gr * size_gb * 1 AS source_storage, ir * (1000.0::DOUBLE * 2592000 / 1000000) AS source_io FROM rt)"
)
_CAT_PHASES = (
    "UNPIVOT (SELECT db_id, overall_score, category, blocker_count, effort_days, strategy, unit_min, unit_max, source_compute + source_storage + source_io AS source_total, target_compute + target_storage AS target_total,"
    " CAST(greatest(2.0, bad * 0.5 + 2) AS DOUBLE) AS \"schema\", round(CASE strategy WHEN 'cross_engine' THEN greatest(10.0::DOUBLE, size_gb / 50 + 5) WHEN 'hybrid' THEN greatest(3.0::DOUBLE, size_gb / 100 + 2)"
    " ELSE greatest(1.0::DOUBLE, size_gb / 100) END, 1) AS data, 5.0::DOUBLE AS application, 5.0::DOUBLE AS go_live FROM ct) ON \"schema\", data, application, go_live INTO NAME phase_name VALUE duration_days"
)


@query(
    "q_as_from_catalog", _CATALOG,
    f"WITH {_CAT_SCORES}, {_CAT_SIZING}, {_TARGET}, {_CAT_SOURCE}, pp AS ({_CAT_PHASES}) SELECT CAST(db_id AS VARCHAR) AS db_id, overall_score, category, CAST(blocker_count AS INTEGER) AS blocker_count, effort_days, strategy, unit_min, unit_max,"
    " source_total, target_total, phase_name, duration_days FROM pp",
)
def as_from_catalog(b: Bind):
    """From flat catalog frames to scores, sizing, cost and phases."""
    scored = A.strategy(A.score(_catalog_profiles(b)))
    priced = M.target_cost(A.sizing(M.source_cost(scored)))
    kept = ("db_id", "overall_score", "category", "blocker_count", "effort_days", "strategy", "unit_min", "unit_max", "source_total", "target_total")
    return A.phases(priced, kept).drop("phase")
