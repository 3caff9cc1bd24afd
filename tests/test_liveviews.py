"""Live views through a DB-API driver; a file of SQLite stands in for a server."""

import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringContains
from pyspark.sql.types import StructType

from opslens.sources import liveviews
from opslens.sources.liveviews import LiveViewReader, key_ranges

DDL = "relid BIGINT, relname STRING, seq_scan BIGINT, ratio DOUBLE"
QUERY = "SELECT relid, relname, seq_scan, ratio, 'wide' AS unused FROM stat_tables"


@pytest.fixture(scope="module")
def target(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("live") / "stats.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE stat_tables (relid INTEGER, relname TEXT, seq_scan INTEGER, ratio REAL)")
        rows = [(i * 3 - 50, f"t{i % 7}", i % 11 if i % 5 else None, i / 8) for i in range(500)]
        con.executemany("INSERT INTO stat_tables VALUES (?, ?, ?, ?)", [*rows, (None, "nokey", 1, None), (None, "nokey", 1, None), (10**12, None, 2, 0.5)])
        con.execute("CREATE TABLE no_rows (relid INTEGER, relname TEXT, seq_scan INTEGER, ratio REAL)")
    con.close()
    return path


def everything(target):
    con = sqlite3.connect(target)
    out = con.execute("SELECT relid, relname, seq_scan, ratio FROM stat_tables").fetchall()
    con.close()
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def reader(target, **options):
    return LiveViewReader(StructType.fromDDL(DDL), {"connect": "sqlite3:connect", "target": target, "query": QUERY, **options})


def test_ranges_cover_every_key():
    for low, high, parts in [(0, 9, 3), (-5, -5, 4), (0, 2, 10), (-50, 10**12, 16)]:
        got = key_ranges(low, high, parts)
        assert len(got) == min(parts, high - low + 1) and got[0][0] is None and got[-1][1] is None
        assert all(a[1] == b[0] for a, b in zip(got, got[1:]))
        assert all(low < b[0] <= high for b in got[1:])
    assert key_ranges(None, None, 4) == [(None, None)]


@pytest.mark.parametrize("options", [{}, {"key": "relid", "parts": 5, "fetchsize": 7}, {"key": "seq_scan", "parts": 100}])
def test_all_rows_come_once(spark, target, options):
    df = liveviews.read_live_view(spark, DDL, "sqlite3:connect", target, QUERY, **options)
    assert ordered(df.collect()) == ordered(everything(target))
    wanted = {None: 1, 5: 6, 100: 12}[options.get("parts")]  # the null keys are a part; seq_scan has 11 values
    assert df.rdd.getNumPartitions() == wanted


def test_empty_view(spark, target):
    df = liveviews.read_live_view(spark, DDL, "sqlite3:connect", target, "SELECT * FROM no_rows", key="relid", parts=4)
    assert df.count() == 0 and df.columns == ["relid", "relname", "seq_scan", "ratio"]


def test_filters_reach_the_database(spark, target):
    df = liveviews.read_live_view(spark, DDL, "sqlite3:connect", target, QUERY, key="relid", parts=4)
    kept = df.where((F.col("relid") >= 100) & (F.col("relname") == "t3") & F.col("seq_scan").isNotNull() & F.col("relname").contains("3"))
    want = [r for r in everything(target) if r[0] is not None and r[0] >= 100 and r[1] == "t3" and r[2] is not None]
    assert want and ordered(kept.collect()) == ordered(want)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("Filter"):].split("\n")[0]
    assert "100" not in left and "t3" not in left and "Contains" in left


def test_which_filters_are_sent(target):
    r = reader(target)
    given = [EqualTo(("relname",), "t1"), GreaterThan(("relname",), "t1"), GreaterThan(("ratio",), float("nan")), In(("relid",), (1, 4)), IsNull(("ratio",)), Not(IsNull(("ratio",))), StringContains(("relname",), "t"), EqualTo(("a", "b"), 1), GreaterThan(("relid",), datetime(2024, 1, 1))]
    left = list(r.pushFilters(given))
    assert [id(f) for f in left] == [id(given[i]) for i in (1, 2, 5, 6, 7, 8)]
    assert r.where == ['"relname" = ?', '"relid" IN (?, ?)', '"ratio" IS NULL'] and r.args == ["t1", 1, 4]
    timed = reader(target, times="true")
    assert list(timed.pushFilters([given[-1]])) == [] and timed.where == ['"relid" > ?']


def test_values_are_parameters_not_text(spark, target):
    df = liveviews.read_live_view(spark, DDL, "sqlite3:connect", target, QUERY)
    assert df.where(F.col("relname") == "x' OR '1'='1").count() == 0
    assert df.where(F.col("relname") == "t1").count() == sum(r[1] == "t1" for r in everything(target))


def test_wrong_options(target):
    for bad in ({"parts": "3"}, {"parts": "0"}, {"key": "relid", "fetchsize": "0"}):
        with pytest.raises(ValueError):
            reader(target, **bad)
    with pytest.raises(ValueError):
        LiveViewReader(StructType.fromDDL(DDL), {"connect": "sqlite3:connect"})
