"""Streams with timers: the answer does not depend on batches, and state ends."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opslens.streaming import sinks, stateful

T0 = datetime(2024, 1, 1)


def at(m):
    return T0 + timedelta(minutes=m)


def put(spark, rows, ddl, folder, name):
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/{name}")


def passing(times, period=60):
    out = []
    for t in sorted(set(times)):
        if not out or t >= out[-1] + period:
            out.append(t)
    return out


ALERTS = {"a": [0, 5, 59, 60, 61, 119, 121, 125, 185, 190], None: [3, 64, 100, 124], "b": [30, 30, 31]}


@pytest.mark.parametrize("cuts", [[], [60], [31, 120]])
def test_alerts_pass_alike_in_any_batches(spark, tmp_path, cuts):
    src, ddl = str(tmp_path / "src"), "k string, ts timestamp"
    rows = [(k, t) for k, ts in ALERTS.items() for t in ts]
    edges = [-1, *cuts, 10_000]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        # within a batch rows come in no order, and the last minutes before a cut come late, within the delay
        part = [(k, at(t)) for k, t in reversed(rows) if low < t + (9 if t % 2 else 0) <= high]
        put(spark, part, ddl, src, f"d={i}")
        got = sinks.run_append(stateful.quiet(sinks.read_files(spark, f"{src}/*").drop("d"), ["k"], "ts", 3600), str(tmp_path / "out"))
    put(spark, [("end", at(9_000))], ddl, src, "d=99")
    got = sinks.run_append(stateful.quiet(sinks.read_files(spark, f"{src}/*").drop("d"), ["k"], "ts", 3600), str(tmp_path / "out"))
    want = {(k, at(t)) for k, ts in ALERTS.items() for t in passing(ts)}
    rows = [(r.k, r.ts) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_deleted_branches_leave_the_state(spark, tmp_path):
    src, out, ddl = str(tmp_path / "src"), str(tmp_path / "out"), "branch_id string, event_type string, event_timestamp timestamp"
    us = lambda m: int((at(m) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    initial = spark.createDataFrame([("old", us(-500), -1, 3, True, us(-400)), ("x", us(-500), -1, 0, False, us(-500))], stateful.BRANCH_DDL)
    run = lambda: sinks.run_into_batches(stateful.live_branches(sinks.read_files(spark, f"{src}/*").drop("d"), initial), out, "update")
    put(spark, [("a", "created", at(0)), ("b", "created", at(0)), ("b", "deleted", at(5)), ("old", "reset", at(6)), ("c", "deleted", at(8)), ("c", "created", at(9))], ddl, src, "d=1")
    last = {r.branch_id: r for r in sinks.last_per_key(run(), ["branch_id"]).collect()}
    assert (last["old"].resets, last["old"].is_protected, last["b"].deleted) == (4, True, us(5))
    assert {r.branch_id for r in stateful.state_of(spark, out).collect()} == {"a", "b", "c", "old", "x"}
    put(spark, [("a", "reset", at(60)), ("x", "deleted", at(61))], ddl, src, "d=2")
    run()
    # b was deleted before the watermark; x after it
    assert {r.branch_id: r.resets for r in stateful.state_of(spark, out).collect()} == {"a": 1, "c": 0, "old": 4, "x": 0}


@pytest.mark.parametrize("salts", [1, 3])
def test_lost_commits(spark, tmp_path, salts):
    put(spark, [(1, at(0)), (2, at(0)), (3, at(1)), (None, at(2)), (9, at(500))], "id bigint, committed_at timestamp", str(tmp_path / "c"), "d=1")
    put(spark, [(1, at(1)), (1, at(2)), (1, at(59)), (2, at(90)), (9, at(500)), (8, at(501))], "id bigint, arrived_at timestamp", str(tmp_path / "a"), "d=1")
    lag = stateful.commit_lag(sinks.read_files(spark, f"{tmp_path}/c/*").drop("d"), sinks.read_files(spark, f"{tmp_path}/a/*").drop("d"), "id", "1 HOUR", salts=salts)
    got = {r.id: (r.status, r.arrivals, r.lag_seconds) for r in sinks.run_append(lag, str(tmp_path / "l")).collect()}
    assert got == {1: ("arrived", 3, 60.0), 2: ("lost", 0, None), 3: ("lost", 0, None), None: ("lost", 0, None)}


class Calls:
    """Stands for the state of one key and counts the calls to it, each of which is a round trip."""

    def __init__(self):
        self.n, self.value, self.map, self.timers = 0, None, {}, []

    def _counted(self, result=None):
        self.n += 1
        return result

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def get(self):
        return self._counted(self.value)

    def exists(self):
        return self._counted(self.value is not None)

    def update(self, value):
        self.value = self._counted(value)

    def clear(self):
        self.value = self._counted()

    def keys(self):
        return self._counted([*self.map])

    def containsKey(self, key):
        return self._counted(key in self.map)

    def getValue(self, key):
        return self._counted(self.map.get(key))

    def updateValue(self, key, value):
        self.map[key] = self._counted(value)

    def removeKey(self, key):
        self._counted(self.map.pop(key))

    def registerTimer(self, ms):
        self.timers.append(self._counted(ms))

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_calls_to_the_state_of_alerts_do_not_grow_with_alerts():
    calls, quiet = Calls(), stateful._Quiet(60_000_000)
    quiet.init(calls)
    times = [i * 1_000_000 for i in reversed(range(5000))]
    list(quiet.handleInputRows(("k",), iter([pd.DataFrame({"key": "k", "at_us": times[i : i + 1000]}) for i in range(0, 5000, 1000)]), calls))
    assert calls.n <= 5 and calls.timers == [0]
    calls.mark = 3_000_000
    got = [t for f in quiet.handleExpiredTimer(("k",), calls, None) for t in f["at_us"]]
    assert got == [i * 60_000_000 for i in range(51)] and calls.n <= 15
    # what the watermark has not passed still waits
    assert calls.timers[1] == 3_001_000


def test_calls_to_the_state_of_branches_do_not_grow_with_branches():
    calls, branches = Calls(), stateful._Branches()
    branches.init(calls)
    names = [f"b{i}" for i in range(2000)]
    new = pd.DataFrame({"branch_id": names, "created": 5, "deleted": [9 if i % 2 else -1 for i in range(2000)], "resets": 1, "is_protected": False, "last": 10_000})
    out = pd.concat(branches.handleInputRows((0,), iter([new[:1500], new[1000:]]), calls))
    assert sorted(out["branch_id"]) == sorted(names) and set(out[out["branch_id"] == "b1200"]["resets"]) == {2}
    assert calls.n <= 4 and calls.timers == [10]
    calls.mark = 10
    list(branches.handleExpiredTimer((0,), calls, None))
    assert sorted(calls.value[0]) == sorted(names[::2]) and calls.n <= 8
    # rows come for the branches of the batch only
    assert [*pd.concat(branches.handleInputRows((0,), iter([new[:1]]), calls))["resets"]] == [2]
