"""Streams: restart, late rows, batch twins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.operators import scd2
from opslens.streaming import sinks, transforms

T0 = datetime(2024, 1, 1)


def put(spark, rows, ddl, folder, name):
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/{name}")


def test_ingest_continues_after_restart(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ddl = "metric_name string, v int"
    put(spark, [("a", 1), ("b", 2)], ddl, src, "d=1")
    assert sinks.run_append(sinks.read_files(spark, f"{src}/*"), out, ["metric_name"]).count() == 2
    assert sinks.run_append(sinks.read_files(spark, f"{src}/*"), out, ["metric_name"]).count() == 2
    put(spark, [("c", 3)], ddl, src, "d=2")
    assert sinks.run_append(sinks.read_files(spark, f"{src}/*"), out, ["metric_name"]).count() == 3


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ddl = "metric_name string, metric_value double, snapshot_timestamp timestamp"
    at = lambda m: T0 + timedelta(minutes=m)
    put(spark, [("m", 1.0, at(1)), ("m", 3.0, at(2)), ("m", 5.0, at(60))], ddl, src, "d=1")
    trend = lambda: transforms.tumbling_trend(sinks.read_files(spark, f"{src}/*"))
    first = sinks.run_append(trend(), out).collect()
    assert [(r.n, r.avg_value) for r in first] == [(2, 2.0)]
    put(spark, [("m", 9.0, at(3)), ("m", 7.0, at(61)), ("m", 1.0, at(120))], ddl, src, "d=2")
    q = trend().writeStream.format("parquet").outputMode("append").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    stored = spark.read.parquet(f"{out}/table")
    assert sorted((r.window_start.hour * 60 + r.window_start.minute, r.n) for r in stored.collect()) == [(0, 2), (60, 2)]
    # the batch over all files is what a reconciliation compares with
    whole = spark.read.parquet(f"{src}/*").where(F.col("snapshot_timestamp") < at(5)).count()
    assert whole - 2 == dropped


def test_scd2_keeps_null_keys_and_refuses_other_buckets(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ddl = "k string, ts timestamp, id bigint, state string"
    at = lambda m: T0 + timedelta(minutes=m)
    parts = [[(None, at(1), 1, "A"), ("a", at(1), 2, "A")], [(None, at(5), 3, "B"), ("a", at(6), 4, "B")], [(None, at(3), 5, "C")]]
    everything = []
    for i, part in enumerate(parts):
        everything += part
        put(spark, part, ddl, src, f"d={i}")
        got = sinks.run_scd2(sinks.read_files(spark, f"{src}/*"), out, ["k"], "ts", ["id"], ["state"], buckets=4)
        want = scd2.build(spark.createDataFrame(everything, ddl), ["k"], "ts", ["id"], ["state"]).select(*got.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    put(spark, [("a", at(0), 9, "Z")], ddl, src, "d=9")
    with pytest.raises(Exception, match="buckets"):
        sinks.run_scd2(sinks.read_files(spark, f"{src}/*"), out, ["k"], "ts", ["id"], ["state"], buckets=8)


def test_late_rows_are_kept_and_repair_their_window(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ddl = "metric_name string, metric_value double, snapshot_timestamp timestamp"
    at = lambda m: T0 + timedelta(minutes=m)
    put(spark, [("m", 1.0, at(1)), ("m", 3.0, at(2)), ("m", 5.0, at(60))], ddl, src, "d=1")
    run = lambda: {(r.window_start.hour * 60 + r.window_start.minute): (r.n, r.avg_value, r.max_value, r.late_rows) for r in sinks.repaired_trend(sinks.read_files(spark, f"{src}/*"), out).collect()}
    assert run() == {0: (2, 2.0, 3.0, 0), 60: (1, 5.0, 5.0, 0)}
    put(spark, [("m", 8.0, at(3)), ("m", 7.0, at(61)), ("m", 1.0, at(120))], ddl, src, "d=2")
    assert run() == {0: (3, 4.0, 8.0, 1), 60: (2, 6.0, 7.0, 0), 120: (1, 1.0, 1.0, 0)}
    assert run() == {0: (3, 4.0, 8.0, 1), 60: (2, 6.0, 7.0, 0), 120: (1, 1.0, 1.0, 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_scd2_in_batches_equals_one_build(spark, tmp_path, seed):
    """Late, repeated and equal changes over several batches."""
    rng = random.Random(seed)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ddl = "k string, ts timestamp, id bigint, state string"
    everything, n = [], 0
    for batch in range(4):
        rows = []
        for _ in range(40):
            n += 1
            late = rng.random() < 0.2
            rows.append((f"k{rng.randint(0, 9)}", T0 + timedelta(seconds=(0 if late else batch * 100) + rng.randint(0, 99)), n, rng.choice("AAB")))
        everything += rows
        put(spark, rows, ddl, src, f"d={batch}")
        stream = sinks.read_files(spark, f"{src}/*").drop("d")
        got = sinks.run_scd2(stream, out, ["k"], "ts", ["id"], ["state"], buckets=4, snapshot_every=1 + seed)
    want = scd2.build(spark.createDataFrame(everything, ddl), ["k"], "ts", ["id"], ["state"]).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_scd2_batch_may_be_repeated(spark, tmp_path):
    store = sinks.Scd2Store(spark, str(tmp_path), ["k"], "ts", ["id"], ["s"], 4)
    ddl = "k string, ts timestamp, id bigint, s string"
    one = spark.createDataFrame([("a", T0, 1, "X"), ("b", T0, 2, "X")], ddl)
    two = spark.createDataFrame([("a", T0 + timedelta(1), 3, "Y"), ("a", T0 - timedelta(1), 4, "W")], ddl)
    store.write(one, 0)
    store.write(two, 1)
    before = sorted(map(str, store.read().collect()))
    store.write(two, 1)
    assert sorted(map(str, store.read().collect())) == before and len(before) == 4


def test_session_and_counts(spark, tmp_path):
    src = str(tmp_path / "src")
    times = [0, 10, 39, 200, 215, 400]
    put(spark, [("u", T0 + timedelta(minutes=m)) for m in times], "u string, ts timestamp", src, "d=1")
    stream = sinks.read_files(spark, f"{src}/*").drop("d")
    out = sinks.run_append(transforms.activity_sessions(stream, "u", "ts"), str(tmp_path / "s")).orderBy("session_start").collect()
    assert [(r.events, (r.session_end - r.session_start).seconds // 60) for r in out] == [(3, 69), (2, 45)]
    counts = sinks.last_batch(sinks.run_into_batches(transforms.event_counts(stream, "u"), str(tmp_path / "c"), "complete"))
    assert [(r.u, r.events) for r in counts.collect()] == [("u", 6)]


def test_expiry(spark, tmp_path):
    src = str(tmp_path / "src")
    h = lambda n: T0 + timedelta(hours=n)
    rows = [("a", "created", h(0)), ("b", "created", h(0)), ("b", "deleted", h(1)), ("c", "created", h(0)), ("c", "created", h(30)), ("d", "deleted", h(40)), ("e", "reset", h(41))]
    put(spark, rows, "branch_id string, event_type string, event_timestamp timestamp", src, "d=1")
    stream = sinks.read_files(spark, f"{src}/*").drop("d")
    out = sinks.run_append(transforms.branch_expiry(stream, 86_400), str(tmp_path / "x")).collect()
    assert [(r.branch_id, r.expired_at) for r in out] == [("a", h(24))]


def test_dedup_and_lag(spark, tmp_path):
    src = str(tmp_path / "src")
    put(spark, [("a", T0), ("a", T0 + timedelta(minutes=5)), ("b", T0)], "k string, ts timestamp", src, "d=1")
    stream = sinks.read_files(spark, f"{src}/*").drop("d")
    assert sinks.run_append(transforms.dedup(stream, ["k"], "ts"), str(tmp_path / "d")).count() == 2
    put(spark, [(1, T0), (2, T0)], "id bigint, committed_at timestamp", str(tmp_path / "c"), "d=1")
    put(spark, [(1, T0 + timedelta(seconds=90)), (2, T0 + timedelta(days=9))], "id bigint, arrived_at timestamp", str(tmp_path / "a"), "d=1")
    lag = transforms.replication_lag(sinks.read_files(spark, f"{tmp_path}/c/*").drop("d"), sinks.read_files(spark, f"{tmp_path}/a/*").drop("d"), "id", "1 DAY", salts=3)
    assert [(r.id, r.lag_seconds) for r in sinks.run_append(lag, str(tmp_path / "l")).collect()] == [(1, 90.0)]
