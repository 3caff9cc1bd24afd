"""Hot and cold folders under a manifest: nothing is lost or doubled, wherever a run dies."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.sources import tables
from opslens.sources.tiered import COLD, HOT, Conflict, TieredTable

NOW = datetime(2024, 6, 1, 12)
STEPS = ["folders written", "folders compared", "before commit", "after commit"]


class Died(Exception):
    pass


def rows(spark, start=0, n=200):
    """A row every twelve hours back from NOW, and one without a time."""
    return spark.range(start, start + n).selectExpr("id", "CASE WHEN id % 50 = 49 THEN NULL ELSE timestampadd(HOUR, -12 * id, TIMESTAMP '2024-06-01 12:00:00') END AS ts", "concat('v', id) AS v")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def cold_ids(n=200, days=90):
    return [i for i in range(n) if i % 50 != 49 and timedelta(hours=12 * i) > timedelta(days=days)]


def test_append_and_archive(spark, tmp_path):
    t = TieredTable(spark, str(tmp_path), "orders", "ts", "p", "b")
    assert t.read().count() == 0 and t.merge() == 0
    assert t.append(rows(spark), "b1") == 200 and t.append(rows(spark), "b1") == 0
    run = t.archive(NOW, 90)
    assert (run["rows_archived"], run["status"]) == (len(cold_ids()), "success") and run["bytes_reclaimed"] > 0
    assert ids(t.read(COLD)) == cold_ids() and ids(t.read()) == list(range(200))
    before = t.manifest()
    assert t.archive(NOW, 90) == run and t.manifest() == before
    assert t.archive(NOW - timedelta(days=400), 90)["status"] == "no_cold_data"


def test_only_the_day_of_the_limit_is_read(spark, tmp_path):
    t = TieredTable(spark, str(tmp_path), "orders", "ts")
    t.append(rows(spark), "b1")
    before = {f["path"] for f in t.manifest()["folders"]}
    t.archive(NOW, 90)
    new = [f for f in t.manifest()["folders"] if f["path"] not in before]
    assert {f["day"] for f in new} == {"2024-03-03"} and {f["tier"] for f in new} == {HOT, COLD}


@pytest.mark.parametrize("step", STEPS)
def test_a_run_that_dies_leaves_either_state_whole(spark, tmp_path, step):
    base = str(tmp_path)
    TieredTable(spark, base, "orders", "ts").append(rows(spark), "b1")

    def die(at):
        if at == step:
            raise Died(at)

    dying = TieredTable(spark, base, "orders", "ts", on_step=die)
    with pytest.raises(Died):
        dying.append(rows(spark, 200, 10), "b2")
    with pytest.raises(Died):
        dying.archive(NOW, 90)
    t = TieredTable(spark, base, "orders", "ts")
    done = step == "after commit"
    assert ids(t.read()) == list(range(210 if done else 200))
    assert ids(t.read(COLD)) == (cold_ids(210) if done else [])
    t.append(rows(spark, 200, 10), "b2")
    assert t.archive(NOW, 90)["rows_archived"] == len(cold_ids(210))
    assert ids(t.read()) == list(range(210)) and ids(t.read(COLD)) == cold_ids(210)
    # what the dead runs left behind goes, what counts stays
    left = t.sweep(datetime.now() + timedelta(days=1))
    # the split day of the archive run, and what the dead runs wrote
    assert len(left) >= (1 if done else 2) and t.sweep(datetime.now() + timedelta(days=1)) == []
    assert ids(t.read()) == list(range(210))


def test_a_manifest_cut_off_does_not_count(spark, tmp_path):
    t = TieredTable(spark, str(tmp_path), "orders", "ts")
    t.append(rows(spark, 0, 10), "b1")
    (tmp_path / "manifest" / "0000000002.json").write_text('{"folders": [')
    assert ids(t.read()) == list(range(10))
    t.append(rows(spark, 10, 5), "b2")
    assert ids(t.read()) == list(range(15)) and t.manifest()["next"] == 4


def test_two_writers(spark, tmp_path):
    base = str(tmp_path)
    other, meddled = TieredTable(spark, base, "orders", "ts"), []

    def meddle(at):
        if at == "before commit" and not meddled:
            meddled.append(other.append(rows(spark, 100, 5), "other"))

    t = TieredTable(spark, base, "orders", "ts", on_step=meddle)
    assert t.append(rows(spark, 0, 5), "mine") == 5 and meddled == [5]
    assert ids(t.read()) == [*range(5), *range(100, 105)]
    stale = t.manifest()
    t.append(rows(spark, 200, 1), "more")
    with pytest.raises(Conflict):
        t._commit(stale)


def test_schema_may_grow(spark, tmp_path):
    t = TieredTable(spark, str(tmp_path), "orders", "ts")
    t.append(rows(spark, 0, 3), "a")
    t.append(rows(spark, 3, 2).withColumn("note.x", F.lit("n")), "b")
    assert [(r.id, r["note.x"]) for r in t.read().orderBy("id").collect()] == [(0, None), (1, None), (2, None), (3, "n"), (4, "n")]
    with pytest.raises(ValueError):
        t.append(rows(spark, 5, 1).withColumn("v", F.lit(1)), "c")


def test_folders_grow_with_the_logarithm_of_batches(spark, tmp_path):
    t = TieredTable(spark, str(tmp_path), "orders", "ts")
    for i in range(9):
        one_day = spark.range(i, i + 1).selectExpr("id", "TIMESTAMP '2024-05-05' AS ts")
        t.append(one_day, f"b{i}")
        t.merge(fan=3)
    assert len(t.manifest()["folders"]) <= 4 and ids(t.read()) == list(range(9))


def test_log(spark, tmp_path):
    t = TieredTable(spark, str(tmp_path / "t"), "orders", "ts", "p", "b")
    t.append(rows(spark), "b1")
    run = t.archive(NOW, 90)
    ops = str(tmp_path / "ops")
    assert (t.write_log(ops), t.write_log(ops)) == (1, 0)
    row = tables.read_ops(spark, ops, "data_archival_history").first()
    assert (row.archival_id, row.rows_archived, row.bytes_reclaimed, row.archive_table, row.archived_at) == (run["archival_id"], run["rows_archived"], run["bytes_reclaimed"], "orders_cold", NOW)
