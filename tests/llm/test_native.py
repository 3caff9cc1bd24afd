"""Sharding and exact dedup against brute force, and their edge cases."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from opslens.llm import exact, shards
from opslens.llm.queries import CHECKS, QUERIES
from opslens.plans.check import compare, duck

DOCS = "doc_id bigint, text string, extra string"


def test_shards_of_the_table(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op2_shards"](spark, sf_dir).collect()}
    total, start, slots = sum(len(t.encode()) + 8 for t in docs.values()), 0, defaultdict(int)
    for i in sorted(docs):
        size = len(docs[i].encode()) + 8
        shard = start * 24 // total
        assert (got[i].size, got[i].text_crc32, got[i].shard, got[i].slot, got[i].start, got[i].law, got[i].grown_shard) == (size, zlib.crc32(docs[i].encode()), shard, slots[shard], start, "bytes", None)
        start, slots[shard] = start + size, slots[shard] + 1
    assert len(got) == len(docs)


@pytest.mark.parametrize("ranges", [1, 7])
def test_shards_of_odd_rows(spark, ranges):
    rows = [(None, 5, "n"), (3, 0, "z"), (3, 0, "z"), (2, None, "m"), (1, 1000, "big"), (4, -7, "neg"), (5, 10, "e")]
    df = spark.createDataFrame(rows, "id bigint, size bigint, slot string")  # slot is a name of the result
    got = shards.assign(df, "size", ["id"], 3, ranges).collect()
    assert sorted((r.start for r in got)) == [0, 5, 1005, 1005, 1005, 1005, 1005]
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert got[0].__fields__ == ["id", "size", "shard", "slot", "start"]


def test_shards_of_nothing_and_of_no_bytes(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "id bigint, size bigint")
    assert [(r.shard, r.slot) for r in shards.assign(df, "size", ["id"], 4, 2).orderBy("id").collect()] == [(0, 0), (0, 1)]
    assert shards.assign(df.limit(0), "size", ["id"], 4, 2).count() == 0


def test_one_size_for_a_third_of_the_rows(spark):
    df = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS id", "1 AS size")
    got = shards.assign(df, "size", ["id"], 10, 8)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {30}
    assert got.select("start").distinct().count() == 300


def test_written_shards(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "repeat('x', cast(id AS INT)) AS text", "id + 8 AS size")
    shards.write_shards(df, str(tmp_path / "s"), "size", ["id"], 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 5 and back.where("length(text) != id").count() == 0


def test_exact_dedup_against_sql(spark, sf_dir):
    ok, text = compare(spark, duck(sf_dir), sf_dir, QUERIES["op10_exact_dedup"], CHECKS["op10_exact_dedup"])
    assert ok, text


ROWS = [(1, "Ab", "x"), (2, "aB", "y"), (3, None, "z"), (4, "", "z"), (5, "É", "z"), (6, "é", "z"), (None, "ab", "z"), (7, "u", "p"), (7, "u", "q"), (8, "v" * 300_000, "z"), (9, "V" * 300_000, "z")]


def wanted():
    groups = defaultdict(list)
    lower = {ord(a): ord(b) for a, b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    for i, t, _ in ROWS:
        groups[(t or "").translate(lower)].append(i)
    key = lambda i: -1 if i is None else i
    return sorted((key(i), max(map(key, ids)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)


def sorted_rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.encode(F.lit("same"), "UTF-8"), lambda t: F.encode(F.substring(t, 1, 1), "UTF-8")])
def test_full_bytes_decide(spark, digest):
    """Also with a digest that says nothing, or little."""
    df = spark.createDataFrame(ROWS, DOCS).repartition(3)
    got = exact.dedup(df, digest=digest)
    assert sorted_rows(got) == wanted()
    assert got.where("kept").count() == len({w[3] for w in wanted()})


def test_dedup_in_several_batches(spark):
    df = spark.createDataFrame(ROWS, DOCS).repartition(5)
    assert sorted_rows(exact.dedup(df, files_per_batch=1)) == wanted()


def test_the_stream_goes_on_with_what_comes_later(spark, tmp_path):
    schema = spark.createDataFrame([], "doc_id bigint, digest binary, locator string").schema
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    for rows in ([(1, b"a", "x"), (2, b"b", "x")], [(3, b"a", "x")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        groups = exact.stream_groups(spark, source, schema, folder)
    assert {(bytes(r.digest), r.keeper.doc_id, r.n) for r in groups.collect()} == {(b"a", 3, 2), (b"b", 2, 1)}


def test_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact.dedup(empty).count() == 0 and exact.keep_unique(empty).count() == 0


def test_kept_rows_have_all_columns(spark, tmp_path):
    spark.createDataFrame([(i, t, e) for i, t, e in ROWS], "doc_id bigint, text string, locator string").repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = exact.keep_unique(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7, 9]


def test_kept_rows_behind_a_shuffle_and_a_join(spark, tmp_path):
    """Rows that no file holds, or that a join has made of one row of a file, have no place of their own."""
    made = spark.range(1000).selectExpr("id + 1000 AS doc_id", "concat('t', id % 500) AS text").groupBy("text", "doc_id").agg(F.max("doc_id").alias("m")).repartition(3)
    kept = exact.keep_unique(made).collect()
    assert sorted(r.doc_id for r in kept) == list(range(1500, 2000)) and len({r.text for r in kept}) == 500

    spark.createDataFrame([(1, "a"), (2, "A")], "doc_id bigint, text string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    twice = files.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    assert [r.doc_id for r in exact.keep_unique(twice).collect()] == [2]
    assert exact.dedup(twice).where("kept").count() == 1


def test_columns_of_any_name(spark, tmp_path):
    odd = "doc_id bigint, text string, `a.b` string, __locator string, `_metadata` string, locator string, digest string, hit string, n string, keeper string"
    spark.createDataFrame([(1, "x", *"12345678"), (2, "X", *"12345678"), (3, None, *"12345678")], odd).write.parquet(str(tmp_path / "o"))
    for docs in (spark.read.parquet(str(tmp_path / "o")), spark.createDataFrame([(1, "x", *"12345678"), (2, "X", *"12345678"), (3, None, *"12345678")], odd)):
        kept = exact.keep_unique(docs)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r["a.b"], r["__locator"]) for r in kept.collect()) == [(2, "1", "2"), (3, "1", "2")]
    sized = spark.createDataFrame([(1, 5, "z"), (2, 7, None)], "`i.d` bigint, `s.z` bigint, `x.y` string")
    assert [(r["i.d"], r["x.y"], r.start) for r in shards.assign(sized, "s.z", ["i.d"], 2, 2).orderBy("slot", "shard").collect()] == [(1, "z", 0), (2, None, 5)]
