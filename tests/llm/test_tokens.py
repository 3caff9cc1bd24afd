"""Token ids, the Huffman store and packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import huffman, packing
from opslens.llm.queries import QUERIES
from opslens.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, "Hello, world!", "x"), (2, None, "x"), (3, "", "x"), (None, "null id", "x"), (5, "same", "x"), (5, "same", "x"), (5, "other", "x"), (6, "long word. " * 9000, "x"), (7, "<|endoftext|> a<|ENDOFTEXT|>", "x")]
SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH, memo_words=50)


def whole(encoder, texts):
    return [e.ids + [2] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def parts(encoder, texts):
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_ids_are_those_of_whole_texts(encoder, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert parts(encoder, texts) == whole(encoder, texts)
    got = [ids[a:b].tolist() for _, ids, bounds in encoder.slices(pa.array(range(len(texts))), pa.array(texts)) for a, b in zip(bounds, bounds[1:])]
    assert got == whole(encoder, texts)


def test_ids_of_odd_texts(encoder):
    r = random.Random(3)
    alphabet = ".,,;:!?aAzZéÉßñÑ İıſσΣς̈́ 　\x1c\x85\t\n'’!<|>endoftextstar0123９中文\U0001f600-_ÿÞþ÷×ªº²ﬁǅ"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    texts += ["x<|endoftext|>y", "X<|ENDOFTEXT|>y", "it's I'LL don't", "a.b.C, x...y é.. 9.9.x", "ä Ä ä\n̈", "", None]
    assert parts(encoder, texts) == whole(encoder, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_ids_of_any_texts(encoder, texts):
    assert parts(encoder, texts) == whole(encoder, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=900), st.integers(6, 20))
def test_codes_go_both_ways(ids, bits):
    ids = np.array(ids, np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=41), bits)
    assert lengths.max(initial=0) <= bits and sum(2.0 ** -int(n) for n in lengths if n) <= 1
    codec = huffman.Codec(lengths)
    payload, checkpoints = codec.encode(ids, 64)
    assert (codec.decode(payload, checkpoints, len(ids), 64) == ids).all()


def test_code_lengths_are_the_shortest():
    """Against all lengths with that limit that a code can have."""
    from itertools import product

    for counts, bits in (([1, 1, 2, 3, 5, 8], 3), ([100, 1, 1, 1, 1], 3), ([7, 7, 7], 2), ([1, 2, 4, 8, 16], 4)):
        best = min(sum(c * n for c, n in zip(counts, ns)) for ns in product(range(1, bits + 1), repeat=len(counts)) if sum(2.0**-n for n in ns) <= 1)
        assert sum(c * int(n) for c, n in zip(counts, huffman.code_lengths(np.array(counts), bits))) == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_store_of_the_table(spark, sf_dir, encoder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op1_token_store"](spark, sf_dir).collect()}
    start = 0
    for r, ids in zip(docs, whole(encoder, [r.text for r in docs])):
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_store_of_odd_rows(spark, tmp_path, encoder):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    huffman.write_store(df, str(tmp_path / "s"), PATH, block_ids=4, files=4)
    rows = sorted(huffman.read_store(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 5, 5, 5, 6, 7]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    want = defaultdict(list)
    for (i, t, _), ids in zip(ODD, whole(encoder, [t for _, t, _ in ODD])):
        want[i].append(ids)
    for i in want:
        assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in rows if r.doc_id == i) == sorted(want[i])


def test_store_of_nothing(spark, tmp_path):
    huffman.write_store(spark.createDataFrame([], SCHEMA), str(tmp_path / "s"), PATH)
    assert huffman.read_store(spark, str(tmp_path / "s")).count() == 0


def slow_best_fit(lengths, capacity):
    windows, rests = [], []
    for i, n in enumerate(lengths):
        windows += [[(i, s, capacity)] for s in range(0, n - n % capacity, capacity)]
        if n % capacity:
            rests.append((n % capacity, i, n - n % capacity))
    left = {}
    for n, i, s in sorted(rests, key=lambda r: (-r[0], r[1], r[2])):
        fit = [w for w in left if left[w] >= n]
        w = min(fit, key=left.get, default=len(windows))
        if not fit:
            windows.append([])
        left[w] = left.get(w, capacity) - n
        windows[w].append((i, s, n))
    return windows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=60), st.integers(1, 33))
def test_best_fit(lengths, capacity):
    got = packing.best_fit(np.array(lengths, np.int64), capacity)
    assert sorted(sum(n for _, _, n in w) for w in got) == sorted(sum(n for _, _, n in w) for w in slow_best_fit(lengths, capacity))
    for w in got:
        assert 0 < sum(n for _, _, n in w) <= capacity
    tails = [s for w in got for s in packing.cut_tail(w, capacity)]
    for pieces in (got, tails):
        of = defaultdict(list)
        for w in pieces:
            for i, s, n in w:
                of[i].append((s, n))
        for i, n in enumerate(lengths):
            at = 0
            for s, m in sorted(of[i]):
                assert s == at and m > 0
                at += m
            assert at == n


def check_pieces(rows, want):
    """Every id in one piece, sequences without gaps and of at most 4096 ids. Returns the padding."""
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    assert {k[0] for k in of} == set(want)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 4096
    filled = [sum(r.length for r in s) for s in sequences.values()]
    return sum(4096 - f for f in filled if f & (f - 1)), sum(filled)


def test_packing_of_the_table(spark, sf_dir, encoder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], whole(encoder, [r.text for r in docs])))
    rows = QUERIES["op6_packing"](spark, sf_dir).collect()
    padding, ids = check_pieces(rows, want)
    assert padding < 0.02 * ids and ids == sum(map(len, want.values()))
    for r in rows:
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())


@pytest.mark.parametrize("docs_per_buffer", [1, 3, 1000])
def test_packing_of_odd_rows(spark, encoder, docs_per_buffer):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(2)
    rows = packing.pack(df, PATH, buffer_docs=docs_per_buffer).collect()
    check_pieces(rows, {i for i, _, _ in ODD})
    assert sum(r.length for r in rows) == sum(map(len, whole(encoder, [t for _, t, _ in ODD])))
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_packed_pieces_leave_some_at_a_time(monkeypatch):
    """The batch that leaves a task is small, however large the buffer; sequence numbers go on from buffer to buffer."""

    class Part:
        get = staticmethod(lambda: Part)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(packing, "TaskContext", Part)
    monkeypatch.setattr(packing, "OUT_IDS", 64, raising=False)
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [f"word{i} " * (i + 1) for i in range(40)]})
    out = [*packing._pack_task(PATH, 2, True, 32, 10_000, 25)(iter([docs]))]
    assert max(sum(b["length"].to_pylist()) for b in out) < 64 + 32
    rows = [r for b in out for r in b.to_pylist()]
    assert sorted({r["sequence_id"] for r in rows}) == list(range(3 << 40, (3 << 40) + len({r["sequence_id"] for r in rows})))
    whole = packing.encoder(PATH, 2, True).encode(docs["text"])
    for i in range(40):
        mine = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == i)
        assert b"".join(ids for _, ids in mine) == whole[0][whole[1][i] : whole[1][i + 1]].astype("<u4").tobytes()
