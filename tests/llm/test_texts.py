"""Near duplicates, toxicity, licenses and sampled segmentations."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opslens.llm import licenses, near, pieces, toxicity
from opslens.llm.queries import QUERIES

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(texts, size, percent):
    """By all pairs."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_duplicates_of_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op5_near_dedup"](spark, sf_dir)
    assert result(got) == components(texts, 3, 85)
    assert got.where("kept != (doc_id = component_id)").count() == 0


def family(n, length, edits, seed):
    """Copies of one text with some words replaced."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for i in r.sample(range(length), r.randint(0, edits)):
            words[i] = f"e{r.randint(0, 10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile", [4, 16, 256])
def test_large_groups_lose_no_link(spark, tile):
    """Many copies whose similarities lie around the limit, in one tile and in many."""
    texts = dict(enumerate(family(60, 80, 5, 1) + family(30, 12, 2, 2) + ["a b c", "A  b\tc"]))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    assert result(near.near_duplicates(df, 3, 85, 7, 36, tile=tile)) == components(texts, 3, 85)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "\x1c one"), (8, "x " * 50_000), (9, "x " * 40_000), (None, "one"), (10, "é É"), (11, "é é")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, component_id string")
    got = near.near_duplicates(df, 3, 85, 7, 36)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == len(rows)
    assert {k: v for k, v in result(got).items() if k is not None} == components({i: t for i, t in rows if i is not None}, 3, 85)
    assert got.where("doc_id IS NULL").select("n_shingles", "component_id", "kept").first() == (1, None, True)
    kept = near.keep_one(df)
    assert kept.columns == df.columns and kept.count() == sum(i is None or v[1] == i for i, v in [(i, components(dict(rows[:9] + rows[10:]), 3, 85).get(i, (0, i))) for i, _ in rows])


def test_near_duplicates_of_nothing_and_of_repeats(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near.near_duplicates(empty).count() == 0 and near.keep_one(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c")] * 3, "doc_id bigint, text string")
    assert [tuple(r) for r in near.near_duplicates(same).collect()] == [(1, 1, 1, True)] * 3


@pytest.mark.parametrize("tile", [2, 256])
def test_repeated_ids_with_other_texts(spark, tile):
    """A doc_id that stands for several texts: each row has the component of its own text, and only copies are lost."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(5, a), (5, b), (5, a), (3, a + " more"), (7, c), (7, d), (8, c + " more"), (9, d + " more"), (9, "alone x y z"), (None, a)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int").repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(df, 3, 85, 7, 36, tile=tile).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 5, True), (5, 3, False), (3, 3, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (9, 9, True), (None, None, True)], key=str)
    assert sorted(r.n for r in near.keep_one(df, size=3, percent=85, rows=7, bands=36, tile=tile).collect()) == [1, 3, 4, 5, 8, 9]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    both = r.integers(0, 2**63, 400).astype(np.uint64)
    a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, 100).astype(np.uint64)])) for _ in range(2))
    s = near.super_minhash([a, b, a[:1], a], 1024)
    assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.06
    assert (s[0] == s[3]).all() and (s != np.uint64(2**64 - 1)).all()
    # one element fills all places, in the steps of a permutation
    assert sorted((s[2] >> np.uint64(40)).tolist()) == list(range(1024))


def test_intersections():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 50, 200, 290)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert near.common(sets, sets, columns=64).tolist() == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 4), *[(100, i) for i in range(101, 160)], *[(i, i + 1) for i in range(200, 260)]]
    got = {r.doc_id: r.component for r in near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4, 20)}, **{i: 7 for i in (7, 8, 9)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 261)}}


# ---- toxicity ------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    """Over the larger table: labels of a fifth are never learnt, and there the classifier finds most of what is toxic."""
    sf_dir = "/root/testdata/sf0.1"
    scores = QUERIES["op8_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in scores.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] > 0.85 * (counts[1, 1] + counts[1, 0])
    assert counts.get((0, 1), 0) < 0.01 * counts[0, 0]


def test_toxicity_of_the_table(spark, sf_dir):
    ids = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    rows = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_labels_of_held_out_documents_change_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(5), turned)
    assert (a.buckets == b.buckets).all() and np.allclose(a.weights, b.weights, atol=1e-9) and a.intercept == pytest.approx(b.intercept)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("bad idiot " if i % 2 else "good day ") * 5, 0.1) for i in range(200)] + [(None, None, 0.2), (500, "", 0.3), (501, "idiot " * 100_000, 0.4)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0), (1, 1), (None, 1), (7, None), (9, 5), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 203
    by_id = {r.doc_id: r.score for r in got.collect()}
    assert all((by_id[i] > 0.5) == (i % 2 == 1) for i in range(200)) and by_id[501] > 0.5 and by_id[None] == by_id[500]
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.train(docs.limit(0), labels).intercept == 0


# ---- licenses ------------------------------------------------------------------------------------------------------

LINES = {
    "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def test_licenses_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    want = Counter((r.doc_id, name) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for name, line in LINES.items() for x in r.text.split("\n") if x == line)
    got = Counter((r.doc_id, r.license) for r in QUERIES["op9_license_scan"](spark, sf_dir).where("confirmed").collect())
    assert len(want) > 100 and got == want


def test_licenses_by_wording(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    texts = {
        1: "code\n" + mit + "\nmore words here", 2: mit.replace("free of charge", "for a fee"), 3: "This work is licensed under the GNU General Public License, version 2.", 4: "we talk of licenses and redistribution now",
        5: None, 6: "", 7: "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", 8: "z" * 200_000 + "\n" + LINES["MIT"], 9: f"{LINES['MIT']}\nnothing of the kind xyz\n{LINES['Apache-2.0']}",
    }
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()] + [(None, LINES["MIT"], "x")], "doc_id bigint, text string, license string")
    rows = licenses.scan(df).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.license, r.confirmed))
        assert (texts.get(r.doc_id) or LINES["MIT"])[r.start : r.start + r.length] == r.text
    assert found[1] == [("MIT", True)] and found[3] == [("GPL-2.0", True)] and found[7] == [("Apache-2.0", True)] and found[8] == [("MIT", True)] and found[None] == [("MIT", True)]
    assert found[9] == [("MIT", True), ("Apache-2.0", True)] and not found[5] and not found[6] and not any(c for _, c in found[4])
    changed = next(r for r in rows if r.doc_id == 2)
    assert changed.license == "MIT" and not changed.confirmed and {"-free", "-charge", "+fee"} <= set(changed.differences)
    assert licenses.scan(df.limit(0)).count() == 0


def confirmed(spark, texts):
    """Confirmed licenses of each text, in order."""
    found = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id", "block").collect():
        assert texts[r.doc_id][r.start : r.start + r.length] == r.text
        found[r.doc_id] += [r.license] * r.confirmed
    return [found[i] for i in range(len(texts))]


def test_licenses_inside_lines(spark):
    """Behind a copyright phrase, in the middle of one long line, broken over comment lines, as an SPDX line."""
    prose = "the quick brown fox jumps over a lazy dog and reads " * 300
    texts = [
        "Copyright (c) 2020 Jane Doe. Released under the MIT License.", f"{prose}{LINES['GPL-3.0']} {prose}", prose + licenses.TEMPLATES["MIT"][2] + " " + prose, "# Licensed under the Apache\n# License, Version 2.0.\nimport os",
        "/* SPDX-License-Identifier: MIT */", f"{prose}{LINES['MIT']} {prose}{LINES['Apache-2.0']}",
    ]
    assert confirmed(spark, texts) == [["MIT"], ["GPL-3.0"], ["MIT"], ["Apache-2.0"], ["MIT"], ["MIT", "Apache-2.0"]]
    other = licenses.scan(spark.createDataFrame([(1, f"{prose}Licensed under CC BY 3.0. {prose}")], "doc_id bigint, text string")).first()
    assert (other.license, other.confirmed, other.differences) == ("CC-BY-4.0", False, ["-4.0"]) and other.text == "Licensed under CC BY 3.0."


def test_licenses_next_to_each_other(spark):
    """Every notice is a row: on adjacent lines, the same one twice, on one line, in an SPDX expression, and beside one that differs."""
    texts = [
        f"{LINES['MIT']}\n{LINES['Apache-2.0']}", f"{LINES['MIT']}\n{LINES['MIT']}\n", " ".join(LINES.values()), "// SPDX-License-Identifier: (MIT OR GPL-2.0-or-later WITH Classpath-exception-2.0) AND Apache-2.0\nimport os",
        "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: Foo-1.0 OR MIT",
    ]
    assert confirmed(spark, texts) == [["MIT", "Apache-2.0"], ["MIT", "MIT"], list(LINES), ["MIT", "GPL-2.0", "Apache-2.0"], ["MIT", "Apache-2.0"], ["MIT"]]
    mixed = f"Licensed under CC BY 3.0.\n{LINES['MIT']}\nLicensed under CC BY 2.0."
    rows = licenses.scan(spark.createDataFrame([(1, mixed)], "doc_id bigint, text string")).orderBy("block").collect()
    assert [(r.license, r.confirmed) for r in rows] == [("CC-BY-4.0", False), ("MIT", True), ("CC-BY-4.0", False)]


def test_licenses_of_a_family_and_denied(spark):
    """BSD licenses are told apart by their third clause; a word in between or a denial right before is not confirmed."""
    two = licenses.TEMPLATES["BSD-2-Clause"][1] + " THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
    clause = " Neither the name of the Example Company, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    cut = two.index(" THIS SOFTWARE")
    three = two[:cut] + " 3." + clause + two[cut:]
    plain = three.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    four = two[:cut] + " 3. All advertising materials must display the following acknowledgement." + clause.replace(" Neither", " 4. Neither") + two[cut:]
    denied = ["This work is not licensed under the GNU General Public License, version 3.", "It is not licensed under the Apache License, Version 2.0.", "No longer released under the MIT License."]
    texts = [two, three, plain, four, two[: two.index(" 1.")], "Why not? " + LINES["MIT"], *denied]
    assert confirmed(spark, texts) == [["BSD-2-Clause"], ["BSD-3-Clause"], ["BSD-3-Clause"], [], [], ["MIT"], [], [], []]
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(denied)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r.license, r.differences) for r in rows] == [("GPL-3.0", ["+not"]), ("Apache-2.0", ["+not"]), ("MIT", ["+no"])]


def test_each_license_template_finds_itself(spark):
    filled = [(name, t.replace("{}", "Jane Doe")) for name, ts in licenses.TEMPLATES.items() for t in ts]
    assert confirmed(spark, [t for _, t in filled]) == [[name] for name, _ in filled]


# ---- segmentations -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


@pytest.fixture(scope="module")
def names():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def all_ways(text, model, names):
    """Every segmentation of a short text with its probability."""
    weight = {names.id_to_piece(int(t)).replace("▁", " "): float(w) for t, w in zip(model.tokens[: len(model.weights) - 256], model.weights)}
    text = " " + text

    def ways(i):
        if i == len(text):
            yield (), 0.0
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in weight:
                for rest, w in ways(j):
                    yield (text[i:j], *rest), w + weight[text[i:j]]

    found = dict(ways(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: math.exp(v - total) for k, v in found.items()}


@pytest.mark.parametrize("text", ["the", "ab at"])
def test_samples_without_replacement(text, model, names):
    truth, n = all_ways(text, model, names), 30_000
    rows = model.sample(pa.array([text] * n), near.mix(np.arange(n, dtype=np.uint64)), 3)
    named = [[tuple(names.id_to_piece(int(i)).replace("▁", " ") for i in ids) for ids, *_ in row] for row in rows]
    for row, ways in zip(rows[:3000], named):
        assert len(set(ways)) == 3 and row[0][2] > row[1][2] > row[2][2]
        assert all(abs(math.log(truth[w]) - p) < 1e-9 and i <= 0 for w, (_, p, _, i) in zip(ways, row))
    first, pairs = Counter(w[0] for w in named), Counter(tuple(w[:2]) for w in named)
    for way, p in truth.items():
        assert abs(first[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    for (a, b), c in pairs.most_common(5):
        p = truth[a] * truth[b] / (1 - truth[a])
        assert abs(c / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    # each segmentation weighed by its inclusion: the weights estimate 1
    assert np.mean([sum(math.exp(p - i) for _, p, _, i in row) for row in rows]) == pytest.approx(1, abs=0.02)


def test_segmentations_of_the_table_decode_to_the_text(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op4_sample_pieces"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r["sample"]) for r in rows) == sorted((i, s) for i in texts for s in (1, 2))
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_segmentations_of_odd_rows(spark, names):
    texts = [(1, ""), (2, None), (3, "  x\n\n y "), (4, "\n"), (5, "▁a ▁"), (6, "été\tℌ\U0001f600"), (7, "a" * 5000), (8, "word " * 20_000), (None, "the"), (9, "the"), (9, "the")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id bigint, text string, ids string")
    out = pieces.sample_pieces(df, MODEL, samples=3).cache()
    back = pieces.decode_pieces(out, MODEL).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t in texts}
    per = Counter(r.doc_id for r in back)
    assert per == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 3, 7: 3, 8: 3, None: 3, 9: 6}
    again = pieces.sample_pieces(df.repartition(4), MODEL, samples=3)
    assert out.exceptAll(again).count() == 0
    assert pieces.sample_pieces(df, MODEL, samples=3, seed=1).exceptAll(out).count() > 0
    assert pieces.sample_pieces(df.limit(0), MODEL).count() == 0
    assert [r.text for r in pieces.decode_pieces(spark.createDataFrame([(None,)], "ids binary"), MODEL).collect()] == [None]


def test_decoding_agrees_with_the_library(model, names):
    for text in ("Hello  world", " x", "été 123, ok?"):
        ids = names.encode(text)
        assert model.decode(np.array(ids, np.uint32)) == names.decode(ids) == text


def test_winners_of_compression_are_confirmed_by_wording(spark):
    """No template stands word by word in these, so the blocks are cut around markers; allowed variations are confirmed, all others not."""
    bsd = licenses.TEMPLATES["BSD-2-Clause"][1]
    good = {"MIT": "Released under the MIT Licence.", "Apache-2.0": "Licensed under the Apache Licence, Version 2.0.", "BSD-2-Clause": bsd.replace("THIS SOFTWARE", "THE SOFTWARE"), "GPL-2.0": "This file is licensed under the GNU General Public License, version 2."}
    m = licenses.matcher(tuple((n, tuple(t)) for n, t in licenses.TEMPLATES.items()), tuple((n, tuple(v)) for n, v in licenses.VARIATIONS.items()))
    for text in good.values():
        words = [w.group().lower() for w in m.word.finditer(text)]
        assert not m._whole(words)
    prose = "Some other words stand before. {} And others behind it, of no meaning."
    assert confirmed(spark, list(good.values())) == confirmed(spark, [prose.format(t) for t in good.values()]) == [[n] for n in good]
    bad = [licenses.TEMPLATES["MIT"][2].replace("this software and", "this softwares and"), "Released over the MIT Licence.", "Licensed under the Apache Licence, Version 1.1.", bsd.replace("source code", "object code")]
    assert confirmed(spark, bad) == [[] for _ in bad]


def test_denials_of_a_clause(spark):
    said = ["Do not assume this is Released under the MIT License.", "It does not cost anything. Released under the MIT License.", "No fee, released under the MIT License."]
    assert confirmed(spark, said) == [[], ["MIT"], ["MIT"]]


def test_templates_of_ones_own(spark):
    """The filter follows from the templates, also where they have none of the usual words."""
    own = {"Own-1": ("Use it as you please, for any purpose, at your own risk.",)}
    df = spark.createDataFrame([(1, "Hello. Use it as you please, for any purpose, at your own risk. Bye."), (2, "Use it as you like."), (3, None), (4, "For any purpose.")], "doc_id bigint, text string")
    rows = {r.doc_id: (r.license, r.confirmed) for r in licenses.scan(df, templates=own, variations={}).collect()}
    assert rows[1] == ("Own-1", True) and 2 not in rows and rows.get(4, (None, False))[1] is False


@pytest.mark.parametrize("alpha", [0.3, 3.0, 8.0])
def test_all_segmentations_come_out_at_any_weights(spark, alpha):
    """Also those that are all but impossible: 64 of them, each once."""
    rows = pieces.sample_pieces(spark.createDataFrame([(1, "the cat")], "doc_id bigint, text string"), MODEL, samples=3000, alpha=alpha, decode=True).collect()
    assert len(rows) == 64 and len({bytes(r.ids) for r in rows}) == 64 and {r.decoded for r in rows} == {"the cat"}
    assert {r.log_inclusion for r in rows} == {0.0} and sum(float(np.exp(r.log_prob)) for r in rows) == pytest.approx(1)
    scores = [r.score for r in sorted(rows, key=lambda r: r["sample"])]
    assert scores == sorted(scores, reverse=True)
