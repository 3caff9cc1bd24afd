"""Vector codes, filter audit and URL filter against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import audit, codes, urls
from opslens.llm.common import looked_up, prepared
from opslens.llm.queries import CHECKS, QUERIES
from opslens.plans.check import compare, duck


@pytest.fixture(autouse=True)
def _settings(spark):
    prepared(spark)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_filter_audit"])
def test_against_sql(spark, sf_dir, name):
    ok, text = compare(spark, duck(sf_dir), sf_dir, QUERIES[name], CHECKS[name])
    assert ok, text


# vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label), all usable, in order of (id, vector)."""
    v = np.array([[int(np.floor(x * 1024)) for x in r[1]] for r in rows], dtype=object)
    pieces = np.split(v, parts, axis=1)
    books = [p[:entries].copy() for p in pieces]

    def nearest(p, book):
        return [min(range(len(book)), key=lambda e: (sum((x - book[e]) ** 2), e)) for x in p]

    for _ in range(rounds):
        for p, book in zip(pieces, books, strict=True):
            to = nearest(p, book)
            for e in set(to):
                mine = [x for x, t in zip(p, to, strict=True) if t == e]
                book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    to = [nearest(p, b) for p, b in zip(pieces, books, strict=True)]
    error = [sum(int(sum((p[i] - b[t[i]]) ** 2)) for p, b, t in zip(pieces, books, to, strict=True)) for i in range(len(rows))]
    by_label = defaultdict(int)
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], bytes(t[i] for t in to).hex(), error[i], by_label[r[2]], digest) for i, r in enumerate(rows))


SCHEMA = "vec_id bigint, embedding array<float>, label int, code string"


def some_vectors(kind, n=300, dim=8):
    rnd = random.Random(kind)
    if kind == "grid":  # many ties, many equal parts and entries
        return [[rnd.choice([-1.0, 0.0, 1.0]) / 512 for _ in range(dim)] for _ in range(n)]
    if kind == "clusters":
        centers = [[rnd.uniform(-2, 2) for _ in range(dim)] for _ in range(6)]
        return [[c + rnd.gauss(0, 0.01) for c in rnd.choice(centers)] for _ in range(n)]
    if kind == "equal":
        return [[0.25, -0.5] * (dim // 2)] * n
    return [[rnd.uniform(-60_000, 60_000) for _ in range(dim)] for _ in range(n)]  # beyond exact doubles


@pytest.mark.parametrize("kind", ["grid", "clusters", "equal", "far"])
def test_codes_by_brute_force(spark, kind):
    vectors = [[float(np.float32(x)) for x in v] for v in some_vectors(kind)]
    rows = [(i * 3 - 40, v, None if i % 3 else i % 7) for i, v in enumerate(vectors)]
    rows += [rows[5], rows[5], (rows[7][0], rows[9][1], 1)]  # repeated rows, a repeated id
    bad = [(1, None, 1), (2, [], 1), (3, [None] * 8, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] * 8, 1), (6, [1.0], 1)]
    shuffled = [(*r, "own") for r in rows + bad]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, SCHEMA).repartition(3)
    got = codes.vector_codes(df, entries=16).drop("label").collect()
    assert Counter(tuple(r) for r in got) == brute_codes(sorted(rows, key=lambda r: (r[0], r[1])), entries=16)


def test_codes_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert codes.vector_codes(none).count() == 0
    assert codes.vector_codes(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).count() == 0
    one = codes.vector_codes(spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], None, "")], SCHEMA)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(None, "00000000", 0, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        codes.vector_codes(spark.createDataFrame([(1, [1.0], 1, "")], SCHEMA))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.sampled_from([1, 3, 200]))
def test_trees_own_what_they_say(seed, n, spread):
    rnd = np.random.default_rng(seed)
    points = rnd.integers(-spread, spread + 1, (n, 3))
    tree = codes.grow(points)
    assert sorted(tree.rows.tolist()) == list(range(n)) and (tree.points == points[tree.rows]).all()
    for (a, b), radius, sums, links in zip(tree.spans, tree.radii, tree.sums, tree.links, strict=True):
        assert (tree.points[a:b].sum(axis=0) == sums).all()
        assert codes.lengths_of(tree.points[a:b] - sums / (b - a)).max() <= radius * (1 + 1e-12) + 1e-12
        if links[0] >= 0:
            assert [tree.spans[links[0]][0], tree.spans[links[0]][1], tree.spans[links[1]][1]] == [a, tree.spans[links[1]][0], b]
    book = rnd.integers(-spread, spread + 1, (9, 3))
    found, sums, counts = codes.assign(tree, codes.Book(book))
    apart = ((tree.points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (found == apart.argmin(axis=1)).all()
    for e in range(9):
        assert counts[e] == (found == e).sum() and (sums[e] == tree.points[found == e].sum(axis=0)).all()


def test_balls_are_owned_without_looking_at_points():
    rnd = np.random.default_rng(5)
    points = np.concatenate([rnd.integers(0, 50, (500, 4)) + c for c in (0, 10_000, 20_000)])
    seen = []

    class Watched(codes.Book):
        def nearest(self, points, among):
            seen.append(len(points))
            return super().nearest(points, among)

    codes.assign(codes.grow(points), Watched(np.array([[25] * 4, [10_025] * 4, [20_025] * 4])))
    assert not seen


def test_looked_up_spreads_hot_keys(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 2, i, "s") for i in range(90)], "k int, i int, __salt string")
    values = spark.createDataFrame([(None, "null"), (1, "one"), (5, "five")], "k int, v string")
    got = looked_up(rows.withColumnRenamed("__salt", "own"), values, "k", rows["i"]).collect()
    assert Counter((r.k, r.i, r.v) for r in got) == Counter((k, i, {None: "null", 1: "one"}.get(k)) for k, i in ((None if i % 3 == 0 else i % 2, i) for i in range(90)))


# filter audit


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40)), min_size=1, max_size=5))
def test_merges_by_sets(sets):
    lists = [sorted(s) for s in sets]
    assert audit.union_size(lists) == len(set().union(*sets))
    assert audit.difference(lists[0], lists[1:]) == sorted(sets[0].difference(*sets[1:]))
    for x in range(42):
        for i in range(len(lists[0])):
            assert audit.gallop(lists[0], x, i) == max(i, sum(y < x for y in lists[0]))


def brute_audit(rows, n, letters="ABCDE"):
    """rows: (part, fails, good, toxic)."""
    out, parts = set(), defaultdict(list)
    for r in rows:
        parts[r[0] or ""].append(r)
    for part, docs in parts.items():
        shapley, lines = Counter(), []
        for order in permutations(range(n)):
            gone = [False] * len(docs)
            for step, f in enumerate(order):
                fails = [bool(d[1][f]) for d in docs]
                removed = [i for i in range(len(docs)) if fails[i] and not gone[i]]
                redundant = sum(fails) - len(removed)
                for i in removed:
                    gone[i] = True
                shapley[f] += len(removed)
                unique = sum(bool(d[1][f]) and sum(map(bool, d[1])) == 1 for d in docs)
                lines.append((f, part, "".join(letters[x] for x in order), step + 1, gone.count(False), len(removed), redundant, unique, sum(bool(docs[i][2]) for i in removed), sum(bool(docs[i][3]) for i in removed)))
        out |= {(*x[1:], shapley[x[0]]) for x in lines}
    return out


@pytest.mark.parametrize("n", [1, 3, 5])
def test_interactions_by_brute_force(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice(["a", "b", None, "hot", "hot", "hot"]), rnd.choice([None, *range(30)]), *[rnd.choice([None, True, False]) for _ in range(7)], "x") for _ in range(400)]
    df = spark.createDataFrame(rows, "p string, id int, f0 boolean, f1 boolean, f2 boolean, f3 boolean, f4 boolean, good boolean, toxic boolean, part string").repartition(4)
    got = audit.interactions(df, "p", "id", {x: f"f{i}" for i, x in enumerate("ABCDE"[:n])}, ["good", "toxic"])
    assert {tuple(r) for r in got.collect()} == brute_audit([(r[0], r[2 : 2 + n], r[7], r[8]) for r in rows], n)
    assert got.count() == 4 * factorial(n) * n
    assert audit.interactions(df.limit(0), "p", "id", {"A": "f0"}, ["good"]).count() == 0


def test_flags_of_odd_texts(spark):
    docs = spark.createDataFrame(
        [
            (1, None, None, 7), (2, "", "s", 7), (2, "", "s", 7), (None, "", "s", 7), (3, "word " * 50, "s", 7), (4, "\u00a0".join("abc"), "s", 7), (5, "A" * 1 + "b" * 19, "s", 7),
            (6, "A" * 1 + "b" * 18, "s", 7), (7, "ok #", "s", 7), (8, " ".join(f"w{i}" for i in range(50)), "s", 7), (9, "word " * 50, "t", 7), (10, "w1 \x0b W1\x1cx", "t", 7), (11, "xy " * 400_000, "t", 7),
        ],
        "doc_id bigint, text string, source string, part int",
    )
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (8, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {(r.doc_id, r.part): "".join(x for x in "abcde" if r[x]) + ("+" if r.good else "") + ("!" if r.toxic else "") for r in audit.judged(docs, labels).collect()}
    assert got == {
        (1, None): "a+!", (2, "s"): "ae", (None, "s"): "a", (3, "s"): "b", (4, "s"): "a", (5, "s"): "a", (6, "s"): "ac", (7, "s"): "ad", (8, "s"): "+", (9, "t"): "be", (10, "t"): "ac", (11, "t"): "b",
    }
    assert audit.judged(docs.limit(0), labels).count() == 0


# URL filter


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path_end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:path_end] if end < path_end else ""


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)


def test_urls_of_the_table(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op13_url_filter"](spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for i, url in pages.items():
        host, path = parse(url)
        rule = rule_of(host, path, urls.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1] + rule[2])
        bad = any(s in host for s in ("casino", "pills", "bets", "spam", "adult", "ads-"))
        assert got[i].verdict == (rule[0] if rule else "block" if bad else "allow"), url


ODD = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/en/1?x", "http://a://b/c", "http://org/", "http://xorg/", "http://a.ORG", "http://a.org?q=/", "x://sub.example.org/es/#f", "http://example.org:80/es/",
    "http://É.com/de/", "http://example.org/en/1234/x?y", "http://a.com/fr", "http://" + "a" * 100 + ".net/" + "b/" * 50_000, "http://a.com/de/?u=http://b.org/", "http://x.net#://y.org/", "http://a.com/x\ny",
]


def test_odd_urls(spark):
    rows = [(i, u, None, "own") for i, u in enumerate(ODD)] + [(None, "http://a.com/de/", "<p>x", "own")] * 2
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path = parse(ODD[r.page_id])
            rule = rule_of(host, path, urls.RULES)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[1] + rule[2], rule[0] if rule else "allow"), ODD[r.page_id]
        else:
            assert (r.rule, r.verdict) == ("com/de/", "block")
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def brute_split(run, counts, total):
    best = None
    for cut in range(1 << (len(run) - 1)):
        words, word = [], run[0]
        for i, c in enumerate(run[1:]):
            if cut >> i & 1:
                words.append(word)
                word = ""
            word += c
        words.append(word)
        score = round(sum(log(counts[w] / total) if counts.get(w) and len(w) > 1 else log(1 / total) - (len(w) - 1) * log(10) for w in words), 7)
        key = (score, -len(words), [len(w) for w in words])
        best = max(best, (key, words)) if best else (key, words)
    return best[1]


def test_splits_by_brute_force(spark):
    rnd = random.Random(3)
    counts = {"".join(rnd.choice("ab") for _ in range(rnd.randint(2, 4))): rnd.randint(1, 1000) for _ in range(20)} | {"casino": 50, "win": 900, "cas": 20, "in": 5000, "ow": 3}
    total = sum(counts.values())
    runs = ["casinowin", "casinowinxq", "a", "zzz"] + ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 10))) for _ in range(60)]
    hosts = spark.createDataFrame([(f"www9.{r}-{r}x.co",) for r in set(runs)] + [("",), ("1.2.3.4",), ("y" * 70,)], "host string")
    got = {r.host: r.words for r in urls.segmented(hosts, spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()}
    for r in set(runs):
        assert got[f"www9.{r}-{r}x.co"] == [w for run in ("www", r, r + "x", "co") for w in brute_split(run, counts, total)]
    assert got["y" * 70] == ["y" * 70] and "" not in got


def test_learnt_words_block_other_hosts(spark):
    good = ["garden", "kitchen", "news", "music", "travel", "school", "books", "river"]
    text = " ".join(good * 30 + ["lucky", "jackpot"] * 10)
    train = [f"http://{a}{b}.net/en/page" for a in good for b in good if a != b]
    train += [f"http://{a}casino.net/en/play" for a in ("lucky", "jackpot", "mega")] + [f"http://{a}-{b}.net/en/play" for a in ("lucky", "jackpot") for b in ("poker", "bets")]
    asked = {"http://luckyjackpot.net/en/": "block", "http://jackpotcasino.net/": "block", "http://gardenriver.net/en/": "allow", "http://newsbooks.net/": "allow"}
    rows = [(i, u, text) for i, u in enumerate(train + list(asked))]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[len(train)].words == ["lucky", "jackpot", "net"]
    assert {u: got[len(train) + i].verdict for i, u in enumerate(asked)} == asked
    assert all(got[i].verdict == ("block" if i >= len(good) * (len(good) - 1) else "allow") for i in range(len(train)))


def test_scores_by_brute_force(spark):
    rows = [(0, "http://casino.a.net/x/1", ""), (1, "http://b.a.net/x/y", ""), (2, "http://b.a.net/x/2", ""), (3, "http://c.a.net/", "")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    tokens = {i: (r.words, ["/" + ("#" if t.isdigit() else t) for t in r.path.split("/") if t]) for i, r in got.items()}
    hosts = {r.host: ("casino" in r.words, r.words) for r in got.values()}
    s, want = urls.SMOOTHING, {}
    counts = [{c: Counter() for c in (True, False)} for _ in range(2)]
    for label, words in hosts.values():
        counts[0][label].update(words)
    for i, (words, path) in tokens.items():
        counts[1][hosts[got[i].host][0]].update(path)
    for i, pair in tokens.items():
        want[i] = log((1 + s) / (2 + s))
        for kind, ts in zip(counts, pair, strict=True):
            size = len(kind[True] | kind[False])
            want[i] += sum(log((kind[True][t] + s) / (kind[True].total() + s * size)) - log((kind[False][t] + s) / (kind[False].total() + s * size)) for t in ts)
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, abs=1e-5)


def test_visible_words(spark):
    html = "<html><style>hidden{}</style><SCRIPT>var hidden</script ><!-- hidden --><p class='hidden'>Seen seen <b>x</b>été</p>"
    got = {r.word: r.n for r in urls.word_counts(spark.createDataFrame([("http://un-split.name.co/path-word?q=term", html), (None, None)], "url string, html string")).collect()}
    assert got == {"seen": 2, "été": 1, "un": 1, "split": 1, "path": 1, "word": 1, "term": 1}
