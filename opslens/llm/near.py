"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.common import looked_up, query, stored, table, tidy
from opslens.llm.tokens import slices_of

SLICE_BYTES = 4 << 20
#: Bits of the filter that says whose sets are needed.
FILTER_BITS = 1 << 26
#: Documents on a side of a tile in which all pairs are compared.
TILE = 256
SKETCH = "doc_id bigint, said binary, n_shingles bigint, digest binary, bands array<bigint>"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of `size` lower-cased words; fewer words are one run; no words, none."""
    lower = pc.ascii_lower(texts.fill_null(""))
    split = pc.ascii_split_whitespace(lower)
    coded = split.flatten().dictionary_encode()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = coded.dictionary.index("").as_py()
    words, is_word = of_word[codes], codes != empty
    bounds = split.offsets.to_numpy()
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        w = words[a:b][is_word[a:b]]
        if not len(w):
            out.append(np.zeros(0, np.uint64))
            continue
        n = min(size, len(w))
        h = np.full(len(w) - n + 1, np.uint64(n))
        for i in range(n):
            h = mix(h * GOLDEN + w[i : len(w) - n + 1 + i])
        h.sort()
        out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
    return out


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, a row of m 64-bit integers for each.

    Every element draws a random permutation of the m places, and at step j a random fraction for its j-th place; a place keeps the
    least j + fraction over the elements. As later steps only lose against earlier ones, a set is done after the first step that leaves no
    place empty: large sets after one step, a set of one element after m.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    signatures = np.full((len(sets), m), none, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = None
    for step in range(m):
        if not len(elements):
            break
        drawn = mix(elements + np.uint64((step + 1) * int(GOLDEN) & (1 << 64) - 1))
        pick = step + ((drawn >> np.uint64(40)) * np.uint64(m - step) >> np.uint64(24)).astype(np.int64)
        if step == 0:
            place, first = pick, pick
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
                rows = np.arange(len(elements))
                order[rows, first], order[:, 0] = 0, first
            place = order[rows, pick]
            order[rows, pick] = order[:, step]
        value = (np.uint64(step) << np.uint64(40)) | (drawn & np.uint64(0xFFFFFFFFFF))
        np.minimum.at(signatures.reshape(-1), owner * m + place, value)
        if step < m - 1:
            going = (signatures == none).any(axis=1)[owner]
            if not going.all():
                owner, elements = owner[going], elements[going]
                if order is None:
                    first = first[going]
                else:
                    order = order[going]
                    rows = np.arange(len(elements))
    return signatures


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` places."""
    n, m = signatures.shape
    parts = signatures.reshape(n, m // rows, rows)
    h = np.tile(np.arange(m // rows, dtype=np.uint64), (n, 1))
    for i in range(rows):
        h = mix(h * GOLDEN + parts[:, :, i])
    return h.view(np.int64)


def digest_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8", copy=False).tobytes())


def sketches(docs: DataFrame, size: int, rows: int, bands: int, key: str = "doc_id", text: str = "text", said: Column | None = None) -> DataFrame:
    """Per document: n_shingles, a digest of its set, its band keys, and `said` as it is. A document without shingles has no digest and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in slices_of(batch.column(1), SLICE_BYTES):
                sets = shingle_sets(batch.column(1).slice(a, n), size)
                full = [s for s in sets if len(s)]
                # small sets take many steps on all of their elements, so some at a time
                keys = np.concatenate([np.zeros((0, bands), np.int64), *(band_keys(super_minhash(full[i : i + 500], rows * bands), rows) for i in range(0, len(full), 500))])
                bounds = np.cumsum([0, *(bands if len(s) else 0 for s in sets)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        batch.column(2).slice(a, n),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.reshape(-1), pa.int64())),
                    ],
                    names=["doc_id", "said", "n_shingles", "digest", "bands"],
                )

    said = F.lit(None) if said is None else said
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), said.cast("binary").alias("said")).mapInArrow(tidy(run), SKETCH)


def common(sets: list[np.ndarray], others: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over some thousand elements at a time."""
    total = np.zeros((len(sets), len(others)), np.float64)
    a, b = (np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (sets, others))
    shared = np.intersect1d(a, b)
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (sets, others))
    at_a, at_b = (np.searchsorted(shared, x) for x in (a, b))
    for x, at, rows in ((a, at_a, "a"), (b, at_b, "b")):
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == x[hit]
        if rows == "a":
            rows_a, at_a = rows_a[hit], at[hit]
        else:
            rows_b, at_b = rows_b[hit], at[hit]
    for c in range(0, len(shared), columns):
        width = min(columns, len(shared) - c)
        left, right = np.zeros((len(sets), width), np.float32), np.zeros((len(others), width), np.float32)
        for m, at, rows in ((left, at_a, rows_a), (right, at_b, rows_b)):
            here = (at >= c) & (at < c + width)
            m[rows[here], at[here] - c] = 1
        total += left @ right.T
    return total


class Groups:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def tile_links(ids: list[int], sets: list[np.ndarray], labels: list[int], percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked in a tile, at most one less than it has documents.

    All pairs are compared, or with `left` those between the first `left` documents and the rest. Documents of equal label are
    connected already.
    """
    rows, columns = (sets, sets) if left is None else (sets[:left], sets[left:])
    both = common(rows, columns)
    sizes = [np.array([len(s) for s in x], float) for x in (rows, columns)]
    linked = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
    groups, first = Groups(len(ids)), {}
    for i, label in enumerate(labels):
        groups.union(first.setdefault(label, i), i)
    found = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        j = int(j) + (left or 0)
        if groups.union(int(i), j):
            found.append((ids[i], ids[j]))
    return found


def components(edges: DataFrame) -> DataFrame:
    """doc_id and component (its smallest doc_id) of every node of `edges` (a, b).

    Distributed union-find: in turn each node hands its larger neighbours, then its smaller ones, to the smallest of its
    neighbourhood, until all edges point to a root. Nodes are aggregated before the shuffle, a node with many neighbours meets its
    smallest in parts, and each round is written.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    seen = None
    while True:
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            return current.union(current.select("b", "b").distinct()).toDF("doc_id", "component")
        seen = now
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = looked_up(both.where("b > a"), least, "a", F.xxhash64("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = looked_up(large, lowest, "a", F.xxhash64("b")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stored(small.union(lowest).distinct(), "links")


def marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits, set at the hashes of `ids` (doc_id): its size is fixed, whatever the number of ids."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    rows = ids.groupBy(F.floor(bit / 32768).cast("int").alias("at")).agg(F.bitmap_construct_agg((bit % 32768).cast("bigint")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r["at"] * 4096 : (r["at"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """digest and set (sorted hashes, little-endian 64-bit integers) of the documents in `wanted` (doc_id), and perhaps of others.

    Which texts are wanted is told by a bitmap, so texts are not shuffled. With more ids than the bitmap has bits it lets all pass.
    """
    bits = marked(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
            for a, n in slices_of(batch.column(1), SLICE_BYTES):
                sets = shingle_sets(batch.column(1).slice(a, n), size)
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["digest", "set"])

    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    return texts.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).mapInArrow(tidy(run), "digest binary, set binary")


def links_in(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in `tiles`: pivot, i, j (they name the tile), name, digest, label, side (0 or 1; null: compare all with all).

    `sets` may have a digest several times, as rows that repeat a doc_id do; a class is in a tile once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []

        def links() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[2] or 0)
            left = None if rows[0][2] is None else sum(r[2] == 0 for r in rows)
            found = tile_links([r[0] for r in rows], [np.frombuffer(r[3], "<u8") for r in rows], [r[1] for r in rows], percent, left)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for pivot, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (pivot, i, j) != name:
                    if rows:
                        yield links()
                    name, rows = (pivot, i, j), []
                # row: name, label, side, set
                if not rows or (rows[-1][0], rows[-1][2]) != (row[0], row[2]):
                    rows.append(row)
        if rows:
            yield links()

    with_sets = tiles.join(sets, "digest").select("pivot", "i", "j", "name", "label", "side", "set")
    return with_sets.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "name", "side").mapInArrow(tidy(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 6, bands: int = 42, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept (doc_id is the smallest of its component).

    Documents are linked if the sets of their runs of `size` words have a Jaccard similarity of `percent` / 100 or more; components
    are what links connect. Candidates share a band of `rows` places of their SuperMinHash signatures; with 6 rows and 42 bands a pair at
    0.8 is missed with a probability of 3e-6. Every link is confirmed on the full sets.

    Equal sets are one class, named by a number, and only classes go on. Each bucket has a pivot, its smallest
    number, and the members of all buckets of a pivot form a group. Groups are cut into blocks of some `tile` members; all pairs
    of a block, with the pivot, are compared in a tile, which returns only links that connect something new. Where a larger group is
    not one component then, what is outside its main component is compared with all other blocks, so no pair that
    shares a band is left out, and pairs inside a component are not compared again.

    A text without words has an empty set and is linked with nothing; null counts as empty. A null doc_id is linked with nothing,
    gets a null component and is kept. Rows that repeat a doc_id are taken as they are: each gets the component of its own text. An empty table gives
    an empty table. Other columns are not read, whatever their names.
    """
    return grouped(docs, size, percent, rows, bands, key, text, tile).drop("said")


def grouped(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 6, bands: int = 42, key: str = "doc_id", text: str = "text", tile: int = TILE, said: Column | None = None) -> DataFrame:
    """`near_duplicates`, with `said` of each row of `docs`."""
    sketched = stored(sketches(docs, size, rows, bands, key, text, said), "near-sketches")
    named = sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    least = named.groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("c")).select("digest", F.col("c.doc_id").alias("rep"), "c.bands")
    # a doc_id with several texts is in several classes, so numbers name them; they stay as they are once written
    classes = stored(least.withColumn("name", F.monotonically_increasing_id()), "near-classes")

    placed = classes.select("name", F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.min("name").alias("pivot"), F.max("name").alias("last")).where("pivot < last").select("band", "pivot")
    members = placed.join(buckets, "band").select("pivot", "name").distinct()
    groups = stored(members.join(classes.select("name", "digest", "rep"), "name"), "near-groups")
    sets = stored(full_sets(docs, groups.select(F.col("rep").alias("doc_id")).distinct(), size, key, text), "near-sets")

    sizes = groups.groupBy("pivot").agg(F.ceil((F.count("*") / tile)).cast("int").alias("blocks"))
    blocked = groups.join(sizes, "pivot")
    one = F.lit(None).cast("int").alias("side")
    block = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("i")
    members = blocked.where("name != pivot").select("pivot", block, F.lit(0).alias("j"), "name", "digest", F.col("name").alias("label"), one)
    pivots = blocked.where("name = pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), "name", "digest", F.col("name").alias("label"), one)
    roots = components(links_in(members.union(pivots), sets, percent)).toDF("name", "component")

    # groups of several blocks that are not one component
    labelled = stored(blocked.where("blocks > 1").join(roots, "name", "left").select("pivot", "name", "digest", "blocks", F.coalesce("component", "name").alias("label")), "near-open")
    parts = labelled.groupBy("pivot", "label").agg(F.count("*").alias("n")).groupBy("pivot").agg(F.max(F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
    still = labelled.join(parts.select("pivot", F.col("main.label").alias("main"), F.ceil(F.col("outside") / tile).cast("int").alias("rests")), "pivot")
    hashed = F.xxhash64("name")
    rest = still.where("label != main").select("pivot", F.pmod(hashed, F.col("rests")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "name", "digest", "label", F.lit(0).alias("side"))
    others = still.select("pivot", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), F.pmod(hashed, F.col("blocks")).cast("int").alias("j"), "name", "digest", "label", F.lit(1).alias("side"))
    more = stored(links_in(rest.union(others), sets, percent), "near-more")
    if not more.isEmpty():
        roots = components(roots.toDF("a", "b").union(more)).toDF("name", "component")

    # the smallest doc_id of a component
    linked = classes.select("digest", "name", "rep").join(roots, "name")
    smallest = linked.groupBy("component").agg(F.min("rep").alias("first"))
    of_class = linked.join(smallest, "component").select("digest", "first").union(classes.join(roots, "name", "left_anti").select("digest", "rep"))
    return sketched.select("doc_id", "said", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(of_class, "digest", "left").select(
        "doc_id", "said", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("first", "doc_id")).alias("kept")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs`, with all columns, that `near_duplicates` keeps. Rows are known by doc_id and MD5 of their text."""
    gone = grouped(docs, key=key, text=text, said=F.unhex(F.md5(text)), **how).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("said").alias("__said")).distinct()
    return docs.join(gone, (docs[key].cast("bigint") == gone["__gone"]) & (F.unhex(F.md5(docs[text])) == gone["__said"]), "left_anti")


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of `documents` by three-word shingles at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85, rows=7, bands=36)
