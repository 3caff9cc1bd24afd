"""SentencePiece segmentations sampled without replacement, and back to text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from opslens.llm.common import column, query, table
from opslens.llm.near import GOLDEN, mix
from opslens.llm.tokens import gather, slices_of

SAMPLES, ALPHA, SEED = 2, 0.3, 0
#: Text a task takes on at a time; the lattices of its distinct words are built once.
SLICE_BYTES = 1 << 20
#: Branches behind a way of so small a log probability are looked at only if the others do not fill the queue for certain.
FAINTEST = -40.0
#: Noise lifts a log probability by less than this: the uniform numbers it is made from are 2**-54 below 1 at most.
MOST_NOISE = 37.5
SPACE = "▁"
SAMPLED = "doc_id bigint, sample int, n_pieces bigint, ids binary, log_prob double, score double, log_inclusion double, decoded string"


def uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys only."""
    h = np.uint64(0)
    for k in keys:
        h = mix(np.atleast_1d(np.asarray(k)).astype(np.int64).view(np.uint64) + h * GOLDEN)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def included(lead: float) -> float:
    """Log probability that Gumbel noise lifts a log probability over a score that it leads by `lead`."""
    return lead if lead < -30 else float(np.log(-np.expm1(-np.exp(min(lead, 700.0)))))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... so many of each."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


@dataclass
class Lattices:
    """Lattices of words as flat arrays: nodes are places between characters, edges are pieces that end at their node.

    An edge has the node it comes from, whether that is its word's first node, its place among the tokens, the log probability of being
    the last piece on the ways to its node, and the summed probability up to and with it. A first node has no edges.
    """

    last: np.ndarray  # of a word: its last node
    node_edge: np.ndarray  # of a node: its first edge
    edge_from: np.ndarray
    edge_node: np.ndarray
    edge_done: np.ndarray
    edge_logp: np.ndarray
    edge_below: np.ndarray
    edge_token: np.ndarray
    edge_tokens: np.ndarray


class Pieces:
    """The model's vocabulary with a weight for each piece.

    A model of merges has ranks and no probabilities; the piece of rank r weighs (r + 2.7) ** -alpha, by Zipf's law, and a byte, for
    characters without a piece, as much as the last rank. The weight of a segmentation is the product over its pieces.
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.first_byte = next(i for i in range(n) if model.is_byte(i))
        plain = [i for i in range(n) if not special[i]]
        if any(SPACE in names[i].lstrip(SPACE) or "\n" in names[i] for i in plain):
            raise ValueError("a piece goes across words")
        weight = -alpha * np.log(np.arange(len(plain)) + 2.7)
        self.byte_weight = float(weight[-1])
        self.tokens = np.concatenate([plain, np.arange(256) + self.first_byte]).astype(np.uint32)
        self.weights, self.sizes = np.concatenate([weight, np.full(256, self.byte_weight)]), np.ones(len(self.tokens), np.int64)
        found = []
        for place, i in enumerate(plain):
            c = np.frombuffer(names[i].replace(SPACE, " ").encode("utf-32-le"), np.uint32)
            *_, (length, _, h) = self.rolled(c, np.arange(len(c), 0, -1), len(c))
            found.append((int(h[0]), place, length))
        found.sort()
        self.hashes = np.array([h for h, _, _ in found] + [0], np.uint64)
        self.places = np.array([p for _, p, _ in found] + [0])
        self.longest = max((n for _, _, n in found), default=0)
        # hashes are found by their upper bits: where the first one with these bits stands, and how many there are at most
        upper = (self.hashes[:-1] >> np.uint64(44)).astype(np.int64)
        self.first_hash = np.searchsorted(upper, np.arange(1 << 20)).astype(np.int32)
        self.first_hash[np.setdiff1d(np.arange(1 << 20), upper)] = len(upper)
        self.likely = self.first_hash < len(upper)
        self.most_alike = int(np.bincount(upper, minlength=1).max())
        written = [bytes([i - self.first_byte]) if model.is_byte(i) else b"" if special[i] else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.text_starts = np.cumsum([0, *map(len, written)]).astype(np.int64)
        self.text = np.frombuffer(b"".join(written), np.uint8)
        self.runs: dict[bytes, int] = {}

    @staticmethod
    def rolled(c: np.ndarray, left: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of 1, 2, ... characters that end inside their word, which has `left` characters from a character on: where they begin, and
        64-bit hashes."""
        at, h, c = np.arange(len(c)), np.zeros(len(c), np.uint64), c.astype(np.uint64)
        for n in range(1, longest + 1):
            on = np.flatnonzero(left[at] >= n)
            at, h = at[on], h[on]
            if not len(at):
                return
            h = h * np.uint64(0x100000001B3) + c[at + (n - 1)]
            yield n, at, mix(h + np.uint64(n))

    def pieces_at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are a piece's, and its place."""
        upper = (h >> np.uint64(44)).view(np.int64)
        at = np.flatnonzero(self.likely[upper])
        k, h = self.first_hash[upper[at]], h[at]
        hit = self.hashes[k] == h
        for _ in range(1, self.most_alike):
            k = np.minimum(k + ~hit, len(self.places) - 1)
            hit = (self.hashes[k] == h) & (k < len(self.places) - 1)
        hit = np.flatnonzero(hit)
        return at[hit], self.places[k[hit]]

    def build(self, words: list[str]) -> Lattices:
        """Lattices of all words at once, node by node from the left.

        Words stand by falling length and nodes by depth, so the nodes of a depth are those of the first words, the ways to them are
        edges that stand together, and a depth is worked out in slices.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        c = np.frombuffer("".join([words[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = sizes[order]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        depth = ranges(np.zeros(len(words), np.int64), sizes).astype(np.int32)  # characters before this one
        left = np.repeat(sizes.astype(np.int32), sizes) - depth  # characters from here to the word's end
        per_depth = len(words) - np.searchsorted(sizes[::-1], np.arange(int(sizes.max(initial=0)) + 1))
        level = np.concatenate([[0], np.cumsum(per_depth)])  # first node of a depth; node = level[characters before it] + word
        n_nodes = int(level[-1])
        # an edge is one number: its node, its length, the place of its tokens; sorted, edges of a node stand together
        packed = []
        alone = np.zeros(len(c), bool)
        for n, at, h in self.rolled(c, left, self.longest):
            hit, place = self.pieces_at(h)
            at = at[hit]
            packed.append((level[depth[at] + n] + word[at]) << 32 | n << 24 | place)
            if n == 1:
                alone[at] = True
        # characters without a piece: their bytes, as one edge
        odd = np.flatnonzero(~alone)
        runs = np.fromiter((self._byte_run(chr(i).encode("utf-8", "surrogatepass")) for i in c[odd].tolist()), np.int64, len(odd))
        packed = np.sort(np.concatenate([*packed, (level[depth[odd] + 1] + word[odd]) << 32 | 1 << 24 | runs]))
        to, token, length = packed >> 32, packed & 0xFFFFFF, packed >> 24 & 0xFF
        weight, tokens = self.weights[token], self.sizes[token]
        per_node = np.bincount(to, minlength=n_nodes)
        node_edge = np.concatenate([[0], np.cumsum(per_node)])
        frm = np.empty(len(to), np.int32)
        total = np.zeros(n_nodes)
        logp, below = np.empty(len(to)), np.empty(len(to))
        for d in range(1, len(level) - 1):
            first, end = level[d], level[d + 1]
            x, y = node_edge[first], node_edge[end]
            head, count = node_edge[first:end] - x, per_node[first:end]
            frm[x:y] = to[x:y] - (first - level[d - length[x:y]])
            w = total[frm[x:y]] + weight[x:y]
            top = np.maximum.reduceat(w, head)
            p = np.exp(w - np.repeat(top, count))
            summed = np.add.reduceat(p, head)
            total[first:end] = top + np.log(summed)
            p /= np.repeat(summed, count)
            np.log(p, out=logp[x:y])
            running = np.cumsum(p)
            below[x:y] = running - np.repeat(running[head] - p[head], count)
        last = np.empty(len(words), np.int32)
        last[order] = level[sizes] + np.arange(len(words))
        return Lattices(last, node_edge.astype(np.int32), frm, to.astype(np.int32), frm < len(words), logp, below, token, tokens)

    def _byte_run(self, raw: bytes) -> int:
        """Where the byte tokens of a character stand in `tokens`, with their number and weight; runs are appended as they come up."""
        if raw not in self.runs:
            n = len(raw)
            self.runs[raw] = len(self.tokens)
            self.tokens = np.concatenate([self.tokens, np.frombuffer(raw, np.uint8).astype(np.uint32) + self.first_byte])
            self.weights = np.concatenate([self.weights, np.full(n, n * self.byte_weight)])
            self.sizes = np.concatenate([self.sizes, np.full(n, n)])
        return self.runs[raw]

    def words_of(self, texts: pa.Array) -> tuple[Lattices, np.ndarray, np.ndarray]:
        """Lattices of the texts' distinct words, the one of every word, and the words per text. A word is blanks and what follows them, or a newline; no piece goes
        across words. As the model does, a blank is put before each text that is not empty."""
        padded = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        offsets = np.frombuffer(padded.buffers()[1], np.int32)[padded.offset : padded.offset + len(padded) + 1].astype(np.int64)
        raw = np.frombuffer(padded.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank, line = raw == 32, raw == 10
        cut = line.copy()
        cut[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw.tobytes())])
        coded = words.dictionary_encode()
        return self.build(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False), np.diff(np.searchsorted(starts, offsets))

    @staticmethod
    def descend(lat: Lattices, nodes: np.ndarray, seeds: np.ndarray, sample: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node a random way to its word's first node: edges, in the order taken, and how many per start."""
        lane = np.arange(len(nodes))
        taken, lanes, steps = [], [], np.zeros(len(nodes), np.int64)
        node, step = nodes.astype(np.int64), 0
        keys = mix(seeds + np.uint64(sample * int(GOLDEN) & (1 << 64) - 1)) + number.astype(np.uint64) * GOLDEN
        while len(lane):
            u = ((mix(keys + np.uint64(step * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            edge, end = lat.node_edge[node].astype(np.int64), lat.node_edge[node + 1] - 1
            more = np.flatnonzero((u > lat.edge_below[edge]) & (edge < end))
            while len(more):
                edge[more] += 1
                more = more[(u[more] > lat.edge_below[edge[more]]) & (edge[more] < end[more])]
            taken.append(edge)
            lanes.append(lane)
            steps[lane] += 1
            on = ~lat.edge_done[edge]
            lane, node, keys, step = lane[on], lat.edge_from[edge[on]].astype(np.int64), keys[on], step + 1
        out = np.empty(int(steps.sum()), np.int64)
        first = np.cumsum(steps) - steps
        for k, (edge, lane) in enumerate(zip(taken, lanes, strict=True)):
            out[first[lane] + k] = edge
        return out, steps

    def sample(self, texts: pa.Array, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Per text up to k distinct segmentations: ids, log probability, perturbed score, log inclusion probability.

        A tree of choices, word by word and from each word's end, has the segmentations as leaves. A leaf's score is its log probability
        plus Gumbel noise; a node's score, the largest below it, can be drawn before its leaves, so it is an exact bound for A*:
        the queue holds the branches off the ways taken, the best is taken next, and leaves come out in order of
        score. The scores of the branches at a node are drawn below the node's own, which the way taken has.
        """
        lat, lattice, per_text = self.words_of(texts)
        last, ends, n = lat.last[lattice], np.cumsum(per_text), len(per_text)
        begins = ends - per_text
        found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in range(n)]
        queues: list[list[tuple[float, np.ndarray, int, int]]] = [[] for _ in range(n)]
        # branches to follow: text, score, edges before, words finished by them, node inside the next word (or none)
        going = [(i, float(g), np.zeros(0, np.int64), 0, None) for i, g in enumerate(-np.log(-np.log(uniform(seeds.view(np.int64), -1))))] if n else []
        for r in range(k):
            if not going:
                break
            starts = [np.append([] if node is None else [node], last[begins[i] + done + (node is not None) : ends[i]]).astype(np.int64) for i, _, _, done, node in going]
            sizes = [len(x) for x in starts]
            number = np.concatenate([done + np.arange(m) for (_, _, _, done, _), m in zip(going, sizes, strict=True)])
            which = np.array([b[0] for b in going])
            edges, steps = self.descend(lat, np.concatenate(starts), np.repeat(seeds[which], sizes), r, number)
            cut = np.concatenate([[0], np.cumsum(steps)])[np.cumsum([0, *sizes])].tolist()
            ways = [np.concatenate([b[2], edges[x:y]]) for b, x, y in zip(going, cut, cut[1:], strict=False)]
            since, scores = np.array([len(b[2]) for b in going]), np.array([b[1] for b in going])
            flat, bounds = np.concatenate(ways), np.cumsum([0, *map(len, ways)])
            logp = lat.edge_logp[flat]
            ids, id_bounds = self._ids(lat, flat, bounds)
            total = np.concatenate([[0.0], np.cumsum(logp)])
            for j, (i, way) in enumerate(zip(which.tolist(), ways, strict=True)):
                found[i].append((ids[id_bounds[j] : id_bounds[j + 1]], float(logp[bounds[j] : bounds[j + 1]].sum()), float(scores[j])))
                queues[i] = queues[i][: k - r]
            held = np.array([sum(q[0] >= FAINTEST + MOST_NOISE for q in queues[i]) for i in which.tolist()])
            for j, score, at, edge in self._branches(lat, flat, bounds, total, since, scores, seeds[which], r, k - r, held):
                queues[which[j]].append((score, ways[j], at, edge))
            going = []
            for i in which.tolist():
                queues[i] = sorted(queues[i], key=lambda q: -q[0])[: k - r]
                if queues[i] and r + 1 < k:
                    g, way, at, edge = queues[i].pop(0)
                    prefix = np.append(way[:at], edge)
                    going.append((i, g, prefix, int(lat.edge_done[prefix].sum()), None if lat.edge_done[edge] else int(lat.edge_from[edge])))
        # the best score that did not come out tells how likely it was to come out
        return [[(got, p, g, included(p - queue[0][0]) if queue else 0.0) for got, p, g in ways] for ways, queue in zip(found, queues, strict=True)]

    @staticmethod
    def _branches(lat: Lattices, flat: np.ndarray, bounds: np.ndarray, total: np.ndarray, since: np.ndarray, scores: np.ndarray, seeds: np.ndarray, sample: int, k: int, held: np.ndarray) -> list[tuple[int, float, int, int]]:
        """The k best branches off each way behind its `since` first edges: way, score, place and edge.

        Branches behind a faint part of a way score less than FAINTEST + MOST_NOISE. Where fewer than k branches score more, of the other part and of those
        `held` in the queue, a way is gone through as a whole; so the result is exact.
        """
        sizes = np.diff(bounds)
        way = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(flat)) - bounds[way]
        gone = total[:-1] - total[bounds[way]]
        behind = place >= since[way]

        def best_of(asked: np.ndarray) -> tuple[np.ndarray, ...]:
            of, at, before, taken = way[asked], place[asked], gone[asked], flat[asked]
            node = lat.edge_node[taken]
            first = lat.node_edge[node].astype(np.int64)
            count = lat.node_edge[node + 1] - first
            i, edge = np.repeat(np.arange(len(taken)), count), ranges(first, count)
            other = edge != taken[i]
            i, edge = i[other], edge[other]
            phi = before[i] + lat.edge_logp[edge]
            noise = -np.log(uniform(seeds[of[i]].view(np.int64) + sample, (at[i] << 16) + edge - first[i]))
            score = -np.logaddexp(-scores[of[i]], np.log(noise) - phi)
            order = np.lexsort((-score, of[i]))
            ways = of[i][order]
            rank = np.arange(len(ways)) - np.searchsorted(ways, ways)
            kept = order[rank < k]
            return of[i[kept]], score[kept], at[i[kept]], edge[kept]

        faint = behind & (gone < FAINTEST)
        found = best_of(np.flatnonzero(behind & ~faint))
        sure = np.bincount(found[0][found[1] >= FAINTEST + MOST_NOISE], minlength=len(sizes)) + held >= k
        unsure = ~sure & (np.bincount(way[faint], minlength=len(sizes)) > 0)
        if unsure.any():
            again = best_of(np.flatnonzero(behind & unsure[way]))
            found = tuple(np.concatenate([x[~unsure[found[0]]], y]) for x, y in zip(found, again, strict=True))
        return list(zip(*(x.tolist() for x in found), strict=True))

    def _ids(self, lat: Lattices, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of ways in the order of the text, and their bounds. Words stand in order, the edges in a word from its end."""
        closing = np.flatnonzero(lat.edge_done[flat])
        opening = np.concatenate([[0], closing[:-1] + 1])[: len(closing)]
        size = closing - opening + 1
        ordered = flat[np.repeat(opening + closing, size) - np.arange(len(flat))]
        tokens = lat.edge_tokens[ordered]
        return gather(self.tokens, lat.edge_token[ordered], tokens), np.concatenate([[0], np.cumsum(tokens)])[bounds]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, without the blank that was put before it."""
        starts = self.text_starts[ids]
        raw = gather(self.text, starts, self.text_starts[ids + 1] - starts).tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(path: str, alpha: float = ALPHA) -> Pieces:
    return Pieces(path, alpha)


def sample_pieces(docs: DataFrame, model: str, samples: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """Distinct sampled segmentations of whole texts: doc_id, sample (from 1), n_pieces, ids, log_prob, score, log_inclusion, decoded.

    A text gets its `samples` segmentations of largest log probability plus Gumbel noise, which is sampling without replacement;
    log_inclusion is the log probability of being among them, given the best score that is not. Texts with fewer segmentations give all
    of them, and inclusion 1. The noise depends on `seed` and doc_id only, so results do not depend on how rows are stored; rows that repeat a
    doc_id draw the same noise. `ids` are little-endian unsigned 32-bit integers; `decoded` is the text read back from them, or null
    without `decode`.

    An empty or null text has one segmentation, of no pieces. A null doc_id has noise of its own. An empty table gives an empty
    table. Other columns are not read, whatever their names. Nothing is shuffled; a task holds the lattices of some texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, alpha)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).fill_null("")
            for a, n in slices_of(texts, SLICE_BYTES):
                some = keys.slice(a, n)
                ids = some.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                seeds = mix(ids.view(np.uint64) * GOLDEN + np.uint64(seed) + some.is_null().to_numpy(zero_copy_only=False).astype(np.uint64))
                rows = [(doc_id, r + 1, len(got), got.astype("<u4").tobytes(), logp, score, inclusion, p.decode(got) if decode else None) for doc_id, of_text in zip(some.to_pylist(), p.sample(texts.slice(a, n), seeds, samples), strict=True) for r, (got, logp, score, inclusion) in enumerate(of_text)]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], t) for i, t in enumerate(types)], names=[f.split()[0] for f in SAMPLED.split(", ")])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SAMPLED)


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """All columns of `encoded` and the text that `ids` (little-endian unsigned 32-bit integers) stand for; null for null. A column called
    like `into` is replaced."""
    kept = [c for c in encoded.columns if c != into]
    rest = encoded.select(*map(column, kept))
    schema = StructType([*rest.schema.fields, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            texts = [None if x is None else p.decode(np.frombuffer(x, "<u4")) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, into])

    return rest.mapInArrow(run, schema)


@query("op4_sample_pieces")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every one of `documents`, and the checksums of their ids and of the texts decoded from them."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    sampled = sample_pieces(table(spark, sf_dir, "documents"), model, decode=True)
    return sampled.select("doc_id", "sample", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.crc32(F.encode("decoded", "UTF-8")).alias("text_crc32"), "log_prob", "score", "log_inclusion")
