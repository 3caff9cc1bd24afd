"""Token ids in files of canonical, length-limited Huffman codes.

A store is a folder with `codebook` (one row: the code length of every id) and `blocks`. A block is a row: file and place in the file,
the documents in it with their lengths, the code bits as 32-bit big-endian words, and the bit offset of every 256th id. Blocks
hold whole documents and decode without one another; inside a block, the parts between two offsets decode side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.llm.common import query, stored_at, table, tidy
from opslens.llm.tokens import END_ID, SLICE_BYTES, binary_slices, encoder, slices_of
from opslens.sources.workdir import drop_folder, new_folder

MAX_BITS = 20
STRIDE = 256
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
BLOCKS = "file int, block bigint, first bigint, doc_ids array<bigint>, lengths array<bigint>, checkpoints binary, payload binary"
DOCUMENTS = "doc_id bigint, start_in_file bigint, file int, n_tokens bigint, ids binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length of each symbol, 0 for those that do not occur: the shortest total with no code over `max_bits` (package-merge)."""
    symbols = np.flatnonzero(counts)
    n = len(symbols)
    lengths = np.zeros(len(counts), np.uint8)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need more than {max_bits} bits")
    if n < 2:
        lengths[symbols] = 1
        return lengths
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[symbols].astype(np.int64)
    items, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = len(items) // 2 * 2
        both = np.concatenate([leaves, items[0:pairs:2] + items[1:pairs:2]])
        order = np.argsort(both, kind="stable")
        items = both[order]
        is_leaf.append(order < n)
    take, found = 2 * n - 2, np.zeros(n, np.uint8)
    for level in reversed(is_leaf):
        own = int(level[:take].sum())
        found[:own] += 1
        take = 2 * (take - own)
    lengths[symbols] = found
    return lengths


class Codec:
    """Codes follow from their lengths: symbols in order of (length, id) get consecutive numbers."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = max(int(lengths.max(initial=0)), 1)
        symbols = np.flatnonzero(lengths)
        symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
        spans = np.int64(1) << (self.bits - self.lengths[symbols])
        firsts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[symbols] = firsts >> (self.bits - self.lengths[symbols])
        entries = np.repeat((symbols << 6) | self.lengths[symbols], spans)
        self.table = np.zeros(1 << self.bits, np.int64)
        self.table[: len(entries)] = entries

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, bytes]:
        """The code bits, and the bit offsets of every `stride`-th id as little-endian 64-bit integers."""
        if not len(ids):
            return b"", b""
        lengths = self.lengths[ids]
        if not lengths.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(lengths)
        at = ends - lengths
        word, shift = at >> 5, (64 - (at & 31) - lengths).astype(np.uint64)
        placed = self.codes[ids] << shift
        group = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(ends[-1]) // 32 + 2, np.uint64)
        words[word[group]] = np.add.reduceat(placed >> np.uint64(32), group)
        words[word[group] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), group)
        return words[: -(-int(ends[-1]) // 32)].astype(">u4").tobytes(), at[::stride].astype("<i8").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int, stride: int = STRIDE) -> np.ndarray:
        """The `n` ids, by table look-ups, all parts between checkpoints at a time."""
        if not n:
            return np.zeros(0, np.uint32)
        words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(stride * self.bits // 32 + 2, np.uint64)])
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = np.frombuffer(checkpoints, "<i8").copy()
        out = np.empty((stride, len(at)), np.uint32)
        mask = (1 << self.bits) - 1
        for step in range(stride):
            seen = (pairs[at >> 5] >> (64 - self.bits - (at & 31)).astype(np.uint64)).astype(np.int64) & mask
            found = self.table[seen]
            out[step] = found >> 6
            at += found & 63
        return out.T.ravel()[:n]


@lru_cache(maxsize=2)
def codec(lengths: bytes) -> Codec:
    return Codec(np.frombuffer(lengths, np.uint8))


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, by_word: bool = True) -> DataFrame:
    """doc_id, said (hash of the text), n, ids (little-endian unsigned integers of 16 bits, or of 32 for a vocabulary beyond): whole texts, each tokenized once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id, by_word)
        width = 2 if enc.vocabulary <= 1 << 16 else 4
        for batch in batches:
            for a, n in slices_of(batch.column(2), SLICE_BYTES):
                ids, bounds = enc.encode(batch.column(2).slice(a, n))
                sizes = pa.array(np.diff(bounds), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), sizes, binary_slices(ids, bounds, width)], names=["doc_id", "said", "n", "ids"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("said"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id bigint, said bigint, n bigint, ids binary")


def flat_ids(sizes: pa.Array, ids: pa.Array) -> np.ndarray:
    """The ids of all rows of `tokenized`, one after the other; every row has one at least."""
    joined = b"".join(ids.to_pylist())
    total = int(sizes.to_numpy().sum())
    return np.frombuffer(joined, f"<u{len(joined) // total}") if total else np.zeros(0, np.uint16)


def count_ids(ids: DataFrame) -> DataFrame:
    """How often each id occurs in all rows of `tokenized`: id, n. Each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            counts = np.bincount(flat_ids(*batch.columns), minlength=len(total))
            counts[: len(total)] += total
            total = counts
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    return ids.select("n", "ids").mapInArrow(tidy(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_store(
    docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, by_word: bool = True,
    max_bits: int = MAX_BITS, block_ids: int = BLOCK_IDS, files: int | None = None,
) -> None:
    """Tokenize whole texts and write their ids, with `end_id` behind each document, in ascending order of doc_id.

    Each text is tokenized once; its ids are written, counted, range-partitioned on doc_id (no text is shuffled), and each partition is
    coded as a stream into a file. The uncoded ids are removed then. Only the counts reach the driver, at most one row per id of the vocabulary.

    A null text is a document of one id. Null doc_ids come first. Rows that repeat a doc_id are kept, in the order of their texts'
    hashes. An empty table gives a store without documents. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    uncoded, scratch = stored_at(tokenized(docs, tokenizer, key, text, end_id, by_word), "token-ids", compression="zstd")
    counts = count_ids(uncoded).collect()
    n_ids = max([r["id"] for r in counts], default=0) + 1
    by_id = np.zeros(n_ids, np.int64)
    for r in counts:
        by_id[r["id"]] = r["n"]
    lengths = code_lengths(by_id, max_bits).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codec(lengths)
        file, block, first = TaskContext.get().partitionId(), 0, 0
        keys, parts, held = [], [], 0

        def close() -> pa.RecordBatch:
            payload, checkpoints = codes.encode(np.concatenate(parts))
            row = [file], [block], [first], [keys], [[len(p) for p in parts]], [checkpoints], [payload]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["file", "block", "first", "doc_ids", "lengths", "checkpoints", "payload"])

        for batch in batches:
            for key, size, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                keys.append(key)
                parts.append(np.frombuffer(ids, f"<u{len(ids) // size}"))
                held += size
                if held >= block_ids:
                    yield close()
                    block, first, keys, parts, held = block + 1, first + held, [], [], 0
        if keys:
            yield close()

    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("said")]
    ranged = uncoded.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(tidy(run), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_folder(spark, scratch)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit integers).

    Blocks are decoded where they are read. The start of a file comes from the totals of the files before, one row each.
    """
    lengths = bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"])
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codec(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                sizes = row.column("lengths")[0].values.to_numpy()
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                ids = codes.decode(row.column("payload")[0].as_py(), row.column("checkpoints")[0].as_py(), int(bounds[-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("doc_ids")[0].values,
                        pa.array(row.column("first")[0].as_py() + bounds[:-1], pa.int64()),
                        pa.array(np.full(len(sizes), row.column("file")[0].as_py()), pa.int32()),
                        pa.array(sizes, pa.int64()),
                        binary_slices(ids, bounds),
                    ],
                    names=["doc_id", "start_in_file", "file", "n_tokens", "ids"],
                )

    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    files = blocks.groupBy("file").agg(F.sum(total).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return blocks.mapInArrow(tidy(run), DOCUMENTS).join(F.broadcast(offsets), "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


@query("op1_token_store")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` as ids, written to a store and read back."""
    import public_tokenizers

    path = new_folder(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
