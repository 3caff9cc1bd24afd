"""Best-fit decreasing packing of token ids into windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.common import query, table, tidy
from opslens.llm.tokens import END_ID, binary_slices, encoder

WINDOW = 4096
#: Ids and documents that are packed together; what a task holds at a time.
BUFFER_IDS, BUFFER_DOCS = 4_000_000, 200_000
#: Ids that leave a task at a time, so that neither side of the pipe holds a second copy of the buffer.
OUT_IDS = 500_000
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class OpenWindows:
    """Windows by remaining capacity, under a segment tree that tells which capacities there are."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.base)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, window: int) -> None:
        self.at[left].append(window)
        i = left + self.base
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least remaining capacity of at least `need`, and that capacity."""
        i = need + self.base
        if not self.tree[i]:
            while i & 1 or not self.tree[i + 1]:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.base:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        left = i - self.base
        window = self.at[left].pop()
        if not self.at[left]:
            self.tree[i] = 0
            while i > 1 and not self.tree[i ^ 1]:
                i >>= 1
                self.tree[i] = 0
        return window, left


def best_fit(lengths: np.ndarray, capacity: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start, length). Items longer than a window are first cut into full windows and a rest.

    Rests are placed longest first, each into the tightest window that takes it. Items of length 0 are in no window.
    """
    windows, rests = [], []
    for item, n in enumerate(lengths.tolist()):
        full = n - n % capacity
        windows += [[(item, s, capacity)] for s in range(0, full, capacity)]
        if n > full:
            rests.append((full - n, item, full))
    still_open = OpenWindows(capacity)
    for short, item, start in sorted(rests):
        found = still_open.take(-short)
        if found is None:
            found = len(windows), capacity
            windows.append([])
        window, left = found
        windows[window].append((item, start, -short))
        if left + short:
            still_open.add(left + short, window)
    return windows


def cut_tail(window: list[tuple[int, int, int]], capacity: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """A badly filled window as sequences whose lengths are powers of two, which need no padding."""
    filled = sum(n for _, _, n in window)
    if 4 * filled >= 3 * capacity:
        return [window]
    out, room = [], 0
    for item, start, n in window:
        while n:
            if not room:
                room = 1 << (filled.bit_length() - 1)
                filled -= room
                out.append([])
            m = min(n, room)
            out[-1].append((item, start, m))
            start, n, room = start + m, n - m, room - m
    return out


def _pack_task(path: str, end_id: int, by_word: bool, capacity: int, buffer_ids: int, buffer_docs: int):
    def flush(keys: list, texts: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
        """Pieces of the buffer, some OUT_IDS ids at a time."""
        rows, held = [], 0
        for k, window in enumerate(s for w in best_fit(np.array([len(t) for t in texts]), capacity) for s in cut_tail(w, capacity)):
            offset = 0
            for item, start, n in window:
                rows.append((item, start, n, first + k, offset))
                offset += n
            held += offset
            if held >= OUT_IDS:
                yield batch_of(keys, texts, rows)
                rows, held = [], 0
        if rows:
            yield batch_of(keys, texts, rows)

    def batch_of(keys: list, texts: list[np.ndarray], rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
        lengths = np.array([r[2] for r in rows], np.int64)
        ids = np.concatenate([texts[item][start : start + n] for item, start, n, _, _ in rows])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([keys[r[0]] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array(lengths, pa.int64()),
                binary_slices(ids, np.concatenate([[0], np.cumsum(lengths)])),
                pa.array([len(texts[r[0]]) for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id, by_word)
        first = TaskContext.get().partitionId() << 40
        keys, texts, held = [], [], 0
        for batch in batches:
            for some, ids, bounds in enc.slices(batch.column(0), batch.column(1)):
                ids = ids.astype("<u4", copy=False)
                for key, a, b in zip(some, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    keys.append(key)
                    texts.append(ids[a:b])
                    held += b - a
                    if held >= buffer_ids or len(keys) >= buffer_docs:
                        for out in flush(keys, texts, first):
                            yield out
                        first = out.column(5)[-1].as_py() + 1
                        keys, texts, held = [], [], 0
        if keys:
            yield from flush(keys, texts, first)

    return run


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, by_word: bool = True,
    window: int = WINDOW, buffer_ids: int = BUFFER_IDS, buffer_docs: int = BUFFER_DOCS,
) -> DataFrame:
    """Pieces of documents in sequences of at most `window` ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Every document, with `end_id` behind it, is tokenized whole. Those longer than a window give full windows and a rest; rests are
    packed by best-fit decreasing among the documents of a buffer of some `buffer_ids` ids, inside the task that read them, so nothing
    is shuffled and a task holds one buffer. A window filled to less than three quarters, which only the last of a buffer
    are as a rule, is cut into sequences whose lengths are powers of two. Other windows are padded by the reader.

    A null or empty text is a document of one id. Null and repeated doc_ids are kept as they are; each row is a document of its own.
    An empty table gives no pieces. Other columns are not read, whatever their names. `ids` are little-endian unsigned 32-bit integers.
    sequence_id holds the task in its upper bits: it is unique, not gapless, and a repeated task gives the same ones.
    """
    run = _pack_task(tokenizer, end_id, by_word, window, buffer_ids, buffer_docs)
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), PIECES)


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all `documents`, with the checksum of their ids."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
