"""Token ids of whole texts, batch by batch."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Distinct words a worker process remembers (some 120 bytes each), and bytes of text it takes on at a time.
MEMO_WORDS, SLICE_BYTES = 300_000, 4 << 20


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


#: Lower-case and upper-case letters of Latin-1, which are letters to every tokenizer and need no normalising.
MARKS = ".,;:!?"
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"


def byte_letters() -> dict[int, str]:
    """How a byte-level model writes the bytes of each Latin-1 letter, lower-cased: printable bytes as the character of that number,
    the others, in order, as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    shown = {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}
    return {ord(c): "".join(shown[b] for b in c.lower().encode()) for c in LETTERS + CAPITALS}


def slices_of(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Start and number of some rows at a time, of about `size` bytes of text."""
    slice_of = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), len(texts)]
    yield from ((a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a)


class Encoder:
    """The ids that the tokenizer gives, without special tokens of its own, and an end id behind each text.

    `by_word` says that the tokenizer lower-cases, drops white space, keeps runs of letters apart from all else, writes bytes as
    characters, and marks the tokens that end a word. Then each distinct word between ASCII white space is encoded once per slice, or not at all if remembered,
    and a word of Latin-1 letters goes straight to the tokenizer's model; the ids are the same as for the whole text.
    Texts in which a special token's string occurs are given to the tokenizer whole. A null text counts as empty.
    """

    def __init__(self, path: str, end_id: int = END_ID, by_word: bool = True, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.end_id, self.by_word, self.memo_words = Tokenizer.from_file(path), end_id, by_word, memo_words
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.letters, self.as_bytes = f"^[{LETTERS}{CAPITALS}]+$", byte_letters()
        self.specials = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    @property
    def vocabulary(self) -> int:
        return max(self.tokenizer.get_vocab_size(), self.end_id + 1)

    def _let_go(self) -> None:
        """Only the first `memo_words` words stay; the others were kept for one slice."""
        while len(self.place) > self.memo_words:
            self.place.popitem()
        n = len(self.place)
        self.used = int(self.starts[n - 1] + self.lengths[n - 1]) if n else 0

    def _remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m, total = len(self.place), len(words), len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + total] = ids
        self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + m] = lengths
        self.place.update(zip(words, range(n, n + m), strict=True))
        self.used += total

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: those of letters some in one call, the others one by one."""
        of_letters = pc.match_substring_regex(pa.array(words, pa.string()), self.letters).to_pylist()
        plain, others = list(compress(words, of_letters)), [w for w, x in zip(words, of_letters, strict=True) if not x]
        self._remember(plain, *self._letters(plain))
        raw = self._raw(others)
        self._remember(others, np.fromiter(chain.from_iterable(raw), np.uint32), np.fromiter(map(len, raw), np.int64, len(raw)))

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters and their numbers. Which tokens end a word is known by their ids."""
        written = "\n".join(words).translate(self.as_bytes).split("\n") if words else []
        lines = [" ".join(written[i : i + 50]) for i in range(0, len(written), 50)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.model.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word of the texts its place in the memo; words per text; whether the text must be encoded whole."""
        lower = pc.ascii_lower(texts)
        whole = np.zeros(len(texts), bool)
        for s in self.specials:
            whole |= pc.match_substring(lower, s).to_numpy(zero_copy_only=False)
        # a letter and a mark never share a token, so a blank between them changes nothing, and words are found again without the mark
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, f"([{LETTERS}])([{MARKS}])", r"\1 \2"))
        per_text = np.diff(split.offsets.to_numpy()).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._let_go()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [words[i] for i in missing]
            self._learn(new)
            at[missing] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        return at[coded.indices.to_numpy(zero_copy_only=False)], per_text, whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and where each text's ids start, with the end of the last."""
        texts = texts.fill_null("")
        if self.by_word and len(texts):
            at, per_text, whole = self._words(texts)
            lengths = self.lengths[at]
            flat = gather(self.ids, self.starts[at], lengths)
            words_before = np.concatenate([[0], np.cumsum(per_text)])
            ids_before = np.concatenate([[0], np.cumsum(lengths)])[words_before]
        else:
            whole, flat, ids_before = np.ones(len(texts), bool), np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if whole.any():
            parts = [flat[ids_before[i] : ids_before[i + 1]] for i in range(len(texts))]
            for i, ids in zip(np.flatnonzero(whole), self._raw([texts[int(i)].as_py() for i in np.flatnonzero(whole)]), strict=True):
                parts[i] = np.array(ids, np.uint32)
            flat = np.concatenate([*parts, np.zeros(0, np.uint32)])
            ids_before = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        n = len(texts)
        out, ends = np.empty(len(flat) + n, np.uint32), ids_before[1:] + np.arange(n)
        mine = np.ones(len(out), bool)
        mine[ends] = False
        out[mine], out[ends] = flat, self.end_id
        return out, ids_before + np.arange(n + 1)

    def slices(self, keys: pa.Array, texts: pa.Array) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """The keys, ids and starts of `encode` for some rows at a time, so that memory holds little beyond the ids."""
        for a, n in slices_of(texts, SLICE_BYTES):
            yield keys.slice(a, n).to_pylist(), *self.encode(texts.slice(a, n))


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int = END_ID, by_word: bool = True) -> Encoder:
    """One per worker process, so that words stay remembered from task to task."""
    return Encoder(path, end_id, by_word)


def binary_slices(ids: np.ndarray, bounds: np.ndarray, width: int = 4) -> pa.Array:
    """ids[bounds[i] : bounds[i + 1]] as little-endian unsigned integers of `width` bytes."""
    ids = np.ascontiguousarray(ids, f"<u{width}")
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * width, np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
