"""License notices in texts: conditional compression against templates, confirmed by wording."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.common import query, table

#: What all BSD licenses say, with numbers of the clauses or without; the disclaimer follows in the one of two clauses, a third in the other.
NUMBERED = (("1.", "2.", "3."), ("", "", ""))
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are"
    " met: {} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " {} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
#: Wording of well-known notices; {} stands for a name, a year or a title. Fixed values.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,'
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", *(f"{BSD.format(*n)} THIS SOFTWARE IS PROVIDED BY" for n in NUMBERED)),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        *(
            f"{BSD.format(*n)} {n[2]} Neither the name of {{}} nor the names of its contributors may be used to endorse or promote products derived"
            " from this software without specific prior written permission."
            for n in NUMBERED
        ),
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
}
#: What an SPDX expression follows.
TAG = "spdx-license-identifier"
#: Ids of SPDX lines beside the license names themselves.
SPDX = {"GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later"), "GPL-2.0": ("GPL-2.0-only", "GPL-2.0-or-later"), "LGPL-3.0": ("LGPL-3.0-only", "LGPL-3.0-or-later")}
TEMPLATES = {name: (*ts, *(f"SPDX-License-Identifier: {i}" for i in (name, *SPDX.get(name, ())))) for name, ts in TEMPLATES.items()}
#: Words of a template (left) that a notice may have otherwise (right), for all licenses and for one. Fixed values.
VARIATIONS: dict[str, tuple[tuple[str, str], ...]] = {
    "": (("license", "licence"), ("licensed", "licenced"), ("sublicense", "sublicence"), ("v", "version"), ("version", "v")),
    "MIT": (("released", "distributed"), ("released", "available"), ("the", "an")),
    "BSD-2-Clause": (("this", "the"), ("must", "should")),
    "BSD-3-Clause": (("this", "the"), ("must", "should")),
    "GPL-2.0": (("work", "program"), ("work", "software"), ("work", "file")),
    "GPL-3.0": (("work", "program"), ("work", "software"), ("work", "file")),
    "LGPL-3.0": (("work", "program"), ("work", "software"), ("work", "file"), ("work", "library")),
}
#: Words around which candidate blocks are cut. A template without any of them adds its longest word.
MARKERS = r"(?i)licen[cs]e|permission is|redistribut|public domain|released under"
#: Most words that stand for a {}.
SLOT = 20
#: Least saving by the best template for a notice to be confirmed.
LEAST_SAVING = 0.25
#: Words of which one before a notice, in the same clause, takes it back.
DENIALS = frozenset(("not", "never", "no", "nor", "neither", "cannot", "t"))
WORD = r"\w+(?:[-/.]\w+)*"
FOUND = "doc_id bigint, block int, start bigint, length bigint, text string, license string, saving double, next_license string, next_saving double, wording double, differences array<string>, confirmed boolean"


def words_of(text: str) -> list[str]:
    """Lower-cased words with inner hyphens, slashes and dots; {} stands for itself."""
    return re.findall(r"\{\}|" + WORD, text.lower())


def markers_of(templates: Iterable[str]) -> str:
    """What a text must say to be looked at, as a pattern that both Spark and Python read: no wording is without a word of it."""
    known = re.compile(MARKERS)
    longest = {max(words_of(t), key=len) for t in templates if words_of(t) and not known.search(" ".join(words_of(t)))}
    return "|".join([MARKERS, *(re.escape(w) for w in sorted(longest))])


class Template(NamedTuple):
    """A wording as words, as runs of words between its {}, and the places of its marker words."""

    name: str
    words: list[str]
    runs: list[list[str]]
    marks: list[int]
    counts: Counter
    compressor: zstandard.ZstdCompressor


def template(name: str, text: str, level: int, markers: str = MARKERS) -> Template:
    words, runs = words_of(text), [[]]
    for w in words:
        if w == "{}":
            runs.append([])
        else:
            runs[-1].append(w)
    data = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    said, ends = " ".join(words), list(accumulate(len(w) + 1 for w in words))
    marks = sorted({bisect_right(ends, m.start()) for m in re.finditer(markers, said)})
    return Template(name, words, [r for r in runs if r], marks, Counter(words), zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=data))


class Matcher:
    """Compares blocks with all templates; equal blocks are compared once."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], variations: Mapping[str, tuple[tuple[str, str], ...]] = VARIATIONS, level: int = 19):
        markers = markers_of(t for ts in templates.values() for t in ts)
        self.entries = [template(name, t, level, markers) for name, ts in templates.items() for t in ts]
        self.allowed = {name: frozenset((*variations.get("", ()), *variations.get(name, ()))) for name in templates}
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.marker, self.word = re.compile(markers), re.compile(WORD)
        self.by_first = defaultdict(list)
        for n, e in enumerate(self.entries):
            if e.runs:
                self.by_first[e.runs[0][0]].append(n)
        self.ids = {e.words[1]: n for n, e in enumerate(self.entries) if len(e.words) == 2 and e.words[0] == TAG}
        self.compare = lru_cache(maxsize=20_000)(self._compare)

    def notices(self, text: str) -> list[tuple]:
        """Start, block and comparison of every candidate: first all whole wordings, then what other marker words stand in."""
        found = list(self.word.finditer(text))
        words, spans = [m.group().lower() for m in found], [m.span() for m in found]
        taken, out = bytearray(len(words)), []
        for ns, a, b in self._whole(words):
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out += [(a, b, n) for n in ns]
        starts, free = [x for x, _ in spans], 0
        for p in sorted({bisect_right(starts, m.start()) - 1 for m in self.marker.finditer(text)}):
            if p >= free and not taken[p]:
                a, b, free = self._around(words, p, max(free, taken.rfind(1, 0, p) + 1), taken.find(1, p))
                out.append((a, b, None))
        rows = []
        for a, b, n in sorted(out, key=lambda x: x[:2]):
            start, end = spans[a][0], spans[b - 1][1]
            while end < len(text) and text[end] in ".,;:!?)]\"'":
                end += 1
            rows.append((start, text[start:end], self._result(text, words, spans, a, text[start:end], n)))
        return rows

    def _whole(self, words: list[str]) -> list[tuple[list[int], int, int]]:
        """Template numbers, first word and end of all places where a template stands word by word, those of most words first."""
        found = []
        for a, w in enumerate(words):
            for n in self.by_first.get(w, ()):
                b = self._end(self.entries[n].runs, words, a)
                if b is not None:
                    found.append((len(self.entries[n].words), [n], a, b))
            if w == TAG and (e := self._expression(words, a))[0]:
                found.append((e[1] - a, e[0], a, e[1]))
        return [f[1:] for f in sorted(found, key=lambda f: (-f[0], f[2], -f[3], -len(f[1])))]

    def _expression(self, words: list[str], a: int) -> tuple[list[int], int]:
        """Numbers of the templates whose ids an SPDX expression names, each license once, and where the expression ends."""
        ids, b = [], a + 1
        while b < len(words):
            if words[b - 1] != "with" and words[b] in self.ids:
                ids.append(self.ids[words[b]])
            b += 1
            if b + 1 >= len(words) or words[b] not in ("or", "and", "with"):
                break
            b += 1
        return list({self.entries[n].name: n for n in ids}.values()), b

    def _end(self, runs: list[list[str]], words: list[str], a: int) -> int | None:
        """Where the runs end if the first starts at word `a` and the others follow with at most SLOT words between."""
        b = a + len(runs[0])
        if words[a:b] != runs[0]:
            return None
        if len(runs) == 1:
            return b
        return next((e for i in range(b, min(len(words), b + SLOT + 1)) if words[i] == runs[1][0] and (e := self._end(runs[1:], words, i)) is not None), None)

    def _around(self, words: list[str], p: int, low: int, high: int) -> tuple[int, int, int]:
        """The block around marker word `p`, between `low` and `high`, and where what it shares with a template ends.

        Each template is laid on the text so that a marker word of it meets `p`. The one with the largest share of its words in its window wins,
        and the window is widened to words that it has up to a quarter of its length outside.
        """
        high = len(words) if high < 0 else high
        best = (-1.0, 0, p, p + 1, self.entries[0] if self.entries else None)
        for e in self.entries:
            same = [q for q in e.marks if e.words[q] == words[p]]
            for q in same or e.marks:
                a, b = max(low, p - q), min(high, p - q + len(e.words))
                share = (Counter(words[a:b]) & e.counts).total() / len(e.words)
                if (share, len(e.words)) > best[:2]:
                    best = (share, len(e.words), a, b, e)
        _, n, a, b, e = best
        first = max(low, a - n // 4)
        parts = [m for m in SequenceMatcher(None, e.words, words[first : min(high, b + n // 4)], autojunk=False).get_matching_blocks() if m.size] if e else []
        if not parts:
            return min(a, p), max(b, p + 1), p + 1
        begin, end = first + parts[0].b, first + parts[-1].b + parts[-1].size
        return min(a, p, begin), max(b, p + 1, end), max(p + 1, end)

    def _result(self, text: str, words: list[str], spans: list[tuple[int, int]], a: int, block: str, n: int | None) -> tuple:
        """The comparison of a block; a denial in the clause before it takes it back."""
        # of an SPDX expression its tag and this id are compared
        name, saving, after, less, wording, differences, same = self.closest(": ".join(self.entries[n].words) if n in self.ids.values() else block)
        denials, at = [], spans[a][0]
        for i in range(a - 1, -1, -1):
            gap = text[spans[i][1] : at]
            if re.search(r"[.,;:!?]|\n\s*\n", gap) or ("\n" in gap and text[at].isupper()):
                break
            denials += [f"+{words[i]}"] * (words[i] in DENIALS)
            at = spans[i][0]
        return name, saving, after, less, wording, (*differences, *denials), same and not denials

    def _compare(self, block: str) -> list[tuple[float, int]]:
        """Saving by each template and its number, the best first."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(e.compressor.compress(raw)) / alone, n) for n, e in enumerate(self.entries)), key=lambda s: (-s[0], self.entries[s[1]].name, len(self.entries[s[1]].words)))

    def closest(self, block: str) -> tuple:
        """The license whose template saves most of a block, confirmed if nothing of its wording differs but allowed variations."""
        savings = self.compare(block)
        if not savings:
            return None, None, None, None, 0.0, (), False
        words = words_of(block)
        # templates that save as much are told apart by wording
        agreed = max((self._wording(words, self.entries[n].words, self.allowed[self.entries[n].name]) + (s, self.entries[n].name) for s, n in savings if s >= savings[0][0] - 0.1), key=lambda x: (x[0], not x[1], x[2]))
        wording, differences, saving, name = agreed
        after = next(((s, self.entries[n].name) for s, n in savings if self.entries[n].name != name), (None, None))
        return name, saving, after[1], after[0], wording, differences, not differences and wording == 1.0 and saving >= LEAST_SAVING

    @staticmethod
    def _wording(words: list[str], template: list[str], allowed: frozenset[tuple[str, str]]) -> tuple[float, tuple[str, ...]]:
        """Share of the template's words found in order, and what differs: - missing, + between. Words that may stand for those of the template are found
        too; what stands before and after is no difference."""
        matched = [p for p in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if p.size]
        found = sum(p.size for p in matched) + template.count("{}")
        # a first and a last word may also be varied, so the text may begin and end beside the first and last match
        first, last = (matched[0], matched[-1]) if matched else (None, None)
        differences, a, b = [], 0, max(0, first.b - first.a) if first else 0
        end = min(len(words), last.b + last.size + len(template) - last.a - last.size) if last else 0
        for p in [*matched, None]:
            upto = p.b if p else end
            missing, between = [w for w in template[a : p.a if p else len(template)] if w != "{}"], words[b:upto]
            open_ = "{}" in template[a : p.a if p else len(template)]
            if not open_ and len(missing) == len(between) and all(pair in allowed for pair in zip(missing, between, strict=True)):
                found += len(missing)
            else:
                inner = p is not None and p is not first
                if missing or (between and inner and not open_):
                    differences += [f"-{w}" for w in missing] + [f"+{w}" for w in between if inner]
            if p:
                a, b = p.a + p.size, p.b + p.size
        return min(1.0, found / max(1, len(template))), tuple(differences)


@lru_cache(maxsize=4)
def matcher(templates: tuple[tuple[str, tuple[str, ...]], ...], variations: tuple[tuple[str, tuple[tuple[str, str], ...]], ...]) -> Matcher:
    return Matcher(dict(templates), dict(variations))


def scan(
    docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, key: str = "doc_id", text: str = "text", variations: Mapping[str, tuple[tuple[str, str], ...]] = VARIATIONS,
) -> DataFrame:
    """A row per notice and other candidate block of a text: doc_id, block (from 0), start, length, text, license, saving, next_license, next_saving, wording, differences, confirmed.

    Candidate blocks are cut in texts with a marker word; the markers follow from the templates. Where a template stands word by word, with up to SLOT words
    for each {}, the block is cut to it (of places that overlap, the one with most words), so that adjacent notices are blocks of their own; an SPDX expression
    is a block for each license that it names, its tag and that id. Around each marker word of the rest a block as long as the template that
    fits best is cut, so each marker word is in some row. How a block was cut says nothing about its license: each is compressed
    alone and with every template as raw dictionary, and the largest `saving`, the share of bytes spared, wins; savings within 0.1 of it are told apart by
    wording. `next_saving` is that of the best other license. The winner is confirmed if it spares enough, no word differs from the template but by
    `variations` (pairs per license, "" for all), and no word of the clause before takes it back.
    `differences` lists words missing (-), in between (+), or denying (+).

    Null and empty texts have no blocks. Null and repeated doc_ids are kept as they are. An empty table gives an empty table. Start and length
    are in characters. Other columns are not read, whatever their names. Nothing is shuffled.
    """
    known, varied = tuple((n, tuple(t)) for n, t in templates.items()), tuple((n, tuple(v)) for n, v in variations.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(known, varied)
        for batch in batches:
            rows = []
            for doc_id, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc_id, i, at, len(block), block, *result) for i, (at, block, result) in enumerate(m.notices(said))]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[f.split()[0] for f in FOUND.split(", ")])

    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return texts.where(F.col("text").rlike(markers_of(t for ts in templates.values() for t in ts))).mapInArrow(run, FOUND)


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all `documents`."""
    return scan(table(spark, sf_dir, "documents"))
