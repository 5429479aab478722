"""License scan by conditional compression.

Passages around license words are candidate blocks. A block is compressed on its own and with each template as zstandard
raw-content dictionary; templates are ranked by how much smaller the block gets for the bytes that the template has. The
winners are then confirmed by the exact wording: the words that the block adds to or leaves out of the template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import zstandard

from . import compression
from .common import filled

# Public wording of notices and licenses, without names and years.
_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
    "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
    "otherwise arising from out of or in connection with the software or the use or other dealings in the software")
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed")
_BSD_TWO = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
    "distribution")
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
            "permit persons to whom the software is furnished to do so subject to the following conditions the above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "software " + _WARRANTY),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in "
                   "compliance with the license you may obtain a copy of the license at "
                   "http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing "
                   "software distributed under the license is distributed on an as is basis without warranties or "
                   "conditions of any kind either express or implied see the license for the specific language governing "
                   "permissions and limitations under the license"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                "public license as published by the free software foundation either version 3 of the license or at your "
                "option any later version"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                "public license as published by the free software foundation either version 2 of the license or at your "
                "option any later version"),
    ("LGPL-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
                 "general public license as published by the free software foundation either version 2.1 of the license "
                 "or at your option any later version"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was "
                "not distributed with this file you can obtain one at"),
    ("BSD-2-Clause", _BSD_TWO + " " + _BSD_END),
    ("BSD-3-Clause", _BSD_TWO + " neither the name of the copyright holder nor the names of its contributors may be used "
                     "to endorse or promote products derived from this software without specific prior written permission "
                     + _BSD_END),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("CC0-1.0", "licensed under cc0 1.0 universal"),
)
#: Words that make a passage a candidate.
SIGNS = r"licen[cs]ed?\b|copyright|permission|redistribut|public domain|creative commons|free software"
#: A sign has two blocks: one that reaches the longest template of up to NOTICE words on both sides of it, one that reaches
#: the longest of all. Wide blocks that touch are one, cut at BLOCK_WORDS with an overlap of the longest template.
NOTICE, BLOCK_WORDS = 20, 640
#: Compression level: the best matches count, and blocks are few.
LEVEL = 19
#: The least size reduction of a template whose wording is compared, as a share of its own compressed size (templates that
#: must stand word for word are always looked up); the most differences per word of the template.
REDUCTION, DIFFERENCES = 0.1, 0.08

_WORD = re.compile(r"[0-9A-Za-z]+(?:\.[0-9A-Za-z]+)*")
_SIGN = re.compile(rf"(?i)\b(?:{SIGNS})")


@dataclass(frozen=True)
class Found:
    name: str
    start: int
    end: int
    reduction: float
    added: str
    missing: str
    differences: int
    agreed: int  # words of the template less differences


def aligned(words: list[str], block: list[str], start: int, allowed: int,
            past: int = 0) -> tuple[int, int, list[str], list[str]] | None:
    """The place (from, to) in the block from ``past`` on, with words added and missing, where the template differs least,
    at most ``allowed`` from a copy that begins at ``start``. None if it differs in more words."""
    end = start + len(words)
    if start >= past and block[start:end] == words:
        return start, end, [], []
    if not allowed:
        return None
    # cost[i][k]: least differences of the first i words from words of the block that end at start - allowed + i + k.
    width, none = 2 * allowed + 1, len(words) + len(block)
    base = start - allowed
    cost = [[0 if past <= base + k <= len(block) else none for k in range(width)]]
    for i, word in enumerate(words, 1):
        above, row = cost[-1], []
        for k in range(width):
            j = base + i + k
            best = none
            if past <= j <= len(block):
                if j > past and block[j - 1] == word:
                    best = above[k]
                if k + 1 < width:
                    best = min(best, above[k + 1] + 1)
                if k and j > past:
                    best = min(best, row[k - 1] + 1)
            row.append(best)
        cost.append(row)
        if min(row) > allowed:
            return None
    k = max(range(width), key=lambda k: (-cost[-1][k], k))
    i, added, missing, used, between = len(words), [], [], [], []
    while i:
        j = base + i + k
        if j > past and block[j - 1] == words[i - 1] and cost[i][k] == cost[i - 1][k]:
            used.append(j - 1)
            added += between
            between, i = [], i - 1
        elif k + 1 < width and cost[i][k] == cost[i - 1][k + 1] + 1:
            missing.append(words[i - 1])
            i, k = i - 1, k + 1
        else:
            if used:
                between.append(block[j - 1])
            k -= 1
    return used[-1], used[0] + 1, added[::-1], missing[::-1]


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words = [t.split() for _, t in templates]
        self.allowed = [int(len(w) * DIFFERENCES) for w in self.words]
        # The allowed differences leave a run of so many words whole; where such runs stand in the template.
        self.runs = [-(-(len(w) - d) // (d + 1)) for w, d in zip(self.words, self.allowed)]
        self.anchors: list[dict[tuple[str, ...], list[int]]] = []
        for words, run in zip(self.words, self.runs):
            at: dict[tuple[str, ...], list[int]] = {}
            for i in range(len(words) - run + 1):
                at.setdefault(tuple(words[i:i + run]), []).append(i)
            self.anchors.append(at)
        self.made = compression.compressors({str(i): t.encode() for i, (_, t) in enumerate(templates)}, level=LEVEL)
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.own = [len(self.alone.compress(t.encode())) for _, t in templates]
        # Words that a template takes up with its most differences.
        widths = [len(w) + d for w, d in zip(self.words, self.allowed)]
        self.reach = max(widths)
        self.notice = max((n for n, w in zip(widths, self.words) if len(w) <= NOTICE), default=0)

    def blocks(self, text: str) -> list[list[tuple[str, int, int]]]:
        """Words (lower case, start, end) of the passages around signs."""
        signs = [m.start() for m in _SIGN.finditer(text)]
        if not signs:
            return []
        words = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
        out = []
        for reach in (self.notice, self.reach):
            ranges: list[list[int]] = []
            at = 0
            for sign in signs:
                while at < len(words) and words[at][2] <= sign:
                    at += 1
                low, high = max(0, at - reach), min(len(words), at + reach)
                if ranges and low <= ranges[-1][1] and reach == self.reach:
                    ranges[-1][1] = max(high, ranges[-1][1])
                else:
                    ranges.append([low, high])
            step = BLOCK_WORDS - self.reach
            for low, high in ranges:
                out += [words[i:min(i + BLOCK_WORDS, high)] for i in range(low, max(low + 1, high - self.reach), step)]
        return out

    def ranked(self, block: list[str]) -> list[tuple[float, int]]:
        """(size reduction as a share of what the template could save, template), the largest first."""
        data = " ".join(block).encode()
        plain = len(self.alone.compress(data))
        size = compression.compressed_sizes(data, self.made, block=1 << 20)
        gains = sorted(((plain - size[str(i)]) / self.own[i], -i) for i in range(len(self.names)))
        return [(g, -i) for g, i in reversed(gains)]

    def compared(self, block: list[str], template: int) -> list[tuple[int, int, list[str], list[str]]]:
        """Every place (from, to) in the block where the template stands, with the words added and missing.

        A copy holds a run of the template; it is aligned within the allowed differences of where the run puts it.
        """
        words, allowed, run = self.words[template], self.allowed[template], self.runs[template]
        out: list[tuple[int, int, list[str], list[str]]] = []
        past, failed = 0, set()
        for j in range(len(block) - run + 1):
            for i in self.anchors[template].get(tuple(block[j:j + run]), ()):
                if j < past:
                    break
                if j - i not in failed:
                    hit = aligned(words, block, j - i, allowed, past)
                    if hit:
                        out.append(hit)
                        past = hit[1]
                    else:
                        failed.add(j - i)
        return out

    def scan(self, text: str) -> tuple[int, list[Found]]:
        """Number of candidate blocks, and the confirmed licenses in order of place; where several templates stand at
        one place, the one that agrees in most words counts, with the fewest differences."""
        blocks = self.blocks(text)
        found: set[Found] = set()
        for block in blocks:
            words = [w for w, _, _ in block]
            for gain, i in self.ranked(words):
                if gain < REDUCTION and self.allowed[i]:
                    continue
                for low, high, added, missing in self.compared(words, i):
                    span = (block[low][1], block[high - 1][2])
                    n = len(added) + len(missing)
                    found.add(Found(self.names[i], *span, round(gain, 6), " ".join(added), " ".join(missing), n,
                                    len(self.words[i]) - n))
        kept: list[Found] = []
        for f in sorted(found, key=lambda f: (-f.agreed, f.differences, f.start - f.end, f.start, f.name, -f.reduction)):
            if all(f.end <= k.start or f.start >= k.end for k in kept):
                kept.append(f)
        return len(blocks), sorted(kept, key=lambda f: f.start)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, licenses, spans, differences for every whole text.

    ``licenses``: names found, sorted, comma-joined, each once; ``spans``: name:start:end in code points, end exclusive,
    by place; ``differences``: words that the text adds (+) or leaves out (-), by span, joined by "|". Null text is
    empty; without a license all three are empty. Repeated rows come out alike. Only texts with a sign go to Python.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    text = filled("text")
    rows = docs.select("doc_id", F.when(text.rlike(rf"(?i)\b(?:{SIGNS})"), text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch, texts in compression.each_text(batches):
            out = [scanner.scan(t) if t else (0, []) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([n for n, _ in out], pa.int64()),
                pa.array([",".join(sorted({f.name for f in fs})) for _, fs in out], pa.string()),
                pa.array([",".join(f"{f.name}:{f.start}:{f.end}" for f in fs) for _, fs in out], pa.string()),
                pa.array(["|".join(f"+{f.added} -{f.missing}" for f in fs if f.added or f.missing) for _, fs in out],
                         pa.string())], names=["doc_id", "n_blocks", "licenses", "spans", "differences"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_blocks long, licenses string, spans string, differences string")
