"""License scans by patience alignment.

A template and a text are aligned on the words that both have exactly once: of these anchors the longest increasing
subsequence stands, and the gaps between them are aligned in the same way; gaps without such words take a plain longest
common subsequence, whatever their size. Coverage is the share of the template's words that are aligned.

Copies that stand side by side are told apart before they are aligned: the window that first has enough of the template,
grown over what follows densely, is one copy, and the next copy starts where the next such window does.

A template of n words with at least the share `least` aligned has one of any floor((1 - least) n) + 1 of its words in
the text. So only places around the rarest of its words are aligned, and texts without any are left at once; both are
exact.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacework.llm import worker

LEAST = 0.8
WORD = re.compile(r"[^\W_]+")

#: Fixed texts: short notices and well-known clauses of public licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}

#: Fixed list of words that are common in any English text; they are chosen last as seeds.
COMMON = frozenset("a above and any any appear are at be by can copies copy conditions fee file following for form forms free general granted if in is it list met must no not notice of one or person purpose public rights source terms that the this to under use version was with without work you".split())


#: Whole texts of public licenses, a table beside this module.
TEXTS = Path(__file__).with_name("license_texts.txt")


def license_texts(path: str | Path = TEXTS) -> dict[str, str]:
    """name -> text of a file in which "== name" starts a text; lines before the first are left out."""
    parts = re.split(r"^== (.+)\n", Path(path).read_text(encoding="utf-8"), flags=re.M)
    return dict(zip(parts[1::2], parts[2::2], strict=True))


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _masks(words: list[str]) -> dict[str, int]:
    """word -> the bits of its places"""
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _step(row: int, mask: int) -> int:
    """The next row of the bit-parallel longest common subsequence: the zeros among the lowest k bits count what the first
    k words have in common with the text so far."""
    hit = row & mask
    return (row + hit) | (row - hit)


def _plain(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places."""
    n, m = len(a), len(b)
    masks, full = _masks(a[::-1]), (1 << n) - 1
    # rows[j]: of a and b[j:], both from their ends.
    rows = [full] * (m + 1)
    for j in range(m - 1, -1, -1):
        mask = masks.get(b[j])
        rows[j] = _step(rows[j + 1], mask) & full if mask else rows[j + 1]
    best = lambda i, j: (~rows[j] & ((1 << (n - i)) - 1)).bit_count()
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best(i + 1, j) >= best(i, j + 1):
            i += 1
        else:
            j += 1
    return out


def increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing subsequence of distinct values, by patience piles."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        pile = bisect.bisect_left(tops, v)
        before.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            ends.append(k)
        else:
            tops[pile], ends[pile] = v, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both. The stack holds the gaps still open."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, n, j, m = gaps.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i >= n or j >= m:
            continue
        once = {w for w, k in Counter(b[j:m]).items() if k == 1}
        count = Counter(a[i:n])
        at = {w: i + k for k, w in enumerate(a[i:n])}
        shared = [(q, at[b[q]]) for q in range(j, m) if b[q] in once and count[b[q]] == 1]
        chain = [shared[k] for k in increasing([p for _, p in shared])]
        if not chain:
            out += [(i + x, j + y) for x, y in _plain(a[i:n], b[j:m])]
            continue
        for q, p in chain:
            out.append((p, q))
            gaps.append((i, p, j, q))
            i, j = p + 1, q + 1
        gaps.append((i, n, j, m))
    return sorted(out)


@dataclass(frozen=True)
class Found:
    name: str
    coverage: float
    start: int
    end: int


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.templates = {name: w for name, w in self.templates.items() if w}
        self.masks = {name: (_masks(w), _masks(w[::-1])) for name, w in self.templates.items()}
        self.seeds: dict[str, list[tuple[str, int]]] = {}
        for name, words in self.templates.items():
            needed = int((1 - least) * len(words) + 1e-9) + 1
            rank = sorted(range(len(words)), key=lambda k, w=words: (w[k] in COMMON, -len(w[k]), k))
            for k in rank[:needed]:
                self.seeds.setdefault(words[k], []).append((name, k))
        self.filter = ahocorasick.Automaton()
        for seed in self.seeds:
            self.filter.add_word(seed, seed)
        self.filter.make_automaton() if self.seeds else None

    def scan(self, text: str) -> list[Found]:
        """The best places of each template that don't overlap, by start and then by name."""
        if not self.seeds or next(self.filter.iter(text.lower()), None) is None:
            return []
        places = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        regions: dict[str, list[list[int]]] = {}
        for at, w in enumerate(words):
            for name, k in self.seeds.get(w, ()):
                n = len(self.templates[name])
                slack = n // 2 + 2
                a, b = max(0, at - k - slack), min(len(words), at + n - k + slack)
                found = regions.setdefault(name, [])
                if found and a < found[-1][1] and b - found[-1][0] <= 4 * n + 8 * slack:
                    found[-1][1] = max(found[-1][1], b)
                else:
                    found.append([a, b])
        out = []
        for name, found in regions.items():
            template = self.templates[name]
            n, taken = len(template), -1
            slack = n // 2 + 2
            for a, b in found:
                at = max(a, taken + 1)
                while (first := self._window(name, words, at, b)) is not None:
                    start, end = first
                    # This copy and the next one may end behind the region; what the next one needs is not for this one.
                    end = self._grown(name, words, start, end, min(len(words), end + n + slack))
                    after = self._window(name, words, end, min(len(words), max(b, end) + n + slack))
                    stop = max(b, end) if after is None else min(max(b, end), after[0])
                    wide = _tight([(i, at + j) for i, j in align(template, words[at:stop])], n, self.least)
                    close = _tight([(i, start + j) for i, j in _plain(template, words[start:end])], n, self.least)
                    pairs = close if len(close) > len(wide) else wide
                    if not pairs:
                        at = start + 1
                        continue
                    out.append(Found(name, len(pairs) / n, places[pairs[0][1]][0], places[pairs[-1][1]][1]))
                    taken, at = pairs[-1][1], pairs[-1][1] + 1
        return sorted(out, key=lambda x: (x.start, x.name))

    def _window(self, name: str, words: list[str], at: int, stop: int) -> tuple[int, int] | None:
        """Of the windows of words[at:stop] that have enough of a template in order, the first to end, as short as it can be."""
        n = len(self.templates[name])
        full, least = (1 << n) - 1, max(1, math.ceil(self.least * n - 1e-9))
        ahead, back = self.masks[name]
        row = full
        for end in range(at, stop):
            mask = ahead.get(words[end])
            if mask:
                row = _step(row, mask) & full
                if n - row.bit_count() >= least:
                    break
        else:
            return None
        row = full
        for start in range(end, at - 1, -1):
            mask = back.get(words[start])
            if mask:
                row = _step(row, mask) & full
                if n - row.bit_count() >= least:
                    break
        return start, end + 1

    def _grown(self, name: str, words: list[str], start: int, end: int, stop: int) -> int:
        """The end of a window after the words that follow it and are more of the template, at least every other one."""
        n = len(self.templates[name])
        row = full = (1 << n) - 1
        ahead = self.masks[name][0]
        most, out = None, end
        for k in range(start, stop):
            row = _step(row, ahead.get(words[k], 0)) & full
            if k + 1 >= end:
                score = 2 * (n - row.bit_count()) - k
                if most is None or score > most:
                    most, out = score, k + 1
        return out


def _tight(pairs: list[tuple[int, int]], n: int, least: float) -> list[tuple[int, int]]:
    """The pairs without stray ends, if they still cover enough of the n words: an end that stands off by more than
    half a template from the rest is dropped."""
    while len(pairs) > 1 and pairs[-1][1] - pairs[-2][1] > n // 2 + 2:
        pairs = pairs[:-1]
    while len(pairs) > 1 and pairs[1][1] - pairs[0][1] > n // 2 + 2:
        pairs = pairs[1:]
    return pairs if pairs and len(pairs) >= least * n - 1e-9 else []


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each template (notices, clauses and whole texts, if none are given) found in a row of df: (id_col, license, coverage double, start, end). Offsets count code
    points, the end is exclusive.

    A null or empty text has none; null and repeated ids stay as they are; other columns are not looked at. Texts are
    scanned whole where they are read; there is no shuffle.
    """
    templates = TEMPLATES | license_texts() if templates is None else templates
    schema = T.StructType([df.schema[id_col], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for x in scanner.scan(text.as_py() or ""):
                    ids.append(doc)
                    found.append(x)
            columns = [pa.array(ids, batch.schema.field(0).type), pa.array([x.name for x in found], pa.string()), pa.array([x.coverage for x in found], pa.float64()), pa.array([x.start for x in found], pa.int64()), pa.array([x.end for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(worker.tasks_of("licenses", run), schema)
