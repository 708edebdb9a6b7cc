"""License scans by patience alignment (operator 8).

Words that occur once in the text and once in a template are anchors; the
longest increasing subsequence of anchors is kept, and the gaps between them are aligned
the same way.  A gap without anchors, of any size, is aligned by longest common subsequence.
Coverage is the share of the template's words that find a partner.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh_name
from .textops import as_bytes, separator_table, word_hashes

MIN_COVERAGE = 0.8
GAP_CELLS = 250_000    # gaps of more cells, words times words, are halved before they are aligned
BATCH_TEXTS = 256

# Public notices and license texts that are looked for.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
}

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SEPARATORS = separator_table(bytes(c for c in range(128) if not chr(c).isalnum()))


def words_of(text: bytes) -> list[bytes]:
    return [w.lower() for w in _WORD.findall(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first number) in which the second grows."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        i = bisect_left(tails, j)
        back.append(at[i - 1] if i else -1)
        tails[i:i + 1] = [j]
        at[i:i + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``, in one row of memory."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        # a place takes the best of the same place above and the match before it, then of all places to its left
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Longest common subsequence as pairs of places.

    A large gap is halved: the place of ``b`` where the two halves of ``a`` meet
    best splits it into two smaller ones, in memory linear in its words.
    """
    ids = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    left, right = (np.array([ids[w] for w in ws], dtype=np.int64) for ws in (a, b))
    out, parts = [], [(0, len(a), 0, len(b))]
    while parts:
        i, j, k, m = parts.pop()
        if (j - i) * (m - k) <= GAP_CELLS or j - i < 2:
            out += [(i + x, k + y) for x, y in _common_table(a[i:j], b[k:m])]
            continue
        mid = (i + j) // 2
        ahead = _common_lengths(left[i:mid], right[k:m])
        behind = _common_lengths(left[mid:j][::-1], right[k:m][::-1])[::-1]
        cut = k + int(np.argmax(ahead + behind))
        parts += [(i, mid, k, cut), (mid, j, cut, m)]
    return sorted(out)


def _common_table(a: list, b: list) -> list[tuple[int, int]]:
    """The same from a table of all cells, for small gaps and for a single word."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, both increasing."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once: dict = {}
        for i in range(a, b):
            once[text[i]] = -1 if text[i] in once else i
        there: dict = {}
        for j in range(c, d):
            there[template[j]] = -1 if template[j] in there else j
        anchors = _increasing(sorted((once[w], j) for w, j in there.items() if j >= 0 and once.get(w, -1) >= 0))
        if not anchors:
            out += [(a + i, c + j) for i, j in _common(text[a:b], template[c:d])]
            continue
        out += anchors
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


class Templates:
    """Templates as words, with the vocabulary that decides which texts can reach the coverage."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE):
        self.names = sorted(templates)
        self.words = [words_of(templates[k].encode()) for k in self.names]
        self.min_coverage = min_coverage
        vocabulary = sorted({w for ws in self.words for w in ws})
        place = {w: i for i, w in enumerate(vocabulary)}
        _, _, hashes = next(iter(word_hashes([b" ".join(vocabulary)], _SEPARATORS)))
        order = np.argsort(hashes)
        self.hashes, self.place = hashes[order], order
        self.weight = np.zeros((len(vocabulary), len(self.names)))
        for t, ws in enumerate(self.words):
            for w in ws:
                self.weight[place[w], t] += 1 / len(ws)

    def reachable(self, texts: list[bytes]):
        """(text, template) pairs in which the text has enough of the template's words; a bound on the coverage."""
        for at, offsets, hashes in word_hashes(texts, _SEPARATORS):
            near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[near] == hashes)
            doc = np.searchsorted(offsets, hit, side="right") - 1
            present = np.zeros((len(offsets) - 1, len(self.hashes)), dtype=bool)
            present[doc, self.place[near[hit]]] = True
            for d, t in zip(*np.nonzero(present @ self.weight >= self.min_coverage - 1e-9)):
                yield at + int(d), int(t)


def find_licenses(text: bytes, candidates: list[int], templates: Templates) -> list[dict]:
    """Places where a template is covered well enough, by start.

    The text is cut into overlapping stretches of twice the template's length, so
    that repeats of a notice do not hide each other's unique words; of stretches that
    overlap, the best coverage counts.
    """
    found, best = [], []
    at = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in at]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    for t in candidates:
        template = templates.words[t]
        known = set(template)
        marks = np.concatenate(([0], np.cumsum([w in known for w in words])))
        size = len(template)
        for start in range(0, max(1, len(words) - size // 2), max(1, size // 2)):
            end = min(len(words), start + 2 * size)
            if marks[end] - marks[start] < templates.min_coverage * size - 1e-9:
                continue
            pairs = align(words[start:end], template)
            if len(pairs) >= templates.min_coverage * size - 1e-9:
                a, b = start + pairs[0][0], start + pairs[-1][0] + 1
                best.append((2 * len(pairs) / (size + b - a), len(pairs), t, a, b))
    taken: list[tuple[int, int]] = []
    for _, matched, t, a, b in sorted(best, key=lambda x: (-x[0], -x[1], x[3], x[2])):
        if all(b <= c or d <= a for c, d in taken):
            taken.append((a, b))
            found.append({"license": templates.names[t], "coverage": matched / len(templates.words[t]),
                          "start": int(chars[at[a][0]]), "end": int(chars[at[b - 1][1]])})
    return sorted(found, key=lambda f: (f["start"], f["license"]))


RESULT = "array<struct<license:string,coverage:double,start:bigint,end:bigint>>"


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None,
                  min_coverage: float = MIN_COVERAGE) -> tuple[DataFrame, str]:
    """(docs with one more column, its name): array of license, coverage, start, end (code points, end exclusive).

    Empty for a null or empty text.  Every input column stays; each row is scanned alone, so repeated rows get
    equal results and an empty table stays empty.  Of overlapping places with equal scores, the one with more
    matched words, then the earlier one, then the first template by name counts.
    """
    name = fresh_name(docs.columns, "licenses")
    held = Templates(templates or TEMPLATES, min_coverage)

    def run(column: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for at in range(0, len(column), BATCH_TEXTS):
            texts = as_bytes(column.slice(at, BATCH_TEXTS))
            near: dict[int, list[int]] = {}
            for d, t in held.reachable(texts):
                near.setdefault(d, []).append(t)
            out += [find_licenses(x, near[i], held) if i in near else [] for i, x in enumerate(texts)]
        return pa.array(out, pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()),
                                                 ("start", pa.int64()), ("end", pa.int64())])))

    return docs.withColumn(name, F.arrow_udf(run, RESULT)(F.col(text).cast("string"))), name


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_licenses, licenses (names), best (highest coverage), coverage, spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked, name = scan_licenses(docs)
    found = F.col(name)
    top = F.array_max(F.transform(found, lambda x: x["coverage"]))
    names = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["license"])))
    spans = F.transform(found, lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return marked.select("doc_id", F.size(names).cast("bigint").alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
                         F.coalesce(top, F.lit(0.0)).alias("coverage"), F.array_join(spans, ",").alias("spans"))
