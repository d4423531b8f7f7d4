"""Licence scan: a trained paragraph classifier whose findings are confirmed by templates.

Words are runs of letters and digits, lower-cased, so marks and comment signs do
not matter.  Paragraphs are lines, and runs of words over several lines up to a
blank one that hold most n-grams of a template, which is how wrapped notices
look.  A paragraph is a sparse bag of hashed word uni- and bigrams.  A
multinomial logistic regression, trained with numpy on sparse rows, tells licence
families and an unknown class apart.  Family examples are made from the templates
by rule (words dropped, other words around them); unknown examples are paragraphs
of a bounded sample of the corpus, and sentences that name a licence without
granting it, also made by rule.  A paragraph counts, as its most probable family,
from a probability of not being unknown on that is calibrated on held-out unknown
examples.  A finding also needs a template of that
family most of whose word trigrams it contains.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import in_arrow
from .textkit import Words, blocks, mix, utf8, words

# Names of licences, as grants use them, and customary wordings of their notices.
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("the MIT License", "the MIT license (MIT)"),
    "apache": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"),
    "gpl": ("the GNU General Public License, version 3", "the GNU General Public License, version 2 or later", "the GNU GPL v3", "GPL-3.0"),
    "lgpl": ("the GNU Lesser General Public License, version 3", "the GNU LGPL v2.1", "LGPL-2.1"),
    "agpl": ("the GNU Affero General Public License, version 3", "AGPL-3.0"),
    "bsd": ("the BSD 3-Clause License", "the BSD 2-Clause License", "the BSD license", "BSD-3-Clause"),
    "isc": ("the ISC License",),
    "mpl": ("the Mozilla Public License, v. 2.0", "MPL-2.0"),
    "cc-by": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc0": ("CC0 1.0 Universal", "the CC0 1.0 Universal Public Domain Dedication"),
}
IDS: dict[str, tuple[str, ...]] = {
    "mit": ("MIT",), "apache": ("Apache-2.0",), "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"), "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "isc": ("ISC",), "mpl": ("MPL-2.0",), "cc-by": ("CC-BY-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc0": ("CC0-1.0",),
}
TAGS = ("SPDX-License-Identifier: {}", "License: {}")
GRANTS = ("Licensed under {}.", "Released under {}.", "Distributed under the terms of {}.", "This work is licensed under {}.", "This project is licensed under {} - see the LICENSE file.", "This software is made available under the terms of {}.")
BODIES: dict[str, tuple[str, ...]] = {
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
}
MENTIONS = (
    "This project is not released under {}.", "This work is not licensed under {}.", "It is no longer distributed under the terms of {}.", "We never licensed the code under {}.", "Nothing here is licensed under {}.",
    "Software under {} is common.", "The article compares {} with other licences.", "Many projects chose {} in that year.", "What does {} say about patents?", "Authors who dislike {} often choose another licence.", "A court had to interpret {} for the first time.",
    "The question is whether it was released under {} or not.", "Unlike code licensed under {}, this may not be copied.",
)


def _templates() -> dict[str, tuple[str, ...]]:
    """Bodies, every grant with every name of a family, and every tag with every identifier."""
    return {f: (*BODIES.get(f, ()), *(g.format(n) for g in GRANTS for n in names), *(t.format(i) for t in TAGS for i in IDS[f])) for f, names in NAMES.items()}


TEMPLATES = _templates()
UNKNOWN = "unknown"
FEATURES = 1 << 14
SAMPLE = 4000
"""Paragraphs of the corpus that the unknown class is trained and calibrated on, at most."""
CONFIRM = 0.6
"""Least share of a template's word trigrams in a paragraph."""
FRAGMENT = 0.5
"""Share of a line's word trigrams in templates from which it is taken for a piece of a notice, not for an unknown example."""
COMMON = 4
"""An n-gram in the templates of so many families tells nothing and confirms nothing."""
FALSE_COST = 4.0
"""What a false finding costs, in the calibration, against a missed notice."""
STEPS = 150
VARIANTS = 8

_U = np.uint64
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[10] = 10
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PLAIN[_low:_high] = np.arange(_low, _high)


def _bags(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: row, feature and weight of every distinct feature, rows scaled to length 1."""
    pairs, at = found.ngrams(2)
    row = found.row()
    key = np.concatenate([row, row[at]]) * FEATURES + (np.concatenate([mix(found.hash ^ _U(1)), pairs]) % _U(FEATURES)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    row, feature = key // FEATURES, key % FEATURES
    norm = np.sqrt(np.bincount(row, count.astype(float) ** 2, minlength=1))
    return row, feature, count / norm[row]


def _words(lines: Sequence[str]) -> Words:
    parts = [x.encode() for x in lines]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts]))
    return words(_PLAIN[data], offsets, lower=True)


def _grams(templates: dict[str, tuple[str, ...]]) -> list[tuple[int, np.ndarray, int]]:
    """Of every template: family (by name), its telling n-grams and their length, 3 words where it has as many."""
    out = []
    for family, name in enumerate(sorted(templates)):
        for t in templates[name]:
            found = _words([t])
            n = min(3, int(found.counts[0]))
            if n:
                out.append((family, np.unique(found.ngrams(n)[0]), n))
    owned = [np.unique(np.concatenate([g for f, g, _ in out if f == i])) for i in {f for f, _, _ in out}]
    gram, count = np.unique(np.concatenate([np.zeros(0, _U), *owned]), return_counts=True)
    return [(f, own, n) for f, g, n in out if len(own := g[~np.isin(g, gram[count >= COMMON])])]


def _some(found: Words, begin: int, end: int) -> Words:
    return Words(found.start[begin:end], found.end[begin:end], found.hash[begin:end], np.array([0, end - begin]))


def _confirmed(one: Words, grams: list[tuple[int, np.ndarray, int]]) -> bool:
    own = {n: one.ngrams(n)[0] for n in {n for _, _, n in grams}}
    return any(np.isin(g, own[n]).mean() >= CONFIRM for _, g, n in grams)


def _pieces(found: Words, grams: list[tuple[int, np.ndarray, int]]) -> np.ndarray:
    """Whether a template confirms a row, or most of a row's word trigrams are those of templates: no example of the unknown class."""
    value, at = found.ngrams(3)
    row, size = found.row()[at], len(found.first) - 1
    hit = np.isin(value, np.concatenate([np.zeros(0, _U), *(g for _, g, n in grams if n == 3)]))
    many = np.bincount(row[hit], minlength=size)
    out = many >= np.maximum(1, FRAGMENT * np.bincount(row, minlength=size))
    for i in np.flatnonzero(~out & (many > 0)):
        out[i] = _confirmed(_some(found, found.first[i], found.first[i + 1]), grams)
    return out


@dataclass(frozen=True)
class Scanner:
    families: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    threshold: float

    def odds(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probabilities of each distinct row, in order; ``row`` is sorted."""
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
        if not len(start):
            return np.zeros((0, len(self.bias)))
        logits = np.add.reduceat(self.weights[feature] * value[:, None], start) + self.bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)


def _variants(text: str, filler: Sequence[str], rng: np.random.Generator) -> list[str]:
    """The text itself, and with words dropped or other words around it."""
    parts, out = text.split(), [text]
    for _ in range(VARIANTS):
        kept = [w for w in parts if rng.random() > 0.08] or parts
        before, after = (" ".join(rng.choice(filler, rng.integers(0, 9))) if len(filler) else "" for _ in range(2))
        out.append(f"{before} {' '.join(kept)} {after}")
    return out


def _sampled(grams: list[tuple[int, np.ndarray, int]]):
    """Bags of the drawn lines that are no piece of a notice, and one of their words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("line"))
            found = words(_PLAIN[data], offsets, lower=True)
            row, feature, value = _bags(found)
            use = np.flatnonzero((found.counts > 0) & ~_pieces(found, grams))
            cut = np.searchsorted(row, np.arange(len(batch) + 1))
            features = [feature[cut[i] : cut[i + 1]] for i in use]
            values = [value[cut[i] : cut[i + 1]] for i in use]
            one = [int(found.first[i] + found.hash[found.first[i]] % _U(found.counts[i])) for i in use]
            word = [data[found.start[k] : min(found.end[k], found.start[k] + 40)].tobytes().decode("utf-8", "ignore") for k in one]
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(use)), pa.array(features, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(word, pa.string())], names=["h", "features", "weights", "word"])

    return task


def train(docs: DataFrame, text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, seed: int = 5) -> Scanner:
    """Fits the classifier; ``SAMPLE`` different lines, those of the least hashes, stand for the unknown class.

    Different lines are counted first, so that little more than the sample leaves the
    tasks, and it leaves them as bags of at most ``FEATURES`` numbers a line.
    """
    lines = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    lines = lines.select("line", F.xxhash64("line").alias("h"))
    different = lines.agg(F.approx_count_distinct("h", 0.01)).first()[0]
    share = min(1.0, 1.5 * SAMPLE / max(1, different))
    some = lines.where(F.pmod("h", F.lit(1 << 32)) < int(share * (1 << 32))).groupBy("h").agg(F.min("line").alias("line"))  # copies of a line count once
    drawn = in_arrow(some, _sampled(_grams(templates)), "h bigint, features array<int>, weights array<double>, word string")
    sample = drawn.orderBy(F.pmod("h", F.lit(1 << 32)), "h").limit(SAMPLE).collect()
    rng = np.random.default_rng(seed)
    families = tuple(sorted(templates))
    filler = sorted({r["word"] for r in sample if r["word"]})
    each = [(_variants(t, filler, rng), i) for i, f in enumerate(families) for t in templates[f]]
    examples = [(v, i) for own, i in each for v in own[:-2]]
    held_grants = [v for own, _ in each for v in own[-2:]]
    mentions = [v for m in MENTIONS for own in NAMES.values() for n in own for v in _variants(m.format(n), filler, rng)[:3]]
    order = rng.permutation(len(mentions))
    fit = [mentions[i] for i in order[::2]]
    held = [mentions[i] for i in order[1::2]]

    def stack(texts: list[str], rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, feature, value = _bags(_words([*texts, "-"])) if texts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        more = np.repeat(np.arange(len(rows)) + len(texts), [len(r["features"]) for r in rows]).astype(np.int64)
        flat = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.array(r[name], kind) for r in rows)])
        return np.append(row, more), np.append(feature, flat("features", np.int64)), np.append(value, flat("weights", float))

    row, feature, value = stack([e for e, _ in examples] + fit, sample[::2])
    y = np.array([i for _, i in examples] + [len(families)] * (len(fit) + len(sample[::2])))
    importance = 1 / np.bincount(y, minlength=len(families) + 1)[y]
    importance /= importance.sum()
    weights, bias = np.zeros((FEATURES, len(families) + 1)), np.zeros(len(families) + 1)
    scanner = Scanner(families, weights, bias, 0.5)
    by = np.argsort(feature, kind="stable")
    used, first = np.unique(feature[by], return_index=True)
    pace, pace0 = np.full((len(used), len(bias)), 1e-12), np.full(len(bias), 1e-12)
    truth = np.eye(len(bias))[y]
    for _ in range(STEPS):
        error = (scanner.odds(row, feature, value) - truth) * importance[:, None]
        slope = np.add.reduceat(error[row[by]] * value[by][:, None], first) + 1e-6 * weights[used]
        pace += slope**2
        weights[used] -= slope / np.sqrt(pace)
        pace0 += error.sum(0) ** 2
        bias -= 0.3 * error.sum(0) / np.sqrt(pace0)
    wrong, right = (np.sort(1 - scanner.odds(*stack(texts, rows))[:, -1]) for texts, rows in ((held, sample[1::2]), (held_grants, [])))
    levels = np.linspace(0.2, 0.95, 76)
    miss, false = np.searchsorted(right, levels) / max(len(right), 1), 1 - np.searchsorted(wrong, levels) / max(len(wrong), 1)
    return Scanner(families, weights.astype(np.float32), bias, float(levels[(miss + FALSE_COST * false).argmin()]))


def _blocks_of_lines(found: Words, doc: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words by blocks of lines without a blank one between them, and the line of each word."""
    line = found.row()
    full = found.counts > 0
    fresh = np.append(True, ~full[:-1] | (doc[1:] != doc[:-1]))
    block = (np.cumsum(fresh) - 1)[line]
    first = np.append(0, np.cumsum(np.bincount(block, minlength=int(fresh.sum()))))
    return Words(found.start, found.end, found.hash, first), line


def _scan(scanner: Scanner, templates: dict[str, tuple[str, ...]]):
    grams = _grams(templates)
    sizes = sorted({n for _, _, n in grams})
    every = {n: np.unique(np.concatenate([g for _, g, m in grams if m == n])) for n in sizes}

    def runs(joined: Words, line: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Family and word range of every template most of whose n-grams lie over two or more lines of a block."""
        block = joined.row()
        for n in sizes:
            value, at = joined.ngrams(n)
            hit = np.flatnonzero(np.isin(value, every[n]))
            if not len(hit):
                continue
            for f, g, m in grams:
                if m != n:
                    continue
                mine = hit[np.isin(value[hit], g)]
                if len(mine) < CONFIRM * len(g):
                    continue
                reach, seen, begin, last = 2 * (len(g) + n), set(), -1, -1
                for word, gram in [*zip(at[mine].tolist(), value[mine].tolist()), (-1, 0)]:
                    enough = len(seen) >= CONFIRM * len(g)
                    if seen and (word < 0 or block[word] != block[begin] or word - last > reach or enough and gram in seen):
                        if enough and line[begin] != line[last + n - 1]:
                            yield f, begin, last + n
                        seen = set()
                    if not seen:
                        begin = word
                    seen.add(gram)
                    last = word

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            total = np.zeros(len(batch), np.int64)
            names: list[list[str]] = [[] for _ in range(len(batch))]
            best = np.zeros(len(batch))
            for a, b in blocks(offsets):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                lines = np.union1d(cuts, np.flatnonzero(part == 10))
                found = words(_PLAIN[part], lines, lower=True)
                doc = np.searchsorted(cuts, lines[:-1], "right") - 1
                mark = np.append(0, np.cumsum((part > 32) | (part < 9) | ((part > 13) & (part < 32))))
                total[a:b] += np.bincount(doc[mark[lines[1:]] > mark[lines[:-1]]], minlength=b - a)
                if not len(found.hash):
                    continue
                row, feature, value = _bags(found)
                line = np.unique(row)
                odds = scanner.odds(row, feature, value)
                top = odds[:, :-1].argmax(1)
                alone = set()
                for k in np.flatnonzero(1 - odds[:, -1] >= scanner.threshold):
                    at = int(line[k])
                    if _confirmed(_some(found, found.first[at], found.first[at + 1]), [g for g in grams if g[0] == top[k]]):
                        names[a + doc[at]].append(scanner.families[top[k]])
                        best[a + doc[at]] = max(best[a + doc[at]], 1 - odds[k, -1])
                        alone.add((int(top[k]), at))
                joined, of = _blocks_of_lines(found, doc)
                for family, begin, end in runs(joined, of):
                    spanned = [(family, i) for i in range(of[begin], of[end - 1] + 1)]
                    odds = scanner.odds(*_bags(_some(joined, begin, end)))[0]
                    if alone.isdisjoint(spanned) and odds[:-1].argmax() == family and 1 - odds[-1] >= scanner.threshold:
                        at = a + doc[of[begin]]
                        names[at].append(scanner.families[family])
                        best[at] = max(best[at], 1 - odds[-1])
                        alone.update(spanned)
            found_lists = pa.array([sorted(set(x)) for x in names], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(total), pa.array([len(x) for x in names], pa.int64()), found_lists, pa.array(best)], names=["doc", "n_paragraphs", "n_licensed", "families", "score"])

    return task


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, columns: Sequence[str] | None = None, scanner: Scanner | None = None) -> DataFrame:
    """``doc`` (a struct of ``columns``, by default all), ``n_paragraphs``, ``n_licensed``, ``families`` (sorted, distinct) and the best ``score``.

    A null text has no paragraph.  Paragraphs of no family are unknown and not
    listed.  ``n_licensed`` counts paragraphs (lines) and notices wrapped over
    several lines, each of which counts once.  Of families with equal
    probability the first by name counts; repeated rows get equal results.
    Without a ``scanner``, one is trained on the documents themselves.
    """
    scanner = scanner or train(docs, text_col, templates)
    columns = list(columns or docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(text_col).alias("text"))
    fields = T._parse_datatype_string("n_paragraphs bigint, n_licensed bigint, families array<string>, score double").fields
    return in_arrow(rows, _scan(scanner, templates), T.StructType([rows.schema["doc"], *fields]))
