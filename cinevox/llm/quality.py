"""Quality rules: counts per document, and the divergence of its histograms from its language's.

The references are learnt from the corpus itself: for every non-null language,
the share of each character class over all its documents, and the shares of its
``COMMON`` most frequent words.  A document is compared with every
reference by the Jensen-Shannon distance (square root of the divergence in
bits); the nearest language counts, so a wrong or missing language tag does not
condemn a text; of equally near languages the first by name counts.  Short
documents vary by chance and are not judged by distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import Scratch, in_arrow
from .textkit import RangeHash, Words, blocks, utf8, words

COMMON = 100
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _classes() -> np.ndarray:
    """Class of each byte: a-z apart, capitals, digits, blanks, line breaks, sentence marks, other marks, lead bytes of wider characters; continuation bytes have none (-1)."""
    table = np.full(256, -1, np.int64)
    table[97:123] = np.arange(26)
    table[65:91] = 26
    table[48:58] = 27
    table[[9, 11, 12, 32]] = 28
    table[[10, 13]] = 29
    table[list(b".,;:!?'\"()-")] = 30
    rest = np.flatnonzero(table[:128] < 0)
    table[rest] = 31
    for i, (lo, hi) in enumerate(((0xC2, 0xC3), (0xC3, 0xC4), (0xC4, 0xD0), (0xD0, 0xE0), (0xE0, 0xF0), (0xF0, 0xF8))):
        table[lo:hi] = 32 + i
    return table


_CLASS = _classes()
N_CLASSES = 38


@dataclass(frozen=True)
class Rules:
    """Thresholds.  Distances lie between 0 and 1; the guards are the least sizes at which they are judged."""

    min_words: int = 20
    max_repeat_percent: int = 30
    guard_chars: int = 200
    guard_words: int = 50
    max_class_distance: float = 0.30
    max_word_distance: float = 0.50


def _histogram(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class, by row."""
    kind = _CLASS[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = kind >= 0
    return np.bincount(row[ok] * N_CLASSES + kind[ok], minlength=(len(offsets) - 1) * N_CLASSES).reshape(-1, N_CLASSES)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language: of classes (``word`` false) and of lower-cased words, by hash (``word`` true)."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        lang = batch.column("lang").dictionary_encode()
        code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.zeros((len(lang.dictionary), N_CLASSES), np.int64)
        keys, counts = [], []
        for a, b in blocks(offsets):
            part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            np.add.at(total, code[a:b], _histogram(part, cuts))
            found = words(part, cuts, lower=True)
            pair = np.stack([code[a:b][found.row()], found.hash.view(np.int64)])
            pair = pair[:, np.lexsort(pair[::-1])]
            start = np.flatnonzero(np.append(True, (pair[:, 1:] != pair[:, :-1]).any(0))[: pair.shape[1]])
            keys.append(pair[:, start])
            counts.append(np.diff(np.append(start, pair.shape[1])))
        c, k = np.nonzero(total)
        for word, key, count in ((True, np.concatenate([np.zeros((2, 0), np.int64), *keys], axis=1), np.concatenate([np.zeros(0, np.int64), *counts])), (False, np.stack([c, k]), total[c, k])):
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(key[0])), pa.array(np.full(len(count), word)), pa.array(key[1]), pa.array(count.astype(np.int64))], names=["lang", "word", "item", "n"])


@dataclass(frozen=True)
class Reference:
    """Shares of a language; ``words`` are sorted, and the last word share is that of all other words."""

    lang: str
    classes: np.ndarray
    words: np.ndarray
    shares: np.ndarray


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[Reference]:
    """Of every non-null language, from all its documents.  The result's size depends on the number of languages only."""
    source = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.save(in_arrow(source, _survey, "lang string, word boolean, item bigint, n bigint").groupBy("lang", "word", "item").agg(F.sum("n").alias("n")), "counts")
    common = counts.where("word").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))).where(F.col("place") <= COMMON)
    ranked = common.drop("place").unionByName(counts.where("not word")).collect()  # the limit is a literal, so every task sends COMMON words of a language at most
    sizes = {r["lang"]: r["n"] for r in counts.where("word").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    scratch.drop("counts")
    out = []
    for lang in sorted({r["lang"] for r in ranked}):
        own = [r for r in ranked if r["lang"] == lang]
        classes = np.zeros(N_CLASSES)
        for r in own:
            if not r["word"]:
                classes[r["item"]] = r["n"]
        common = sorted((int(np.int64(r["item"]).view(np.uint64)), r["n"]) for r in own if r["word"])
        shares = np.array([n for _, n in common] + [sizes.get(lang, 0) - sum(n for _, n in common)], float)
        out.append(Reference(lang, classes / max(classes.sum(), 1), np.array([w for w, _ in common], np.uint64), shares / max(shares.sum(), 1)))
    return out


def _distance(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the shares; 1 where a row is empty."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + share) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(share > 0, share * np.log2(share / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0)


def _repeats(found: Words) -> np.ndarray:
    """Words in 8-word windows that occur twice or more in their row, by row."""
    value, at = found.ngrams(8)
    row = found.row()
    by = np.lexsort((value, row[at]))
    same = (value[by][1:] == value[by][:-1]) & (row[at][by][1:] == row[at][by][:-1])
    twice = np.zeros(len(at), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    step = np.zeros(len(found.hash) + 9, np.int64)
    step[at[twice]] += 1
    step[at[twice] + 8] -= 1
    covered = np.append(0, np.cumsum(np.cumsum(step)[: len(found.hash)] > 0))
    return covered[found.first[1:]] - covered[found.first[:-1]]


def _line_repeats(data: np.ndarray, offsets: np.ndarray, found: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row, by row."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    starts = starts[starts < len(data)]
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[row + 1])
    filled = np.searchsorted(found.start, ends) > np.searchsorted(found.start, starts)
    starts, ends, row = starts[filled], ends[filled], row[filled]
    value = RangeHash(data).of(starts, ends)
    by = np.lexsort((value, row))
    same = (value[by][1:] == value[by][:-1]) & (row[by][1:] == row[by][:-1])
    return np.bincount(row[by][1:][same], minlength=rows)


def _judge(known: Sequence[Reference], rules: Rules, inside: str | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.unique(np.concatenate([r.words for r in known])) if known else np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = utf8(batch.column("doc").field(inside) if inside else batch.column("text"))
            size = len(batch)
            n = {k: np.zeros(size, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")}
            near = np.ones((2, size))
            best = np.full(size, -1)
            for a, b in blocks(offsets):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                found = words(part, cuts)
                sums = lambda flags: np.append(0, np.cumsum(flags))
                n["n_words"][a:b] = found.counts
                head = sums((part & 0xC0) != 0x80)
                each = np.append(0, np.cumsum(head[found.end] - head[found.start]))
                n["word_chars"][a:b] = each[found.first[1:]] - each[found.first[:-1]]
                n["n_chars"][a:b] = np.diff(head[cuts])
                n["n_symbols"][a:b] = np.diff(sums(_SYMBOL[part])[cuts])
                n["n_dup_lines"][a:b] = _line_repeats(part, cuts, found)
                n["n_repeat_words"][a:b] = _repeats(found)
                if not known:
                    continue
                classes = _histogram(part, cuts)
                value, row = words(part, cuts, lower=True).hash, found.row()
                place = np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1) if len(vocabulary) else np.zeros(len(value), np.int64)
                hit = vocabulary[place] == value if len(vocabulary) else np.zeros(len(value), bool)
                common = np.bincount(row[hit] * max(len(vocabulary), 1) + place[hit], minlength=(b - a) * max(len(vocabulary), 1)).reshape(b - a, -1)
                for i, reference in enumerate(known):
                    own = common[:, np.searchsorted(vocabulary, reference.words)] if len(reference.words) else np.zeros((b - a, 0), np.int64)
                    bins = np.column_stack([own, found.counts - own.sum(1)])
                    pair = np.stack([_distance(classes, reference.classes), _distance(bins, reference.shares)])
                    closer = (pair.sum(0) < near[:, a:b].sum(0)) | (best[a:b] < 0)
                    near[:, a:b][:, closer] = pair[:, closer]
                    best[a:b][closer] = i
            failed = (n["n_words"] < rules.min_words) | (100 * n["n_repeat_words"] > rules.max_repeat_percent * n["n_words"])
            judged = (n["n_chars"] >= rules.guard_chars) & (n["n_words"] >= rules.guard_words) & (best >= 0)
            far = judged & ((near[0] > rules.max_class_distance) | (near[1] > rules.max_word_distance))
            langs = pa.array([r.lang for r in known] or [""], pa.string()).take(pa.array(np.maximum(best, 0), mask=best < 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(n[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & ~far), langs, pa.array(near[0]), pa.array(near[1])],
                names=["doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "class_distance", "word_distance"],
            )

    return task


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules(), columns: Sequence[str] | None = None) -> DataFrame:
    """Counts and verdict of every document.

    Returns one row per input row: ``doc`` (a struct of ``columns``, by default
    all), ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, the ``nearest`` language and
    both distances to it (1 if there is none).  A null text counts as an empty
    one and fails.  Without any known language only the base rules judge.
    """
    known = references(docs, text_col, lang_col)
    columns = list(columns or docs.columns)
    inside = text_col if text_col in columns else None  # then the text is not sent twice
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), *([] if inside else [F.col(text_col).alias("text")]))
    more = T._parse_datatype_string("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, nearest string, class_distance double, word_distance double")
    return in_arrow(rows, _judge(known, rules, inside), T.StructType([rows.schema["doc"], *more.fields]))
