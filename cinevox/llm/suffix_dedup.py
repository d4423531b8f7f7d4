"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``depth`` bytes (its window), so windows
are ordered by most-significant-digit passes that stop there, and a group that
still has two members after the last digit is a repeated window.  A window is
read from its anchor on, the smallest-hashed gram of ``GRAM`` bytes inside it:
equal windows have equal anchors at equal offsets, and neighbouring windows
mostly share theirs, so one row stands for a run of them.

* Pass 1: the digit is the anchor.  A row is a run of up to ``depth - GRAM + 1``
  windows.
* Pass 2: a run is cut by the window's offset to the anchor into classes of
  ``CLASS``; the bytes that all windows of a class share are the next digit.
* Pass 3: the same with classes of ``PART``.
* Pass 4: the digit is the rest of the window, and a row is one window.

After each pass, groups of one are dropped.  Where all rows of a group have the
same bytes, or some do, these are repeated as they are; of the other contents
one row each goes on to the next pass.  Groups are only counted, with partial
sums, and rows meet their counts in joins that deal out large groups
(``skew.spread_join``), so no group is ever gathered in one place.

Digits are compared as hashes of 62 bits, at the same two points in every pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, in_arrow
from .skew import spread_join
from .textkit import RangeHash, blocks, mix, utf8

GRAM = 50
CLASS = 51
PART = 8
CHUNK = 1 << 22
"""Windows of a very long text that are filed at once."""

_U = np.uint64
_AT = _U((1 << 28) - 1)


def _runs(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, ...] | None:
    """Runs of windows with one anchor: first window, end, anchor position, digit, fingerprint of the run."""
    hashes = RangeHash(data)
    grams = hashes.grams(GRAM)
    width = depth - GRAM + 1
    if len(grams) < width:
        return None
    least = (grams & ~_AT) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & _AT).astype(np.int64)
    first, end = offsets[:-1], offsets[1:] - depth + 1
    first, end = first[end > first], end[end > first]
    new = np.ones(len(anchor) + 1, bool)
    new[1:-1] = anchor[1:] != anchor[:-1]
    new[first] = True
    new[end] = True
    lo = np.flatnonzero(new[:-1])
    hi = np.append(lo[1:], len(anchor))
    row = np.searchsorted(first, lo, "right") - 1
    inside = (row >= 0) & (lo < end[row]) if len(end) else np.zeros(len(lo), bool)
    lo, hi = lo[inside], hi[inside]
    at = anchor[lo]
    whole = hashes.of(lo, hi - 1 + depth) ^ mix((at - lo).astype(np.uint64))
    return lo, hi, at, grams[at], whole


def _pieces(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of rows, and pieces of rows too long for one: first byte, bytes, offsets in them; with the first row."""
    for a, b in blocks(offsets):
        start, end = offsets[a], offsets[b]
        if b - a > 1 or end - start <= CHUNK + depth:
            yield a, start, data[start:end], offsets[a : b + 1] - start
            continue
        for at in range(start, end - depth + 1, CHUNK):
            part = data[at : min(end, at + CHUNK + depth - 1)]
            yield a, at, part, np.array([0, len(part)])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _file(depth: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for _, start, part, cuts in _pieces(data, offsets, depth):
                runs = _runs(part, cuts, depth)
                if runs is None or not len(runs[0]):
                    continue
                lo, hi, at, digit, whole = runs
                row = np.searchsorted(offsets, lo + start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), batch.column("key").take(pa.array(row)), _signed(digit), _signed(whole), pa.array((lo + start - offsets[row]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array((at - lo).astype(np.int32))],
                    names=["id", "key", "digit", "whole", "lo", "n", "anchor"],
                )

    return task


def _refine(depth: int):
    """Pass 2: runs by class, each with its digit and its bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("runs")
            each = lists.flatten()
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            lo, n, at = (each.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "n", "anchor"))
            lo = lo + offsets[row]
            at = at + lo
            for a, b in blocks(offsets):
                which = slice(*np.searchsorted(row, (a, b)))
                base = offsets[a]
                hashes = RangeHash(data[base : offsets[b]])
                l, m, p, r = lo[which] - base, n[which], at[which] - base, row[which]
                digit = hashes.of(p, p + GRAM)
                for near in range(0, depth - GRAM + 1, CLASS):
                    far = min(near + CLASS, depth - GRAM + 1)
                    s, e = np.maximum(l, p - far + 1), np.minimum(l + m - 1, p - near)
                    ok = e >= s
                    if not ok.any():
                        continue
                    s, e, q, k = s[ok], e[ok], p[ok], r[ok]
                    shared = hashes.of(q - near, q - far + 1 + depth) ^ mix(digit[ok] + _U(near))
                    size = e - s + depth
                    ends = np.cumsum(size)
                    take = np.arange(ends[-1]) + np.repeat(s + base - (ends - size), size)
                    text = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[take])])
                    whole = hashes.of(s, e + depth) ^ mix((q - s).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(k)), batch.column("key").take(pa.array(k)), _signed(shared), _signed(whole), pa.array((s + base - offsets[k]).astype(np.int32)), pa.array((e - s + 1).astype(np.int32)), pa.array((q - s).astype(np.int32)), text],
                        names=["id", "key", "digit", "whole", "lo", "n", "offset", "bytes"],
                    )

    return task


def _divide(depth: int):
    """Pass 3: runs by smaller class; ``offset`` is that of the anchor to a run's first window."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("bytes"), pa.large_binary())
            n, offset, lo = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "offset", "lo"))
            digit = batch.column("digit").to_numpy().view(np.uint64)
            for a, b in blocks(offsets):
                last = (offset[a:b] - n[a:b] + 1) // PART
                count = offset[a:b] // PART - last + 1
                row = np.repeat(np.arange(a, b), count)
                near = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count - last, count)) * PART
                first = np.maximum(0, offset[row] - near - PART + 1)  # windows of the run, by place in it
                end = np.minimum(n[row], offset[row] - near + 1)
                at = offsets[row] - offsets[a]
                hashes = RangeHash(data[offsets[a] : offsets[b]])
                anchor = at + offset[row]
                shared = hashes.of(anchor - near, anchor - near - PART + 1 + depth) ^ mix(digit[row] + near.astype(np.uint64))
                whole = hashes.of(at + first, at + end - 1 + depth) ^ mix((offset[row] - first).astype(np.uint64))
                size = end - first - 1 + depth
                ends = np.cumsum(size)
                take = np.arange(size.sum()) + np.repeat(offsets[row] + first - (ends - size), size)
                text = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[take])])
                k = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(k), batch.column("key").take(k), _signed(shared), _signed(whole), pa.array((lo[row] + first).astype(np.int32)), pa.array((end - first).astype(np.int32)), text],
                    names=["id", "key", "digit", "whole", "lo", "n", "bytes"],
                )

    return task


def _single(depth: int):
    """Pass 4: every window of the runs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("bytes"), pa.large_binary())
            lo = batch.column("lo").to_numpy()
            for a, b in blocks(offsets):
                count = np.maximum(0, np.diff(offsets[a : b + 1]) - depth + 1)
                row = np.repeat(np.arange(a, b), count)
                i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = offsets[row] - offsets[a] + i
                value = RangeHash(data[offsets[a] : offsets[b]]).of(start, start + depth)
                k = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(k) for c in ("id", "key", "digit")), _signed(value), pa.array((lo[row] + i).astype(np.int32))], names=["id", "key", "digit", "value", "lo"])

    return task


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the bytes under the spans of each row."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        spans = batch.column("spans")
        length = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        each = spans.flatten()
        row = np.repeat(np.arange(len(batch)), length)
        step = np.zeros(len(data) + len(batch) + 1, np.int32)
        for field, by in (("lo", 1), ("hi", -1)):
            np.add.at(step, each.field(field).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[row] + row, by)
        covered = np.cumsum(step[:-1]) > 0  # one uncovered place after each row keeps rows apart
        place = np.ones(len(covered), bool)
        place[offsets[1:] + np.arange(len(batch))] = False
        begins = covered & ~np.append(False, covered[:-1])
        at = offsets + np.arange(len(batch) + 1)
        tally = np.append(0, np.cumsum(begins))
        n_spans = tally[at[1:]] - tally[at[:-1]]
        gone = covered[place]
        total = np.append(0, np.cumsum(gone))
        removed = total[offsets[1:]] - total[offsets[:-1]]
        kept = np.append(0, np.cumsum(np.diff(offsets) - removed))
        rest = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(n_spans.astype(np.int64)), rest.cast(pa.binary())],
            names=["doc", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def _settle(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of the rows ``id, key, digit, whole, lo, n, ...``: those whose bytes occur twice, and one of each content that must be ordered further."""
    counts = rows.groupBy("digit").agg(F.count("*").alias("c"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("c > 1")
    twice = scratch.save(counts.select("digit", "c", (F.col("a") == F.col("b")).alias("alike")), f"{name}-twice")
    shared = scratch.save(spread_join(rows, twice, ["digit"], "c", ["id", "key", "lo"]), f"{name}-shared")
    mixed = shared.where("not alike").drop("alike").withColumn("place", F.xxhash64("id", "key", "lo"))
    contents = mixed.groupBy("digit", "whole").agg(F.count("*").alias("c"), F.min("place").alias("least")).where("c > 1")
    contents = scratch.save(contents, f"{name}-contents")
    marked = scratch.save(spread_join(mixed, contents, ["digit", "whole"], "c", ["place"], "left"), f"{name}-marked")
    scratch.drop(f"{name}-twice", f"{name}-contents")
    repeated = shared.where("alike").drop("alike").unionByName(marked.where("least is not null").drop("place", "least"))
    return repeated, marked.where("least is null or place = least").drop("place", "least")


def _still_open(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen runs, with all columns."""
    same = F.col("c.id").eqNullSafe(F.col("o.id")) & (F.col("c.key") == F.col("o.key")) & (F.col("c.lo") == F.col("o.lo")) & (F.col("c.n") == F.col("o.n"))
    return runs.alias("c").join(chosen.select("id", "key", "lo", "n").alias("o"), same, "left_semi")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 200) -> DataFrame:
    """Byte ranges under windows of ``depth`` bytes that start at two places or more.

    Returns ``id, key, spans`` with ``spans`` an array of ``lo, hi`` (they may
    overlap) for each document that has any; ``key`` is the text's hash, so that
    null or repeated ids do not mix documents.  A row that occurs twice repeats
    all its windows.  Nulls count as empty texts; texts shorter than ``depth``
    have no window.
    """
    if depth < 2 * GRAM:
        raise ValueError(f"depth must be {2 * GRAM} bytes or more")
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = _identified(docs, id_col, text_col).where(F.octet_length("text") >= depth)
    head = f"id {rows.schema['id'].dataType.simpleString()}, key bigint"
    span = lambda df: df.select("id", "key", "lo", (F.col("lo") + F.col("n") - 1 + depth).alias("hi"))

    filed = scratch.save(in_arrow(rows, _file(depth), f"{head}, digit bigint, whole bigint, lo int, n int, anchor int"), "filed")
    runs, open_runs = _settle(filed, scratch, "run")
    scratch.drop("filed")

    further = open_runs.groupBy("id", "key").agg(F.collect_set(F.struct("lo", "n", "anchor")).alias("runs"))
    texts = rows.alias("t").join(further.alias("f"), F.col("t.id").eqNullSafe(F.col("f.id")) & (F.col("t.key") == F.col("f.key"))).select("t.id", "t.key", "text", "runs")
    classed = scratch.save(in_arrow(texts, _refine(depth), f"{head}, digit bigint, whole bigint, lo int, n int, offset int, bytes binary"), "classed")
    runs = scratch.save(span(runs), "run-spans")
    scratch.drop("run-shared", "run-marked")
    classes, open_classes = _settle(classed.drop("offset", "bytes"), scratch, "class")
    parted = scratch.save(in_arrow(_still_open(classed, open_classes), _divide(depth), f"{head}, digit bigint, whole bigint, lo int, n int, bytes binary"), "parted")
    classes = scratch.save(span(classes), "class-spans")
    scratch.drop("class-shared", "class-marked", "classed")
    parts, open_parts = _settle(parted.drop("bytes"), scratch, "part")
    still = _still_open(parted, open_parts).select("id", "key", "digit", "lo", "bytes")
    windows = scratch.save(in_arrow(still, _single(depth), f"{head}, digit bigint, value bigint, lo int"), "windows")
    parts = scratch.save(span(parts), "part-spans")
    scratch.drop("part-shared", "part-marked", "parted")
    twice = scratch.save(windows.groupBy("digit", "value").agg(F.count("*").alias("c")).where("c > 1"), "twice")
    windows = spread_join(windows, twice, ["digit", "value"], "c", ["id", "key", "lo"]).withColumn("n", F.lit(1))

    found = runs.unionByName(classes).unionByName(parts).unionByName(span(windows))
    spans = scratch.save(found.groupBy("id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    scratch.drop("run-spans", "class-spans", "part-spans", "windows", "twice")
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 200, columns: Sequence[str] | None = None, as_text: bool = False) -> DataFrame:
    """Each document without the bytes under windows of ``depth`` bytes that start anywhere else too.

    Returns one row per input row: ``doc`` (a struct of ``columns``, by default
    all, so no name can clash), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept`` (the remaining bytes, concatenated; a cut may fall
    inside a character).  With ``as_text``, only ``doc`` and ``kept_text``, which
    leaves out characters that a cut has broken.  Nulls count as empty texts.
    """
    spans = repeated_spans(docs, id_col, text_col, depth)
    columns = list(columns or docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    both = rows.alias("t").join(spans.alias("f"), F.col("t.id").eqNullSafe(F.col("f.id")) & (F.col("t.key") == F.col("f.key")), "left").select("doc", "text", "spans")
    out = T.StructType([rows.schema["doc"], *T._parse_datatype_string("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").fields])
    if as_text:
        return in_arrow(both, _texts, T.StructType([rows.schema["doc"], T.StructField("kept_text", T.StringType())]))
    return in_arrow(both, _cut, out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        texts = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], names=["doc", "kept_text"])
