"""Collocations: exact counts of frequent phrases found through merged count-min sketches.

The first pass hashes every word and every pair of words into ``DEPTH`` rows of
counters.  A task sums its own counts, Spark merges them, and only one bit for
each counter is kept: whether it reached the threshold.  A run's counters are
never below its count, so every frequent one has all its bits set.  The second
pass does the same for longer runs in which all pairs have their bits set: what
contains a rare run is rare.  The last pass counts exactly, by the phrase itself,
the runs whose bits, and those of all runs inside, are set.  Rare runs that share
counters with others are counted too and drop out by their exact count, so
nothing frequent is lost and nothing else stays.

A sketch has a counter for every ``SHARE`` bytes of text, up to ``WIDEST`` in a
row.  The bits of both are what tasks hold and what is broadcast, ``2 * DEPTH *
WIDEST / 8`` bytes (256 MB) at most; a corpus of more than ``SHARE * WIDEST``
bytes (8 GB) has more rare runs reach the last pass, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, in_arrow
from .skew import spread_join
from .textkit import RangeHash, blocks, joined, mix, utf8

LONGEST = 4
LEVELS = ((1, 2), (3, 4))
"""Lengths of runs that share a sketch; the second one knows the first."""
DEPTH = 2
SHARE = 16
NARROWEST, WIDEST = 1 << 16, 1 << 29
SLICE, SLICES = 1 << 16, 512
"""Counters that are sent together, at least; slices that a sketch is cut into, at most, so that what a task sends at once is not cut into ever smaller parts."""
RAW = 1 << 22
"""Numbers of counters that a task gathers before it sums them up."""
HELD = 1 << 20
"""Sums, and phrases, that a task holds before it hands them on."""
BYTES = 1 << 19
"""Bytes of text handled at once; longer texts are cut between pieces."""
TASK = 27
"""A task counts ``2 ** TASK`` bytes of text, or less where that leaves cores idle, in the last round too: the more it sums up, the less it sends."""
FAN_IN = 34
"""Each ``2 ** FAN_IN`` bytes of text are merged by themselves before all are."""

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.ones(256, np.uint8)
_KIND[[0x20, 9]] = 0
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_TO_LOWER, _TO_KIND = _LOWER.tobytes(), _KIND.tobytes()
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BRIEF = 64
"""Bytes of words that are hashed eight by eight."""
_ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, eight bytes at a time; of very long ones, by prefix sums."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    value = mix((eight[start] & _KEPT[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _U(_ROWS[0])))
    longer, done = np.flatnonzero((size > 8) & (size <= _BRIEF)), 8
    while len(longer):
        value[longer] = mix(joined(value[longer], eight[start[longer] + done] & _KEPT[np.minimum(size[longer] - done, 8)]))
        done += 8
        longer = longer[size[longer] > done]
    longest = np.flatnonzero(size > _BRIEF)
    if len(longest):
        value[longest] = RangeHash(data).of(start[longest], end[longest])
    return value


class Runs:
    """Words of a block of lower-cased texts, and the hashes of the runs of them that stay inside a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        raw = data.tobytes()
        self.data = np.frombuffer(raw.translate(_TO_LOWER), np.uint8)
        kind = np.frombuffer(raw.translate(_TO_KIND), np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        np.equal(kind, 1, out=inside[1:-1])
        starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        both = cut[inside[cut] & inside[cut + 1]]
        starts[both] = ends[both] = True
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        fresh = np.zeros(len(self.start) + 1, bool)
        fresh[first] = fresh[np.searchsorted(self.start, np.flatnonzero(kind == 2))] = True
        self.group = np.cumsum(fresh[:-1], dtype=np.int32)  # of the piece: grows at each cut and each row that words follow
        self.seed = seeds[self.row]
        self.word = _word_hashes(self.data, self.start, self.end)

    def hashes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: where the runs begin, as word numbers, and their hashes, which depend on the language."""
        count = len(self.word)
        value = joined(self.seed, self.word)
        for n in range(1, LONGEST + 1):
            at = np.flatnonzero(self.group[n - 1 :] == self.group[: count - n + 1]) if count >= n else np.zeros(0, np.int64)
            if n > 1:
                longer = np.zeros(count, np.uint64)
                longer[at] = joined(value[at], self.word[at + n - 1])
                value = longer
            yield at, mix(value[at] ^ _U(n))

    def phrases(self, at: np.ndarray, n: np.ndarray) -> pa.Array:
        """The words from each place on, by single spaces."""
        edges = np.empty(2 * len(self.start) + 1, np.int64)
        edges[0:-1:2], edges[1:-1:2], edges[-1] = self.start, self.end, len(self.data)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(self.data)])
        out, order = [], []
        for size in range(1, LONGEST + 1):
            own = np.flatnonzero(n == size)
            if len(own):
                words = [pieces.take(pa.array(2 * (at[own] + i))) for i in range(size)]
                out.append(pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())))
                order.append(own)
        if not out:
            return pa.array([], pa.large_binary())
        back = np.empty(len(at), np.int64)
        back[np.concatenate(order)] = np.arange(len(at))
        return pa.chunked_array(out).combine_chunks().take(pa.array(back))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Runs]]:
    """Blocks of a batch, with the input row of each of their rows."""
    data, offsets = utf8(batch.column("text"))
    seeds = batch.column("seed").to_numpy().view(np.uint64)
    owner = np.arange(len(offsets) - 1)
    for row in np.flatnonzero(np.diff(offsets) > BYTES)[::-1]:
        ends = np.flatnonzero(_KIND[data[offsets[row] : offsets[row + 1]]] == 2) + offsets[row] + 1
        ends = np.unique(ends[np.searchsorted(ends, np.arange(offsets[row] + BYTES, offsets[row + 1], BYTES), "right") - 1]) if len(ends) else ends
        ends = ends[(ends > offsets[row]) & (ends < offsets[row + 1])]
        offsets, owner = np.insert(offsets, row + 1, ends), np.insert(owner, row + 1, np.full(len(ends), row))
    for a, b in blocks(offsets, BYTES):
        yield owner[a:b], Runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], seeds[owner[a:b]])


def _column(value: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counter of each hash in a row of the sketch, numbered through all rows."""
    return ((mix(value * _U(_ROWS[row])) >> _U(32)) * _U(width) >> _U(32)).astype(np.uint32) + np.uint32(row * width)


def _slice(width: int) -> int:
    """Counters of a slice: whole bytes of bits."""
    return max(SLICE, -(-DEPTH * width // SLICES // 8) * 8)


class Marks:
    """The bits of a sketch's counters."""

    def __init__(self, packed: np.ndarray, width: int):
        self.packed, self.width = packed, width

    def all_set(self, value: np.ndarray) -> np.ndarray:
        """Where all are, as places."""
        fit = np.arange(len(value))
        for row in range(DEPTH):
            column = _column(value[fit], row, self.width)
            fit = fit[(self.packed[column >> np.uint32(3)] << (column & np.uint32(7)).astype(np.uint8)) & np.uint8(128) != 0]
        return fit


def _alive(runs: Runs, known: list[Marks]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: places and hashes of the runs whose bits are set, as far as they are known, and those of all runs inside."""
    inner = np.ones(len(runs.word) + 1, bool)
    for n, (at, value) in enumerate(runs.hashes(), 1):
        if n > 1 and known:
            fit = np.flatnonzero(inner[at] & inner[at + 1])
            at, value = at[fit], value[fit]
        for lengths, marks in zip(LEVELS, known):
            if n in lengths:
                fit = marks.all_set(value)
                at, value = at[fit], value[fit]
        inner = np.zeros(len(runs.word) + 1, bool)
        inner[at] = True
        yield at, value


def _count_type(least: int) -> np.dtype:
    """Of counts that stop at ``least``: where a part reaches it the sum does, and below it all are exact."""
    return np.dtype(np.uint8 if least < 256 else np.uint64)


def _packed(key: np.ndarray, count: np.ndarray, least: int, part: int, size: int) -> pa.RecordBatch:
    """Rows ``slice, part, n, counters`` of sorted counters: the steps from place to place in their slice, by halves, and the counts, compressed."""
    number = key // _U(size)
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(key)])
    ends = np.append(first[1:], len(key))
    place = (key - number * _U(size)).astype(np.uint32)
    steps = np.diff(place, prepend=np.uint32(0))
    steps[first] = place[first]
    low, high = steps.astype(np.uint16), (steps >> np.uint32(16)).astype(np.uint16)
    counts = np.minimum(count, _U(least)).astype(_count_type(least))
    blobs = [pa.compress(low[a:b].tobytes() + high[a:b].tobytes() + counts[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(first, ends, strict=True)]
    columns = [number[first].astype(np.int32), np.full(len(first), part, np.int32), (ends - first).astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(blobs, pa.binary())], names=["slice", "part", "n", "counters"])


def _unpacked(n: int, counters: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    kind = _count_type(least)
    data = pa.decompress(counters, n * (4 + kind.itemsize), "zstd")
    steps = np.frombuffer(data, np.uint16, n, 2 * n).astype(np.int64) << 16
    steps += np.frombuffer(data, np.uint16, n)
    return np.cumsum(steps, out=steps), np.frombuffer(data, kind, n, 4 * n)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, least: int, known: list) -> Iterator[pa.RecordBatch]:
    """Counters of this task's runs of the next level, summed before they are handed on."""
    part, lengths, size = TaskContext.get().partitionId(), LEVELS[len(known)], _slice(width)
    marks = [Marks(bits.value, width) for bits in known]
    raw, sums, held = [], np.zeros(0, np.uint64), 0
    for batch in batches:
        for _, runs in _blocks(batch):
            for n, (_, value) in enumerate(_alive(runs, marks), 1):
                if n in lengths:
                    raw += [_column(value, row, width) for row in range(DEPTH)]
                    held += DEPTH * len(value)
                if n == lengths[-1]:
                    break
            if held > RAW:
                sums = _summed(raw, sums)
                raw, held = [], 0
                if len(sums) > HELD // 2 or (sums & _U(1 << 31)).any():
                    yield _packed(sums >> _U(32), sums & _U(0xFFFFFFFF), least, part, size)
                    sums = sums[:0]
    if held or len(sums):
        sums = _summed(raw, sums)
        yield _packed(sums >> _U(32), sums & _U(0xFFFFFFFF), least, part, size)


def _summed(raw: list[np.ndarray], sums: np.ndarray) -> np.ndarray:
    """``sums`` and one for each number in ``raw``: sorted numbers of counters, in the high half, with their counts, in the low one."""
    if raw:
        key = np.concatenate(raw)
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        more = (key[first].astype(np.uint64) << _U(32)) + np.diff(first, append=len(key)).astype(np.uint64)
        if not len(sums):
            return more
        both = np.concatenate([sums, more])
        both.sort()
        key = both >> _U(32)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        sums = (key[first] << _U(32)) + np.add.reduceat(both & _U(0xFFFFFFFF), first) if len(first) else both
    return sums


def _merge(batches: Iterator[pa.RecordBatch], least: int, marks: bool, size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice and part, summed: each slice's sums again as such rows, or the bits of those that reached ``least``."""
    now, sums = None, np.zeros(size, np.uint64)

    def row() -> pa.RecordBatch:
        if marks:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], names=["slice", "marks"])
        key = np.flatnonzero(sums)
        return _packed((key + now[0] * size).astype(np.uint64), sums[key], least, now[1], size)

    for batch in batches:
        for number, part, n, counters in zip(*(batch.column(c).to_pylist() for c in ("slice", "part", "n", "counters")), strict=True):
            if now != (number, part):
                if now is not None:
                    yield row()
                now, sums[:] = (number, part), 0
            places, counts = _unpacked(n, counters, least)
            sums[places] += counts  # places are distinct
    if now is not None:
        yield row()


def _distinct(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of their hashes, where each hash begins there, and one more for the end.

    Sorted by their first bits with the place behind them: hashes that share those
    may take turns and so begin twice, and are counted in parts.
    """
    bits = _U(len(value).bit_length())
    order = value >> bits << bits | np.arange(len(value), dtype=np.uint64)
    order.sort()
    order = (order & (_U(1) << bits) - _U(1)).astype(np.int64)
    value = value[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
    return order, first, np.append(first, len(value))


def _survivors(batches: Iterator[pa.RecordBatch], width: int, known: list) -> Iterator[pa.RecordBatch]:
    """``lang, size, phrase, f`` of runs that may be frequent, summed over the task as far as it holds them; words of all kinds have size 0."""
    marks = [Marks(bits.value, width) for bits in known]
    found: list[tuple] = []
    held: list[tuple] = []
    seen = size = 0
    for batch in batches:
        langs = batch.column("lang")
        words = np.zeros(len(batch), np.int64)
        for owner, runs in _blocks(batch):
            np.add.at(words, owner, np.bincount(runs.row, minlength=len(owner)))
            alive = list(_alive(runs, marks))
            found.append((runs, langs.take(pa.array(owner)), *(np.concatenate([a[i] for a in alive]) for i in (0, 1)), [len(a[0]) for a in alive]))
            seen += len(found[-1][2])
            if seen > HELD // 2:
                held.append(_counted(found))
                size += len(held[-1][0])
                found, seen = [], 0
            if size > HELD:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD * 3 // 4:
                    yield _survivor_rows(held[0])
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(batch), np.int32)), pa.array([""] * len(batch), pa.string()), pa.array(words)], names=["lang", "size", "phrase", "f"])
    if found:
        held.append(_counted(found))
    if held:
        yield _survivor_rows(_merged(held))


def _counted(found: list[tuple]) -> tuple:
    """Hashes, counts, lengths, languages and phrases of the different runs of some blocks; a phrase is put together once."""
    value = np.concatenate([f[3] for f in found])
    order, first, ends = _distinct(value)
    place = np.sort(order[first])
    count = np.zeros(len(value), np.int64)
    count[order[first]] = np.diff(ends)
    edges = np.searchsorted(place, np.cumsum([0, *(len(f[3]) for f in found)]))
    base, sizes, langs, phrases = 0, [], [], []
    for (runs, lang, at, _, lengths), a, b in zip(found, edges[:-1], edges[1:], strict=True):
        own = place[a:b] - base
        n = np.repeat(np.arange(1, LONGEST + 1, dtype=np.uint8), lengths)[own]
        sizes.append(n)
        langs.append(lang.take(pa.array(runs.row[at[own]])))
        phrases.append(runs.phrases(at[own], n))
        base += len(at)
    return value[place], count[place], np.concatenate(sizes), pa.chunked_array(langs).combine_chunks(), pa.chunked_array(phrases).combine_chunks()


def _merged(held: list[tuple]) -> tuple:
    if len(held) == 1:
        return held[0]
    value, count, n = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2))
    order, first, _ = _distinct(value)
    summed = np.add.reduceat(count[order], first) if len(first) else count
    first = order[first]
    take = lambda i: pa.chunked_array([h[i] for h in held]).combine_chunks().take(pa.array(first))
    return value[first], summed, n[first], take(3), take(4)


def _survivor_rows(entry: tuple) -> pa.RecordBatch:
    _, count, n, lang, phrase = entry
    return pa.RecordBatch.from_arrays([lang, pa.array(n.astype(np.int32)), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(count)], names=["lang", "size", "phrase", "f"])


def _marks(scratch: Scratch, source: DataFrame, size: int, width: int, least: int, known: list) -> np.ndarray:
    """The bits of the next level's sketch, ``DEPTH * WIDEST / 8`` bytes at most."""
    counters = in_arrow(source.select("seed", "text"), partial(_sketch, width=width, least=least, known=list(known)), "slice int, part int, n int, counters binary")
    each = _slice(width)
    merged = lambda rows, kind, marks: in_arrow(rows.repartition("slice", "part").sortWithinPartitions("slice", "part"), partial(_merge, least=least, marks=marks, size=each), kind)
    groups = size >> FAN_IN
    if groups:
        counters = merged(counters.withColumn("part", F.pmod("part", F.lit(groups + 1)).cast("int")), counters.schema, False)
    found = scratch.save(merged(counters.withColumn("part", F.lit(0)), "slice int, marks binary", True), f"marks-{len(known)}")  # written by all tasks at once, as the driver reads one after another
    packed = np.zeros(-(-DEPTH * width // each) * (each // 8), np.uint8)
    for row in found.toLocalIterator():
        packed[row["slice"] * (each // 8) :][: each // 8] = np.frombuffer(row["marks"], np.uint8)
    return packed


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30) -> DataFrame:
    """``lang, size, phrase, f`` of all runs of one to four words that occur ``least`` times or more in a language, and one row of ``size`` 0 for all words of each."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    source = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("seed"), F.col(f"`{text_col}`").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(WIDEST, max(NARROWEST, size // SHARE))
    cores = spark.sparkContext.defaultParallelism
    source = source.coalesce(max(1, -(-(size >> TASK) // cores)) * cores)
    known = []
    for _ in LEVELS:
        known.append(spark.sparkContext.broadcast(_marks(scratch, source, size, width, least, known)))
    counted = in_arrow(source, partial(_survivors, width=width, known=known), "lang string, size int, phrase string, f bigint")
    return scratch.save(counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0)), "frequent")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, contained: int = 80) -> DataFrame:
    """Each language's best ``top`` phrases of two to four words: ``lang, rank, phrase, a, l, r, n, score``.

    Texts (null: empty), A-Z lower-cased, are cut at ``. , ; : ! ?`` and line
    breaks; phrases lie inside a piece, and a null language counts as ``und``.
    Of the cuts of a phrase in two, with ``l`` and ``r`` occurrences of its parts,
    the one of the least ``score = floor(2000000 * a / (l + r))`` counts, of equal
    ones the first.  A phrase goes if one that contains it has ``contained``
    percent of its occurrences or more.  Rank is by score, ``a``, both falling,
    and phrase by bytes.  ``n`` are all words of the language.  Equal rows count
    each; an empty table has no phrases.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    known = frequent(docs, text_col, lang_col, least)
    totals = known.where("size = 0").select("lang", F.col("f").alias("n"))

    words = F.split("phrase", " ")
    run = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    candidates = known.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), words.alias("words"))
    inside = candidates.where("size > 2").withColumn("part", F.explode(F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(words, i, k), ' '))))")))
    longer = inside.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    open_ = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer").cast("decimal(20,0)") < contained * F.col("a").cast("decimal(20,0)"), F.lit(True)))
    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = scratch.save(cuts, "cuts")
    parts = known.where(f"size between 1 and {LONGEST - 1}").select("lang", "phrase", "f")
    for side, name in (("left", "l"), ("right", "r")):
        degree = scratch.save(cuts.groupBy("lang", side).agg(F.count("*").alias("c")), f"degree-{side}")
        cuts = spread_join(cuts, parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], "c", ["phrase", "k"], counts=degree)
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase").cast("binary"))
    first = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
