"""Chroma fingerprints of audio columns, and their alignment.

A recording (WAV, 16-bit PCM) becomes frames of twelve pitch classes.  Filters
over an integral image of the frames, each the difference of two rectangles'
sums, are quantised to two bits; sixteen of them make the 32-bit integer of a
position.  Two recordings are aligned by keys of two positions near each
other, some of whose bits agree but for one at most: the histogram of their
position differences gives the offsets, and the bits that differ along the overlap
at an offset tell whether they are the same sound.  Keys are longer in larger
tables, so that chance meetings do not grow with the square of the table; how many
choices of bits there are follows from that, so that of the least overlap with the
most errors one in 200 is missed where errors are independent, and of longer ones
or with fewer errors hardly any.

Recordings with equal fingerprints are one class, compared once; a key that many
classes share costs pairs only with the queries, and is dealt out.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, in_arrow
from .skew import spread_join

FRAME = 1024
HOP = 512
SPAN = 16
"""Frames under the filters of one position."""


def _filters() -> list[tuple[int, int, int, int, int]]:
    """Kind (0 halves in time, 1 halves in pitch, 2 middle third in time, 3 quarters), first class, classes, first frame, frames; by rule, wide and narrow in turn."""
    out = []
    for i in range(16):
        height = (2, 4, 6, 12)[i % 4]
        width = (16, 12, 8, 6)[i // 4]
        out.append((i * 7 % 4, i * 5 % (12 - height + 1), height, (i * 3) % (SPAN - width + 1), width))
    return out


FILTERS = _filters()
LEVELS = (-0.12, 0.0, 0.12)
"""Quantiser bounds of a filter's answer, which lies between -1 and 1."""


def pcm(wav: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (channels averaged, -1 to 1) and rate of a WAV file; none for anything else."""
    none = np.zeros(0, np.float32), 0
    if wav is None or len(wav) < 12 or wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        return none
    at, channels, rate, bits = 12, 0, 0, 0
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(wav):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wav, at + 8)
            if kind != 1 or bits != 16 or not channels:
                return none
        if name == b"data" and channels:
            body = wav[at + 8 : at + 8 + size]
            samples = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
            return samples.mean(1, dtype=np.float32) / np.float32(32768), rate
        at += 8 + size + size % 2
    return none


def wav(samples: np.ndarray, rate: int) -> bytes:
    """A mono WAV file of samples between -1 and 1."""
    body = np.clip(np.round(samples * 32767), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, scaled to length 1 (silence: 0)."""
    n = (len(samples) - FRAME) // HOP + 1 if len(samples) >= FRAME else 0
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hertz = np.arange(power.shape[1]) * rate / FRAME
    heard = (hertz >= 55) & (hertz <= min(3520, rate / 2))
    tone = np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12
    out = np.zeros((n, 12))
    for k in range(12):
        out[:, k] = power[:, heard][:, tone == k].sum(1)
    out = np.log1p(out)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-3)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """The 32-bit integer of each position."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.zeros((len(frames) + 1, 13))
    total[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)
    area = lambda t0, t1, k0, k1: total[at + t1, k1] - total[at + t0, k1] - total[at + t1, k0] + total[at + t0, k0]
    out = np.zeros(n, np.int64)
    for kind, k, height, t, width in FILTERS:
        whole = area(t, t + width, k, k + height)
        if kind == 0:
            part = area(t, t + width // 2, k, k + height)
        elif kind == 1:
            part = area(t, t + width, k, k + height // 2)
        elif kind == 2:
            third = width // 3
            part = area(t + third, t + width - third, k, k + height) * width / (2 * (width - 2 * third))
        else:
            part = area(t, t + width // 2, k, k + height // 2) + area(t + width // 2, t + width, k + height // 2, k + height)
        answer = np.divide(2 * part - whole, whole, out=np.zeros(n), where=whole > 1e-9)
        level = np.searchsorted(LEVELS, answer)
        out = out << 2 | np.array([0, 1, 3, 2])[level]  # neighbouring levels differ by one bit
    return out


def fingerprints(media: DataFrame, id_col: str, media_col: str, wav_of: Callable[[object], bytes | None] | None = None) -> DataFrame:
    """``id`` and ``codes``, one integer for each position; none for null, short or unreadable recordings.

    ``wav_of`` makes the recording of a value where the column holds none: each is
    made and forgotten in the task that fingerprints it, so none passes through Spark.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(chroma(*pcm(wav_of(m.as_py()) if wav_of else m.as_py()))) for m in batch.column("media")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.list_(pa.int64()))], names=["id", "codes"])

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return in_arrow(rows, task, f"id {rows.schema['id'].dataType.simpleString()}, codes array<bigint>")


SILENCE = int(fingerprint(np.zeros((SPAN, 12)))[0])
GAP = 4
"""Positions between the two of a window; neighbours are much alike."""
MISSED = 0.005
"""Of the least overlaps with the most errors, the share that may have too few common keys."""
ROUNDS = 64
"""Choices of bits at most; keys are shortened where it would take more."""


def _choices(n_windows: int, width: int, windows: int, wanted: int, most_errors: float) -> list[list[int]]:
    """The bits of a window's ``width`` that make each of its keys.

    A key has twice the bits of the number of all windows.  With a share of
    ``most_errors`` it meets its like, but for one bit at most, with the probability
    ``p``; there are as many as give ``windows`` windows ``wanted`` common ones.
    """
    few = lambda mean: math.exp(-mean) * sum(mean**k / math.factorial(k) for k in range(wanted))
    mean = next(m / 10 for m in range(1, 10_000) if few(m / 10) <= MISSED)
    bits = min(width, max(16, round(2 * math.log2(max(n_windows, 2)))))
    while True:
        p = (1 - most_errors) ** bits + bits * most_errors * (1 - most_errors) ** (bits - 1)
        rounds = math.ceil(mean / (windows * p))
        if rounds <= ROUNDS or bits <= 16:
            return [sorted(range(width), key=lambda k: hashlib.sha256(f"{r}:{k}".encode()).digest())[:bits] for r in range(rounds)]  # noqa: B023
        bits -= 1


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _votes(classes: DataFrame, scratch: Scratch, most_errors: float, least_overlap: int, least_shared: int) -> DataFrame:
    """``query, match, from, at``: windows of two classes with a common key, as often as they have one; ``from`` and ``at`` are their first positions."""
    gap = min(GAP, least_overlap // 4)
    length = F.size("codes") - gap
    pair = F.zip_with(F.slice("codes", 1, length), F.slice("codes", gap + 1, length), lambda p, q: F.shiftleft(p, 32).bitwiseOR(q))
    windows = classes.where(length > 0).select("match", "asked", F.posexplode(pair).alias("at", "window")).where(F.col("window") != _signed(SILENCE << 32 | SILENCE))
    choices = _choices(windows.count(), 64 if gap else 32, max(1, least_overlap - gap), max(1, least_shared - (gap > 0)), most_errors)
    marks = [int.from_bytes(hashlib.sha256(f"{r}".encode()).digest()[:8]) for r in range(len(choices))]  # keep the keys of different choices apart
    plain = [(sum(1 << k for k in own), mark) for own, mark in zip(choices, marks, strict=True)]
    near = [(mask, mark ^ flip) for (mask, mark), own in zip(plain, choices, strict=True) for flip in (0, *(1 << k for k in own))]

    def keys(of: list[tuple[int, int]]) -> Column:
        table = F.array(*[F.array(F.lit(_signed(mask)), F.lit(_signed(mark))) for mask, mark in of])
        return F.explode(F.transform(table, lambda x: F.col("window").bitwiseAND(x[0]).bitwiseXOR(x[1]))).alias("key")

    listed = windows.select("match", "at", keys(plain))
    probes = windows.where("asked").select(F.col("match").alias("query"), F.col("at").alias("from"), keys(near))
    degree = scratch.save(listed.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1"), "degree")  # a key of one window is never dealt out
    return spread_join(listed, probes, ["key"], "_c", ["match", "at"], keep=["query", "match", "from", "at"], counts=degree, hint="merge").where("query <> match")


def _search(prints: DataFrame, is_query: Column, most_errors: float, least_overlap: int, least_shared: int) -> tuple[DataFrame, DataFrame]:
    """The classes ``codes, match, n_members, asked`` of ``prints`` and the links ``query, match, n_members, shift, bit_errors`` of those asked for."""
    scratch = Scratch(prints.sparkSession, "align")
    full = prints.where(F.size("codes") > 0).select("id", "codes", F.coalesce(is_query, F.lit(False)).alias("asked"))
    classes = scratch.save(full.groupBy("codes").agg(F.min("id").alias("match"), F.count("*").alias("n_members"), F.max("asked").alias("asked")).where("match is not null"), "classes")
    votes = _votes(classes, scratch, most_errors, least_overlap, least_shared)
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.array("from", F.col("from") + min(GAP, least_overlap // 4))))))
    votes = votes.groupBy("query", "match", (F.col("from") - F.col("at")).alias("shift")).agg(covered.alias("shared"))
    pairs = votes.where(F.col("shared") >= least_shared).groupBy("query", "match").agg(F.collect_list("shift").alias("shifts"))
    one = classes.select(F.col("match").alias("query"), F.col("codes").alias("x"))
    other = classes.select("match", "n_members", F.col("codes").alias("y"))
    both = pairs.join(one, "query").join(other, "match")

    def compared(shift: Column) -> Column:
        start, end = F.greatest(F.lit(0), shift), F.least(F.size("x"), F.size("y") + shift)
        n = F.greatest(F.lit(0), end - start)
        bits = F.zip_with(F.slice("x", start + 1, n), F.slice("y", start - shift + 1, n), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        errors = F.when(n >= least_overlap, F.aggregate(bits, F.lit(0), lambda total, v: total + v))
        return F.struct((2 * errors - 32 * n).alias("cost"), shift.alias("shift"), (errors / (32 * n)).alias("bit_errors"))

    fitting = F.filter(F.transform("shifts", compared), lambda c: c["bit_errors"] <= most_errors)
    found = both.select("query", "match", "n_members", F.array_min(fitting).alias("best")).where("best is not null").select("query", "match", "n_members", "best.shift", "best.bit_errors")
    heard = F.size(F.filter("codes", lambda code: code != SILENCE))
    own = classes.where(F.col("asked") & (F.size("codes") >= least_overlap) & (heard >= least_shared))
    return classes, scratch.save(found.union(own.select(F.col("match").alias("query"), "match", "n_members", F.lit(0), F.lit(0.0))), "found")


def align(prints: DataFrame, is_query: Column, most_errors: float = 0.12, least_overlap: int = 16, least_shared: int = 2) -> DataFrame:
    """Recordings that contain the same sound as a query.

    Returns ``id`` (of the query), ``match`` (least id of a class of equal
    fingerprints), ``n_members`` of that class, ``shift`` (position of the query
    less that of the match) and ``bit_errors`` (share of the bits that differ
    along the overlap).  Two positions of the query, ``GAP`` apart, vote for those
    that have a key with them; windows of silence do not vote.  All shifts where
    such windows cover ``least_shared`` positions or more are compared bit by bit,
    and count if they overlap by ``least_overlap`` positions and differ by
    ``most_errors`` at most.  A pair has the one with the most equal bits less
    differing ones, ties go to the least shift.  A query's own class is listed too,
    if it has ``least_overlap`` positions and ``least_shared`` that are not silent.
    Recordings without integers, null ids among the queries and columns other than
    ``id`` and ``codes`` are left out; rows with equal ids and equal codes count as
    members of their class and, as queries, give equal rows.
    """
    classes, found = _search(prints, is_query, most_errors, least_overlap, least_shared)
    names = classes.select("codes", F.col("match").alias("query"))
    asked = prints.where(F.size("codes") > 0).where(is_query)
    return asked.select("id", "codes").join(names, "codes").select("id", "query").join(found, "query").select("id", "match", "n_members", "shift", "bit_errors")


def linked(prints: DataFrame, is_query: Column, most_errors: float = 0.12, least_overlap: int = 16, least_shared: int = 2) -> DataFrame:
    """Every row of ``prints`` with its class and its number of links, as ``align`` finds them.

    A link is a pair of different classes, one of them a query's at least.  Returns
    ``id``, ``class_id``, ``n_members``, ``n_links``, the linked class with the fewest
    errors, then the least id (``match``, ``shift``, ``bit_errors``; null without links), and
    ``links_crc``, the sum of the CRC-32 of ``match:shift`` over all links.  Where both are
    queries and shifts fit equally well, the least shift counts for either.  Rows without integers
    have no class and no links.
    """
    classes, found = _search(prints, is_query, most_errors, least_overlap, least_shared)
    there = found.where("query <> match").select(F.col("query").alias("class_id"), "match", "bit_errors", "shift")
    back = there.select(F.col("match").alias("class_id"), F.col("class_id").alias("match"), "bit_errors", -F.col("shift"))
    links = there.union(back).groupBy("class_id", "match").agg(F.min(F.struct("bit_errors", "shift")).alias("best"))
    name = F.concat_ws(":", F.col("match").cast("string"), F.col("best.shift").cast("string"))
    sums = links.groupBy("class_id").agg(
        F.count("*").alias("n_links"), F.min(F.struct("best.bit_errors", "match", "best.shift")).alias("best"), F.sum(F.crc32(name)).alias("links_crc")
    )
    named = classes.select("codes", F.col("match").alias("class_id"), "n_members").join(sums, "class_id", "left")
    named = Scratch(prints.sparkSession, "linked").save(named, "named")
    each = spread_join(prints.select("id", "codes"), named, ["codes"], "n_members", ["id"], "left", keep=["id", "class_id", "n_members", "n_links", "best", "links_crc"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return each.select("id", "class_id", "n_members", zero("n_links"), "best.match", "best.shift", "best.bit_errors", zero("links_crc"))


def melody(vector: list[float | None] | None, rate: int = 4000, note: float = 0.1) -> bytes | None:
    """A recording with every value of a vector as a note, its pitch by the value, for tables without recordings.

    A null vector gives none; null values are rests.
    """
    if vector is None:
        return None
    time = np.arange(int(rate * note)) / rate
    shape = np.minimum(1, np.minimum(time, time[::-1]) / 0.01)
    values = np.array([np.nan if v is None else v for v in vector], float)
    tone = np.where(np.isfinite(values), 220 * 2 ** (np.floor(np.clip(np.nan_to_num(values), -1, 1) * 36) / 12), 0)
    sound = np.sin(2 * np.pi * tone[:, None] * time) * shape * (tone > 0)[:, None] * 0.5
    return wav(sound.ravel(), rate)
