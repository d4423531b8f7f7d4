"""Training samples: windows around annotated points, windows with nothing, splits, oversampling, batches.

All chance is a hash of names and counters (``functions.scalar.uniform``), so the
same seed gives the same samples whatever the partitioning, and the split of a
point does not depend on how often it is drawn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import uniform
from ..sources.scratch import Scratch
from .config import Config

NOTHING_FACTOR = 1.2
POINT_TRIES, NEGATIVE_TRIES = 2000, 1000
"""Proposals for each wanted sample at most; the quota is filled from those that fit, in order."""
ROUNDS = (2, 8, 40, 120, 400, 1200)
"""Proposals for each wanted sample after each round; only groups below their quota go on, up to the limit."""
CHUNK = 4096
"""Proposals of a group that one row stands for until they are spread over the tasks."""
BLOCK = {"t": 4, "y": 16, "x": 16}
"""Sizes of the blocks of places in which free ones are counted."""
TOGETHER = 64
"""Blocks whose places are marked at once."""
DRAWS = 1 << 14
"""Draws of a range of free places that meet its blocks at once."""


def window_fits(config: Config, t: str = "t", y: str = "y", x: str = "x") -> Column:
    (f0, f1), (hy, hx) = config.nframes, config.half_size
    t, y, x = F.col(t), F.col(y), F.col(x)
    return (x - hx >= 0) & (x + hx + 1 <= F.col("w")) & (y - hy >= 0) & (y + hy + 1 <= F.col("h")) & (t - f0 >= 0) & (t + f1 <= F.col("n_frames"))


def contains(config: Config, roi: str = "r") -> Column:
    """Whether the window centred at ``t, y, x`` contains the point ``<roi>_t, _y, _x``; the bounds differ by axis."""
    (f0, f1), (hy, hx) = config.nframes, config.half_size
    rt, ry, rx = (F.col(f"{roi}_{c}") for c in "tyx")
    return rt.between(F.col("t") - f0, F.col("t") + f1) & ry.between(F.col("y") - hy, F.col("y") + hy + 1) & (F.col("x") - hx < rx) & (rx < F.col("x") + hx + 1)


def jitter(config: Config, *key: Column | int | str) -> list[Column]:
    """``t, y, x`` moved by up to 2 frames and a fifth of the half window; floors, so shifts reach further down than up."""
    reach = {"t": 2.0, "y": config.half_size[0] * 0.2, "x": config.half_size[1] * 0.2}
    return [F.floor(F.col(c) + (uniform(*key, c) * 2 - 1) * r).cast("int").alias(c) for c, r in reach.items()]


def balance(points: DataFrame, naug: int) -> DataFrame:
    """``movie_id, cat, n, nmax, quota``: classes below 3/4 of the largest aim at 0.85 of it, times ``naug``."""
    counts = points.groupBy("movie_id", "cat").agg(F.count("*").alias("n"))
    most = counts.withColumn("nmax", F.max("n").over(Window.partitionBy("movie_id")))
    goal = F.when(F.col("n") < 0.75 * F.col("nmax"), 0.85 * F.col("nmax")).otherwise(F.col("n"))
    return most.withColumn("quota", F.ceil(goal * naug).cast("bigint"))


def split(points: DataFrame, val_ratio: float, seed: int) -> DataFrame:
    """Adds ``split``, drawn for each point and independent of repetitions."""
    draw = uniform(seed, "split", F.col("movie_id"), F.col("cat"), F.col("roi_idx"))
    return points.withColumn("split", F.when(draw < val_ratio, "val").otherwise("train"))


def numbered(rows: DataFrame, keys: Sequence[str], slot: Column, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... by group of ``keys`` in the order of ``slot`` and then of ``order``.

    Slots are ranges of the order: they are counted first, so a task numbers one
    slot and a group's slots, never a group's rows.
    """
    dealt = rows.withColumn("_slot", slot)
    sums = dealt.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order))
    return dealt.join(before, [*keys, "_slot"]).withColumn(name, F.col("_before") + inside).drop("_slot", "_before")


def _filled(wanted: DataFrame, keys: Sequence[str], limit: int, fitting: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first ``quota`` of each group's proposals ``k`` = 1, 2, ... that ``fitting`` keeps, among ``quota * limit``.

    ``wanted`` has the ``keys`` of a group and its ``quota``.  Proposals are made
    in rounds, for the groups still below it; those that fit are kept in the
    shared folder.  They are counted by ``CHUNK`` of ``k``, and only the chunk in
    which a group reaches its quota is numbered, to find the last ``k`` that it keeps.
    """
    scratch = Scratch(wanted.sparkSession, "sampling")
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given by number, or the few chunks are put into one task
    short = scratch.save(wanted.withColumn("have", F.lit(0).cast("bigint")), "short-0")
    slot = F.floor((F.col("k") - 1) / CHUNK).alias("_slot")
    out, low = None, 0
    for i, high in enumerate([*(r for r in ROUNDS if r < limit), limit]):
        first, last = F.col("quota") * low, F.col("quota") * high
        chunks = short.where(last > first).select("*", F.explode(F.sequence(F.floor(first / CHUNK), F.floor((last - 1) / CHUNK))).alias("chunk")).repartition(tasks, *keys, "chunk")
        tries = chunks.select("*", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, (F.col("chunk") + 1) * CHUNK)).alias("k")).where((F.col("k") > first) & (F.col("k") <= last)).drop("chunk", "quota", "have")
        fit = scratch.save(fitting(tries), f"fit-{i}")
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slot"))
        slots = scratch.save(fit.groupBy(*keys, slot).agg(F.count("*").alias("_n")).withColumn("_upto", upto), f"slots-{i}")
        turned = slots.join(short.select(*keys, (F.col("quota") - F.col("have")).alias("_open")), list(keys)).where("_upto >= _open and _upto - _n < _open")
        inside = fit.select(*keys, "k", slot).join(turned, [*keys, "_slot"]).withColumn("_turn", F.col("_upto") - F.col("_n") + F.row_number().over(Window.partitionBy(*keys).orderBy("k")))
        ends = scratch.save(inside.where("_turn = _open").select(*keys, F.col("k").alias("_last")), f"ends-{i}")
        kept = fit.join(ends, list(keys), "left").where("_last is null or k <= _last").drop("_last")
        out = kept if out is None else out.unionByName(kept)
        made = slots.groupBy(*keys).agg(F.sum("_n").alias("made"))
        left = short.join(made, list(keys), "left").withColumn("have", F.col("have") + F.coalesce("made", F.lit(0))).drop("made").where("have < quota")
        short, low = scratch.save(left, f"short-{i + 1}"), high
        if high == limit or short.isEmpty():
            return out


def sample_points(points: DataFrame, movies: DataFrame, config: Config, naug: int = 1, val_ratio: float = 0.1, seed: int = 0, rep: int = 0, limit: int = POINT_TRIES) -> DataFrame:
    """``movie_id, rep, seq, t, y, x, cat, noisy, split``: one jittered window for each point, then noisy copies up to the quota.

    Points ``movie_id, cat, roi_idx, t, y, x``.  Copies are jittered windows of
    points chosen by hash; windows beyond the movie are skipped.
    """
    scratch = Scratch(points.sparkSession, "points")
    movies = scratch.save(movies, "movies")
    placed = split(points, val_ratio, seed).join(movies, "movie_id")
    ranked = numbered(placed, ["movie_id", "cat"], F.floor(F.col("roi_idx") / CHUNK), ["roi_idx"], "place").withColumn("place", F.col("place") - 1)
    placed = ranked = scratch.save(ranked, "ranked")
    own = placed.select("movie_id", "cat", "roi_idx", "split", *jitter(config, seed, rep, F.col("movie_id"), F.col("cat"), F.col("roi_idx")), "n_frames", "h", "w").where(window_fits(config))
    own = own.select("movie_id", F.col("roi_idx").cast("bigint").alias("seq"), "t", "y", "x", "cat", F.lit(False).alias("noisy"), "split")

    def fitting(tries: DataFrame) -> DataFrame:
        pick = F.floor(uniform(seed, rep, "pick", F.col("movie_id"), F.col("cat"), F.col("k")) * F.col("n")).cast("int")
        tried = tries.select("movie_id", "cat", "k", pick.alias("place")).join(ranked.drop("roi_idx").hint("shuffle_hash"), ["movie_id", "cat", "place"])
        return tried.select("movie_id", "cat", "k", "split", *jitter(config, seed, rep, "copy", F.col("movie_id"), F.col("cat"), F.col("k")), "n_frames", "h", "w").where(window_fits(config))

    copies = _filled(balance(placed, naug), ["movie_id", "cat"], limit, fitting)
    copies = copies.select("movie_id", (F.col("k") + 1000000000).cast("bigint").alias("seq"), "t", "y", "x", "cat", F.lit(True).alias("noisy"), "split")
    return own.unionByName(copies).select("movie_id", F.lit(rep).alias("rep"), "seq", "t", "y", "x", "cat", "noisy", "split")


def free_blocks(points: DataFrame, movies: DataFrame, config: Config) -> DataFrame:
    """Blocks of places with windows that fit and contain no point: ``movie_id, block, t, y, x`` (the first place), ``dt, dy, dx`` (sizes), ``n`` and ``bits``.

    ``movies`` has ``movie_id, n_frames, h, w``.  ``n`` are the free places; a block
    that points reach has a bit for each of its places in raster order, others
    have no ``bits`` and are free throughout.  Blocks without a free place are left
    out.  Equal points count once, so a block has no more of them than places
    around it.
    """
    (f0, f1), (hy, hx) = config.nframes, config.half_size
    low = {"t": F.lit(f0), "y": F.lit(hy), "x": F.lit(hx)}
    high = {"t": F.col("n_frames") - f1, "y": F.col("h") - hy - 1, "x": F.col("w") - hx - 1}
    counts = {c: F.greatest(F.lit(0), F.ceil((high[c] - low[c] + 1) / BLOCK[c])).cast("bigint") for c in BLOCK}
    sized = movies.select("movie_id", *[high[c].cast("int").alias(f"high_{c}") for c in BLOCK], *[counts[c].alias(f"n_{c}") for c in BLOCK])
    number = F.expr("(_bt * n_y + _by) * n_x + _bx")

    reach = {  # the places whose window holds a point, as contains() has it, from and to
        "t": (F.ceil(F.col("t") - f1), F.floor(F.col("t") + f0)), "y": (F.ceil(F.col("y") - hy - 1), F.floor(F.col("y") + hy)),
        "x": (F.floor(F.col("x") - hx) + (F.col("x") != F.floor("x")).cast("int"), F.ceil(F.col("x") + hx) - 1),
    }
    boxes = points.select("movie_id", "t", "y", "x").distinct().join(sized, "movie_id")
    for c in BLOCK:
        boxes = boxes.withColumn(f"a_{c}", F.greatest(low[c], reach[c][0]).cast("int")).withColumn(f"b_{c}", F.least(F.col(f"high_{c}"), reach[c][1]).cast("int"))
    boxes = boxes.where("a_t <= b_t and a_y <= b_y and a_x <= b_x")
    for c, size in BLOCK.items():
        block = lambda end: F.floor((F.col(f"{end}_{c}") - low[c]) / size).cast("bigint")  # noqa: B023, E731
        boxes = boxes.withColumn(f"_b{c}", F.explode(F.sequence(block("a"), block("b"))))
    boxes = boxes.select("movie_id", number.alias("block"), *[(F.col(f"_b{c}") * size + low[c]).cast("int").alias(c) for c, size in BLOCK.items()], *[F.col(n) for c in BLOCK for n in (f"high_{c}", f"a_{c}", f"b_{c}")])
    kind = points.schema["movie_id"].dataType.simpleString()
    near = boxes.withColumn("_group", F.floor(F.col("block") / TOGETHER))
    marked = near.groupBy("movie_id", "_group").applyInArrow(lambda table: _marked(table), f"movie_id {kind}, block bigint, free int, bits binary")

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = sized.where("n_t > 0 and n_y > 0 and n_x > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_t") * F.col("n_y") * F.col("n_x") - 1) / CHUNK))).alias("_chunk")).repartition(tasks, "movie_id", "_chunk")
    every = every.select("*", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("n_t") * F.col("n_y") * F.col("n_x"), (F.col("_chunk") + 1) * CHUNK) - 1)).alias("block"))
    at = {"t": F.expr("block div (n_y * n_x)"), "y": F.expr("block div n_x % n_y"), "x": F.expr("block % n_x")}
    for c, size in BLOCK.items():
        every = every.withColumn(c, (at[c] * size + low[c]).cast("int")).withColumn(f"d{c}", F.least(F.lit(size), F.col(f"high_{c}") - F.col(c) + 1).cast("int"))
    both = every.join(marked, ["movie_id", "block"], "left").withColumn("n", F.coalesce("free", F.col("dt") * F.col("dy") * F.col("dx")))
    return both.where("n > 0").select("movie_id", "block", *BLOCK, *[f"d{c}" for c in BLOCK], "n", "bits")


def _marked(table: pa.Table) -> pa.Table:
    """The free places of blocks: boxes of taken places are marked at their corners and summed up along each axis."""
    own, at, row = np.unique(table.column("block").to_numpy(), return_index=True, return_inverse=True)
    marks = np.zeros([len(own), *(n + 1 for n in BLOCK.values())], np.int32)
    ends, sizes = [], []
    for c, n in BLOCK.items():
        first, high, a, b = (table.column(name).to_numpy() for name in (c, f"high_{c}", f"a_{c}", f"b_{c}"))
        size = np.minimum(n, high - first + 1)
        ends.append((np.maximum(a - first, 0), np.minimum(b - first, size - 1) + 1))
        sizes.append(size[at])
    for corner in np.ndindex(2, 2, 2):
        np.add.at(marks, (row, *(ends[i][side] for i, side in enumerate(corner))), (-1) ** sum(corner))
    free = marks.cumsum(1).cumsum(2).cumsum(3) == 0
    found = [free[i, :nt, :ny, :nx] for i, (nt, ny, nx) in enumerate(zip(*sizes, strict=True))]
    bits = [np.packbits(f).tobytes() for f in found]
    return pa.table({"movie_id": table.column("movie_id").take(pa.array(at)), "block": pa.array(own), "free": pa.array([int(f.sum()) for f in found], pa.int32()), "bits": pa.array(bits, pa.binary())})


def _nth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the ``nth`` free places of blocks."""
    for batch in batches:
        nth, bits = batch.column("nth").to_numpy().astype(np.int64), batch.column("bits").to_pylist()
        first, size = ([batch.column(f"{prefix}{c}").to_numpy().astype(np.int64) for c in BLOCK] for prefix in ("", "d"))
        place = np.array([n if b is None else np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8)))[n] for n, b in zip(nth.tolist(), bits, strict=True)], np.int64)
        found = first[0] + place // (size[1] * size[2]), first[1] + place // size[2] % size[1], first[2] + place % size[2]
        yield pa.RecordBatch.from_arrays([batch.column("movie_id"), batch.column("k"), *(pa.array(f.astype(np.int32)) for f in found)], names=["movie_id", "k", *BLOCK])


def sample_nothing(points: DataFrame, movies: DataFrame, config: Config, naug: int = 1, val_ratio: float = 0.1, seed: int = 0, rep: int = 0) -> DataFrame:
    """Windows at random places that contain no point, 1.2 times the largest class, in the columns of ``sample_points``.

    Free places are counted by block and numbered by running sums over blocks; a
    draw is the number of a free place, each as likely as any other, so nothing is
    proposed in vain and a quota is full wherever a movie has one free place.  A
    draw meets its block by ranges of numbers as wide as a block; of a range with
    very many draws, about ``DRAWS`` meet the blocks by themselves.  Neither side
    of that join may be broadcast: both are as long as the quotas.
    """
    scratch = Scratch(points.sparkSession, "nothing")
    most = points.groupBy("movie_id", "cat").agg(F.count("*").alias("c")).groupBy("movie_id").agg(F.max("c").alias("nmax"))
    wanted = scratch.save(movies.join(most, "movie_id").withColumn("quota", F.ceil(F.col("nmax") * NOTHING_FACTOR * naug).cast("bigint")), "wanted")
    blocks = scratch.save(free_blocks(points, wanted, config), "blocks")
    sums = blocks.groupBy("movie_id", F.floor(F.col("block") / CHUNK).alias("slot")).agg(F.sum("n").alias("own"))
    earlier = Window.partitionBy("movie_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("movie_id", "slot", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy("movie_id")).alias("free"))
    inside = Window.partitionBy("movie_id", "slot").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("slot", F.floor(F.col("block") / CHUNK)).join(starts.drop("free"), ["movie_id", "slot"])
    placed = placed.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("slot", "before")
    width = BLOCK["t"] * BLOCK["y"] * BLOCK["x"]
    open_ = wanted.join(starts.groupBy("movie_id").agg(F.max("free").alias("free")), "movie_id").where("quota > 0")
    open_ = scratch.save(open_.withColumn("turns", F.ceil(F.col("quota") / (F.floor(F.col("free") / width) + 1) / DRAWS).cast("int")), "open")
    ranged = placed.join(open_.select("movie_id", "turns"), "movie_id").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("range", F.explode(F.expr(f"sequence(start div {width}, (start + n - 1) div {width})")))

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = open_.select("movie_id", "quota", "free", "turns", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / CHUNK))).alias("chunk")).repartition(tasks, "movie_id", "chunk")
    draws = chunks.select("movie_id", "free", "turns", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least(F.col("quota"), (F.col("chunk") + 1) * CHUNK))).alias("k"))
    chance = lambda what: uniform(seed, rep, what, F.col("movie_id"), F.col("k"))
    share = chance("nothing") + chance("finer") / 4294967296.0
    drawn = draws.withColumn("number", F.least(F.floor(share * F.col("free")), F.col("free") - 1)).withColumn("range", F.expr(f"number div {width}")).withColumn("turn", (F.col("k") % F.col("turns")).cast("int"))
    met = drawn.hint("merge").join(ranged, ["movie_id", "turn", "range"]).where("number between start and start + n - 1").select("movie_id", "k", (F.col("number") - F.col("start")).alias("nth"), *BLOCK, *[f"d{c}" for c in BLOCK], "bits")
    kind = points.schema["movie_id"].dataType.simpleString()
    kept = met.mapInArrow(_nth, f"movie_id {kind}, k bigint, t int, y int, x int")
    return kept.select(
        "movie_id", F.lit(rep).alias("rep"), (F.col("k") + 2000000000).cast("bigint").alias("seq"), "t", "y", "x", F.lit(0).alias("cat"),
        (chance("noise") < 0.5).alias("noisy"), F.when(chance("side") < val_ratio, "val").otherwise("train").alias("split"),
    )


def sample_negatives(points: DataFrame, movies: DataFrame, config: Config, add_nothing: int, naug: int = 1, val_ratio: float = 0.1, seed: int = 0, rep: int = 0) -> DataFrame:
    """Hand-picked places with nothing, as class 0: each once, and for ``naug`` > 1 noisy copies up to ``add_nothing`` times as many."""
    chosen = points.select("movie_id", F.lit(0).alias("cat"), "roi_idx", "t", "y", "x")
    if add_nothing <= 1:
        return sample_points(chosen.limit(0), movies, config, 1, val_ratio, seed, rep)
    both = sample_points(chosen, movies, config, add_nothing, val_ratio, seed, rep, NEGATIVE_TRIES)
    return both if naug > 1 else both.where(~F.col("noisy"))


def repetitions(movies: DataFrame, factors: dict[str, int]) -> DataFrame:
    """``movie_id, rep``: every movie once, named ones as often as they say; unknown names are an error."""
    if unknown := sorted(set(factors) - {str(r[0]) for r in movies.select("movie_id").where(F.col("movie_id").cast("string").isin(list(factors))).distinct().collect()}):
        raise ValueError(f"no such movies: {', '.join(unknown)}")
    many = F.lit(1)
    for name, factor in factors.items():
        many = F.when(F.col("movie_id").cast("string") == name, factor).otherwise(many)
    return movies.select("movie_id", F.explode(F.sequence(F.lit(0), many - 1)).alias("rep"))


def oversampled(samples: DataFrame) -> DataFrame:
    """Samples of all repetitions without the validation samples of any but the first."""
    return samples.where((F.col("split") == "train") | (F.col("rep") == 0))


def minibatches(samples: DataFrame, size: int, epoch: int, seed: int = 0, keys: tuple[str, ...] = ("movie_id", "rep", "seq"), rows: int = 100000) -> DataFrame:
    """Adds ``batch``: shuffled by hash, cut into batches of ``size``, the incomplete last one left out.

    Places are counted over ranges of the hash first, then inside each range; there is a range for about ``rows`` samples,
    so a task's share stays the same as the samples grow.
    """
    buckets = samples.count() // rows + 64
    drawn = samples.withColumn("u", uniform(seed, epoch, *[F.col(k) for k in keys])).withColumn("slot", F.floor(F.col("u") * buckets).cast("int"))
    sums = drawn.groupBy("slot").agg(F.count("*").alias("n"))
    before = sums.select("slot", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = drawn.join(before, "slot").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("slot").orderBy("u", *keys)) - 1)
    full = F.floor(F.col("total") / size)
    return placed.withColumn("batch", F.floor(F.col("place") / size)).where(F.col("batch") < full).drop("u", "slot", "before", "total", "place")


def flips(voxels: DataFrame, h: int, w: int, seed: int = 0, p: float = 0.3) -> DataFrame:
    """Windows ``win_id, t, y, x, v`` turned over along y, along x, each with probability ``p``."""
    turn = lambda axis, n: F.when(uniform(seed, "flip", axis, F.col("win_id")) < p, n - 1 - F.col(axis)).otherwise(F.col(axis)).cast("int")
    return voxels.withColumn("y", turn("y", h)).withColumn("x", turn("x", w))


def squares(voxels: DataFrame, h: int, w: int, seed: int = 0, p: float = 0.15, mode: str = "zero") -> DataFrame:
    """A square of side 1 to 11, at the same place in every frame of a window, set to 0 or raised by 1."""
    draw = lambda what: uniform(seed, mode, what, F.col("win_id"))
    side = (F.floor(draw("side") * F.lit(min(11, h - 2, w - 2))) + 1).cast("int")
    own = voxels.withColumn("side", side)
    own = own.withColumn("y0", F.floor(draw("y") * (h - 1 - F.col("side"))).cast("int")).withColumn("x0", F.floor(draw("x") * (w - 1 - F.col("side"))).cast("int"))
    inside = (draw("gate") < p) & F.col("y").between(F.col("y0"), F.col("y0") + F.col("side") - 1) & F.col("x").between(F.col("x0"), F.col("x0") + F.col("side") - 1)
    return own.withColumn("v", F.when(inside, F.lit(0) if mode == "zero" else F.col("v") + 1).otherwise(F.col("v"))).drop("side", "y0", "x0")
