"""From movies to probability maps: window grids, normalised windows, scoring, accumulation.

A window is the cube of ``nframes[0]`` frames before its centre and
``nframes[1]`` from it on, ``half_size`` rows and columns to either side.
``detect`` is the production form.  A task makes a block of the maps, some frames
of a part of the picture, from the frames around it: it scores every window that
reaches the block, those that reach two blocks in both, and adds them up along
one axis after another.  So the maps come dense and final from where they are
made; nothing but the frames with their surroundings is shuffled, and a block
bounds a task's memory whatever the length of a movie and the size of its frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .config import Config
from .skew import spread_join

Scorer = Callable[[np.ndarray, Config], np.ndarray]
"""From normalised windows (n, frames, rows, columns), 0 to 255, to the classes' probabilities (n, classes but 0)."""


def shifts(model: int, n_models: int, dxy: int, dz: int, legacy: bool = True) -> tuple[int, int]:
    """Frames and pixels by which a model's grid is shifted; the legacy form takes each from the other's step."""
    a, b = model * dxy // n_models, model * dz // n_models
    return (a, b) if legacy else (b, a)


def grid_counts(n_frames: Column, h: Column, w: Column, config: Config, shift_t: int, shift_xy: int, dz: int, dxy: int) -> tuple[Column, Column, Column]:
    """Windows along time (of a movie already padded), rows and columns."""
    along = lambda length, size, shift, step: F.greatest(F.lit(0), F.ceil((length - size - shift) / F.lit(step))).cast("int")
    return along(n_frames, sum(config.nframes), shift_t, dz), along(h, 2 * config.half_size[0] + 1, shift_xy, dxy), along(w, 2 * config.half_size[1] + 1, shift_xy, dxy)


def centres(movies: DataFrame, config: Config, n_models: int = 1, dxy: int = 10, dz: int = 2, legacy: bool = True) -> DataFrame:
    """``movie_id, model_id, win_id, t, y, x`` of every window, t in the padded movie; ids run along x, then y, then t.

    A movie smaller than a window has none.
    """
    out = None
    for model in range(n_models):
        shift_t, shift_xy = shifts(model, n_models, dxy, dz, legacy)
        nz, ny, nx = grid_counts(F.col("n_frames") + sum(config.nframes), F.col("h"), F.col("w"), config, shift_t, shift_xy, dz, dxy)
        sized = movies.select("movie_id", nz.alias("nz"), ny.alias("ny"), nx.alias("nx")).where("nz > 0 and ny > 0 and nx > 0")
        ids = sized.withColumn("win_id", F.explode(F.expr("sequence(0L, bigint(nz) * ny * nx - 1)")))
        own = ids.select(
            "movie_id", F.lit(model).alias("model_id"), "win_id",
            (F.expr("win_id div (bigint(ny) * nx)") * dz + config.nframes[0] + shift_t).cast("int").alias("t"),
            (F.expr("win_id div nx % ny") * dxy + config.half_size[0] + shift_xy).cast("int").alias("y"),
            (F.expr("win_id % nx") * dxy + config.half_size[1] + shift_xy).cast("int").alias("x"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def pad_time(voxels: DataFrame, before: int, after: int) -> DataFrame:
    """First frames repeated ``before`` times and last ones ``after`` times; t counts from the padding's start."""
    last = voxels.groupBy("movie_id").agg(F.max("t").alias("last"))
    both = voxels.join(last, "movie_id")
    first_copies = F.when(F.col("t") == 0, F.sequence(F.lit(0), F.lit(before))).otherwise(F.array(F.col("t") + before))
    last_copies = F.when(F.col("t") == F.col("last"), F.sequence(F.col("t") + before, F.col("t") + before + after)).otherwise(F.array(F.col("t") + before))
    return both.select("movie_id", F.explode(F.array_union(first_copies, last_copies)).alias("t"), "y", "x", "v")


def window_voxels(centres: DataFrame, voxels: DataFrame, config: Config) -> DataFrame:
    """Every voxel of every window, as ``movie_id, model_id, win_id, ct, cy, cx, t, y, x, v``: an equi-join on exploded offsets.

    For tests and small grids; ``detect`` does not form these rows.
    """
    (f0, f1), (hy, hx) = config.nframes, config.half_size
    span = lambda c, a, b: F.explode(F.sequence(F.col(c) - a, F.col(c) + b))
    need = centres.select("movie_id", "model_id", "win_id", F.col("t").alias("ct"), F.col("y").alias("cy"), F.col("x").alias("cx"))
    need = need.withColumn("t", span("ct", f0, f1 - 1)).withColumn("y", span("cy", hy, hy)).withColumn("x", span("cx", hx, hx))
    return need.hint("shuffle_hash").join(voxels, ["movie_id", "t", "y", "x"])


def minmax(rows: DataFrame, keys: list[str], top: float = 255.0, truncate: bool = True, eps: float | None = None) -> DataFrame:
    """``v`` scaled to 0..``top`` over each group of ``keys``, as ``s``; flat groups give 0.

    With ``truncate`` the result is cut to whole numbers, never rounded; with
    ``eps`` the range is at least that instead of 1 for flat groups.
    """
    ranges = rows.groupBy(*keys).agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))
    spread = F.col("high") - F.col("low")
    spread = F.greatest(spread, F.lit(eps)) if eps is not None else F.when(spread > 0, spread).otherwise(1.0)
    scaled = (F.col("v") - F.col("low")) / spread * top
    return rows.join(ranges, keys).withColumn("s", F.floor(scaled).cast("int") if truncate else scaled).drop("low", "high")


def splat(scored: DataFrame, config: Config, value: str = "p") -> DataFrame:
    """Adds ``value`` of each window to the block around its centre: ``total`` and ``n`` by ``movie_id, cat, t, y, x``.

    Along one axis after another, so a window becomes as many rows as the block's
    sides together and not as its volume has places.  What shares a place is added
    up first; rows meet by frame, and stay there for rows and columns.
    """
    back, ahead, by, bx = config.bounds
    add = lambda rows: rows.groupBy("movie_id", "cat", "t", "y", "x").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    spread = lambda rows, c, a, b: rows.withColumn(c, F.explode(F.sequence(F.col(c) - a, F.col(c) + b)))
    sums = spread(add(scored.select("movie_id", "cat", "t", "y", "x", F.col(value).alias("total"), F.lit(1).cast("bigint").alias("n"))), "t", back, ahead - 1)
    sums = add(sums.repartition("movie_id", "cat", "t"))
    return add(spread(add(spread(sums, "y", by, by)), "x", bx, bx))


def divide(sums: DataFrame, movies: DataFrame, config: Config, classes: int) -> DataFrame:
    """Averages as whole numbers 0..255 on the movie's own grid, the padding cropped; uncovered voxels are 0."""
    grid = (
        movies.select("movie_id", "h", "w", F.explode(F.expr("sequence(0, n_frames - 1)")).alias("t"))
        .select("movie_id", "t", "w", F.explode(F.expr("sequence(0, h - 1)")).alias("y"))
        .select("movie_id", "t", "y", F.explode(F.expr("sequence(0, w - 1)")).alias("x"))
        .withColumn("cat", F.explode(F.sequence(F.lit(1), F.lit(classes))))
    )
    shown = sums.select("movie_id", "cat", (F.col("t") - config.nframes[0]).alias("t"), "y", "x", "total", "n")
    level = F.floor(F.col("total") / F.greatest(F.col("n"), F.lit(1)) * 255).cast("int")
    return grid.hint("shuffle_hash").join(shown, ["movie_id", "cat", "t", "y", "x"], "left").select("movie_id", "cat", "t", "y", "x", F.coalesce(level, F.lit(0)).alias("p8"))


def before_after(windows: np.ndarray, config: Config) -> np.ndarray:
    """A scorer without weights: how much brighter a window is before (shrinking) or after (growing) its centre, in 4096ths."""
    total = windows.astype(np.int64).sum((2, 3))
    before, after = total[:, : config.nframes[0]].sum(1), total[:, config.nframes[0] :].sum(1)
    both = np.stack([before, after], 1)
    return (4096 * both // (before + after + 1)[:, None]) / 4096


def sliding(cube: np.ndarray, size: tuple[int, ...], pick: np.ufunc) -> np.ndarray:
    """Least (``np.minimum``) or greatest value of every window of ``size`` in a cube.

    Along one axis after another: the axis is cut into pieces as long as a window,
    so a window is the end of one and the start of the next, and running extrema
    from either side of the pieces give it in one comparison, however long it is.
    """
    for axis, k in enumerate(size):
        cube = np.moveaxis(cube, axis, 0)
        n = len(cube)
        if n < k:
            return np.zeros([max(0, m - w + 1) for m, w in zip(np.moveaxis(cube, 0, axis).shape, size, strict=True)], cube.dtype)
        pieces = np.concatenate([cube, np.repeat(cube[-1:], -n % k, axis=0)]).reshape(-1, k, *cube.shape[1:])
        ahead = pick.accumulate(pieces, axis=1).reshape(-1, *cube.shape[1:])
        behind = pick.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].reshape(-1, *cube.shape[1:])
        cube = np.moveaxis(pick(behind[: n - k + 1], ahead[k - 1 : n]), 0, axis)
    return cube


def normalise(windows: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Windows scaled to 0..255 by their ranges, if these are not given their own, and truncated; flat windows become 0."""
    axes = (1, 2, 3)
    low = (windows.min(axes) if low is None else low).reshape(-1, 1, 1, 1)
    spread = (windows.max(axes) if high is None else high).reshape(-1, 1, 1, 1) - low
    return np.floor((windows - low) / np.where(spread > 0, spread, 1) * 255).astype(np.uint8)


def _reaching(count: int, first: int, step: int, low: int, high: int) -> np.ndarray:
    """Those of the numbers ``first + step * i``, ``i`` below ``count``, that lie from ``low`` to ``high``; as ``i``."""
    a, b = max(0, -(-(low - first) // step)), min(count - 1, (high - first) // step)
    return np.arange(a, b + 1)


class _Block:
    """Frames around one block of a movie: frames ``t0`` to ``t1``, rows ``y0`` to ``y1``, columns ``x0`` to ``x1``, all inclusive."""

    def __init__(self, table: pa.Table, config: Config, chunk: int, tile: int):
        one = {c: table.column(c)[0].as_py() for c in ("n_frames", "h", "w", "chunk", "ty", "tx", "top", "left", "ch", "cw")}
        self.config, self.n, self.h, self.w = config, one["n_frames"], one["h"], one["w"]
        times = table.column("t").to_numpy()
        order = np.argsort(times)
        self.first, self.top, self.left = int(times.min()), one["top"], one["left"]
        self.cube = np.stack(table.column("pixels").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), one["ch"], one["cw"]))[order].astype(float)
        self.t0, self.y0, self.x0 = one["chunk"] * chunk, one["ty"] * tile, one["tx"] * tile
        self.t1, self.y1, self.x1 = min(self.n, self.t0 + chunk) - 1, min(self.h, self.y0 + tile) - 1, min(self.w, self.x0 + tile) - 1
        self.movie = table.column("movie_id")[0].as_py(), table.schema.field("movie_id").type

    def grid(self, shift_t: int, shift_xy: int, dxy: int, dz: int, bounds: tuple[int, int, int, int]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
        """Along time, rows and columns: numbers and centres of a model's windows that reach the block by ``bounds``, and how many windows there are; times are those of the padded movie less its padding."""
        (hy, hx), (back, ahead, by, bx) = self.config.half_size, bounds
        out = []
        for length, start, step, low, high in (
            (self.n - shift_t, shift_t, dz, self.t0 - ahead + 1, self.t1 + back),
            (self.h - 2 * hy - 1 - shift_xy, hy + shift_xy, dxy, self.y0 - by, self.y1 + by),
            (self.w - 2 * hx - 1 - shift_xy, hx + shift_xy, dxy, self.x0 - bx, self.x1 + bx),
        ):
            count = max(0, ceil(length / step))
            which = _reaching(count, start, step, low, high)
            out.append((which, start + step * which, count))
        return tuple(zip(*out, strict=True))

    def windows(self, times: np.ndarray, ys: np.ndarray, xs: np.ndarray, dxy: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each of the centre times: its place, and the windows (rows, columns, and their cubes) with their least and greatest values."""
        (f0, f1), (hy, hx) = self.config.nframes, self.config.half_size
        size = f0 + f1, 2 * hy + 1, 2 * hx + 1
        frames = np.clip(np.arange(times[0] - f0, times[-1] + f1), 0, self.n - 1) - self.first
        rows, columns = slice(ys[0] - hy - self.top, ys[-1] + hy + 1 - self.top), slice(xs[0] - hx - self.left, xs[-1] + hx + 1 - self.left)
        cube = self.cube[frames, rows, columns]
        view = np.lib.stride_tricks.sliding_window_view(cube, size)
        low, high = (sliding(cube, size, pick)[:, ::dxy, ::dxy] for pick in (np.minimum, np.maximum))
        for k, t in enumerate(times):
            at = t - times[0]
            yield k, view[at, ::dxy, ::dxy], low[at], high[at]


def _blocks(images: DataFrame, config: Config, chunk: int, tile: int, bounds: tuple[int, int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Frames dealt to the blocks whose windows need them, cut to what those need, and the movies' sizes."""
    (f0, f1), (hy, hx), (back, ahead, by, bx) = config.nframes, config.half_size, bounds
    sized = images.groupBy("movie_id").agg(F.count("*").cast("int").alias("n_frames"), F.first("h").cast("int").alias("h"), F.first("w").cast("int").alias("w"), F.count("*").alias("frames"))
    sized = Scratch(images.sparkSession, "detect").save(sized, "sizes")
    near = spread_join(images.select("movie_id", "t", "pixels"), sized, ["movie_id"], "frames", ["t"])
    whole = lambda c, d: F.floor(c / F.lit(d)).cast("int")
    earliest, latest = F.greatest(F.lit(0), whole(F.col("t") - back - f1 + 1, chunk)), F.least(whole(F.col("n_frames") - 1, chunk), whole(F.col("t") + ahead - 1 + f0, chunk))
    dealt = near.withColumn("chunk", F.explode(F.sequence(earliest, latest)))
    for c, n in (("ty", "h"), ("tx", "w")):
        dealt = dealt.withColumn(c, F.explode(F.sequence(F.lit(0), whole(F.col(n) - 1, tile))))
    edge = lambda c, n, margin: (F.greatest(F.lit(0), F.col(c) * tile - margin), F.least(F.col(n), (F.col(c) + 1) * tile + margin))
    (top, bottom), (left, right) = edge("ty", "h", by + hy), edge("tx", "w", bx + hx)
    cut = dealt.withColumns({"top": top, "left": left, "ch": bottom - top, "cw": right - left})
    row = lambda y: F.slice("pixels", y * F.col("w") + F.col("left") + 1, F.col("cw"))
    part = F.flatten(F.transform(F.sequence(F.col("top"), F.col("top") + F.col("ch") - 1), row))
    pixels = F.when((F.col("ch") == F.col("h")) & (F.col("cw") == F.col("w")), F.col("pixels")).otherwise(part)
    return cut.withColumn("pixels", pixels).groupBy("movie_id", "chunk", "ty", "tx"), sized


def _scored(config: Config, scorers: list[Scorer], classes: int, dxy: int, dz: int, legacy: bool, chunk: int, tile: int, group: int):
    back, ahead, by, bx = config.bounds

    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, config, chunk, tile)
        shape = block.t1 - block.t0 + 1, block.y1 - block.y0 + 1, block.x1 - block.x0 + 1
        sums, counts = np.zeros((*shape, classes)), np.zeros(shape, np.int64)
        for model, scorer in enumerate(scorers):
            _, centres, _ = block.grid(*shifts(model, len(scorers), dxy, dz, legacy), dxy, dz, config.bounds)
            if not all(map(len, centres)):
                continue
            times, ys, xs = centres
            scores = np.zeros((len(times), len(ys), len(xs), classes))
            for k, windows, low, high in block.windows(times, ys, xs, dxy):
                cubes, low, high = windows.reshape(-1, *windows.shape[2:]), low.ravel(), high.ravel()
                parts = [slice(a, a + group) for a in range(0, len(cubes), group)]
                scores[k] = np.concatenate([scorer(normalise(cubes[p], low[p], high[p]), config) for p in parts]).reshape(*scores.shape[1:])
            reach = []
            for axis, (where, start, a, b) in enumerate(((times, block.t0, back, ahead - 1), (ys, block.y0, by, by), (xs, block.x0, bx, bx))):
                wide, hits = np.zeros((*scores.shape[:axis], shape[axis], *scores.shape[axis + 1 :])), np.zeros(shape[axis], np.int64)
                for step in range(-a, b + 1):  # centres are apart, so one step of all of them hits a place once
                    at = where + step - start
                    inside = np.flatnonzero((at >= 0) & (at < shape[axis]))
                    np.moveaxis(wide, axis, 0)[at[inside]] += np.moveaxis(scores, axis, 0)[inside]
                    hits[at[inside]] += 1
                scores = wide
                reach.append(hits)
            sums += scores
            counts += reach[0][:, None, None] * reach[1][:, None] * reach[2]
        levels = np.floor(sums / np.maximum(counts, 1)[..., None] * 255).astype(np.int32)
        levels = np.moveaxis(levels, 3, 0).reshape(classes * shape[0], -1)
        n, (name, kind) = len(levels), block.movie
        columns = {"movie_id": pa.array([name] * n, kind), "cat": np.repeat(np.arange(1, classes + 1), shape[0]), "t": np.tile(np.arange(block.t0, block.t1 + 1), classes)}
        columns |= {c: np.full(n, v) for c, v in (("top", block.y0), ("left", block.x0), ("h", shape[1]), ("w", shape[2]))}
        columns = {c: v if isinstance(v, pa.Array) else pa.array(v.astype(np.int32)) for c, v in columns.items()}
        return pa.table(columns | {"levels": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * levels.shape[1]), pa.array(levels.ravel()))})

    return run


def detect_blocks(images: DataFrame, config: Config, scorers: list[Scorer], classes: int, dxy: int = 10, dz: int = 2, legacy: bool = True, chunk: int = 32, tile: int = 512, group: int = 512) -> DataFrame:
    """Probability maps as dense blocks: ``levels`` (0..255) of ``h`` by ``w`` places from row ``top`` and column ``left`` on, by ``movie_id, cat, t``."""
    blocks, _ = _blocks(images, config, chunk, tile, config.bounds)
    kind = images.schema["movie_id"].dataType.simpleString()
    return blocks.applyInArrow(_scored(config, scorers, classes, dxy, dz, legacy, chunk, tile, group), f"movie_id {kind}, cat int, t int, top int, left int, h int, w int, levels array<int>")


def detect(images: DataFrame, config: Config, scorers: list[Scorer], classes: int, **options) -> DataFrame:
    """Probability maps ``movie_id, cat, t, y, x, p8`` of frames ``movie_id, t, h, w, pixels``, averaged over an ensemble.

    Movies without a single window (too small) get maps of 0.  The options are
    those of ``detect_blocks``.
    """
    each = detect_blocks(images, config, scorers, classes, **options).select("movie_id", "cat", "t", "top", "left", "w", F.posexplode("levels").alias("place", "p8"))
    return each.select("movie_id", "cat", "t", (F.col("top") + F.expr("place div w")).cast("int").alias("y"), (F.col("left") + F.col("place") % F.col("w")).alias("x"), "p8")


def block_frames(blocks: DataFrame, value: str = "levels") -> DataFrame:
    """Blocks of ``detect_blocks`` as whole frames ``movie_id, cat, t, h, w, pixels``; a frame's blocks are what is gathered."""
    parts = blocks.groupBy("movie_id", "cat", "t").agg(F.max(F.col("top") + F.col("h")).alias("h"), F.max(F.col("left") + F.col("w")).alias("w"), F.array_sort(F.collect_list(F.struct("top", "left", F.struct("h", "w").alias("size"), F.col(value).alias("levels")))).alias("parts"))
    of_row = lambda y: F.filter("parts", lambda p: (p["top"] <= y) & (y < p["top"] + p["size"]["h"]))
    cut = lambda y: F.flatten(F.transform(of_row(y), lambda p: F.slice(p["levels"], (y - p["top"]) * p["size"]["w"] + 1, p["size"]["w"])))
    joined = F.flatten(F.transform(F.sequence(F.lit(0), F.col("h") - 1), cut))
    return parts.select("movie_id", "cat", "t", "h", "w", F.when(F.size("parts") == 1, F.col("parts")[0]["levels"]).otherwise(joined).alias("pixels"))


def _ranged(config: Config, n_models: int, dxy: int, dz: int, legacy: bool, chunk: int, tile: int):
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, config, chunk, tile)
        rows = []
        for model in range(n_models):
            (kt, ky, kx), centres, (_, ny, nx) = block.grid(*shifts(model, n_models, dxy, dz, legacy), dxy, dz, (0, 1, 0, 0))
            if not all(map(len, centres)):
                continue
            for k, windows, low, high in block.windows(*centres, dxy):
                number = (int(kt[k]) * ny + ky[:, None]) * nx + kx
                totals = [normalise(cubes, lo, hi).reshape(len(cubes), -1).sum(1, dtype=np.int64) for cubes, lo, hi in zip(windows, low, high, strict=True)]
                rows.append((np.full(number.size, model), number.ravel(), low.ravel(), high.ravel(), np.concatenate(totals)))
        model, number, low, high, total = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i in range(5))
        name, kind = block.movie
        columns = {"movie_id": pa.array([name] * len(model), kind), "model_id": pa.array(model.astype(np.int32)), "win_id": pa.array(number.astype(np.int64)), "low": pa.array(low), "high": pa.array(high), "total": pa.array(total.astype(np.int64))}
        return pa.table(columns)

    return run


def window_ranges(images: DataFrame, config: Config, n_models: int = 1, dxy: int = 10, dz: int = 2, legacy: bool = True, chunk: int = 32, tile: int = 512) -> DataFrame:
    """``movie_id, model_id, win_id, low, high`` of every window of the grids, and ``total``, the sum of its normalised pixels.

    A window belongs to the block its centre lies in; blocks are those of ``detect``.
    """
    blocks, _ = _blocks(images, config, chunk, tile, (0, 1, 0, 0))
    kind = images.schema["movie_id"].dataType.simpleString()
    return blocks.applyInArrow(_ranged(config, n_models, dxy, dz, legacy, chunk, tile), f"movie_id {kind}, model_id int, win_id bigint, low double, high double, total bigint")
