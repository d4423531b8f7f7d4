"""Typical object size from the spacing of tiles' autocorrelation peaks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .augment import gaussian
from .quantiles import quantiles


def frame_picks(movies: DataFrame, n: int = 12) -> DataFrame:
    """``movie_id, t``: up to ``n`` frames from first to last, evenly spaced and cut to whole numbers."""
    count = F.least(F.lit(n), "n_frames")
    picks = F.when(count == 1, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.floor(i * (F.col("n_frames") - 1) / F.greatest(count - 1, F.lit(1))).cast("int"))))
    return movies.where("n_frames > 0").select("movie_id", F.explode(picks).alias("t"))


def tile_validity(voxels: DataFrame, tile: int, least: float = 0.9) -> DataFrame:
    """``movie_id, t, ty, tx, share, valid`` of all whole tiles; a value of exactly 0 is outside the image."""
    cell = lambda c: F.floor(F.col(c) / tile).cast("int")
    tiles = voxels.groupBy("movie_id", "t", cell("y").alias("ty"), cell("x").alias("tx")).agg(F.count("*").alias("n"), F.avg((F.col("v") != 0).cast("double")).alias("share"))
    return tiles.where(F.col("n") == tile * tile).select("movie_id", "t", "ty", "tx", "share", (F.col("share") >= least).alias("valid"))


def radial_mean(voxels: DataFrame, cy: int, cx: int, radius: int) -> DataFrame:
    """Mean value by whole distance to a centre, ``movie_id, t, r, mean``."""
    r = F.bround(F.sqrt((F.col("y") - cy) * (F.col("y") - cy) + (F.col("x") - cx) * (F.col("x") - cx))).cast("int")
    return voxels.withColumn("r", r).where(F.col("r") <= radius).groupBy("movie_id", "t", "r").agg(F.avg("v").alias("mean"))


def first_peak(profile: np.ndarray, prominence: float) -> float:
    """Place of the first peak behind the first valley of the smoothed profile that rises so much above it; NaN if none."""
    p = np.convolve(profile, np.full(3, 1 / 3), "same")
    inner = np.arange(1, len(p) - 1)
    left, here, right = p[:-2], p[1:-1], p[2:]
    valleys = inner[(here < left) & (here <= right) & (inner > 1)]
    if not len(valleys):
        return float("nan")
    floor = np.minimum.accumulate(np.where(np.arange(len(p)) < valleys[0], np.inf, p))
    peaks = inner[(here > left) & (here >= right) & (inner > valleys[0]) & (here - floor[1:-1] >= prominence)]
    if not len(peaks):
        return float("nan")
    low, top, high = p[peaks[0] - 1 : peaks[0] + 2]
    bend = low - 2 * top + high
    return peaks[0] + (float(np.clip((low - high) / (2 * bend), -0.5, 0.5)) if bend else 0.0)


def _autocorrelation(image: np.ndarray, size: int) -> np.ndarray:
    power = np.abs(np.fft.rfft2(image, s=(size, size))) ** 2
    return np.fft.fftshift(np.fft.irfft2(power, s=(size, size)))


@lru_cache(maxsize=4)
def _taper(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The taper of a tile and what its autocorrelation is divided by."""
    taper = np.outer(np.hanning(n), np.hanning(n))
    own = _autocorrelation(taper, 2 * n)
    return taper, np.maximum(own / own.max(), 0.25)


def tile_spacing(tile: np.ndarray, sigma: float = 12.0, prominence: float = 0.1) -> float:
    """Spacing of one square tile in pixels: high-pass, taper, autocorrelation corrected for the taper, rings."""
    n = len(tile)
    valid = (tile != 0).astype(float)
    background = gaussian(tile * valid, sigma) / np.maximum(gaussian(valid, sigma), 1e-3)
    taper, share = _taper(n)
    ac = _autocorrelation((tile - background) * valid * taper, 2 * n) / share
    y, x = np.indices(ac.shape) - n
    ring = np.rint(np.hypot(y, x)).astype(int)
    keep = ring <= n // 2
    profile = np.bincount(ring[keep], ac[keep], n // 2 + 1) / np.maximum(np.bincount(ring[keep], minlength=n // 2 + 1), 1)
    return first_peak(profile / profile[2], prominence) if n > 4 and profile[2] > 0 else float("nan")


def tile_spacings(images: DataFrame, tile: int = 192, sigma: float = 12.0, least: float = 0.9, prominence: float = 0.1) -> DataFrame:
    """``movie_id, t, ty, tx, spacing`` of the valid tiles of frames; spacing is null without a peak.

    A frame is a row, so no shuffle is needed; tiles shrink to fit small frames.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, found = [], [], []
            for k, (pixels, h, w) in enumerate(zip(batch.column("pixels"), batch.column("h").to_pylist(), batch.column("w").to_pylist(), strict=True)):
                image = pixels.values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w)
                size = min(tile, h, w) // 2 * 2
                for y in range(0, h - size + 1, size) if size else ():
                    for x in range(0, w - size + 1, size):
                        part = image[y : y + size, x : x + size]
                        if (part != 0).mean() >= least:
                            value = tile_spacing(part, sigma, prominence)
                            rows.append(k)
                            places.append((y // size, x // size))
                            found.append(None if np.isnan(value) else value)
            where = np.array(places, np.int32).reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("movie_id").take(take), batch.column("t").take(take), pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(found, pa.float64())], names=["movie_id", "t", "ty", "tx", "spacing"])

    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    return images.select("movie_id", "t", "h", "w", "pixels").mapInArrow(task, f"movie_id {kinds['movie_id']}, t {kinds['t']}, ty int, tx int, spacing double")


def spacing_summary(tiles: DataFrame, frames: DataFrame, min_tiles: int = 10, min_fraction: float = 0.4, min_spacing: float = 8.0) -> DataFrame:
    """``movie_id, spacing, q25, q75, trend, n_tiles, n_valid, n_frames, status`` of valid tiles.

    ``frames`` are the sampled frames ``movie_id, t``, those without a valid tile
    included.  ``trend`` is the median of the last third of them over that of the
    first third, null where either has no spacing; ``status`` says why an
    estimate does not count.
    """
    own = Window.partitionBy("movie_id")
    ranked = frames.select("movie_id", "t").distinct().withColumn("place", F.row_number().over(own.orderBy("t"))).withColumn("n_frames", F.count("*").over(own).cast("int"))
    third = F.greatest(F.lit(1), F.floor(F.col("n_frames") / 3))
    both = tiles.join(ranked, ["movie_id", "t"])
    early, late = F.col("place") <= third, F.col("place") > F.col("n_frames") - third
    part = F.filter(F.array(F.lit("all"), F.when(early, F.lit("early")), F.when(late, F.lit("late"))), lambda p: p.isNotNull())
    found = quantiles(both.select("movie_id", "spacing", F.explode(part).alias("part")), ["movie_id", "part"], "spacing", {"spacing": 0.5, "q25": 0.25, "q75": 0.75})
    of = lambda name: found.where(F.col("part") == name)
    thirds = of("early").select("movie_id", F.col("spacing").alias("early")).join(of("late").select("movie_id", F.col("spacing").alias("late")), "movie_id").select("movie_id", (F.col("late") / F.col("early")).alias("trend"))
    counts = both.groupBy("movie_id").agg(F.count("spacing").alias("n_tiles"), F.count("*").alias("n_valid"), F.first("n_frames").alias("n_frames"))
    stats = counts.join(of("all").drop("part"), "movie_id", "left").join(thirds, "movie_id", "left").select("movie_id", "spacing", "q25", "q75", "trend", "n_tiles", "n_valid", "n_frames")
    few = (F.col("n_tiles") < min_tiles) | (F.col("n_tiles") < min_fraction * F.col("n_valid"))
    return stats.withColumn("status", F.when(few, "few tiles").when(F.col("spacing") < min_spacing, "pixel noise").otherwise("ok"))


def contrast_limits(voxels: DataFrame, low: float = 0.01, high: float = 0.998, frames: int = 10) -> DataFrame:
    """``movie_id, low, high``: percentiles of the values ``v`` of every n-th frame, about ``frames`` of a movie."""
    step = voxels.groupBy("movie_id").agg(F.greatest(F.lit(1), F.floor((F.max("t") + 1) / frames)).alias("step"))
    some = voxels.join(step, "movie_id").where(F.col("t") % F.col("step") == 0)
    return quantiles(some, ["movie_id"], "v", {"low": low, "high": high})
