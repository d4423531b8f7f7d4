"""Noise augmentations of windows, as numpy kernels over Arrow batches; each window draws from its own seed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import Config

FLIP = 0.3


def gaussian(cube: np.ndarray, sigma: float, axes: tuple[int, ...] | None = None) -> np.ndarray:
    """Blur along the axes, the border mirrored (edge repeated), out to four sigma."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / max(sigma, 1e-9)) ** 2)
    kernel /= kernel.sum()
    out = cube.astype(float)
    for axis in axes if axes is not None else range(cube.ndim):
        n = out.shape[axis]
        at = np.mod(np.arange(-reach, n + reach), 2 * n)
        wide = np.take(out, np.where(at < n, at, 2 * n - 1 - at), axis)
        out = sum(k * np.take(wide, np.arange(i, i + n), axis) for i, k in enumerate(kernel))
    return out


def blur(cube: np.ndarray, sigma: float) -> np.ndarray:
    """Blur along all axes with a Gaussian integrated over each voxel, out to four sigma, zero beyond the border."""
    reach = int(max(4 * sigma, 0.5) + 0.5)
    steps = np.array([math.erf((i - 0.5) / (math.sqrt(2) * sigma)) for i in range(-reach, reach + 2)])
    kernel = np.diff(steps) / 2
    out = cube.astype(float)
    for axis in range(cube.ndim):
        n = out.shape[axis]
        wide = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in range(cube.ndim)])
        out = sum(k * np.take(wide, np.arange(i, i + n), axis) for i, k in enumerate(kernel))
    return out


def gamma(cube: np.ndarray, power: float) -> np.ndarray:
    low, high = cube.min(), cube.max()
    return cube.astype(float) if high <= low else ((cube - low) / (high - low)) ** power * (high - low) + low


def augment(cube: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Contrast (p .25), one frame's contrast (.3), blur (.25), smoothed noise (.4), a black square (.15), a raised square (.15)."""
    out = cube.astype(float)
    if rng.random() < 0.25:
        out = gamma(out, rng.uniform(0.6, 1.4))
    if rng.random() < 0.3:
        frame = rng.integers(len(out))
        out[frame] = gamma(out[frame], max(1e-3, 1.5 * rng.random()))
    if rng.random() < 0.25:
        out = blur(out, max(1e-3, 1.5 * rng.random()))
    if rng.random() < 0.4:
        out = out + blur(rng.normal(0, 1, out.shape), max(1e-3, 1.5 * rng.random()))
    for mode in ("zero", "add"):
        if rng.random() < 0.15:
            side = int(rng.integers(1, max(2, min(12, out.shape[1] - 1, out.shape[2] - 1))))
            y, x = (int(rng.integers(max(1, n - 1 - side))) for n in out.shape[1:])
            place = (slice(None), slice(y, y + side), slice(x, x + side))
            out[place] = 0 if mode == "zero" else out[place] + 1
    return out


def noise(windows: DataFrame, seed: int = 0) -> DataFrame:
    """Windows ``win_id, n, h, w, noisy, cube`` (values in row-major order) with the noisy ones augmented."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            cubes = []
            for r in rows:
                cube = np.array(r["cube"], float).reshape(r["n"], r["h"], r["w"])
                cubes.append(augment(cube, np.random.default_rng([seed, r["win_id"]])).ravel() if r["noisy"] else cube.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("win_id", "n", "h", "w", "noisy")), pa.array(cubes, pa.list_(pa.float64()))], names=["win_id", "n", "h", "w", "noisy", "cube"])

    return windows.select("win_id", "n", "h", "w", "noisy", "cube").mapInArrow(task, "win_id bigint, n int, h int, w int, noisy boolean, cube array<double>")


def transformed(cube: np.ndarray, noisy: bool, rng: np.random.Generator) -> np.ndarray:
    """A training window as an epoch sees it: turned over along rows, along columns, each by chance, then, if noisy, with the noise chain."""
    for axis in (1, 2):
        if rng.random() < FLIP:
            cube = np.flip(cube, axis)
    return augment(cube, rng) if noisy else cube.astype(float)


def train_transforms(windows: DataFrame, config: Config, seed: int = 0, epoch: int = 0, noise: bool = True, keys: tuple[str, ...] = ("movie_id", "rep", "seq", "cat")) -> DataFrame:
    """``windows`` of ``jobs.sample_windows`` as one epoch trains on them: flips for all of ``split`` train, noise for those marked ``noisy`` unless ``noise`` is off.

    Windows of the validation side stay as they are.  A window's chance comes
    from its ``keys``, the seed and the epoch, whatever the partitioning.
    """
    shape = config.window_shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            values = batch.column("cube").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), *shape)
            marks = zip(values, *(batch.column(c).to_pylist() for c in ("_train", "noisy", "_chance")), strict=True)
            cubes = [transformed(cube, bool(noisy) and noise, np.random.default_rng([seed, epoch, chance % (1 << 64)])).ravel() if train else cube.ravel() for cube, train, noisy, chance in marks]
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * math.prod(shape))
            done = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(cubes)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), done], names=[*others, "cube"])

    others = [c for c in windows.columns if c != "cube"]
    marked = windows.select(*others, "cube", F.coalesce(F.col("split") == "train", F.lit(False)).alias("_train"), F.xxhash64(*keys).alias("_chance"))
    return marked.mapInArrow(task, T.StructType([*(windows.schema[c] for c in others), T.StructField("cube", T.ArrayType(T.DoubleType()))]))
