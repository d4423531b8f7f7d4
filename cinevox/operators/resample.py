"""Resizing of movies by separable resampling weights, corners aligned.

``weights`` makes a small table from output place to input places; an axis is
resized by joining pixels with it and adding up.  ``resize`` is the production
form: every frame is two small matrix products in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .skew import spread_join


def _spline(x: np.ndarray) -> np.ndarray:
    """The cubic B-spline."""
    x = np.abs(x)
    return np.where(x < 1, 2 / 3 - x**2 + x**3 / 2, np.where(x < 2, (2 - x) ** 3 / 6, 0.0))


def matrix(n_in: int, n_out: int, order: int = 1) -> np.ndarray:
    """Weights (output, input).  Order 0 takes the nearest place, 1 the two around, 3 a cubic spline through all places, mirrored at the ends."""
    at = np.arange(n_out) * ((n_in - 1) / (n_out - 1) if n_out > 1 else 0.0)
    if n_in == 1:
        return np.ones((n_out, 1))
    if order == 0:
        out = np.zeros((n_out, n_in))
        out[np.arange(n_out), np.floor(at + 0.5).astype(int)] = 1
        return out
    if order == 1:
        low = np.minimum(np.floor(at).astype(int), n_in - 2)
        out = np.zeros((n_out, n_in))
        out[np.arange(n_out), low] = 1 - (at - low)
        out[np.arange(n_out), low + 1] += at - low
        return out
    fold = lambda i: np.where(np.mod(i, 2 * n_in - 2) < n_in, np.mod(i, 2 * n_in - 2), 2 * n_in - 2 - np.mod(i, 2 * n_in - 2))

    def basis(places: np.ndarray) -> np.ndarray:
        out = np.zeros((len(places), n_in))
        for i in range(-2, n_in + 2):
            out[:, int(fold(np.array(i)))] += _spline(places - i)
        return out

    return basis(at) @ np.linalg.inv(basis(np.arange(n_in, dtype=float)))


POLE = 3**0.5 - 2
"""Of the recursive filter that turns values into coefficients of a cubic spline through them."""


def coefficients(values: np.ndarray) -> np.ndarray:
    """Spline coefficients along the first axis, mirrored at its ends: a running sum forward, one back."""
    n = len(values)
    if n == 1:
        return values.astype(float)
    out = 6 * values.astype(float)
    powers = POLE ** np.arange(2 * n - 2)
    start = np.tensordot(powers[:n], out, 1) + np.tensordot(powers[n:][::-1], out[1:-1], 1)  # the mirrored line is a ring of 2 n - 2
    out[0] = start / (1 - POLE ** (2 * n - 2))
    for k in range(1, n):
        out[k] += POLE * out[k - 1]
    out[-1] = POLE / (POLE**2 - 1) * (out[-1] + POLE * out[-2])
    for k in range(n - 2, -1, -1):
        out[k] = POLE * (out[k + 1] - out[k])
    return out


def taken(values: np.ndarray, at: np.ndarray, order: int = 1) -> np.ndarray:
    """Values at places between those along the first axis, by the rules of ``matrix``."""
    n = len(values)
    if order == 0:
        return values[np.floor(at + 0.5).astype(int)].astype(float)
    low = np.floor(at).astype(int)
    wide = lambda w: w.reshape(-1, *[1] * (values.ndim - 1))
    if order == 1 or n == 1:
        return wide(1 - (at - low)) * values[low] + wide(at - low) * values[np.minimum(low + 1, n - 1)]
    own, ring = coefficients(values), 2 * n - 2
    out = 0.0
    for step in (-1, 0, 1, 2):
        inner = np.mod(low + step, ring)
        out = out + wide(_spline(at - (low + step))) * own[np.where(inner < n, inner, ring - inner)]
    return out


def weights(spark: SparkSession, n_in: int, n_out: int, order: int = 1) -> DataFrame:
    """``o, i, w``: at most ``n_in * n_out`` rows."""
    m = matrix(n_in, n_out, order)
    rows = [(int(o), int(i), float(m[o, i])) for o, i in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "o int, i int, w double")


def resize_axis(voxels: DataFrame, axis: str, table: DataFrame) -> DataFrame:
    others = [c for c in ("movie_id", "t", "y", "x") if c != axis]
    return voxels.join(table, F.col(axis) == F.col("i")).groupBy(*others, F.col("o").alias(axis)).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def resize(images: DataFrame, h: int | Column, w: int | Column, order: int = 3) -> DataFrame:
    """Frames at another size, which may be columns; unchanged if they have it already."""
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    cache: dict[tuple[int, int], np.ndarray] = {}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            new = [batch.column(c).to_pylist() for c in ("new_h", "new_w")]
            for pixels, a, b, h, w in zip(batch.column("pixels"), batch.column("h").to_pylist(), batch.column("w").to_pylist(), *new, strict=True):
                image = pixels.values.to_numpy(zero_copy_only=False).astype(float).reshape(a, b)
                for n in ((a, h), (b, w)):
                    if n not in cache:
                        cache[n] = matrix(*n, order)
                out.append((image if (a, b) == (h, w) else cache[a, h] @ image @ cache[b, w].T).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("movie_id"), batch.column("t"), batch.column("new_h"), batch.column("new_w"), pa.array(out, pa.list_(pa.float64()))],
                names=["movie_id", "t", "h", "w", "pixels"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    sized = images.select("movie_id", "t", "h", "w", "pixels", column(h).cast("int").alias("new_h"), column(w).cast("int").alias("new_w"))
    return sized.mapInArrow(task, f"movie_id {kinds['movie_id']}, t {kinds['t']}, h int, w int, pixels array<double>")


REACH = 30
"""Frames on either side that a frame between them is made of; a cubic spline's weights are below 1e-15 beyond."""
FRAMES = 128
"""New frames that are made together."""
PIXELS = 1 << 16
"""Pixels of a frame that are resized together."""


def resize_time(images: DataFrame, sizes: DataFrame, order: int = 3) -> DataFrame:
    """Movies at another number of frames; ``sizes`` has ``movie_id, n_frames, new_frames``.

    New frames are made in runs of ``FRAMES``, from the frames between them and
    ``REACH`` more on either side, by strips of ``PIXELS`` pixels: a frame goes to a
    run and a half on average, and a task holds a strip of a run however long the
    movie is and however large its frames are.
    """
    spark = images.sparkSession
    scratch = Scratch(spark, "time")
    plan = sizes.where("new_frames > 0").select("movie_id", "n_frames", "new_frames", F.col("n_frames").cast("bigint").alias("frames"))
    near = spread_join(images.select("movie_id", "t", "h", "w", "pixels"), scratch.save(plan, "plan"), ["movie_id"], "frames", ["t"])
    step = (F.col("n_frames") - 1) / (F.col("new_frames") - 1)
    last = F.floor((F.col("new_frames") - 1) / FRAMES)
    run = lambda at: F.least(last, F.greatest(F.lit(0), F.floor(at / FRAMES)))
    runs = F.when((F.col("n_frames") == 1) | (F.col("new_frames") == 1), F.sequence(F.lit(0).cast("bigint"), last)).otherwise(F.sequence(run((F.col("t") - REACH - 1) / step - 1), run((F.col("t") + REACH + 1) / step + 1)))
    dealt = near.withColumn("run", F.explode(runs)).withColumn("strip", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") * F.col("w") - 1) / PIXELS).cast("int"))))
    dealt = dealt.withColumn("pixels", F.when(F.col("h") * F.col("w") <= PIXELS, F.col("pixels")).otherwise(F.slice("pixels", F.col("strip") * PIXELS + 1, F.lit(PIXELS))))

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        one = {c: table.column(c)[0].as_py() for c in ("n_frames", "new_frames", "run", "h", "w")}
        first = table.column("t")[0].as_py()
        values = table.column("pixels").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        new = np.arange(one["run"] * FRAMES, min(one["new_frames"], (one["run"] + 1) * FRAMES))
        at = new * ((one["n_frames"] - 1) / (one["new_frames"] - 1) if one["new_frames"] > 1 else 0.0)
        out = taken(values, at - first, order)
        n = len(new)
        same = lambda c: table.column(c).slice(0, 1).take(pa.array(np.zeros(n, np.int64)))
        pixels = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
        return pa.table({"movie_id": same("movie_id"), "t": pa.array(new.astype(np.int32)), "h": same("h"), "w": same("w"), "strip": same("strip"), "pixels": pixels})

    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    parts = dealt.groupBy("movie_id", "run", "strip").applyInArrow(combine, f"movie_id {kinds['movie_id']}, t int, h {kinds['h']}, w {kinds['w']}, strip int, pixels array<double>")
    parts = scratch.save(parts, "parts")
    whole = parts.where(F.col("h") * F.col("w") <= PIXELS).drop("strip")
    cut = parts.where(F.col("h") * F.col("w") > PIXELS).groupBy("movie_id", "t", "h", "w").agg(F.array_sort(F.collect_list(F.struct("strip", "pixels"))).alias("strips"))
    return whole.unionByName(cut.select("movie_id", "t", "h", "w", F.flatten(F.transform("strips", lambda s: s["pixels"])).alias("pixels")))
