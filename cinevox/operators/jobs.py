"""Whole operations on movies: preparing and reversing training copies, estimating the object size, sampling windows, writing detections.

Frames are ``movie_id, t, h, w, pixels``, points ``movie_id, file, roi_idx, t, y, x``
where ``file`` is the movie's name followed by a class suffix.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import detect, matching, points as point_ops, resample, sampling, spacing
from .config import Config

REVERSED = {"_cell_death.zip": "_cell_delamination.zip", "_nothing.zip": "_nothing.zip"}


def sizes(frames: DataFrame) -> DataFrame:
    """``movie_id, n_frames, h, w``."""
    return frames.groupBy("movie_id").agg(F.count("*").cast("int").alias("n_frames"), F.max("h").alias("h"), F.max("w").alias("w"))


def suffix_of(points: DataFrame) -> DataFrame:
    """Adds ``suffix``, the file's name behind the movie's; points of other movies' files are left out."""
    name = F.col("movie_id").cast("string")
    own = points.where(F.startswith(F.col("file"), F.concat(name, F.lit("_"))))
    return own.withColumn("suffix", F.expr("substring(file, length(cast(movie_id as string)) + 1)"))


def prepare(frames: DataFrame, points: DataFrame, scales: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames and points at the scale of ``config``, and a summary of each movie.

    ``scales`` has ``movie_id, cell_diameter, extrusion_duration``.  A movie keeps
    its size along an axis whose scale is within 30 % of the model's.  First space
    is resized, then time, both by cubic splines with corners aligned.  The summary
    has ``movie_id, ratio_xy, ratio_t, shape_in, shape_out, cell_diameter,
    extrusion_duration, target_diameter, target_duration, rois`` (points by file).
    """
    ratios = point_ops.scale_factors(scales.select("movie_id", "cell_diameter", "extrusion_duration"), config.cell_diameter, config.extrusion_duration)
    new = lambda c, ratio: F.bround(F.col(c) * F.col(ratio)).cast("int")
    plan = sizes(frames).join(ratios, "movie_id").select("*", new("n_frames", "ratio_t").alias("new_frames"), new("h", "ratio_xy").alias("new_h"), new("w", "ratio_xy").alias("new_w"))
    both = frames.select("movie_id", "t", "h", "w", "pixels").join(plan.select("movie_id", "new_h", "new_w", (F.col("ratio_t") != 1).alias("in_time")), "movie_id")
    kept = resample.resize(both.where(~F.col("in_time")), F.col("new_h"), F.col("new_w"))
    timed = resample.resize(both.where("in_time"), F.col("new_h"), F.col("new_w"))
    scaled = kept.unionByName(resample.resize_time(timed, plan.select("movie_id", "n_frames", "new_frames").where("n_frames <> new_frames")))
    scaled = scaled.unionByName(timed.join(plan.where("n_frames = new_frames").select("movie_id"), "movie_id", "left_semi"))
    moved = point_ops.prepare(points, plan)
    rois = counts_of(points)
    summary = plan.join(rois, "movie_id", "left").select(
        "movie_id", "ratio_xy", "ratio_t", F.array("n_frames", "h", "w").alias("shape_in"), F.array("new_frames", "new_h", "new_w").alias("shape_out"), "cell_diameter", "extrusion_duration",
        F.lit(float(config.cell_diameter)).alias("target_diameter"), F.lit(float(config.extrusion_duration)).alias("target_duration"), "rois",
    )
    return scaled, moved, summary


def counts_of(points: DataFrame) -> DataFrame:
    """``movie_id, rois``: the number of points by file, in order of name."""
    by_file = points.groupBy("movie_id", "file").agg(F.count("*").alias("n"))
    return by_file.groupBy("movie_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "n")))).alias("rois"))


def reverse(frames: DataFrame, points: DataFrame, mapping: Mapping[str, str] = REVERSED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Movies ``<movie_id>_rev`` played backwards with the points that have a place in them, and a summary.

    Points keep their meaning and move to the suffix ``mapping`` gives; files of
    other suffixes are dropped.  The summary has ``movie_id, movie, shape, rois, dropped``.
    """
    named = lambda c: F.concat(F.col(c).cast("string"), F.lit("_rev"))
    shape = sizes(frames)
    kept, dropped = point_ops.remap(suffix_of(points), dict(mapping))
    turned = point_ops.reverse(kept, shape).withColumn("movie_id", named("movie_id")).withColumn("file", F.concat("movie_id", "suffix"))
    gone = dropped.groupBy("movie_id").agg(F.array_sort(F.collect_set("file")).alias("dropped"))
    summary = shape.join(gone, "movie_id", "left").select(named("movie_id").alias("movie_id"), F.col("movie_id").cast("string").alias("movie"), F.array("n_frames", "h", "w").alias("shape"), F.coalesce("dropped", F.array().cast("array<string>")).alias("dropped"))
    summary = summary.join(counts_of(turned), "movie_id", "left").select("movie_id", "movie", "shape", "rois", "dropped")
    return point_ops.reverse_frames(frames).withColumn("movie_id", named("movie_id")), turned, summary


def summary_files(summary: DataFrame, suffix: str) -> DataFrame:
    """``file, text``: each movie's summary as JSON, in ``<movie_id><suffix>``, such as ``.prepare.json``."""
    return summary.select(F.concat(F.col("movie_id").cast("string"), F.lit(suffix)).alias("file"), F.to_json(F.struct(*summary.columns)).alias("text"))


def estimate_size(frames: DataFrame, given: DataFrame | None = None, n: int = 12, tile: int = 192, **options) -> DataFrame:
    """The typical object's size of each movie, from evenly spaced frames.

    Returns ``movie_id, cell_diameter, warn, status`` and the figures of
    ``spacing.spacing_summary``.  ``given`` (``movie_id, cell_diameter``, null for
    automatic) goes before the estimate; without it all are automatic.  Movies
    without a valid tile have the status ``no estimate``; sizes whose status is
    not ``ok`` or ``given`` are not to be used.
    """
    counted = sizes(frames)
    picked = spacing.frame_picks(counted.select("movie_id", "n_frames"), n)
    return _estimated(frames.join(picked, ["movie_id", "t"], "left_semi"), counted, picked, given, tile, **options)


def _estimated(some: DataFrame, counted: DataFrame, picked: DataFrame, given: DataFrame | None, tile: int = 192, **options) -> DataFrame:
    found = spacing.spacing_summary(spacing.tile_spacings(some, tile), picked, **options)
    asked = given if given is not None else counted.select("movie_id", F.lit(None).cast("double").alias("cell_diameter"))
    return point_ops.resolve_diameter(asked, found).join(found.drop("status"), "movie_id", "left")


def estimate_size_of_files(spark: SparkSession, path: str | list[str], given: DataFrame | None = None, n: int = 12, **options) -> DataFrame:
    """``estimate_size`` of TIFF files, of which directories and the ``n`` pages that are picked are read, and nothing else."""
    from ..sources import stacks

    index = stacks.page_index(spark, path)
    counted = sizes(index)
    picked = spacing.frame_picks(counted.select("movie_id", "n_frames"), n)
    some = stacks.read_pages(index.join(picked, ["movie_id", "t"], "left_semi"))
    return _estimated(some, counted, picked, given, **options)


def sample_all(points: DataFrame, negatives: DataFrame | None, movies: DataFrame, config: Config, add_nothing: int = 10, naug: int = 1, val_ratio: float = 0.2, seed: int = 0, factors: Mapping[str, int] | None = None) -> DataFrame:
    """Every training window of a set of movies: those of points, those with nothing and those of hand-picked ``negatives``.

    Movies named in ``factors`` are sampled that many times; only training windows
    are repeated.  ``movie_id, rep, seq, t, y, x, cat, noisy, split``.
    """
    turns = dict(factors or {})
    reps = sampling.repetitions(movies, turns)
    out = None
    for rep in range(max([1, *turns.values()])):
        own = movies.join(reps.where(F.col("rep") == rep).select("movie_id"), "movie_id", "left_semi")
        streams = [sampling.sample_points(points, own, config, naug, val_ratio, seed, rep), sampling.sample_nothing(points, own, config, naug, val_ratio, seed, rep)]
        if negatives is not None:
            picked = sampling.sample_negatives(negatives, own, config, add_nothing, naug, val_ratio, seed, rep)
            streams.append(picked.withColumn("seq", F.col("seq") + 4000000000))
        for stream in streams:
            out = stream if out is None else out.unionByName(stream)
    return sampling.oversampled(out)


def split_overlap(samples: DataFrame) -> DataFrame:
    """``movie_id, cat, t, y, x`` of windows that are on both sides of the split."""
    keys = ["movie_id", "cat", "t", "y", "x"]
    side = lambda name: samples.where(F.col("split") == name).select(*keys)
    return side("train").intersect(side("val"))


def sample_windows(samples: DataFrame, frames: DataFrame, config: Config, top: float = 1.0) -> DataFrame:
    """Adds ``cube`` to samples: the window's pixels by frame, row, column, cut to 0..255 and then scaled to 0..``top``.

    Each sample meets the frames of its window by movie and time, and takes its
    rows and columns of them, so a window is all that is gathered of a sample.
    Samples whose window leaves the movie are dropped.
    """
    (f0, f1), (hy, hx) = config.nframes, config.half_size
    keys = [c for c in samples.columns]
    need = samples.withColumn("_key", F.struct(*keys)).select("_key", "movie_id", "y", "x", F.explode(F.sequence(F.col("t") - f0, F.col("t") + f1 - 1)).alias("_at"))
    images = frames.select("movie_id", F.col("t").alias("_at"), "h", "w", "pixels")
    met = need.join(images, ["movie_id", "_at"]).where((F.col("y") - hy >= 0) & (F.col("y") + hy < F.col("h")) & (F.col("x") - hx >= 0) & (F.col("x") + hx < F.col("w")))
    row = lambda k: F.slice("pixels", ((F.col("y") + k) * F.col("w") + F.col("x") - hx + 1).cast("int"), 2 * hx + 1)
    part = met.select("_key", "_at", F.flatten(F.transform(F.sequence(F.lit(-hy), F.lit(hy)), row)).alias("part"))
    lists = part.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "part"))).alias("parts")).where(F.size("parts") == f0 + f1)
    cubes = lists.select("_key", F.flatten(F.transform("parts", lambda p: p["part"])).cast("array<double>").alias("v"))

    def scaled(values, largest: float, cut: bool):
        """The bounds are fields of a row of its own, or they would be sought anew for each value."""
        low, high = F.array_min(values), F.array_max(values)
        bounds = F.struct(values.alias("values"), low.alias("low"), F.when(high > low, high - low).otherwise(1.0).alias("spread"))

        def one(b):
            each = lambda v: (v - b["low"]) / b["spread"] * largest
            return F.transform(b["values"], (lambda v: F.floor(each(v)).cast("double")) if cut else each)

        return F.transform(F.array(bounds), one)[0]

    whole = cubes.withColumn("v", scaled(F.col("v"), 255.0, True))
    return whole.select("_key.*", scaled(F.col("v"), top, False).alias("cube"))


def evaluate_windows(samples: DataFrame, frames: DataFrame, config: Config, weights) -> tuple[DataFrame, DataFrame]:
    """Scores and confusion of a network on sampled windows, without augmentation."""
    from . import network

    numbered = sample_windows(samples, frames, config, 255.0).withColumn("win_id", F.xxhash64("movie_id", "rep", "seq", "cat"))
    guess = network.predict(numbered.select("win_id", "cube"), weights, config)
    best = F.expr("array_position(probabilities, array_max(probabilities)) - 1").cast("int")
    both = numbered.select("win_id", F.col("cat").cast("int").alias("y_true")).join(guess.select("win_id", best.alias("y_pred")), "win_id")
    return matching.window_scores(both), matching.confusion(both)


def map_frames(maps: DataFrame, value: str = "p8") -> DataFrame:
    """Voxels ``movie_id, cat, t, y, x, <value>`` of whole grids as frames ``movie_id, cat, t, h, w, pixels``."""
    by_frame = maps.groupBy("movie_id", "cat", "t").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v")))).alias("cells"))
    return by_frame.select("movie_id", "cat", "t", "h", "w", F.transform("cells", lambda c: c["v"]).alias("pixels"))


def write_detections(folder: str, config: Config, maps: DataFrame, events: DataFrame | None = None, cleaned: DataFrame | None = None) -> DataFrame:
    """Writes a movie's results by class: ``<movie><class>_rawproba.tif``, ``_cleaned_proba.tif`` and the events' archive ``<movie><class>.zip``.

    ``maps`` are blocks of ``detect_blocks`` or voxels of ``detect``, ``cleaned`` voxels of ``regions.cleaned``,
    ``events`` points with ``movie_id, cat, t, y, x``.  Classes without a name in
    ``config`` are left out.  Returns ``file, n`` of all files.
    """
    from ..sources import files

    names = maps.sparkSession.createDataFrame([(c, n) for c, n in enumerate(config.catnames) if c], "cat int, catname string")
    title = F.regexp_replace("catname", r"\.zip$", "")
    out = None
    for table, ending in ((maps, "_rawproba.tif"), (cleaned, "_cleaned_proba.tif")):
        if table is not None:
            images = (detect.block_frames(table) if "levels" in table.columns else map_frames(table)).withColumn("cat", F.col("cat").cast("int")).join(F.broadcast(names), "cat")
            done = files.write_movies(images, folder, F.concat(F.col("movie_id").cast("string"), title, F.lit(ending)), "u1")
            out = done if out is None else out.unionByName(done)
    if events is not None:
        found = events.withColumn("cat", F.col("cat").cast("int")).join(F.broadcast(names), "cat")
        done = files.write_points(found.select(F.concat(F.col("movie_id").cast("string"), "catname").alias("file"), "cat", *[F.round(c).cast("int").alias(c) for c in "tyx"]), folder)
        out = done if out is None else out.unionByName(done)
    return out
