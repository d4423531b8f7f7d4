"""Points and movies prepared for training: cleaning, rescaling, reversal, names, classes by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, roi_name

# Colours of the classes' outlines.
COLOURS = {1: "red", 2: "blue", 3: "green", 4: "yellow"}


def clean(points: DataFrame, movies: DataFrame) -> DataFrame:
    """Rounded half to even, kept inside the movie, without repeats; ``movie_id, t, y, x``."""
    inside = points.join(movies, "movie_id")
    place = lambda c, n: clip(F.bround(F.col(c)), 0, F.col(n) - 1).cast("int").alias(c)
    return inside.select("movie_id", place("t", "n_frames"), place("y", "h"), place("x", "w")).distinct()


def rescale_coordinate(c: Column, n_in: Column, n_out: Column) -> Column:
    """Corner to corner, rounded half to even; an axis of one place goes to 0."""
    scaled = F.bround(c * (n_out - 1) / F.when(n_in > 1, n_in - 1).otherwise(1))
    return F.when(n_in > 1, clip(scaled, F.lit(0), n_out - 1)).otherwise(0).cast("int")


def scale_factors(movies: DataFrame, cell_diameter: float, duration: float, tolerance: float = 0.3) -> DataFrame:
    """Adds ``ratio_xy, ratio_t``: model size over the movie's ``cell_diameter`` and ``extrusion_duration``, or 1 where they differ by no more than the tolerance times the model's."""
    ratio = lambda model, own: F.when(F.abs(F.lit(model) - F.col(own)) > model * tolerance, F.lit(model) / F.col(own)).otherwise(1.0)
    return movies.select("*", ratio(cell_diameter, "cell_diameter").alias("ratio_xy"), ratio(duration, "extrusion_duration").alias("ratio_t"))


def prepare(points: DataFrame, movies: DataFrame) -> DataFrame:
    """Points on the rescaled movie; ``movies`` has the sizes ``n_frames, h, w`` and ``new_frames, new_h, new_w``."""
    both = points.join(movies, "movie_id")
    axis = lambda c, a, b: rescale_coordinate(F.col(c), F.col(a), F.col(b)).alias(c)
    return both.select(*[c for c in points.columns if c not in ("t", "y", "x")], axis("t", "n_frames", "new_frames"), axis("y", "h", "new_h"), axis("x", "w", "new_w"))


def reverse(points: DataFrame, movies: DataFrame) -> DataFrame:
    """Points of the movie played backwards."""
    return points.join(movies.select("movie_id", "n_frames"), "movie_id").withColumn("t", (F.col("n_frames") - 1 - F.col("t")).cast("int")).drop("n_frames").select(*points.columns)


def reverse_frames(images: DataFrame) -> DataFrame:
    last = images.groupBy("movie_id").agg(F.max("t").alias("last"))
    return images.join(last, "movie_id").withColumn("t", (F.col("last") - F.col("t")).cast(images.schema["t"].dataType)).drop("last").select(*images.columns)


def remap(files: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Point files with their suffix replaced, and those whose suffix has no place in the reversed movie."""
    to = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    known = F.col("suffix").isin(list(mapping))
    return files.where(known).withColumn("suffix", F.element_at(to, F.col("suffix"))), files.where(~known | F.col("suffix").isNull())


def point_files(files: DataFrame, stem: Column) -> DataFrame:
    """Those named after the movie, backups left out, in order of name."""
    name = F.col("name")
    return files.where(name.startswith(F.concat(stem, F.lit("_"))) & name.endswith(".zip") & ~name.endswith(".bak.zip")).orderBy("name")


def named(points: DataFrame) -> DataFrame:
    """Adds ``name``, ``position`` (counted from 1) and ``colour`` by class."""
    colours = F.create_map(*[F.lit(v) for pair in COLOURS.items() for v in pair])
    return points.select("*", roi_name(F.col("t"), F.col("y"), F.col("x")).alias("name"), (F.col("t") + 1).alias("position"), F.coalesce(F.try_element_at(colours, F.col("cat").cast("int")), F.lit("white")).alias("colour"))


def frame_of(position: Column, z_position: Column, t_position: Column) -> Column:
    return F.greatest(position, z_position, t_position) - 1


def with_class(points: DataFrame, classes: DataFrame) -> DataFrame:
    """Points of known suffixes with their class number; ``classes`` (``cat, suffix``) has a row for each class."""
    return points.join(classes, "suffix")


def counts_by_file(points: DataFrame) -> DataFrame:
    """``movie_id, rois``: a map from file suffix to number of points."""
    by_file = points.groupBy("movie_id", "suffix").agg(F.count("*").alias("n"))
    return by_file.groupBy("movie_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "n")))).alias("rois"))


def resolve_diameter(movies: DataFrame, estimates: DataFrame) -> DataFrame:
    """The given ``cell_diameter`` or else the estimate, whether the trend is suspicious, and a status where there is neither."""
    both = movies.join(estimates.select("movie_id", "spacing", "trend", "status"), "movie_id", "left")
    automatic = F.col("cell_diameter").isNull()
    odd = automatic & ((F.col("trend") < 0.7) | (F.col("trend") > 1 / 0.7))
    return both.select("movie_id", F.coalesce("cell_diameter", "spacing").alias("cell_diameter"), F.coalesce(odd, F.lit(False)).alias("warn"), F.when(automatic, F.coalesce("status", F.lit("no estimate"))).otherwise("given").alias("status"))
