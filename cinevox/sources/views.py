"""The driver's tables seen as movies, points and labels, in Spark and as DuckDB SQL.

``VIEWS`` has the same relations as common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``movie_id, t, h, w, pixels``: a movie of 8 by 8 frames for each label of the embeddings."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    pixels = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 1000).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("movie_id"), rank.alias("t"), F.lit(8).alias("h"), F.lit(8).alias("w"), pixels.alias("pixels"))


def voxels(images: DataFrame) -> DataFrame:
    """``movie_id, t, y, x, v`` of frames."""
    each = images.select("movie_id", "t", "w", F.posexplode("pixels").alias("pos", "v"))
    return each.select("movie_id", "t", F.expr("pos div w").cast("int").alias("y"), (F.col("pos") % F.col("w")).alias("x"), "v")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``movie_id, t, h, w, pixels``: 16 by 16 frames of four 8 by 8 ones each; an incomplete last frame is left out."""
    small = frames(spark, sf_dir).select("movie_id", F.expr("t div 4").cast("int").alias("t"), (F.col("t") % 4).alias("q"), "pixels")
    four = small.groupBy("movie_id", "t").agg(F.array_sort(F.collect_list(F.struct("q", "pixels"))).alias("part")).where(F.size("part") == 4)
    rows = [F.slice(F.col("part")[y // 8 * 2 + side]["pixels"], y % 8 * 8 + 1, 8) for y in range(16) for side in (0, 1)]
    return four.select("movie_id", "t", F.lit(16).alias("h"), F.lit(16).alias("w"), F.concat(*rows).alias("pixels"))


def movies(images: DataFrame) -> DataFrame:
    """``movie_id, n_frames, h, w``."""
    return images.groupBy("movie_id").agg(F.count("*").cast("int").alias("n_frames"), F.first("h").alias("h"), F.first("w").alias("w"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``movie_id, roi_idx, t, y, x`` of the events, one movie for each type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("movie_id"), F.col("event_id").alias("roi_idx"),
        (F.expr("unix_timestamp(ts) div 86400") - 19723).cast("int").alias("t"), F.col("user_id").cast("int").alias("y"), (F.col("event_id") % 97).cast("int").alias("x"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, y, x, weight`` of the line items: month, supplier and part on a 64 by 64 grid."""
    ship = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select((F.year(ship) * 12 + F.month(ship)).alias("t"), (F.col("l_suppkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x"), F.col("l_quantity").alias("weight"))


VIEWS = {
    "voxels": """voxels AS (
  SELECT movie_id, CAST(t AS INT) AS t, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(floor((CAST(e AS DOUBLE) + 1) * 1000) AS INT) AS v
  FROM (SELECT label AS movie_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))""",
    "mosaic": """mosaic AS (
  SELECT movie_id, CAST(r // 4 AS INT) AS t, CAST((r % 4) // 2 * 8 + pos // 8 AS INT) AS y, CAST(r % 2 * 8 + pos % 8 AS INT) AS x, CAST(floor((CAST(e AS DOUBLE) + 1) * 1000) AS INT) AS v
  FROM (SELECT label AS movie_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n,
               unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
  WHERE r // 4 < n // 4)""",
    "points": """points AS (
  SELECT event_type AS movie_id, event_id AS roi_idx, CAST(floor(epoch(date_trunc('second', ts)) / 86400) - 19723 AS INT) AS t, CAST(user_id AS INT) AS y, CAST(event_id % 97 AS INT) AS x FROM events)""",
    "hits": """hits AS (
  SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS t, CAST(l_suppkey % 64 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x, l_quantity AS weight FROM lineitem)""",
}
