"""Detections against annotations.

Both are points ``movie_id, roi_idx, t, y, x``; ``roi_idx`` is the order in their
file, which matters: a detection takes the nearest annotation within both
tolerances that no earlier detection has taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalar import distance
from ..sources.scratch import Scratch

POINT = ("roi_idx", "t", "y", "x")
AXES = ("t", "y", "x")
PAIR = ["movie_id", "d", "g", "mix", *AXES]
SHARE = 1 << 17
"""Candidate pairs that one task settles at once."""


def near_pairs(detected: DataFrame, truth: DataFrame, dxy: float, dt: int) -> DataFrame:
    """Pairs within both tolerances as ``movie_id, d_*, g_*, mix``: an equi-join on cells of time and place with the tolerances behind it.

    Cells are a little wider than twice a tolerance, so what a detection reaches lies in two of them along an axis at most.
    """
    reach = {"t": max(0, int(dt)), "y": max(0, math.ceil(dxy)), "x": max(0, math.ceil(dxy))}
    cell = lambda c, shift=0: F.floor((F.col(c) + shift) / (2 * reach[c] + 1))
    cells = [f"cell_{c}" for c in reach]
    left, right = detected, truth.select("movie_id", *[F.col(c).alias(f"g_{c}") for c in POINT], *[cell(c).alias(f"cell_{c}") for c in reach])
    for c, r in reach.items():
        left = left.withColumn(f"cell_{c}", F.explode(F.sequence(cell(c, -r), cell(c, r))))
    left = left.select("movie_id", *[F.col(c).alias(f"d_{c}") for c in POINT], *cells)
    off = distance(F.col("d_y") - F.col("g_y"), F.col("d_x") - F.col("g_x"))
    late = F.abs(F.col("d_t") - F.col("g_t"))
    return left.join(right, ["movie_id", *cells]).where((late <= dt) & (off <= dxy)).drop(*cells).withColumn("mix", off + late)


def _fold(table: pa.Table) -> pa.Table:
    """Pairs of one share: those of settled detections that matched (``settled``), and those that stay open.

    Detections go in order.  One takes its nearest free annotation unless an
    earlier detection, open here or in another share (``other``), may still take
    it; then it stays open with all its free annotations, which later ones leave
    alone.
    """
    movie = table.column("movie_id").combine_chunks().dictionary_encode()
    movie = np.asarray(movie.indices)
    d, g, mix = (table.column(c).to_numpy() for c in ("d", "g", "mix"))
    other = table.column("other").fill_null(1 << 62).to_numpy()
    order = np.lexsort((g, mix, d, movie))
    _, annotation = np.unique(np.stack([movie, g]), axis=1, return_inverse=True)
    first = np.flatnonzero(np.append(True, (d[order][1:] != d[order][:-1]) | (movie[order][1:] != movie[order][:-1]))[: len(order)])
    taken, wanted, matched, left = set(), set(), [], []
    row, which = order.tolist(), annotation.ravel()[order].tolist()
    for start, end in zip(first.tolist(), [*first[1:].tolist(), len(row)], strict=True):
        free = [i for i in range(start, end) if which[i] not in taken]
        if not free:
            continue
        best = free[0]
        if which[best] in wanted or other[row[best]] < d[row[best]]:
            wanted.update(which[i] for i in free)
            left += [row[i] for i in free]
        else:
            taken.add(which[best])
            matched.append(row[best])
    out = table.select(PAIR).take(pa.array(matched + left, pa.int64()))
    return out.append_column("settled", pa.array([True] * len(matched) + [False] * len(left)))


def matches(detected: DataFrame, truth: DataFrame, dxy: float = 15, dt: int = 4, share: int = SHARE) -> DataFrame:
    """``detected`` with ``match``, the ``roi_idx`` of its annotation; null for a false positive.

    Greedy matching in rounds.  A round deals the open pairs into shares of about
    ``share`` by place, all pairs of a detection in one, and each share settles
    what no earlier detection of another share can change.  The earliest open
    detection always settles, so rounds end; shares are cut along another axis in
    each, so what a border held open lies inside a share in the next.  No movie
    and no connected group of points is gathered.
    """
    scratch = Scratch(detected.sparkSession, "matching")
    near = near_pairs(detected, truth, dxy, dt).where(F.col("mix") < dt + 1.1 * dxy)
    pairs = near.select("movie_id", F.col("d_roi_idx").cast("bigint").alias("d"), F.col("g_roi_idx").cast("bigint").alias("g"), "mix", *[F.col(f"d_{c}").alias(c) for c in AXES])
    pairs, settled, turn = scratch.save(pairs, "pairs-0"), None, 0
    while n := pairs.count():
        shares = -(-n // share)
        axes = AXES[turn % 3 :] + AXES[: turn % 3]
        if shares > 1:
            dealt = scratch.save(pairs.repartitionByRange(shares, "movie_id", *axes, "d").withColumn("share", F.spark_partition_id()), f"shares-{turn}")
            dealt = dealt.join(_elsewhere(dealt), ["movie_id", "g", "share"], "left")
        else:
            dealt = pairs.select("*", F.lit(0).alias("share"), F.lit(None).cast("bigint").alias("other"))
        kind = T.StructType([*pairs.select(*PAIR).schema.fields, T.StructField("settled", T.BooleanType())])
        folded = scratch.save(dealt.groupBy("share").applyInArrow(_fold, kind), f"folded-{turn}")
        done = folded.where("settled").select("movie_id", "d", "g")
        settled = done if settled is None else settled.union(done)
        if shares == 1:
            break
        turn += 1
        pairs = scratch.save(folded.where("not settled").drop("settled").join(done, ["movie_id", "g"], "left_anti").select(*PAIR), f"pairs-{turn}")
        scratch.drop(f"pairs-{turn - 1}", f"shares-{turn - 1}")
    if settled is None:
        return detected.withColumn("match", F.lit(None).cast("bigint"))
    return detected.join(settled.select("movie_id", F.col("d").alias("roi_idx"), F.col("g").alias("match")), ["movie_id", "roi_idx"], "left")


def _elsewhere(dealt: DataFrame) -> DataFrame:
    """``movie_id, g, share, other``: for annotations wanted in several shares, the earliest detection of another share that wants them."""
    own = dealt.groupBy("movie_id", "g", "share").agg(F.min("d").alias("d"))
    each = Window.partitionBy("movie_id", "g")
    least = own.withColumn("least", F.min(F.struct("d", "share")).over(each))
    second = least.withColumn("second", F.min(F.when(F.col("share") != F.col("least.share"), F.col("d"))).over(each)).where("second is not null")
    return second.select("movie_id", "g", "share", F.when(F.col("share") == F.col("least.share"), F.col("second")).otherwise(F.col("least.d")).alias("other"))


def false_positives(detected: DataFrame, truth: DataFrame, dxy: float = 15, dt: int = 4) -> DataFrame:
    return matches(detected, truth, dxy, dt).where("match is null").drop("match")


def false_negatives(detected: DataFrame, truth: DataFrame, dxy: float = 15, dt: int = 4) -> DataFrame:
    """Annotations without any detection within both tolerances; not one-to-one."""
    found = near_pairs(detected, truth, dxy, dt).select("movie_id", F.col("g_roi_idx").alias("roi_idx")).distinct()
    return truth.join(found, ["movie_id", "roi_idx"], "left_anti")


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column]:
    """Precision and recall; both 0 without detections."""
    none = tp + fp == 0
    ratio = lambda n: F.when(none | (n == 0), 0.0).otherwise(tp / F.when(n == 0, 1).otherwise(n))
    return ratio(tp + fp), ratio(tp + fn)


def compare(detected: DataFrame, truth: DataFrame, dxy: float = 15, dt: int = 4) -> DataFrame:
    """``movie_id, tp, fp, fn, precision, recall`` of every movie with points."""
    hit = matches(detected, truth, dxy, dt).groupBy("movie_id").agg(F.count("match").alias("tp"), F.count(F.when(F.col("match").isNull(), 1)).alias("fp"))
    missed = false_negatives(detected, truth, dxy, dt).groupBy("movie_id").agg(F.count("*").alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    every = truth.select("movie_id").union(detected.select("movie_id")).distinct().join(hit, "movie_id", "left").join(missed, "movie_id", "left").select("movie_id", zero("tp").alias("tp"), zero("fp").alias("fp"), zero("fn").alias("fn"))
    precision, recall = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return every.select("*", precision.alias("precision"), recall.alias("recall"))


def confusion(labelled: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """``y_true, y_pred, n`` for all pairs of classes that occur on either side."""
    classes = labelled.select(F.col(truth).alias("c")).union(labelled.select(guess)).distinct()
    grid = classes.select(F.col("c").alias("y_true"), F.lit(1).alias("k")).join(classes.select(F.col("c").alias("y_pred"), F.lit(1).alias("k")), "k").drop("k")
    counts = labelled.groupBy(F.col(truth).alias("y_true"), F.col(guess).alias("y_pred")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def window_scores(labelled: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """``n, accuracy, balanced_accuracy`` (mean recall of the true classes)."""
    right = (F.col(truth) == F.col(guess)).cast("double")
    by_class = labelled.groupBy(truth).agg(F.count("*").alias("k"), F.sum(right).alias("r"))
    return by_class.agg(F.sum("k").alias("n"), (F.sum("r") / F.sum("k")).alias("accuracy"), F.avg(F.col("r") / F.col("k")).alias("balanced_accuracy"))


def epoch_metrics(batches: DataFrame) -> DataFrame:
    """Loss and accuracy of ``epoch, size, loss, correct`` rows, batches weighted by size."""
    total = F.greatest(F.sum("size"), F.lit(1))
    return batches.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("size")) / total).alias("loss"), (F.sum("correct") / total).alias("accuracy"))
