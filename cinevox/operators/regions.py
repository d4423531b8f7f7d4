"""From probability maps to events: thresholding, morphology, regions, centroids.

Maps are rows ``movie_id, cat, t, y, x, p8``.  Stencils along one axis are window
functions over rows of pixels.  Components are found in two steps: inside blocks
of voxels, then over the links between blocks, of which there are few.  The
watershed is put together from these: distances along lines, maxima as plateaus
of components, markers numbered over the movie; only the flood itself runs in a
task, one connected component of the mask at a time, as it never leaves one.
"""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.scratch import Scratch
from .components import connected_components

KEYS = ["movie_id", "cat"]
LEVEL = 125
BLOCK = {"t": 16, "y": 64, "x": 64}
"""Sizes of the blocks in which voxels are joined first."""
FACES = [(-1, 0, 0), (0, -1, 0), (0, 0, -1)]
AROUND = [s for s in product((-1, 0, 1), repeat=3) if s < (0, 0, 0)]
"""Steps to the neighbours that come before a voxel in raster order: 3 of 6, and 13 of 26."""


def threshold(maps: DataFrame, level: int = LEVEL, value: str = "p8") -> DataFrame:
    return maps.withColumn("b", (F.col(value) > level).cast("int"))


def along(axis: str, keys: list[str] = KEYS) -> "Window":
    return Window.partitionBy(*keys, *(a for a in ("t", "y", "x") if a != axis)).orderBy(axis)


def erode(maps: DataFrame, value: str = "b", keys: list[str] = KEYS) -> DataFrame:
    """Least of each pixel and those before it in its row and column, of a dense grid; the border repeats itself."""
    out = maps
    for axis in ("x", "y"):
        out = out.withColumn(value, F.least(value, F.coalesce(F.lag(value).over(along(axis, keys)), F.col(value))))
    return out


def dilate(maps: DataFrame, dt: int, dxy: int, value: str = "b", keys: list[str] = KEYS) -> DataFrame:
    """Largest value in a box of ``dt`` frames by ``dxy`` by ``dxy`` pixels of a dense grid; even sizes reach one further back."""
    out = maps
    for axis, size in (("t", dt), ("y", dxy), ("x", dxy)):
        out = out.withColumn(value, F.max(value).over(along(axis, keys).rowsBetween(-(size // 2), size - size // 2 - 1)))
    return out


def edt(mask: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Squared Euclidean distance ``d2`` of every set voxel of a dense grid to the nearest unset one of its movie; movies without one are left out.

    One pass an axis: the least of ``f(q) + (p - q)^2`` over a line of voxels, within
    the reach that the distance found so far leaves.  A group is one line, a row
    or column of a frame or one pixel through time, never a frame or movie.
    """
    out = mask.select(*keys, "t", "y", "x", F.when(F.col("b") == 0, 0).cast("bigint").alias("d2"))
    for axis in ("x", "y", "t"):
        others = [*keys, *(c for c in ("t", "y", "x") if c != axis)]
        lines = out.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct(axis, "d2"))).alias("line"))

        def nearest(p: Column, i: Column) -> Column:
            reach = F.coalesce(F.ceil(F.sqrt(p["d2"])), F.size("line")).cast("int")
            start = F.greatest(F.lit(1), i + 1 - reach)
            around = F.slice("line", start, i + 2 + reach - start)
            off = lambda q: (p[axis] - q[axis]).cast("bigint")  # noqa: B023, E731
            return F.struct(p[axis].alias(axis), F.array_min(F.transform(around, lambda q: q["d2"] + off(q) * off(q))).alias("d2"))

        out = lines.select(*others, F.inline(F.transform("line", nearest)))
    return out.where("d2 > 0").select(*keys, "t", "y", "x", "d2")


def strict_maxima(maps: DataFrame, value: str = "p8", keys: list[str] = KEYS) -> DataFrame:
    """Voxels above all their 26 neighbours that exist."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = maps.select(*keys, *[F.col(a) for a in ("t", "y", "x")], F.col(value).alias("other"))
    for axis in ("t", "y", "x"):
        around = around.withColumn(f"d{axis}", F.explode(near)).withColumn(axis, F.col(axis) + F.col(f"d{axis}"))
    rival = around.where("dt <> 0 or dy <> 0 or dx <> 0").groupBy(*keys, "t", "y", "x").agg(F.max("other").alias("rival"))
    return maps.join(rival, [*keys, "t", "y", "x"], "left").where(F.coalesce(F.col(value) > F.col("rival"), F.lit(True))).drop("rival")


def _roots(t: np.ndarray, y: np.ndarray, x: np.ndarray, steps: list[tuple[int, int, int]], value: np.ndarray | None) -> np.ndarray:
    """For each voxel of a block, the first one in raster order of those it is joined with; where there are values, equal ones are joined."""
    order = np.lexsort((x, y, t))
    place = [c[order] - c.min() for c in (t, y, x)]
    number = np.full([int(c.max()) + 3 for c in place], -1)
    number[tuple(c + 1 for c in place)] = np.arange(len(order))
    ends = []
    for step in steps:
        other = number[tuple(c + 1 + s for c, s in zip(place, step, strict=True))]
        here = np.flatnonzero(other >= 0)
        if value is not None:
            here = here[value[order][here] == value[order][other[here]]]
        ends.append((here, other[here]))
    a, b = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
    root = np.arange(len(order))
    while not np.array_equal(root[a], root[b]):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
    out = np.empty(len(order), np.int64)
    out[order] = order[root]
    return out


def _in_block(table: pa.Table, columns: list[str], steps: list[tuple[int, int, int]], value: str | None, halo: bool) -> pa.Table:
    """The block's own voxels with the place ``rt, ry, rx`` of the one that stands for them and, with a halo, whether a neighbour is ``higher``."""
    t, y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("t", "y", "x"))
    own, higher = np.arange(len(t)), None
    if halo:
        every = table.column(value).to_numpy().astype(float)
        low = [int(c.min()) for c in (t, y, x)]
        cube = np.full([int(c.max()) - m + 3 for c, m in zip((t, y, x), low, strict=True)], -np.inf)
        place = tuple(c - m + 1 for c, m in zip((t, y, x), low, strict=True))
        cube[place] = every
        above = np.zeros(len(t), bool)
        for step in product((-1, 0, 1), repeat=3):
            above |= cube[tuple(c + s for c, s in zip(place, step, strict=True))] > every
        own = np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False))
        higher = above[own]
    if not len(own):
        own = np.zeros(0, np.int64)
    mine = table.take(pa.array(own))
    root = _roots(t[own], y[own], x[own], steps, mine.column(value).to_numpy() if value else None) if len(own) else own
    out = mine.select(columns)
    for name, c in (("rt", t), ("ry", y), ("rx", x)):
        out = out.append_column(name, pa.array(c[own][root].astype(np.int32)))
    return out.append_column("higher", pa.array(higher)) if halo else out


def _joined(rows: DataFrame, keys: list[str], steps: list[tuple[int, int, int]], value: str | None = None, halo: bool = False) -> tuple[DataFrame, DataFrame, Scratch]:
    """Rows with the places of their local roots, and those of local roots by component: ``*keys, rt, ry, rx, root`` (a struct ``t, y, x``)."""
    scratch = Scratch(rows.sparkSession, "label")
    block = {c: F.floor(F.col(c) / size).cast("int") for c, size in BLOCK.items()}
    kind = T.StructType([*rows.schema.fields, *T._parse_datatype_string("rt int, ry int, rx int" + (", higher boolean" if halo else "")).fields])
    dealt = rows.withColumns({f"_b{c}": b for c, b in block.items()})
    if halo:  # a voxel also goes to the blocks that it touches
        for c, size in BLOCK.items():
            near = F.filter(F.array(F.col(f"_b{c}"), F.floor((F.col(c) - 1) / size).cast("int"), F.floor((F.col(c) + 1) / size).cast("int")), lambda b: b.isNotNull())
            dealt = dealt.withColumn(f"_n{c}", F.explode(F.array_distinct(near)))
        dealt = dealt.withColumn("_own", F.expr(" and ".join(f"_b{c} = _n{c}" for c in BLOCK))).drop(*(f"_b{c}" for c in BLOCK)).withColumnsRenamed({f"_n{c}": f"_b{c}" for c in BLOCK})
    columns = rows.columns
    rooted = scratch.save(dealt.groupBy(*keys, *(f"_b{c}" for c in BLOCK)).applyInArrow(lambda table: _in_block(table, columns, steps, value, halo), kind), "rooted")

    edge = F.lit(False)
    for c, size in BLOCK.items():
        edge = edge | F.pmod(F.col(c), F.lit(size)).isin(0, size - 1)
    root = F.struct(*keys, *(F.col(f"r{c}").alias(c) for c in BLOCK))
    border = rooted.where(edge).select(*keys, "t", "y", "x", root.alias("root"), *([F.col(value).alias("value")] if value else []))
    moves = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"d{c}") for c, s in zip(BLOCK, step, strict=True)]) for step in steps])).alias("move")
    other = {c: F.col(c) + F.col(f"move.d{c}") for c in BLOCK}
    leaves = F.lit(False)
    for c, size in BLOCK.items():
        leaves = leaves | (F.floor(F.col(c) / size) != F.floor(other[c] / size))
    out = border.select("*", moves).where(leaves).select(*keys, *(other[c].alias(c) for c in BLOCK), F.col("root").alias("a"), *(["value"] if value else []))
    links = out.join(border.withColumnRenamed("root", "b"), [*keys, *BLOCK, *(["value"] if value else [])]).select("a", "b").distinct()
    found = connected_components(scratch.save(links, "links"), scratch)
    local = rooted.select(*keys, "rt", "ry", "rx").distinct().withColumn("node", root)
    named = local.join(found, "node", "left").select(*keys, "rt", "ry", "rx", F.coalesce("component", "node").alias("root"))
    return rooted, scratch.save(named.select(*keys, "rt", "ry", "rx", F.struct("root.t", "root.y", "root.x").alias("root")), "roots"), scratch


def label(mask: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Connected components (6 neighbours) of the rows of ``mask``, as ``label``: 1, 2, ... by first voxel in raster order.

    Voxels are joined inside blocks by numpy, and blocks by distributed star steps
    over the roots that touch across their faces, so a component may span any
    number of blocks and has one link for each pair of roots that touch.
    """
    rooted, roots, _ = _joined(mask, keys, FACES)
    ranks = roots.select(*keys, "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy("root")))
    named = roots.join(ranks, [*keys, "root"]).drop("root")
    return rooted.join(named, [*keys, "rt", "ry", "rx"]).select(*mask.columns, "label")


def maxima(maps: DataFrame, value: str = "p8", keys: list[str] = KEYS, flat: bool = False) -> DataFrame:
    """Rows of plateaus (equal values, 26 neighbours) with no higher neighbour; rows that do not exist are no neighbours.

    A map of one value only has none, unless ``flat``.  Plateaus are components
    that may span any number of blocks; whether one touches a higher voxel is an
    aggregate over its blocks.
    """
    rooted, roots, _ = _joined(maps, keys, AROUND, value, True)
    local = rooted.groupBy(*keys, "rt", "ry", "rx").agg(F.max("higher").alias("higher"), F.first(value).alias("level"))
    known = roots.join(local, [*keys, "rt", "ry", "rx"])
    tops = known.groupBy(*keys, "root").agg(F.max("higher").alias("higher")).where("not higher").select(*keys, "root")
    if not flat:
        uneven = known.groupBy(*keys).agg(F.min("level").alias("low"), F.max("level").alias("high")).where("low < high").select(*keys)
        tops = tops.join(uneven, keys, "left_semi")
    named = roots.join(tops, [*keys, "root"]).drop("root")
    return rooted.join(named, [*keys, "rt", "ry", "rx"], "left_semi").select(*maps.columns)


def region_stats(labelled: DataFrame, value: str = "p8", keys: list[str] = KEYS) -> DataFrame:
    """``volume`` (voxels), ``proba`` (mean value) and centroid ``t, y, x`` of every label."""
    return labelled.groupBy(*keys, "label").agg(F.count("*").cast("double").alias("volume"), F.avg(value).alias("proba"), *[F.avg(a).alias(a) for a in ("t", "y", "x")])


def scaled_position(init: Column, now: Column, c: Column) -> Column:
    return F.floor(c * (init / now)).cast("int")


def events(stats: DataFrame, movies: DataFrame | None = None, volume: float = 800, proba: float = 180) -> DataFrame:
    """Regions over both thresholds as events in the coordinates of the movie before rescaling.

    ``movies`` has ``movie_id, n_frames, h`` and the sizes ``map_frames, map_h`` of
    its maps; columns are scaled like rows.
    """
    passed = stats.where((F.col("volume") > volume) & (F.col("proba") > proba))
    if movies is None:
        return passed.select("movie_id", "cat", *[F.floor(a).cast("int").alias(a) for a in ("t", "y", "x")], "volume", "proba")
    both = passed.join(movies.select("movie_id", "n_frames", "h", "map_frames", "map_h"), "movie_id")
    return both.select(
        "movie_id", "cat", scaled_position(F.col("n_frames"), F.col("map_frames"), F.col("t")).alias("t"),
        scaled_position(F.col("h"), F.col("map_h"), F.col("y")).alias("y"), scaled_position(F.col("h"), F.col("map_h"), F.col("x")).alias("x"), "volume", "proba",
    )


def cleaned(labelled: DataFrame, grid: DataFrame, volume: float = 800, proba: float = 180, keys: list[str] = KEYS) -> DataFrame:
    """The grid with every voxel of a passing region at the region's mean, cut to a whole number, and 0 elsewhere."""
    passed = region_stats(labelled, keys=keys).where((F.col("volume") > volume) & (F.col("proba") > proba)).select(*keys, "label", F.floor("proba").cast("int").alias("mean"))
    shown = labelled.join(passed, [*keys, "label"]).select(*keys, "t", "y", "x", "mean")
    return grid.select(*keys, "t", "y", "x").join(shown, [*keys, "t", "y", "x"], "left").select(*keys, "t", "y", "x", F.coalesce("mean", F.lit(0)).alias("p8"))


def grow(rows: DataFrame, sizes: DataFrame, dt: int, dxy: int, keys: list[str] = KEYS) -> DataFrame:
    """Voxels ``*keys, t, y, x`` that a box of ``dt`` frames by ``dxy`` by ``dxy`` around one of ``rows`` reaches, inside the movie (``last, h, w`` by key).

    ``dilate`` of a grid of which only the set voxels are given.
    """
    out = rows.select(*keys, "t", "y", "x").join(sizes.select(*keys, F.col("last").alias("_t"), (F.col("h") - 1).alias("_y"), (F.col("w") - 1).alias("_x")), keys)
    for axis, size in (("t", dt), ("y", dxy), ("x", dxy)):
        span = F.sequence(F.greatest(F.lit(0), F.col(axis) - (size - size // 2 - 1)), F.least(F.col(f"_{axis}"), F.col(axis) + size // 2))
        out = out.withColumn(axis, F.explode(span)).distinct()
    return out.select(*keys, *[F.col(a).cast("int").alias(a) for a in ("t", "y", "x")])


def flood(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Priority flood from the markers inside the mask over 6 neighbours, lowest first, first come first among equals.

    All arrays have a border of one voxel outside the mask; what is returned has it too.
    """
    plane, row = height.shape[1] * height.shape[2], height.shape[2]
    level, inside, out = height.ravel().tolist(), mask.ravel().tolist(), np.where(mask, markers, 0).ravel().tolist()
    queue = [(level[p], i, p) for i, p in enumerate(np.flatnonzero(np.where(mask, markers, 0)).tolist())]
    heapq.heapify(queue)
    age = len(queue)
    while queue:
        _, _, p = heapq.heappop(queue)
        for q in (p - plane, p - row, p - 1, p + 1, p + row, p + plane):
            if inside[q] and not out[q]:
                out[q] = out[p]
                heapq.heappush(queue, (level[q], age, q))
                age += 1
    return np.array(out).reshape(height.shape)


def _flooded(table: pa.Table) -> pa.Table:
    """Labels of one component of the mask."""
    t, y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("t", "y", "x"))
    place = tuple(c - c.min() + 1 for c in (t, y, x))
    shape = [int(c.max()) + 2 for c in place]
    height, markers, mask = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
    height[place], markers[place], mask[place] = -table.column("d2").to_numpy(), table.column("marker").to_numpy(), True
    labels = flood(height, markers, mask)[place]
    return table.drop_columns(["d2", "marker"]).append_column("label", pa.array(labels)).filter(pa.array(labels > 0))


def watershed_regions(maps: DataFrame, dt: int = 4, dxy: int = 10, level: int = LEVEL) -> DataFrame:
    """``movie_id, cat, t, y, x, p8, island, label`` of the voxels in a region of a dense map.

    Threshold, erosion and distance; maxima of the distance, grown to boxes and
    numbered over the movie, are the markers from which the mask is flooded.
    ``island`` numbers the mask's components, ``label`` the markers; a marker that
    reaches into two islands labels voxels of both.  An island is flooded by one
    task: what that holds is a connected run of voxels over the level, not a movie.
    """
    scratch = Scratch(maps.sparkSession, "watershed")
    ints = [F.col(c).cast("int").alias(c) for c in ("cat", "t", "y", "x", "p8")]
    maps = maps.select("movie_id", *ints)
    sizes = scratch.save(maps.groupBy(*KEYS).agg(F.max("t").alias("last"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")), "sizes")
    mask = scratch.save(erode(threshold(maps, level)), "mask")
    far = edt(mask)
    lit = scratch.save(label(mask.where("b = 1").select(*KEYS, "t", "y", "x", "p8").join(far, [*KEYS, "t", "y", "x"])).withColumnRenamed("label", "island"), "lit")
    marked = label(grow(maxima(lit.select(*KEYS, "t", "y", "x", "d2"), "d2", flat=True), sizes, dt, dxy)).withColumnRenamed("label", "marker")
    both = lit.join(marked, [*KEYS, "t", "y", "x"], "left").withColumn("marker", F.coalesce("marker", F.lit(0)))
    kind = T.StructType([*both.drop("d2", "marker").schema.fields, T.StructField("label", T.LongType())])
    return both.groupBy(*KEYS, "island").applyInArrow(_flooded, kind).select(*KEYS, "t", "y", "x", "p8", "island", "label")


def watershed_events(maps: DataFrame, movies: DataFrame | None = None, volume: float = 800, proba: float = 180, dt: int = 4, dxy: int = 10) -> DataFrame:
    """Events of the watershed's regions."""
    return events(region_stats(watershed_regions(maps, dt, dxy)), movies, volume, proba)
