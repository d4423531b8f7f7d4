"""Exact k-means with Drake's adaptive bounds.

Every vector keeps an upper bound of the distance to its own centroid, a lower
bound for each of its ``b`` next centroids in order, and one lower bound for all
the rest.  When centroids move, the bounds follow the moves.  A vector is left
where it is while its upper bound lies below all others; else it is compared
with those listed centroids whose bounds reach it; only where the bound of the
rest reaches it too is it compared with all.  Comparisons are of squared
distances in integers, so equal distances go to the smaller number and the
result is that of comparing everything; bounds in floating point only decide
what need not be compared, with a margin for their rounding.

``b`` starts at a quarter of the centroids and shrinks, down to an eighth, to
what the round before made use of.  Vectors and bounds are written in the shared
folder after each round.  A round brings the driver the change of each
centroid's sum, one row for each centroid, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

_EXACT = 1 << 21
"""Sums of ``2 * dims`` products of integers up to this are exact in doubles for up to 1024 components."""
_STATE = "cluster int, was int, upper double, near array<int>, low array<double>, rest double, place int"


def largest(dims: int) -> int:
    """Components below this in size have squared distances below 2^62."""
    return math.isqrt((1 << 62) // max(dims, 1)) // 2


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every centroid."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT and points.shape[1] <= 1024:
        p, c = points.astype(float), centroids.astype(float)
        return ((p * p).sum(1)[:, None] + (c * c).sum(1) - 2 * p @ c.T).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def _pairwise(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((points - centroids) ** 2).sum(1)


@dataclass
class Bounds:
    """Of a batch of vectors; ``place`` is how far down its list a vector had to look, ``b + 1`` for all centroids."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray
    rest: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, centroids: np.ndarray, b: int) -> Bounds:
        """By comparing with all centroids."""
        found = squares(points, centroids)
        order = np.argsort(found, axis=1, kind="stable")[:, : b + 2]
        root = np.sqrt(np.take_along_axis(found, order, 1).astype(float))
        rest = root[:, b + 1] if order.shape[1] > b + 1 else np.full(len(points), np.inf)
        return cls(order[:, 0].copy(), root[:, 0].copy(), order[:, 1 : b + 1].copy(), root[:, 1 : b + 1].copy(), rest.copy(), np.full(len(points), b + 1))

    def follow(self, moves: np.ndarray, b: int) -> None:
        """Bounds after every centroid has moved so far, with lists cut to ``b``."""
        self.upper += moves[self.cluster]
        self.low -= moves[self.near]
        self.rest -= moves.max(initial=0)
        if self.near.shape[1] > b:
            self.rest = np.minimum(self.rest, self.low[:, b:].min(1))
            self.near, self.low = self.near[:, :b].copy(), self.low[:, :b].copy()
        self.place = np.zeros(len(self.upper), np.int64)

    def _sure(self) -> np.ndarray:
        return _below(self.upper, np.minimum(self.low.min(1, initial=np.inf), self.rest))

    def settle(self, points: np.ndarray, centroids: np.ndarray) -> None:
        """The nearest centroid of every vector, by as few comparisons as the bounds allow."""
        open_ = np.flatnonzero(~self._sure())
        own = np.zeros(len(points), np.int64)
        own[open_] = _pairwise(points[open_], centroids[self.cluster[open_]])
        self.upper[open_] = np.sqrt(own[open_].astype(float))
        open_ = open_[~self._sure()[open_]]
        listed = _below(self.upper[open_], self.rest[open_])
        self._from_list(open_[listed], points, centroids, own)
        every = open_[~listed]
        if len(every):
            new = Bounds.of(points[every], centroids, self.near.shape[1])
            for name in ("cluster", "upper", "near", "low", "rest", "place"):
                getattr(self, name)[every] = getattr(new, name)

    def _from_list(self, rows: np.ndarray, points: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> None:
        best, number, column = own[rows].copy(), self.cluster[rows].copy(), np.full(len(rows), -1)
        for z in range(self.near.shape[1]):
            reach = np.flatnonzero(~_below(self.upper[rows], self.low[rows, z]))
            at = rows[reach]
            other = self.near[at, z]
            found = _pairwise(points[at], centroids[other])
            self.low[at, z] = np.sqrt(found.astype(float))
            self.place[at] = z + 1
            closer = (found < best[reach]) | ((found == best[reach]) & (other < number[reach]))
            best[reach[closer]], number[reach[closer]], column[reach[closer]] = found[closer], other[closer], z
        moved = column >= 0
        at, z = rows[moved], column[moved]
        self.near[at, z], self.low[at, z] = self.cluster[at], self.upper[at]  # the old one takes the new one's place
        self.cluster[at], self.upper[at] = number[moved], np.sqrt(best[moved].astype(float))
        order = np.argsort(self.low[rows], axis=1, kind="stable")
        self.near[rows], self.low[rows] = np.take_along_axis(self.near[rows], order, 1), np.take_along_axis(self.low[rows], order, 1)


def _below(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Below by more than rounding can explain."""
    return one + 1e-9 * (1 + one) < other


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def _settled(batch: pa.RecordBatch, centroids: np.ndarray, moves: np.ndarray | None, b: int) -> tuple[np.ndarray, np.ndarray, Bounds]:
    """Points, former clusters (-1 at first) and bounds of a batch against centroids that have moved."""
    points = _matrix(batch.column("point"), centroids.shape[1], np.int64)
    if moves is None:
        return points, np.full(len(points), -1), Bounds.of(points, centroids, b)
    former = batch.column("cluster").to_numpy().astype(np.int64)
    width = len(batch.column("near").flatten()) // len(batch)
    lists = [_matrix(batch.column(name), width, kind) for name, kind in (("near", np.int64), ("low", float))]
    bounds = Bounds(former.copy(), batch.column("upper").to_numpy().copy(), *lists, batch.column("rest").to_numpy().copy(), former)
    bounds.follow(moves, b)
    bounds.settle(points, centroids)
    return points, former, bounds


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, moves: np.ndarray | None, b: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            _, former, now = _settled(batch, centroids, moves, b)
            state = {"cluster": now.cluster.astype(np.int32), "was": former.astype(np.int32), "upper": now.upper, "near": _lists(now.near, pa.int32()), "low": _lists(now.low, pa.float64()), "rest": now.rest, "place": now.place.astype(np.int32)}
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("point"), *map(pa.array, state.values())], names=["doc", "point", *state])


def _last(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, moves: np.ndarray | None, b: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            points, _, now = _settled(batch, centroids, moves, b)
            found = _pairwise(points, centroids[now.cluster])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(now.cluster.astype(np.int32)), pa.array(found)], names=["doc", "cluster", "distance"])


def _changes(batches: Iterator[pa.RecordBatch], k: int, dims: int) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors that changed their cluster: what it adds to each cluster's number and sum."""
    count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for batch in batches:
        points = _matrix(batch.column("point"), dims, np.int64)
        for name, sign in (("cluster", 1), ("was", -1)):
            cluster = batch.column(name).to_numpy()
            for c in np.unique(cluster[cluster >= 0]):
                own = cluster == c
                count[c] += sign * own.sum()
                total[c] += sign * points[own].sum(0)
        if np.abs(total).max(initial=0) > 1 << 61:
            yield _change_rows(count, total)
            count[:], total[:] = 0, 0
    yield _change_rows(count, total)


def _change_rows(count: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    own = np.flatnonzero((count != 0) | total.any(1))
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), _lists(total[own], pa.int64())], names=["cluster", "n", "sums"])


@dataclass
class Clustering:
    """``assigned`` has ``doc, cluster, distance``; ``places`` tells by round how many vectors looked how far down their lists."""

    assigned: DataFrame
    centroids: list[list[int]]
    places: list[dict[int, int]]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", columns: Sequence[str] | None = None) -> Clustering:
    """Clusters of the vectors of ``dims`` finite components, each component made the integer ``floor(scale * x)``.

    Vectors with another number of components, or with a null or non-finite one,
    are left out, as are those with an integer of ``largest(dims)`` (2^27 for 64)
    or more in size, whose squared distances need not fit a long.  The
    first centroids are the ``k`` vectors with the least SHA-256 of
    ``<seed>:<id>`` in hexadecimal (a null id counts as an empty text; of equal
    ids the lesser vector comes first), or all vectors if there are fewer.  A
    round assigns every vector to the nearest centroid, by squared distance and
    then by number, and moves every centroid that has vectors to the floor of
    their mean.  After the rounds the vectors are assigned once more.  Equal rows
    are assigned alike; an empty table has no centroids.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    columns = list(columns or vectors.columns)
    vector = F.col(f"`{vector_col}`")
    whole = lambda x: F.floor(scale * x.cast("double"))
    fits = lambda x: F.coalesce(~F.isnan(x) & (F.abs(scale * x.cast("double")) < largest(dims) - 1), F.lit(False))
    kept = vectors.where(vector.isNotNull() & (F.size(vector) == dims)).where(F.forall(vector, fits))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    points = kept.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.transform(vector, lambda x: whole(x).cast("int")).alias("point"), F.sha2(F.concat(F.lit(f"{seed}:"), name), 256).alias("hash"))
    centroids = np.array([r["point"] for r in points.orderBy("hash", "point").limit(k).select("hash", "point").collect()], np.int64).reshape(-1, dims)
    k = len(centroids)
    b = min(max(1, math.ceil(k / 4)), max(k - 1, 0))
    sums, counts, moves, places = [[0] * dims for _ in range(k)], [0] * k, None, []
    now = points.select("doc", "point")
    kind = T.StructType([*now.schema.fields, *T._parse_datatype_string(_STATE).fields])
    for turn in range(rounds if k else 0):
        now = scratch.save(now.mapInArrow(partial(_round, centroids=centroids, moves=moves, b=b), kind), f"round-{turn}")
        if turn:
            scratch.drop(f"round-{turn - 1}")
        changed = now.where("cluster <> was").select("cluster", "was", "point").mapInArrow(partial(_changes, k=k, dims=dims), "cluster int, n bigint, sums array<bigint>")
        total = changed.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)])
        for row in total.collect():
            c = row["cluster"]
            counts[c] += row["n"]
            sums[c] = [s + int(row[f"s{i}"]) for i, s in enumerate(sums[c])]
        places.append({r["place"]: r["n"] for r in now.groupBy("place").agg(F.count("*").alias("n")).collect()})
        new = np.array([[s // n for s in own] if n else list(map(int, old)) for own, n, old in zip(sums, counts, centroids, strict=True)], np.int64).reshape(-1, dims)
        moves = np.sqrt(_pairwise(new, centroids).astype(float)) * (1 + 1e-12)
        if turn:
            b = min(b, max(math.ceil(k / 8), 1, *[p for p in places[-1] if p <= b]))
        centroids = new
    done = now.mapInArrow(partial(_last, centroids=centroids, moves=moves, b=b), T.StructType([now.schema["doc"], *T._parse_datatype_string("cluster int, distance bigint").fields]))
    done = scratch.save(done, "assigned")
    scratch.drop(f"round-{rounds - 1}")
    return Clustering(done, centroids.tolist(), places)
