"""Bounded k-means against comparing every vector with every centroid."""

import hashlib
import math
import random

import pytest

from cinevox.llm.centroids import cluster, largest

ROW = "vec_id bigint, embedding array<double>, cluster string, point int"


def lloyd(rows, k, rounds, dims, scale=64):
    """``id, cluster, distance`` of the kept rows, and the centroids."""
    whole = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(scale * x) < largest(dims) - 1 for x in v)
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if whole(v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [p for _, p in sorted(((name(i), p) for i, p in kept))[:k]]

    def assign():
        out = []
        for i, p in kept:
            out.append((i, p, *reversed(min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(centres)))))
        return out

    for _ in range(rounds if kept else 0):
        found = assign()
        for j in range(len(centres)):
            own = [p for _, p, c, _ in found if c == j]
            if own:
                centres[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return sorted(((i, c, d) for i, _, c, d in assign()), key=str) if kept else [], centres


def vectors(kind, dims):
    rng = random.Random(kind)
    groups = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    if kind == "ties":  # few different places, so many equal distances and empty clusters
        rows = [(i, [float(rng.randrange(2)) / 64 for _ in range(dims)]) for i in range(150)]
    elif kind == "large":
        rows = [(i, [x * 20_000 for x in rng.choice(groups)]) for i in range(150)]
    elif kind == "few":
        rows = [(i, [rng.random() for _ in range(dims)]) for i in range(5)]
    elif kind == "empty":
        rows = []
    else:
        rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(groups)]) for i in range(600)]
    bad = [[0.0] * (dims - 1), [0.0] * (dims + 1), [], None, [None] + [0.0] * (dims - 1), [math.nan] + [0.0] * (dims - 1), [math.inf] + [0.0] * (dims - 1), [1e300] * dims]
    return [*rows, *rows[:7], *[(900 + i, v) for i, v in enumerate(bad)], *([(None, rows[0][1]), (None, rows[1][1])] if rows else [])]


@pytest.mark.parametrize("kind, k, dims", [("groups", 16, 8), ("groups", 1, 3), ("ties", 16, 8), ("ties", 40, 8), ("large", 16, 8), ("few", 16, 8), ("few", 2, 3), ("empty", 16, 8)])
def test_equals_comparing_everything(spark, kind, k, dims):
    """Repeated rows, null ids, other lengths, null and non-finite components, clashing names."""
    rows = vectors(kind, dims)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], ROW).repartition(3)
    got = cluster(df, k=k, dims=dims)
    want, centres = lloyd(rows, k, 3, dims)
    assert sorted(((r["doc"]["vec_id"], r["cluster"], r["distance"]) for r in got.assigned.collect()), key=str) == want
    assert got.centroids == centres


def test_bounds_spare_comparisons(spark):
    rows = vectors("groups", 8)
    places = cluster(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], ROW), k=16, dims=8, rounds=6).places
    last = places[-1]
    assert last.get(0, 0) > 0.8 * sum(last.values()) and last.get(5, 0) == 0  # settled by bounds alone; none compared with all
