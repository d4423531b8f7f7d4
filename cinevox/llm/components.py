"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import spread_join


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; the component is its least node.

    Large-star and small-star steps: each node links its larger neighbours to its
    least one, then its smaller ones, until nothing changes.  Every step is a
    shuffle of the remaining edges and is written to the shared folder, which
    bounds the lineage.  A node's least neighbour is found by partial sums, and
    the edges of a hub meet it in a join that deals them out
    (``skew.spread_join``), so no neighbourhood is gathered in one place.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, step = scratch.save(both, f"{name}-0"), 0
    sums = _state(now)
    while True:
        around = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).select("a", F.least("a", "m").alias("m"), "c")
        least = scratch.save(least, f"{name}-{step}-least")
        larger = spread_join(around, least, ["a"], "c", ["b"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = scratch.save(larger.where("a <> b").distinct(), f"{name}-{step}-star")
        lesser = scratch.save(star.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), f"{name}-{step}-lesser")
        small = spread_join(star, lesser, ["a"], "c", ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(lesser.select("a", F.col("m").alias("b")))
        step += 1
        after = scratch.save(small.where("a <> b").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", *(f"{name}-{step - 1}-{part}" for part in ("least", "star", "lesser")))
        last, sums, now = sums, _state(after), after
        if sums == last:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
