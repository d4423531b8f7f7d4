"""Exact quantiles of groups of any size, with bounded state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch
from .skew import spread_join

LIMIT = 1 << 16
"""Values that are sorted in one place at most."""
RANGES = 1024


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float], limit: int = LIMIT) -> DataFrame:
    """``keys`` and, for each name in ``at``, the quantile of the finite values at that share, between two values in proportion.

    Groups of up to ``limit`` values are sorted as they are.  In larger ones the
    values around a wanted rank are selected: they are counted by ``RANGES`` ranges
    between the least and the greatest one that may still be it, the range that
    holds the rank is kept with its own least and greatest value, and so on until
    one value or no more than ``limit`` are left.  Only counts are shuffled, but
    for the last few values.
    """
    keys = list(keys)
    scratch = Scratch(rows.sparkSession, "quantiles")
    v = F.col(value).cast("double")
    values = rows.select(*keys, v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    stats = scratch.save(values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "stats")
    direct = lambda some: some.groupBy(*keys).agg(*[F.percentile("v", F.lit(p)).alias(name) for name, p in at.items()])
    if (stats.agg(F.max("n")).first()[0] or 0) <= limit:
        return direct(values)
    large = stats.where(F.col("n") > limit)
    small = direct(values.join(large.select(*keys), keys, "left_anti"))

    ranks = F.array_distinct(F.array(*[end(F.lit(float(p)) * (F.col("n") - 1)).cast("bigint") for p in at.values() for end in (F.floor, F.ceil)]))
    state = large.select(*keys, "n", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"))
    state, turn, found = scratch.save(state, "state-0"), 0, None

    def met(open_: DataFrame, name: str) -> DataFrame:
        """Values between the bounds of each open rank of their group."""
        packed = scratch.save(open_.groupBy(*keys, "n").agg(F.collect_list(F.struct("rank", "lo", "hi", "below")).alias("open")), name)  # two ranks a quantile
        each = spread_join(values, packed, keys, "n", ["v"]).select(*keys, "v", F.inline("open"))
        return each.where(F.col("v").between(F.col("lo"), F.col("hi")))

    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > limit)
    while not (open_ := state.where(wide)).isEmpty():
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))
        halves = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # the width itself may be beyond all doubles
        place = F.when(F.col("hi") - F.col("lo") == float("inf"), F.least(F.floor(halves * RANGES), F.lit(RANGES - 1))).otherwise(place)
        counted = met(open_, f"open-{turn}").withColumn("range", place).groupBy(*keys, "rank", "below", "range").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        earlier = Window.partitionBy(*keys, "rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        first = F.col("below") + F.coalesce(F.sum("c").over(earlier), F.lit(0))
        chosen = counted.withColumn("first", first).where((F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("first") + F.col("c")))
        after = chosen.join(large.select(*keys, "n"), keys).select(*keys, "n", "rank", "lo", "hi", F.col("first").alias("below"), F.col("c").alias("inside"))
        done = state.where(~wide)
        turn += 1
        state = scratch.save(done.unionByName(after), f"state-{turn}")
    exact = state.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
    sorted_ = F.array_sort(F.collect_list("v"))
    rest = met(state.where("lo < hi"), "last").groupBy(*keys, "rank", "below").agg(sorted_.alias("own")).select(*keys, "rank", F.get("own", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
    found = exact.unionByName(rest).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")).join(large.select(*keys, "n"), keys)

    def between(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(place).cast("bigint"), F.ceil(place).cast("bigint")
        value = lambda rank: F.element_at("at", rank)
        return F.when(low == high, value(low)).otherwise((high - place) * value(low) + (place - low) * value(high))

    return small.unionByName(found.select(*keys, *[between(p).alias(name) for name, p in at.items()]))
