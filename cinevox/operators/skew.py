"""Joins that stay spread over the tasks when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = 1024
"""A key with more than this share of all rows is dealt out."""
LEAST, MOST = 256, 1 << 22
"""Rows of a key that are never dealt out, and that always are."""


def spread_join(rows: DataFrame, keyed: DataFrame, on: Sequence[str], count: str, by: Sequence[str]) -> DataFrame:
    """``rows`` joined with ``keyed``, a written table whose column ``count`` says how many of ``rows`` have a key.

    A key of many rows is cut into pieces by the hash of the columns ``by``, and its
    rows of ``keyed`` are repeated for each.  The names of such keys are broadcast:
    their counts add up to no more than all rows, so there are ``PIECES`` of them,
    or one for every ``MOST`` rows, at most.
    """
    on = list(on)
    total, most = keyed.agg(F.sum(count), F.max(count)).first()
    piece = max(LEAST, min(MOST, (total or 0) // PIECES))
    keep = [*rows.columns, *(c for c in keyed.columns if c not in rows.columns and c != count)]
    if (most or 0) <= piece:
        return rows.join(keyed, on).select(*keep)
    large = F.broadcast(keyed.where(F.col(count) > piece).select(*on, F.ceil(F.col(count) / piece).cast("int").alias("_pieces")))
    turn = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_pieces")), F.lit(0)).cast("int")
    dealt = rows.join(large, on, "left").withColumn("_turn", turn).drop("_pieces")
    repeated = keyed.join(large, on, "left").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(repeated, [*on, "_turn"]).select(*keep)
