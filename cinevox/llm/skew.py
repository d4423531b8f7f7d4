"""Joins that stay spread over the tasks when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = 1024
"""A key with more than this share of all rows is dealt out; there are no more such keys than this."""
LEAST = 256
"""Rows of a key that are never dealt out."""
MOST = 1 << 22
"""Rows of a key that always are."""


def spread_join(
    rows: DataFrame, keyed: DataFrame, on: Sequence[str], count: str, by: Sequence[str], how: str = "inner", keep: Sequence[str] | None = None, counts: DataFrame | None = None, hint: str | None = None
) -> DataFrame:
    """``rows`` joined with ``keyed``, whose column ``count``, or that of the table ``counts``, says how many of ``rows`` have a key.

    A key of more than one ``PIECES``-th of all rows is cut into pieces by the
    hash of the columns ``by``, and its rows of ``keyed`` are repeated for each of
    them; so is one of more than ``MOST`` rows.  Only the names of these keys are
    broadcast: their counts add up to no more than all rows, so there are
    ``PIECES`` of them, or one for every ``MOST`` rows, at most.  The counts are
    read more than once and should be a written table.  Keys are not null.
    ``keep`` are the columns of the result, by default all but ``count``.  ``hint``
    names the join, for rows made by ``explode``, which Spark takes for as few as it read.
    """
    on = list(on)
    counts = keyed if counts is None else counts
    total, most = counts.agg(F.sum(count), F.max(count)).first()
    piece = max(LEAST, min(MOST, (total or 0) // PIECES))
    keep = list(keep or [*rows.columns, *(c for c in keyed.columns if c not in rows.columns and c != count)])
    if (most or 0) <= piece:
        return rows.join(keyed.hint(hint) if hint else keyed, on, how).select(*keep)
    large = F.broadcast(counts.where(F.col(count) > piece).select(*on, F.ceil(F.col(count) / piece).cast("int").alias("_pieces")))
    turn = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_pieces")), F.lit(0)).cast("int")
    dealt = rows.join(large, on, "left").withColumn("_turn", turn).drop("_pieces")
    repeated = keyed.join(large, on, "left").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(repeated.hint(hint) if hint else repeated, [*on, "_turn"], how).select(*keep)


def without_common(rows: DataFrame, keyed: DataFrame, key: str, count: str, below: int) -> DataFrame:
    """``rows`` whose key has a ``count`` under ``below`` in ``keyed``; rows of very common keys are dropped before they are sent anywhere."""
    total = keyed.agg(F.sum(count)).first()[0] or 0
    large = keyed.where(F.col(count) > max(LEAST, below, total // PIECES)).select(key)
    return rows.join(F.broadcast(large), key, "left_anti").join(keyed.where(F.col(count) < below).select(key), key)
