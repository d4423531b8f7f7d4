"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) that depends on the parts only: the first 32 bits of the MD5 of the parts joined by ``-``."""
    text = F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def clip(x: Column, low: Column | int, high: Column | int) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_column(low), F.least(x, as_column(high)))


def distance(dy: Column, dx: Column) -> Column:
    return F.sqrt(dy * dy + dx * dx)


def softmax(logits: Column) -> Column:
    odds = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    total = F.aggregate(odds, F.lit(0.0), lambda s, v: s + v)
    return F.transform(odds, lambda v: v / total)


def argmax(values: Column) -> Column:
    """Index of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def roi_name(t: Column, y: Column, x: Column) -> Column:
    """``TTTT-YYYY-XXXX`` with frames counted from 1."""
    return F.format_string("%04d-%04d-%04d", t + 1, y, x)
