"""Secrets in texts: certain ones by their form, weak ones only beside what completes them.

A credential has parts: an identifier of who asks, a secret, and an endpoint
where both are used.  Assignments to a secret's name, access identifiers and long
hexadecimal runs are certain enough by themselves (``BASE``).  User names,
passwords under short or vague names, and addresses are not (``WEAK``): of these,
a user or a key is reported only where a part of the other role stands in the
same scope (a paragraph: no blank line between) within ``REACH`` code points, and
an address only where both stand so.  Parts meet in an interval join: the bucket
of where one ends, and the next one, against the bucket of where another begins,
so a part meets no more others than begin within its reach, however many a
document has.

DataFrame functions only.  Places come from what a pattern matches and what it
leaves between: their lengths, summed up inside a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

REACH = 300
"""Code points between the parts of a credential at most."""


def _either(pattern: str) -> str:
    """The pattern with its ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


def _named(names: str, value: str) -> str:
    """A value assigned to one of the names; group 2 is the value."""
    return rf"""({_either(names)})["']?\x20*[:=]\x20*["']?({value})"""


@dataclass(frozen=True)
class Kind:
    """A pattern whose group has at least ``least`` characters; ``role`` is its part in a credential.

    What has no match of ``quick``, which a single character begins, has none of the pattern that counts.
    """

    name: str
    pattern: str
    group: int
    least: int
    role: str
    quick: str


def _assigned(name: str, names: str, value: str, least: int, role: str) -> Kind:
    return Kind(name, _named(names, value + "+"), 2, least, role, rf"""[:=]\x20*["']?{value}{{{least},}}""")


_ADDRESS = "[A-Za-z0-9._~:/?#@%&+=-]"
BASE = (
    _assigned("assign", "password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]", 12, "secret"),
    Kind("access", "AKIA[A-Z0-9]+", 0, 18, "identifier", "AKIA[A-Z0-9]{14,}"),
    Kind("hex", "[0-9a-f]{16,}", 0, 16, "secret", "[0-9a-f]{16,}"),  # whole runs, as [0-9a-f]+ gives those of 16 or more
)
WEAK = (
    _assigned("user", "user_?name|user|login|account|client_?id|app_?id|key_?id", "[A-Za-z0-9@._+-]", 3, "identifier"),
    _assigned("key", "pass_?phrase|pass|pwd|private_?key|access_?key|credential|auth", r"[A-Za-z0-9+/_.=!@#$%^&*-]", 6, "secret"),
    Kind(
        "host", rf"""((?:{_either("https?|ftp|ssh|sftp|postgres|postgresql|mysql|mongodb|redis|amqp|ldap")})://|(?:{_either("hostname|host|server|endpoint|url")})["']?\x20*[:=]\x20*["']?)({_ADDRESS}+)""",
        2, 4, "endpoint", rf"""[:=]\x20*["']?{_ADDRESS}{{4,}}""",
    ),
)
KINDS = (*BASE, *WEAK)
BLANK_LINES = r"\x0A[\x20\x09\x0D]*\x0A[\x20\x09\x0D\x0A]*"


def _running(steps: Column) -> Column:
    """Running sums of an array, in blocks of about the root of its length, so that the arrays that grow stay short."""
    grow = lambda values, first: F.aggregate(values, F.array(first), lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v)))
    zero = F.lit(0).cast("bigint")
    width = F.ceil(F.sqrt(F.size(steps))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / width).cast("int") - 1), lambda b: F.slice(steps, b * width + 1, width))
    starts = grow(F.transform(blocks, lambda block: F.aggregate(block, zero, lambda s, v: s + v)), zero)
    return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda block, start: F.slice(grow(block, start), F.lit(2), F.size(block))))


def places(text: Column, pattern: str) -> Column:
    """``start, end`` of every match, leftmost and without overlap, in code points, end exclusive."""
    lengths = lambda parts: F.transform(parts, lambda p: F.char_length(p).cast("bigint"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(lengths(F.split(text, pattern, -1)), F.concat(F.array(F.lit(0).cast("bigint")), lengths(found)), lambda gap, before: gap + before)
    return F.zip_with(F.slice(_running(steps), F.lit(1), F.size(found)), lengths(found), lambda start, n: F.struct(start.alias("start"), (start + n).alias("end")))


def _spans(kind: Kind, number: int) -> Column:
    """``start, kind, end, role`` of the kind's matches in ``text`` whose group is long enough; the text is cut up only if it has one."""
    text = F.col("text")
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    with_value = F.zip_with(places(text, kind.pattern), values, lambda p, v: F.struct(p["start"].alias("start"), F.lit(number).alias("kind"), p["end"].alias("end"), v.alias("value")))
    kept = F.filter(with_value, lambda s: F.char_length(s["value"]) >= kind.least)
    if kind.name == "hex":  # a number or a word is a base span but no part of a credential
        role = lambda s: F.when(s["value"].rlike("[0-9]") & s["value"].rlike("[a-f]"), F.lit(kind.role))
    else:
        role = lambda s: F.lit(kind.role)
    spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), role(s).alias("role")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,role:string>>")
    return F.when(text.rlike(kind.quick) & text.rlike(kind.pattern), spans).otherwise(none)


def _candidates(docs: DataFrame, text_col: str, columns: Sequence[str]) -> DataFrame:
    """``row, doc, base, weak, breaks`` of every input row, written once; ``row`` is a number given at that."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    for i, kind in enumerate(KINDS):
        rows = rows.withColumn(kind.name, _spans(kind, i))
    weak = F.concat(*[kind.name for kind in WEAK])
    breaks = F.when(F.size(weak) > 0, places(F.col("text"), BLANK_LINES)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc", F.concat(*[kind.name for kind in BASE]).alias("base"), weak.alias("weak"), breaks.alias("breaks"))
    return Scratch(docs.sparkSession, "secrets").save(rows, "candidates")


def _parts(found: DataFrame) -> DataFrame:
    """``row, scope, start, kind, end, role, weak`` of all parts of rows with a weak one; weak ones that overlap base ones are left out."""
    some = found.where(F.size("weak") > 0).withColumn("base", F.filter("base", lambda s: s["role"].isNotNull()))
    none = F.lit(None)
    at_break = F.transform("breaks", lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("kind"), b["end"].alias("end"), none.cast("string").alias("role")))
    each = some.select("row", F.inline(F.concat("base", "weak", at_break)))
    weak, base = F.col("kind") >= len(BASE), F.col("kind").between(0, len(BASE) - 1)
    onward = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select(
        "*", weak.alias("weak"), F.count(F.when(F.col("kind") < 0, 1)).over(onward).alias("scope"),
        F.max(F.when(base, F.col("end"))).over(onward).alias("reached"), F.min(F.when(base, F.col("start"))).over(backward).alias("next"),
    )
    covered = F.coalesce(F.col("reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return placed.where((F.col("kind") >= 0) & ~(F.col("weak") & covered)).drop("reached", "next")


def _links(parts: DataFrame, reach: int) -> DataFrame:
    """Pairs ``a, b`` of parts of different roles in one scope, ``b`` beginning within ``reach`` of the end of ``a``."""
    bucket = lambda c: F.floor(F.col(c) / (reach + 1))
    side = lambda name: F.struct("start", "kind", "end", "role", "weak").alias(name)
    ends = parts.select("row", "scope", side("a"), F.explode(F.array(bucket("end"), bucket("end") + 1)).alias("bucket"))
    begins = parts.select("row", "scope", side("b"), bucket("start").alias("bucket"))
    apart = F.col("b.start") - F.col("a.end")
    return ends.join(begins, ["row", "scope", "bucket"]).where(apart.between(0, reach) & (F.col("a.role") != F.col("b.role")))


def credentials(docs: DataFrame, text_col: str = "text", columns: Sequence[str] | None = None, reach: int = REACH) -> DataFrame:
    """One row for every linked pair: ``doc`` (a struct of ``columns``, by default all) and the parts ``first`` and ``second``, structs ``kind, role, start, end``."""
    found = _candidates(docs, text_col, list(columns or docs.columns))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    part = lambda c: F.struct(F.element_at(names, F.col(f"{c}.kind") + 1).alias("kind"), F.col(f"{c}.role").alias("role"), F.col(f"{c}.start").alias("start"), F.col(f"{c}.end").alias("end"))
    return _links(_parts(found), reach).select("row", part("a").alias("first"), part("b").alias("second")).join(found.select("row", "doc"), "row").select("doc", "first", "second")


def secrets(docs: DataFrame, text_col: str = "text", columns: Sequence[str] | None = None, reach: int = REACH) -> DataFrame:
    """Every input row with its secrets.

    Returns ``doc`` (a struct of ``columns``, by default all), ``base`` and
    ``spans``: arrays of ``kind, start, end`` in code points, end exclusive, by
    start, then kind in the order of ``KINDS``, then end.  ``spans`` holds the base
    spans and the weak ones that are linked.  A null or empty text has none;
    equal rows have equal spans, each row by itself.
    """
    found = _candidates(docs, text_col, list(columns or docs.columns))
    pairs = _links(_parts(found), reach)
    seen = lambda one, other: pairs.where(f"{one}.weak").select("row", f"{one}.start", f"{one}.kind", f"{one}.end", F.col(f"{one}.role").alias("own"), F.col(f"{other}.role").alias("role"))
    met = seen("a", "b").unionByName(seen("b", "a")).groupBy("row", "start", "kind", "end", "own").agg(*[F.max(F.col("role") == role).alias(role) for role in ("identifier", "secret")])
    complete = F.when(F.col("own") == "identifier", F.col("secret")).when(F.col("own") == "secret", F.col("identifier")).otherwise(F.col("identifier") & F.col("secret"))
    linked = met.where(complete).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    named = lambda spans: F.transform(F.array_sort(spans), lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    both = found.select("row", "doc", bare.alias("base")).join(linked, "row", "left")
    return both.select("doc", named(F.col("base")).alias("base"), named(F.concat("base", F.coalesce("linked", none))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
