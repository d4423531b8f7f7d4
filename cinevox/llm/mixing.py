"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

A source's documents wait in a queue in hashed order, one round after another
while its target asks for more.  An entry's virtual finish time is the number of
words of its source up to and including it, divided by the source's target, so
all queues are served at the rates of their targets and run out at time 1.  The
mix is the entries in the order of virtual finish time, up to the total budget.

Running sums are taken in two steps, over the totals of ranges (of hashes within
a source, of finish times) and then inside each range, so no source and no order
is summed in one task however large it is.  Words are counted once: sizes and
hashes go to a table in the shared folder, which the later passes read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SLICES = 4096
"""Ranges of each source's hashed order, and of the finish times; hashes are 32 hex digits, ranges their first three."""


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """Each source's target, from ``source, source_size``.

    Sources by code point, null last, have the ``weights`` in turn and share
    ``percent`` / 100 of all sizes; none gets more than ``most`` times its size,
    and what exceeds that is shared by the others by weight.  The table has a
    row for each source; its order is the only thing here that is not split.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = (F.row_number().over(order) - 1) % len(weights)
    wide = sizes.select("source", F.col("source_size").cast("decimal(38,0)").alias("size"), F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("decimal(38,0)").alias("weight"))
    by_ratio = Window.orderBy((F.col("size") / F.col("weight").cast("double")).asc(), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    summed = wide.select("*", F.sum("size").over(everything).alias("total"), F.sum("weight").over(everything).alias("weights"), F.sum("size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)).alias("weights_before"))
    rest = percent * F.col("total") - 100 * most * F.coalesce("before", F.lit(0))
    full = 100 * most * F.col("size") * (F.col("weights") - F.coalesce("weights_before", F.lit(0))) < rest * F.col("weight")
    marked = summed.select("source", "size", "weight", "total", full.alias("full"))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    open_words = percent * F.col("total") - 100 * most * F.coalesce(F.sum(F.when(F.col("full"), F.col("size"))).over(everything), F.lit(0))
    share = (F.col("weight") * open_words).cast("double") / (100 * open_weight).cast("double")
    return marked.select("source", F.col("size").cast("bigint").alias("source_size"), F.when(F.col("full"), (most * F.col("size")).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2, columns: Sequence[str] | None = None) -> DataFrame:
    """Every document as an entry of the queue, once for each round, with the words the mix takes of it.

    Returns ``doc`` (a struct of ``columns``, by default all), ``entry`` (a struct
    that names the input row), ``size`` (words; a null text has none),
    ``source_size``, ``target``, ``round``, ``finish`` (virtual), ``position``
    (words of the mix before it) and ``taken``.  An entry that reaches its
    source's target, or the budget, is taken in part, from its first word on;
    those behind it, and documents without words, have 0 and stand at position 0,
    outside the order, dealt out by their hashes.  The order depends on
    ids and texts only, so reruns agree; equal rows are interchangeable.
    """
    columns = list(columns or docs.columns)
    text = F.col(text_col)
    rank = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(source_col).alias("source"), n_words(text).alias("size"), rank.alias("rank"))
    rows = Scratch(docs.sparkSession, "mix").save(rows.withColumn("slice", F.conv(F.substring("rank", 1, 3), 16, 10).cast("int")), "sizes")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))

    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    shares = targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), weights, percent, most)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("source", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    starts = starts.alias("p").join(shares.alias("s"), same("p", "s")).select("p.*", "source_size", "target")
    inside = Window.partitionBy("source", "slice").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        rows.alias("r").join(starts.alias("p"), same("r", "p") & (F.col("r.slice") == F.col("p.slice")))
        .select("doc", "r.source", "r.slice", "size", "rank", "source_size", "target", "before")
        .withColumn("end", F.col("before") + F.sum("size").over(inside))
        .withColumn("entry", F.struct("source", "slice", F.count(F.lit(1)).over(inside).alias("place")))
    )
    entries = queued.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("end", F.col("end") + F.col("round") * F.col("source_size"))
    whole = F.round("target").cast("bigint")
    wanted = F.greatest(F.lit(0), F.least("size", F.col("size") + whole - F.col("end"))).cast("bigint")
    last = F.when(wanted > 0, F.least(F.col("end"), whole)).otherwise(F.col("end"))
    finish = F.when(F.col("target") > 0, last / F.col("target")).otherwise(0.0)
    entries = entries.select("doc", "entry", "rank", "size", "source_size", "target", "round", finish.alias("finish"), wanted.alias("wanted"))

    ahead = F.when(F.col("finish") < 1, F.floor(F.col("finish") * SLICES)).otherwise(SLICES + F.least(F.lit(8 * SLICES - 1), F.floor(F.log2("finish") * SLICES / 4)))
    entries = entries.withColumn("slot", F.when(F.col("wanted") > 0, ahead).otherwise(-1 - F.col("entry.slice")).cast("int"))
    sums = entries.groupBy("slot").agg(F.sum("wanted").alias("n"))
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))  # 10 * SLICES rows at most
    budget = shares.agg(F.floor(F.coalesce(F.sum("source_size"), F.lit(0)) * percent / 100).alias("budget"))  # one row
    inside = Window.partitionBy("slot").orderBy("finish", "rank", "round").rowsBetween(Window.unboundedPreceding, 0)
    placed = entries.join(F.broadcast(starts), "slot").withColumn("position", F.col("start") + F.sum("wanted").over(inside) - F.col("wanted")).join(F.broadcast(budget))
    taken = F.greatest(F.lit(0), F.least("wanted", F.col("budget") - F.col("position")))
    return placed.select("doc", "entry", "rank", "size", "source_size", "target", "round", "finish", "position", taken.cast("bigint").alias("taken"))


def taken_by_document(entries: DataFrame) -> DataFrame:
    """One row per input row of ``mix``, with the words taken over all rounds."""
    return entries.groupBy("entry").agg(F.first("doc").alias("doc"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).drop("entry")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, range-sorted by virtual finish time: ``doc`` (a struct of the input row), ``size``, ``taken``, ``finish``.

    A row for every entry with words taken.  The queue works on ids and hashes;
    rows join their entries once, by id and the hash of all columns, and equal
    rows share their entries.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(*every).alias("key"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    used = mix(narrow, "id", "text", "source", columns=["id", "key"], **options).where("taken > 0")
    turns = used.groupBy(F.col("doc.id").alias("id"), F.col("doc.key").alias("key")).agg(F.collect_list(F.struct("finish", "rank", "round", "size", "taken")).alias("turns"))
    rows = docs.select(F.struct(*every).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(*every).alias("key"))
    both = rows.alias("r").join(turns.alias("t"), F.col("r.id").eqNullSafe(F.col("t.id")) & (F.col("r.key") == F.col("t.key"))).select("doc", "r.id", "r.key", "turns")
    one = both.withColumn("copy", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0)))).where("copy = 1")
    each = one.select("doc", F.explode("turns").alias("turn"))
    return each.orderBy("turn.finish", "turn.rank", "turn.round").select("doc", "turn.size", "turn.taken", "turn.finish")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")
