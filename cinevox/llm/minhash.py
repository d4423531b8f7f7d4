"""Near-duplicate groups by circulant MinHash, banding and exact verification.

Two permutations make all coordinates of a signature: the first scatters a
shingle over the circle of 32-bit integers, the second, shifted along the circle
by ``k``, gives coordinate ``k`` as its least value over the shingles.  Bands of
coordinates nominate pairs; a pair counts as a link only after its full shingle
sets have been compared.

Documents with the same set are one node.  In a bucket (documents that agree in
a band) every node is first compared with one leader only, the node with most
company, which joins most of a large group of copies in a number of comparisons
in proportion to its size.  What that leaves open is compared with a second
leader, the node with the fewest rare shingles.  What is left is compared with the nodes of its
buckets that are still in another component, so no link between different texts
is lost to the size of a bucket, but for pairs that counts rule out: two nodes
either share a rare shingle (these pairs are listed by shingle), or all they
share is among their other shingles, of which both must have enough.

With ``bands`` = 40 and ``rows`` = 4 a pair of similarity 0.8 escapes all bands
with a probability of 7e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .scratch import Scratch, in_arrow
from .skew import spread_join, without_common
from .textkit import Words, blocks, joined, mix, utf8, words

RARE = 16
"""A shingle of fewer nodes is rare."""

_U = np.uint64


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within rows, and each row's range of them."""
    value, at = found.ngrams(size)
    row = found.row()[at]
    short = np.flatnonzero((found.counts > 0) & (found.counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            more = found.counts[short] > i
            whole[more] = joined(whole[more], found.hash[found.first[short[more]] + i])
        value = np.append(value, mix(whole ^ _U(size)))
        row = np.append(row, short)
    by = np.lexsort((value, row))
    value, row = value[by], row[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(found.first)))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column("text"))
    for a, b in blocks(offsets):
        found = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        yield a, b, *_shingles(found, size)


def _sign(size: int, bands: int, rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.zeros(len(batch), np.int64)
            node = np.zeros((len(batch), 2), np.uint64)
            key = np.zeros((len(batch), bands), np.uint64)
            for a, b, value, first in _sets(batch, size):
                count[a:b] = np.diff(first)
                full = np.flatnonzero(count[a:b])
                if not len(full):
                    continue
                start = first[full]
                node[a + full, 0] = np.add.reduceat(mix(value), start)
                node[a + full, 1] = np.add.reduceat(mix(value ^ _U(0x5851F42D4C957F2D)), start)
                place = (value >> _U(32)).astype(np.uint32)
                for band in range(bands):
                    joint = np.full(len(full), band, np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        least = np.minimum.reduceat(_second(place + np.uint32(k)), start)
                        joint = mix(joint * _U(0xD1342543DE82EF95) + least)
                    key[a + full, band] = joint
            empty = count == 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64)), mask=pa.array(empty))
            names = pa.array([None if e else bytes(n) for e, n in zip(empty, node)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(count), names, lists], names=["id", "key", "n_shingles", "node", "bands"])

    return task


def _node_sets(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, value, first in _sets(batch, size):
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), lists], names=["node", "set"])

    return task


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """``id, key`` (the text's hash), ``n_shingles``, ``node`` (fingerprint of the set; null if empty), ``bands``."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return in_arrow(source, _sign(size, bands, rows), f"id {kind}, key bigint, n_shingles bigint, node binary, bands array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets have ``100 * common >= percent * union``; a node of many pairs has its set sent to several tasks."""
    both = pairs
    for side, column in (("a", "x"), ("b", "y")):
        degree = scratch.save(pairs.groupBy(side).agg(F.count("*").alias("c")), f"{name}-degree-{side}")
        both = spread_join(both, sets.select(F.col("node").alias(side), F.col("set").alias(column)), [side], "c", ["a", "b"], counts=degree)
    common = F.size(F.array_intersect("x", "y")).cast("bigint")
    union = F.size("x") + F.size("y") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 4
) -> DataFrame:
    """Groups of documents linked, directly or over others, by shingle sets of similarity ``percent`` / 100 or more.

    Words are runs of bytes outside ``0x20 0x09-0x0D``, A-Z lower-cased; a set
    holds the distinct runs of ``shingle`` words, or the whole sequence of fewer
    words.  Returns one row per input row: ``id``, ``key`` (the text's hash),
    ``n_shingles``, ``group`` (null without words), ``component_id`` (least id of
    the group) and ``kept`` (``id`` is ``component_id``).  A document without words or with a null text
    is linked with nothing and kept.  Null ids take part; a group's id is null
    only if it has no other, and then all its rows are kept.  Equal rows get
    equal results.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.save(signatures(docs, id_col, text_col, shingle, bands, rows), "signed")
    nodes = signed.where("node is not null").groupBy("node")
    nodes = scratch.save(nodes.agg(F.min("id").alias("id"), F.min(F.struct("id", "key")).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("c")), "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = scratch.save(banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    members = scratch.save(spread_join(banded, shared, ["band"], "c", ["node"], keep=["band", "node", "n", "c"]), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "at"), "node")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    texts = source.alias("t").join(wanted.alias("w"), F.col("t.id").eqNullSafe(F.col("w.at.id")) & (F.col("t.key") == F.col("w.at.key"))).select("node", "text")
    sets = scratch.save(in_arrow(texts, _node_sets(shingle), "node binary, set array<bigint>").dropDuplicates(["node"]), "sets")

    near = lambda n, m: (100 * F.least(n, m) >= percent * F.greatest(n, m))
    company = members.groupBy("node").agg(F.sum("c").alias("company"))
    leaders = scratch.save(members.join(company, "node").groupBy("band").agg(F.max(F.struct("company", "node", "n")).alias("leader")), "leaders")
    star = spread_join(members, leaders, ["band"], "c", ["node"], counts=shared).where((F.col("node") != F.col("leader.node")) & near(F.col("n"), F.col("leader.n")))
    tested = scratch.save(_pair("node", "leader", star.select("node", F.col("leader.node").alias("leader"))), "star")
    edges = scratch.save(_linked(tested, sets, percent, scratch, "star"), "edges")
    comps = connected_components(edges, scratch, "joined")

    now = members.where("c > 2").select("band", "node", "n").join(comps, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    now = scratch.save(_open(now, scratch, "open"), "open")
    if not now.isEmpty():
        each = scratch.save(now.groupBy("node").agg(F.first("n").alias("n"), F.first("component").alias("component")).join(sets, "node").select("node", "n", "component", F.explode("set").alias("shingle")), "each")
        tally = scratch.save(each.groupBy("shingle").agg(F.count("*").alias("c")), "tally")
        rare = scratch.save(without_common(each, tally, "shingle", "c", RARE), "rare")
        scratch.drop("each", "tally")
        sides = lambda rows, key, *names: (rows.select(key, *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")
        apart = (F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & near(F.col("a_n"), F.col("b_n"))

        left, right = sides(rare, "shingle", "node", "n", "component")
        by_rare = left.join(right, "shingle").where(apart).select("a_node", "b_node")
        wide = now.join(rare.groupBy("node").agg(F.count("*").alias("rare")), "node", "left").withColumn("wide", F.col("n") - F.coalesce("rare", F.lit(0))).where(100 * F.col("wide") >= percent * F.col("n"))
        # common / union >= p / 100 means common * (100 + p) >= p * (both sizes), and common is within both counts
        enough = (100 + percent) * F.least("a_wide", "b_wide") >= percent * (F.col("a_n") + F.col("b_n"))
        wide = scratch.save(_open(wide.drop("rare"), scratch, "wide"), "wide")
        best = F.max(F.struct((F.col("wide") / F.col("n")).alias("share"), *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "component", "wide"))))
        plainest = scratch.save(wide.groupBy("band").agg(best.alias("leader"), F.count("*").alias("c")).select("band", "leader.*", "c"), "plainest")
        star = spread_join(wide.select("band", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "component", "wide")]), plainest, ["band"], "c", ["a_node"])
        star = star.where((F.col("a_component") != F.col("b_component")) & near(F.col("a_n"), F.col("b_n")) & enough).select("a_node", "b_node")
        star = scratch.save(_pair("a_node", "b_node", star.union(by_rare)).join(tested, ["a", "b"], "left_anti"), "second-star")
        tested = tested.union(star)
        edges = scratch.save(edges.union(_linked(star, sets, percent, scratch, "second")), "more-edges")
        comps = connected_components(edges, scratch, "rejoined")
        wide = scratch.save(_open(wide.drop("component").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")), scratch, "rewide"), "rewide")
        wide = scratch.save(wide.join(wide.groupBy("node").agg(F.collect_list("band").alias("bands")), "node"), "pairable")
        left, right = sides(wide, "band", "node", "n", "component", "wide", "bands")
        once = F.array_min(F.array_intersect("a_bands", "b_bands")) == F.col("band")
        per_band = scratch.save(wide.groupBy("band").agg(F.count("*").alias("c")), "per-band")
        by_band = spread_join(left, right, ["band"], "c", ["a_node"], counts=per_band).where(apart & enough & once).select("a_node", "b_node")
        rest = scratch.save(_pair("a_node", "b_node", by_band).join(tested, ["a", "b"], "left_anti"), "rest")
        edges = scratch.save(edges.union(_linked(rest, sets, percent, scratch, "rest")), "all-edges")
        comps = connected_components(edges, scratch, "all")
        scratch.drop("rare", "wide", "plainest", "second-star", "more-edges", "rewide", "pairable", "per-band", "rest", "all-edges")

    scratch.drop("members", "shared", "sets", "leaders", "star", "edges", "open")
    groups = comps.join(nodes.select("node", "id"), "node")
    least = scratch.save(groups.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("c")), "components")
    named = spread_join(groups, least, ["component"], "c", ["node"], keep=["node", "component", "component_id"])
    labels = nodes.select("node", "id").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("group"), F.coalesce("component_id", "id").alias("component_id"))
    own = signed.select("id", "key", "n_shingles", "node")
    linked = spread_join(own.where("node is not null"), labels, ["node"], "c", ["id", "key"], keep=["id", "key", "n_shingles", "group", "component_id"], counts=nodes.select("node", "c"))
    empty = own.where("node is null").select("id", "key", "n_shingles", F.col("node").alias("group"), F.col("id").alias("component_id"))
    return linked.unionByName(empty).select("*", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows that have the least id of their group, one for each group, and all rows without words."""
    groups = near_duplicates(docs, id_col, text_col, **options)
    chosen = groups.where("kept and group is not null").groupBy("group").agg(F.min(F.struct("id", "key")).alias("at")).select("at.id", "at.key", F.lit(True).alias("single"))
    empty = groups.where("group is null").select("id", "key", F.lit(False).alias("single")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    stay = chosen.unionByName(empty)
    both = rows.alias("r").join(stay.alias("s"), F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.key") == F.col("s.key"))).select("doc", "r.id", "r.key", "single")
    turn = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0)))
    return both.where(~F.col("single")).select("doc.*").unionByName(both.where("single").withColumn("turn", turn).where("turn = 1").select("doc.*"))


def _pair(one: str, other: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _open(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows of buckets that span components."""
    buckets = rows.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("c"))
    mixed = scratch.save(buckets.where("c0 <> c1").select("band", "c"), f"{name}-buckets")
    return spread_join(rows, mixed, ["band"], "c", ["node"], keep=rows.columns)
