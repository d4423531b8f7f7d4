"""Queries over the corpus tables, one for each operator, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, centroids, language_id, masked_lm, secrets
from .byte_bpe import encode_digests
from .licenses import scan
from .minhash import near_duplicates
from .mixing import WORD, mix, taken_by_document
from .phrases import collocations
from .quality import quality
from .scratch import Scratch
from .skew import spread_join
from .suffix_dedup import remove_repeats
from .token_rollup import TokenRollup, changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_documents(spark, sf_dir), depth=200, columns=["doc_id"])
    return cut.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(_documents(spark, sf_dir), shingle=4, percent=80)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(_documents(spark, sf_dir), columns=["doc_id"])
    return judged.select("doc.doc_id", *[c for c in judged.columns if c not in ("doc", "class_distance", "word_distance")], F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


@_query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_documents(spark, sf_dir), columns=["doc_id"]).select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    fold = language_id.fold(F.col("doc_id"))
    model = language_id.train(docs.where(fold != 1))
    found = language_id.predict(docs, model, columns=["doc_id"]).select("doc.doc_id", "lang_pred", "score", "ambiguous")
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_by_document(mix(_documents(spark, sf_dir), columns=["doc_id"])).select("doc.doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS rank
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS n,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS HUGEINT) AS w
  FROM docs GROUP BY source),
ratios AS (
  SELECT *, sum(n) OVER () AS total, sum(w) OVER () AS ws,
         coalesce(sum(n) OVER o, 0) AS before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM sources
  WINDOW o AS (ORDER BY n / CAST(w AS DOUBLE), source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 200 * n * (ws - w_before) < (150 * total - 200 * before) * w AS is_full FROM ratios),
shares AS (
  SELECT source, CAST(n AS BIGINT) AS source_size,
         CASE WHEN is_full THEN CAST(2 * n AS DOUBLE)
              ELSE CAST(w * (150 * total - 200 * coalesce(sum(n) FILTER (is_full) OVER (), 0)) AS DOUBLE)
                   / CAST(100 * sum(w) FILTER (NOT is_full) OVER () AS DOUBLE) END AS target
  FROM marked),
queued AS (
  SELECT d.doc_id, d.rank, d.size, s.source_size, s.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank, d.size ROWS UNBOUNDED PRECEDING) AS ends
  FROM docs d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
entries AS (
  SELECT doc_id, rank, size, source_size, target, round, ends + round * source_size AS ends,
         greatest(0, least(size, size + CAST(round(target) AS BIGINT) - ends - round * source_size)) AS wanted
  FROM queued, (VALUES (0), (1)) r(round)),
placed AS (
  SELECT *, sum(wanted) OVER (ORDER BY CASE WHEN wanted > 0 THEN least(ends, CAST(round(target) AS BIGINT)) / target END, rank, round
                              ROWS UNBOUNDED PRECEDING) - wanted AS position
  FROM entries)
SELECT doc_id, size, source_size, target,
       CAST(sum(greatest(0, least(wanted, (SELECT CAST(floor(sum(source_size) * 150 / 100) AS BIGINT) FROM shares) - position))) AS BIGINT) AS taken
FROM placed GROUP BY doc_id, rank, size, source_size, target
"""


@_query
def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted under two tokenizers, exact copies deleted, one count revised, then compacted, one batch sent twice."""
    scratch = Scratch(spark, "rollup")
    docs = _documents(spark, sf_dir)
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = scratch.save(
        docs.select(
            "doc_id", "source", "lang", F.md5("text").alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*[0-9A-Za-z][^\x20\x09-\x0D]*")).cast("bigint").alias("plain"), F.octet_length(text).cast("bigint").alias("bytes"),
        ),
        "counted",
    )
    first = scratch.save(counted.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "first")
    paired = spread_join(counted, first, ["digest"], "n", ["doc_id"], "left")
    marked = scratch.save(paired.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))), "marked")
    each = lambda rows, name, n, **more: rows.select("source", "lang", F.lit(name).alias("tokenizer"), F.col(n).alias("n_tokens"), *[F.col(v).alias(k) for k, v in more.items()])

    rollup = TokenRollup(spark, scratch.path("store"))
    rollup.commit(1, changes(each(marked, "words-1", "words").union(each(marked, "bytes-1", "bytes")), "insert"))
    copies = marked.where("copy")
    gone = changes(each(copies, "words-1", "words").union(each(copies, "bytes-1", "bytes")), "delete")
    rollup.commit(2, gone)
    rollup.commit(3, changes(each(marked.where("not copy"), "words-1", "plain", was="words"), "revise"))
    rollup.compact()
    rollup.commit(2, gone)
    return rollup.totals()


ORACLES["op2_token_rollup"] = r"""
WITH docs AS (
  SELECT source, lang, text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text) AS copy,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*[0-9A-Za-z][^\x20\x09-\x0D]*')) AS BIGINT) AS plain,
         CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes
  FROM documents)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM (SELECT source, lang, 'words-1' AS tokenizer, plain AS n FROM docs WHERE NOT copy
      UNION ALL SELECT source, lang, 'bytes-1', bytes FROM docs WHERE NOT copy)
GROUP BY source, lang, tokenizer
"""


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_documents(spark, sf_dir), columns=["doc_id"])
    return found.select("doc.doc_id", "n_paragraphs", "n_licensed", "families", F.round("score", 6).alias("score"))


@_query
def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = masked_lm.score(docs, masked_lm.train(docs), columns=["doc_id"])
    return scored.select("doc.doc_id", "n_tokens", F.round("log_prob", 3).alias("log_prob"), F.round("mean_log_prob", 5).alias("mean_log_prob"))


@_query
def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector played as a melody, with the number of its links to queries, the recordings whose id is divisible by 20; ``audio.align`` lists them."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prints = Scratch(spark, "audio").save(audio.fingerprints(vectors, "vec_id", "embedding", audio.melody), "prints")
    each = audio.linked(prints, F.col("id") % 20 == 0)
    return each.select(F.col("id").alias("vec_id"), "class_id", "n_members", "n_links", F.col("match").alias("match_id"), "shift", F.round("bit_errors", 6).alias("bit_errors"), "links_crc")


@_query
def op13_drake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 finite components in one of 16 clusters after three rounds."""
    found = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), columns=["vec_id"])
    names = [(i, ",".join(map(str, c))) for i, c in enumerate(found.centroids)]
    named = spark.createDataFrame(names, "cluster int, name string").select("cluster", F.sha2("name", 256).alias("centroid_sha256"))
    total = lambda column: F.sum(F.col(column).cast("decimal(38,0)"))
    sums = found.assigned.groupBy("cluster").agg(total("distance").alias("own"))
    each = sums.join(sums.agg(total("own").alias("every"))).join(named, "cluster")  # a row for each cluster
    joined = found.assigned.join(F.broadcast(each), "cluster")
    return joined.select("doc.vec_id", "cluster", "distance", F.col("own").cast("bigint").alias("cluster_inertia"), F.col("every").cast("bigint").alias("inertia"), "centroid_sha256")


def _drake_oracle(rounds: int = 3, k: int = 16) -> str:
    """Rounds of comparing every vector with every centroid."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS p
  FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), p) - 1 AS INT) AS cluster, p AS c
  FROM kept QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT row, vec_id, p, cluster, d FROM (
    SELECT row, vec_id, p, cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p, c)]) AS d FROM kept, c{i})
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT cluster, i, sum(v) AS s, count(*) AS n
        FROM (SELECT cluster, unnest(p) AS v, unnest(range(64)) AS i FROM a{i}) GROUP BY cluster, i)
  GROUP BY cluster),
c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(x AS BIGINT) FOR x IN c], ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


ORACLES["op13_drake"] = _drake_oracle()


@_query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(_documents(spark, sf_dir), columns=["doc_id"])
    of = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind.name)).cast("bigint").alias(f"n_{kind.name}") for kind in secrets.BASE]
    return found.select("doc.doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def _secrets_oracle() -> str:
    """Every kind's matches and the pieces between them, their lengths summed up; weak parts meet all others of their document."""
    quoted = lambda pattern: pattern.replace("'", "''")
    spans = " UNION ALL ".join(
        f"SELECT row, {i} AS kind, '{k.role}' AS role, {k.least} AS least, regexp_extract_all(text, '{quoted(k.pattern)}') AS m, "
        f"regexp_extract_all(text, '{quoted(k.pattern)}', {k.group}) AS v, string_split_regex(text, '{quoted(k.pattern)}') AS g FROM docs"
        for i, k in enumerate(secrets.KINDS)
    )
    n = len(secrets.BASE)
    names = ", ".join(f"'{k.name}'" for k in secrets.KINDS)
    text = lambda rows: f"string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER ({rows})"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
cut AS ({spans}
  UNION ALL SELECT row, -1, NULL, 0, regexp_extract_all(text, '{secrets.BLANK_LINES}'), regexp_extract_all(text, '{secrets.BLANK_LINES}'), string_split_regex(text, '{secrets.BLANK_LINES}') FROM docs),
placed AS (
  SELECT row, kind, role, v, least, sum(gap + size) OVER (PARTITION BY row, kind ORDER BY i) - size AS start, size
  FROM (SELECT row, kind, role, least, unnest(v) AS v, unnest([len(x) FOR x IN m]) AS size, unnest([len(x) FOR x IN g[:len(m)]]) AS gap, unnest(range(len(m))) AS i FROM cut)),
found AS (
  SELECT row, kind, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop,
         CASE WHEN kind <> 2 OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-f]') THEN role END AS role
  FROM placed WHERE len(v) >= least),
parts AS (
  SELECT *, (SELECT count(*) FROM found b WHERE b.row = p.row AND b.kind < 0 AND b.start <= p.start) AS scope FROM found p
  WHERE role IS NOT NULL AND (kind < {n} OR NOT EXISTS (
    SELECT 1 FROM found b WHERE b.row = p.row AND b.kind BETWEEN 0 AND {n - 1} AND b.role IS NOT NULL AND b.start < p.stop AND p.start < b.stop))),
met AS (
  SELECT p.row, p.kind, p.start, p.stop, p.role, bool_or(o.role = 'identifier') AS identifier, bool_or(o.role = 'secret') AS secret
  FROM parts p JOIN parts o ON p.row = o.row AND p.scope = o.scope AND p.role <> o.role
   AND (o.start - p.stop BETWEEN 0 AND {secrets.REACH} OR p.start - o.stop BETWEEN 0 AND {secrets.REACH})
  WHERE p.kind >= {n} GROUP BY ALL),
every AS (
  SELECT row, kind, start, stop FROM found WHERE kind BETWEEN 0 AND {n - 1}
  UNION ALL
  SELECT row, kind, start, stop FROM met WHERE CASE role WHEN 'identifier' THEN secret WHEN 'secret' THEN identifier ELSE identifier AND secret END)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce({text(f"kind < {n}")}, '')) AS base_sha256, coalesce({text("kind >= 0")}, '') AS spans
FROM docs LEFT JOIN every USING (row) GROUP BY row, doc_id
"""


ORACLES["op12_secrets"] = _secrets_oracle()


@_query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


ORACLES["op11_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM cut GROUP BY lang),
runs AS (
  SELECT lang, size, unnest([array_to_string(words[i:i + size - 1], ' ') FOR i IN range(1, len(words) - size + 2)]) AS phrase
  FROM cut, (VALUES (1), (2), (3), (4)) sizes(size)),
known AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM known WHERE size > 1),
inside AS (
  SELECT lang, a, unnest(flatten([[array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, size - k + 2)] FOR k IN range(2, size)])) AS phrase
  FROM candidates WHERE size > 2),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k
  FROM candidates LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c
  JOIN known l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN known r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:c.size], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000
"""
