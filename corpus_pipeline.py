"""The corpus pipeline: quality rules, near-dedup, suffix dedup, mixing, byte-level BPE.

Every stage reads the rows that its predecessor wrote as Parquet.  All but the
last return the columns of the documents; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinevox.llm.byte_bpe import encode
from cinevox.llm.minhash import one_of_each_group
from cinevox.llm.mixing import first_words, mixed_documents
from cinevox.llm.quality import quality
from cinevox.llm.scratch import Scratch
from cinevox.llm.suffix_dedup import remove_repeats


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns, from ``doc``, with another text."""
    new = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return docs.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality(docs).where("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id."""
    return one_of_each_group(docs, shingle=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes under 200-byte strings that start anywhere else too; a document may end up empty."""
    cut = remove_repeats(docs, depth=200, columns=[c for c in docs.columns if c != "text"], as_text=True)
    return _with_text(cut, docs.columns, F.col("kept_text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order: repeated documents are repeated rows, one cut short has its first words only."""
    entries = mixed_documents(docs)
    text = F.when(F.col("taken") < F.col("size"), first_words(F.col("doc.text"), F.col("taken"))).otherwise(F.col("doc.text"))
    return _with_text(entries, docs.columns, text)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, and whether they decode to its text."""
    encoded = encode(docs, columns=["doc_id", "lang", "source"], decoded=False)
    return encoded.select("doc.*", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("exact").alias("round_trip"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

ORACLE_SQL = None
"""The learnt references of the first stage have no SQL; tests compare with brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
