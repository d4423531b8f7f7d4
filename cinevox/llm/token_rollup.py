"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed sums by key,
written below ``deltas/batch=<id>``; a one-row file below ``commits/batch=<id>``
then makes it count.  Totals are the sum of the committed deltas, so their order
does not matter.  A batch whose id is committed is skipped, and one that failed
half-way is overwritten by its next attempt, so every batch counts once.

``compact`` adds the committed deltas to a base, a table of totals below
``bases/base=<n>`` with the batches it holds.  Readers take the latest whole base
and the committed deltas that it does not hold.  ``forget`` then removes what the
base holds, its commits too, so what readers read does not grow with all batches
there ever were; of these only the numbers stay, in the base, for the question
whether a batch was committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def changes(rows: DataFrame, op: str) -> DataFrame:
    """Rows of ``source, lang, tokenizer, n_tokens`` as changes; for ``revise`` also ``was``, the count so far."""
    was = F.col("was") if op == "revise" else F.lit(None).cast("bigint")
    return rows.select(F.lit(op).alias("op"), *[F.col(k).cast("string").alias(k) for k in KEYS], F.col("n_tokens").cast("bigint").alias("n_tokens"), was.cast("bigint").alias("was"))


class TokenRollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def committed(self, batch: int) -> bool:
        if self._exists(f"{self.path}/commits/batch={int(batch)}/_SUCCESS"):
            return True
        bases = self._bases()
        return bool(bases) and not self._held(bases[-1]).where(F.col("batch") == int(batch)).isEmpty()

    def _held(self, base: int) -> DataFrame:
        return self.spark.read.schema("batch bigint").parquet(f"{self.path}/bases/base={base}/batches")

    def _names(self, folder: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def commit(self, batch: int, changed: DataFrame) -> bool:
        """Adds a batch; False if it was committed before.

        ``changed`` has ``op`` (``insert``, ``delete`` or ``revise``), the keys,
        ``n_tokens`` and ``was``.  A delete takes back ``n_tokens``, a revision
        replaces ``was`` by ``n_tokens`` under the same key.  Null keys are keys
        of their own; null counts count as 0.  Other operations are an error.
        """
        if self.committed(batch):
            return False
        n, was = F.coalesce("n_tokens", F.lit(0)), F.coalesce("was", F.lit(0))
        known = F.when(F.col("op").isin("insert", "delete", "revise"), True).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))).cast("boolean"))
        docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
        tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - was)
        delta = changed.where(known).groupBy(*KEYS).agg(F.sum(docs).cast("bigint").alias("n_docs"), F.sum(tokens).alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={int(batch)}")
        self.spark.range(1).select(F.lit(int(batch)).alias("id")).write.mode("overwrite").parquet(f"{self.path}/commits/batch={int(batch)}")
        return True

    def _bases(self) -> list[int]:
        """Numbers of the whole bases, the latest last."""
        return sorted(int(n.partition("=")[2]) for n in self._names("bases") if self._exists(f"{self.path}/bases/{n}/batches/_SUCCESS"))

    def _signed(self) -> tuple[DataFrame, DataFrame]:
        """Rows that add up to the totals, and the batches in them: the latest base, and committed deltas outside it."""
        commits = self.spark.read.schema("id bigint, batch bigint").parquet(f"{self.path}/commits").select("batch")
        deltas = self.spark.read.schema(f"{_DELTA}, batch bigint").parquet(f"{self.path}/deltas").join(commits, "batch", "left_semi")
        if not (bases := self._bases()):
            return deltas.drop("batch"), commits
        base = f"{self.path}/bases/base={bases[-1]}"
        held = self._held(bases[-1])
        totals = self.spark.read.schema(_DELTA).parquet(f"{base}/totals")
        return totals.unionByName(deltas.join(held, "batch", "left_anti").drop("batch")), commits.union(held).distinct()

    def compact(self) -> int | None:
        """Writes a new base of everything committed; its number, or None without commits.

        The list of its batches is written last and makes it count; a compaction
        that failed before is overwritten.  Deltas and older bases stay until
        ``forget`` removes them, for readers that still use them.
        """
        if not self._exists(f"{self.path}/commits"):
            return None
        number = max(self._bases(), default=0) + 1
        base = f"{self.path}/bases/base={number}"
        rows, batches = self._signed()
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        sums.write.mode("overwrite").parquet(f"{base}/totals")
        batches.select(F.col("batch").cast("bigint").alias("batch")).coalesce(8).write.mode("overwrite").parquet(f"{base}/batches")
        return number

    def forget(self) -> None:
        """Removes deltas and commits that the latest base holds, and older bases; the batches stay committed."""
        if not (bases := self._bases()):
            return
        there = {int(n.partition("=")[2]) for folder in ("deltas", "commits") for n in self._names(folder) if n.startswith("batch=")}  # since the last time
        held = [r["batch"] for r in self._held(bases[-1]).where(F.col("batch").isin(sorted(there))).collect()]
        for name in [*(f"{folder}/batch={b}" for folder in ("commits", "deltas") for b in held), *(f"bases/base={b}" for b in bases[:-1])]:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` of keys that still have documents or tokens."""
        if not self._exists(f"{self.path}/commits"):
            return self.spark.createDataFrame([], _DELTA)
        sums = self._signed()[0].groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")
