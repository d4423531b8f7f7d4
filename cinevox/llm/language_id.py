"""Language identification by error-correcting output codes.

Every learnt language has a codeword of +1 and -1.  For each bit a binary
classifier over byte n-grams (naive Bayes log-odds, from the n-gram counts of
all labelled documents, each language weighing the same) says on which side a
text lies.  Decoding adds up the logistic loss of a codeword's bits under the
classifiers' margins, each bit weighted by how well its classifier separates the
two sides, and takes the codeword of least loss; a runner-up that is nearly as
good flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import in_arrow
from .textkit import blocks, utf8

BUCKETS = 4096
GRAMS = (2, 3, 4)
SMOOTHING = 0.5
EVIDENCE = 12.0
"""A text's mean log-odds count as of so many independent n-grams at most."""
AMBIGUOUS = 0.9
"""Texts whose best codeword has less than this share of the likelihood are flagged."""
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def profile(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts of each row; letters are folded to lower case, and all else of ASCII to one blank."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    text = _FOLD[data].astype(np.uint32)
    out = np.zeros(rows * BUCKETS, np.int64)
    for n in GRAMS:
        if len(text) < n:
            continue
        size = len(text) - n + 1
        value = np.full(size, n, np.uint32)
        for i in range(n):
            value = value * np.uint32(0x01000193) ^ text[i : i + size]
        value *= np.uint32(0x9E3779B1)
        ok = row[:size] == row[n - 1 :]
        out += np.bincount(row[:size][ok] * BUCKETS + (value[ok] >> np.uint32(20)), minlength=rows * BUCKETS)
    return out.reshape(rows, BUCKETS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of profiles by language, one set of rows for each task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        lang = batch.column("lang").dictionary_encode()
        names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
        for a, b in blocks(offsets):
            counts = profile(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for c in np.unique(code[a:b]):
                sums[names[c]] = sums.get(names[c], 0) + counts[code[a:b] == c].sum(0)
    for name, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])


def codewords(n: int, bits: int = 0, seed: int = 7) -> np.ndarray:
    """``n`` codewords of +1 and -1: every bit splits the languages; the set with the largest least distance of 200 draws."""
    if n < 2:
        return np.ones((n, 0))
    bits = bits or max(15, 4 * int(np.ceil(np.log2(n))))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0)
        flat = np.abs(code.sum(0)) == n
        code[0, flat] *= -1
        gap = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if gap > far:
            best, far = code, gap
    return best


@dataclass(frozen=True)
class Model:
    """Learnt languages, their codewords, the n-gram weights of each bit's classifier and the bits' weights."""

    langs: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        total = counts.sum(1, keepdims=True)
        return counts @ self.weights / np.maximum(total, 1) * np.minimum(total, EVIDENCE)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share of the likelihood."""
        if not len(self.langs):
            return np.zeros(len(margins), np.int64), np.zeros(len(margins))
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        best = loss.argmin(1)
        share = 1 / np.exp(loss.min(1)[:, None] - loss).sum(1)
        return best, share


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows with a language.  What reaches the driver is ``BUCKETS`` counts for each language."""
    source = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = in_arrow(source, _count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(rows["lang"].unique()))
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(np.array(langs, object), rows["lang"].to_numpy(object)), rows["bucket"].to_numpy(int)] = rows["n"]
    code = codewords(len(langs))
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True) if len(langs) else counts
    side = lambda sign: (code == sign).T.astype(float) @ share / np.maximum((code == sign).sum(0), 1)[:, None]
    weights = (np.log(side(1)) - np.log(side(-1))).T if code.shape[1] else np.zeros((BUCKETS, 0))
    own = (share @ weights) * code  # mean margin of each language on its own side
    trust = np.clip(own.min(0), 0, None) if code.shape[1] else np.zeros(0)
    trust = trust / trust.mean() if trust.sum() > 0 else np.ones(code.shape[1])
    return Model(langs, code, weights, trust)


def _predict(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNDETERMINED], object)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            best, share = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for a, b in blocks(offsets):
                best[a:b], share[a:b] = model.decode(model.margins(profile(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
            known = batch.column("lettered").to_numpy(zero_copy_only=False) & bool(model.langs)
            score = np.where(known, share, 0.0)
            lang = pa.array(names[np.where(known, best, len(model.langs))].tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), lang, pa.array(score), pa.array(~known | (score < AMBIGUOUS))], names=["doc", "lang_pred", "score", "ambiguous"])

    return task


def predict(docs: DataFrame, model: Model, text_col: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """``doc`` (a struct of ``columns``, by default all), ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``, from the text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if no language was learnt.  Of codewords with equal loss the language
    that is first by name counts, and its score, 1/2 or less, flags it.
    """
    columns = list(columns or docs.columns)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(text_col).alias("text"), lettered.alias("lettered"))
    fields = T._parse_datatype_string("lang_pred string, score double, ambiguous boolean").fields
    return in_arrow(rows, _predict(model), T.StructType([rows.schema["doc"], *fields]))


def fold(id_column: Column, folds: int = 3) -> Column:
    """Remainder of the CRC-32 of the id as text; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds
