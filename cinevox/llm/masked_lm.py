"""Document scores by masked pseudo-likelihood.

A small network predicts every token from the two tokens on its left and the two
on its right: one embedding table for each of the four places, their sum through
tanh, and a softmax in two steps, over ``CLASSES`` classes of tokens and over the
tokens of the class.  A document's score is the sum of the log-probabilities of
its tokens, each given both sides.

The vocabulary is counted over the whole corpus: the most frequent words, of any
length, and a class of hash buckets for all other words.  Training runs where the
data is, on every window of every document.  Documents are dealt by hash into
groups of about ``GROUP`` words and into ``ROUNDS`` rounds; a group's windows are
descended over in the order of the hash, from the weights of the round before;
Spark then averages the groups' weights by their numbers of windows, as integers.
So neither the layout of the table nor the order of the sums changes a score, and
the windows and groups grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, in_arrow
from .textkit import blocks, utf8, words

CLASSES = 64
MEMBERS = 64
SIZE = CLASSES * MEMBERS
COMMON = SIZE - MEMBERS
"""Words with a token of their own; the last class has the buckets of all others."""
PAD = SIZE
WIDTH = 16
AROUND = (-2, -1, 1, 2)
ROUNDS = 3
GROUP = 1_000_000
"""Words of a group, on average."""
LEAST = 200_000
"""Windows that a group descends over at least, if need be in several passes over its own."""
BATCH = 1 << 14
SCORED = 1 << 15
"""Windows of a step of the descent, and windows scored at once."""
NEAR = 1 << 11
"""Rows of the classes' wide answers made at once, so that they stay in cache."""
PLACES = 18
"""First bits of a word's hash by which common words are found."""
TASKS = 4096
"""Partitions of a round at most; each descends over its groups one after another and sends their sum."""
RATE = 0.15
_FIX = 1 << 20
_U = np.uint64


def _tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no answer between -1 and 1 times the weights (a row for each outcome) can leave the range in which exponentials keep their digits."""
    return float(np.abs(weights).sum(1).max() + np.abs(bias).max()) < 60


def _exps(logits: np.ndarray, tame: bool) -> np.ndarray:
    """Exponentials in the place of the logits, each row up to a factor of its own unless they are ``tame``."""
    if not tame:
        logits -= logits.max(1, keepdims=True)
    return np.exp(logits, out=logits)


def _log_share(logits: np.ndarray, own: np.ndarray, tame: bool) -> np.ndarray:
    """Log-probability of one place of each row; the numbers are used up."""
    if not tame:
        logits -= logits.max(1, keepdims=True)
    chosen = logits[np.arange(len(own)), own]
    return chosen - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype))


def _slopes(hidden: np.ndarray, weights: np.ndarray, bias: np.ndarray, own: np.ndarray, tame: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the loss by the hidden rows, by the weights (a row for each outcome) and by the biases."""
    logits = hidden @ weights.T
    logits += bias
    odds = _exps(logits, tame)
    total = odds @ np.ones(len(weights), odds.dtype)
    odds[np.arange(len(own)), own] -= total
    share = 1 / total  # narrow rows are divided instead of wide ones
    back = odds @ weights
    back *= share[:, None]
    return back, odds.T @ (hidden * share[:, None]), share @ odds


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        found = [words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True).hash for a, b in blocks(offsets)]
        word, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, _U), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


@dataclass(frozen=True)
class Model:
    """Hashes of the common words, sorted, and their tokens; the four ``place`` tables, the classes' and the tokens' outputs and biases."""

    common: np.ndarray
    token: np.ndarray
    place: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token of every word, and the rows' ranges."""
        w = words(data, offsets, lower=True)
        token = COMMON + (w.hash % _U(MEMBERS)).astype(np.int64)
        at = self._places()[w.hash >> _U(64 - PLACES)]
        several = np.flatnonzero(at == len(self.common) + 1)
        at[several] = np.searchsorted(self.common, w.hash[several])
        at = np.minimum(at, len(self.common))
        hit = np.flatnonzero(at < len(self.common))
        hit = hit[self.common[at[hit]] == w.hash[hit]]
        token[hit] = self.token[at[hit]]
        return token, w.first

    def _places(self) -> np.ndarray:
        """By the first bits of a hash: the common word that has them, if there is one, and where to look if there are several."""
        if "places" not in self.__dict__:
            n = len(self.common)
            first = (self.common >> _U(64 - PLACES)).astype(np.int64)
            count = np.bincount(first, minlength=1 << PLACES)
            places = np.full(1 << PLACES, n, np.int32)
            places[first] = np.arange(n)
            places[count > 1] = n + 1
            self.__dict__["places"] = places
        return self.__dict__["places"]

    @staticmethod
    def contexts(token: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens around every token; ``PAD`` beyond the ends of its row."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out = np.full((len(AROUND), len(token)), PAD)
        for k, step in enumerate(AROUND):
            here = np.arange(max(0, -step), len(token) - max(0, step))
            here = here[row[here] == row[here + step]]
            out[k, here] = token[here + step]
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.place[0].take(context[0], axis=0)
        for k in range(1, len(AROUND)):
            total += self.place[k].take(context[k], axis=0)
        return np.tanh(total, out=total)

    @staticmethod
    def by_class(token: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """An order by class, and of each class that occurs the range in that order and that of its tokens."""
        kind = (token // MEMBERS).astype(np.uint16)  # numbers this small are sorted by counting
        by = np.argsort(kind, kind="stable")
        cut = np.searchsorted(kind[by], np.arange(CLASSES + 1))
        return by, [(slice(cut[c], cut[c + 1]), slice(c * MEMBERS, (c + 1) * MEMBERS)) for c in range(CLASSES) if cut[c] < cut[c + 1]]

    def tame(self) -> tuple[bool, bool]:
        return _tame(self.top.T, self.top_bias), _tame(self.out, self.bias)

    def log_probs(self, token: np.ndarray, context: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token))
        tame_top, tame_out = self.tame()
        for a in range(0, len(token), SCORED):
            by, kinds = self.by_class(token[a : a + SCORED])
            by += a
            own, hidden = token[by], self.hidden(context.take(by, axis=1))
            kind, member = own // MEMBERS, own % MEMBERS
            part = np.empty(len(own), hidden.dtype)
            for b in range(0, len(own), NEAR):
                rows = slice(b, b + NEAR)
                part[rows] = _log_share(hidden[rows] @ self.top + self.top_bias, kind[rows], tame_top)
            for rows, inside in kinds:
                part[rows] += _log_share(hidden[rows] @ self.out[inside].T + self.bias[inside], member[rows], tame_out)
            out[by] = part
        return out

    def parts(self) -> list[np.ndarray]:
        return [self.place, self.top, self.top_bias, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def replaced(self, values: np.ndarray) -> Model:
        """The model with other weights, in the order of ``flat``."""
        ends = np.cumsum([p.size for p in self.parts()])
        return Model(self.common, self.token, *(v.astype(np.float32).reshape(p.shape) for v, p in zip(np.split(values, ends[:-1]), self.parts(), strict=True)))


class _Descent:
    """Descent from a model's weights, with a rate for each row of weights that shrinks as its gradients add up."""

    def __init__(self, model: Model):
        self.model = model.replaced(model.flat())
        self.pace = [np.full(n, 1e-3, np.float32) for n in (len(AROUND) * (SIZE + 1), CLASSES, SIZE)]

    def _rate(self, pace: np.ndarray, at: np.ndarray | slice, slope: np.ndarray) -> np.ndarray:
        pace[at] += np.einsum("ij,ij->i", slope, slope) / np.float32(WIDTH)
        return np.float32(RATE) / np.sqrt(pace[at])

    def step(self, token: np.ndarray, context: np.ndarray) -> None:
        m, n = self.model, len(token)
        tame_top, tame_out = m.tame()
        by, kinds = m.by_class(token)
        token, context = token[by], context.take(by, axis=1)
        hidden = m.hidden(context)
        kind, member = token // MEMBERS, token % MEMBERS
        back, top = np.empty_like(hidden), np.ascontiguousarray(m.top.T)
        slope, bias = np.zeros_like(top), np.zeros_like(m.top_bias)
        for a in range(0, n, NEAR):
            rows = slice(a, a + NEAR)
            back[rows], own, own_bias = _slopes(hidden[rows], top, m.top_bias, kind[rows], tame_top)
            slope += own
            bias += own_bias
        m.top[:] -= (slope * self._rate(self.pace[1], slice(None), slope)[:, None]).T
        m.top_bias[:] -= bias * np.float32(RATE / n)
        slope, bias = np.zeros_like(m.out), np.zeros_like(m.bias)
        for rows, inside in kinds:
            own, slope[inside], bias[inside] = _slopes(hidden[rows], m.out[inside], m.bias[inside], member[rows], tame_out)
            back[rows] += own
        m.out[:] -= slope * self._rate(self.pace[2], slice(None), slope)[:, None]
        m.bias[:] -= bias * np.float32(RATE / n)
        back *= 1 - hidden**2
        every = (context + np.arange(len(AROUND))[:, None] * (SIZE + 1)).ravel().astype(np.uint16)
        by = np.argsort(every, kind="stable")
        every = every[by]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        row = every[first]
        slope = np.add.reduceat(back.take(by % n, axis=0), first)
        m.place.reshape(-1, WIDTH)[row] -= slope * self._rate(self.pace[0], row, slope)[:, None]
        for weights, bound in ((m.top, 8), (m.top_bias, 20), (m.out, 8), (m.bias, 20), (m.place, 8)):
            np.clip(weights, -bound, bound, out=weights)


def _learn(start: Model):
    """Rows come sorted by group and hash; yields the sum of the weights that the groups end with, each by its number of windows."""

    def descended(held: list[tuple[np.ndarray, np.ndarray]], descent: _Descent, last: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        token, context = np.concatenate([t for t, _ in held]), np.concatenate([c for _, c in held], axis=1)
        end = len(token) if last else len(token) // BATCH * BATCH
        for a in range(0, end, BATCH):
            descent.step(token[a : min(end, a + BATCH)], context[:, a : min(end, a + BATCH)])
        return [(token[end:], context[:, end:])], end

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, descent, seen, early, held = None, None, 0, [], []
        shares, total = 0, 0

        def finish() -> None:
            nonlocal seen, shares, total
            seen += descended(held, descent, True)[1] if held else 0
            whole, n = early, seen
            while early and 0 < n < LEAST:
                n += descended(whole, descent, True)[1]
            share = (seen + 1023) // 1024
            shares += share
            total = total + np.round(descent.model.flat().astype(float) * _FIX).astype(np.int64) * share

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            groups = batch.column("dealt").to_numpy()
            cuts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts, np.append(cuts[1:], len(groups)), strict=True):
                if group != groups[lo]:
                    if seen or held:
                        finish()
                    group, descent, seen, early, held = groups[lo], _Descent(start), 0, [], []
                own = offsets[lo : hi + 1]
                for a, b in blocks(own):
                    token, first = start.tokens(data[own[a] : own[b]], own[a : b + 1] - own[a])
                    if not len(token):
                        continue
                    held.append((token, start.contexts(token, first)))
                    if seen < LEAST:
                        early.append(held[-1])  # for further passes, if the group turns out to be small
                    else:
                        early = []
                    held, n = descended(held, descent, False)
                    seen += n
        if seen or held:
            finish()
        if shares:
            yield pa.RecordBatch.from_arrays([pa.array([shares], pa.int64()), pa.array([total], pa.list_(pa.int64()))], names=["n", "weights"])

    return task


def train(docs: DataFrame, text_col: str = "text", seed: int = 11) -> Model:
    """Vocabulary and weights from all documents; only ``COMMON`` words and one set of weights reach the driver.

    The hash that deals documents covers all columns that can be hashed, so that
    copies of a text with different ids spread over the groups.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "lm")
    counts = scratch.save(in_arrow(texts, _tally, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    sums = counts.groupBy().agg(F.sum("n").alias("n")).first()
    ranked = counts.orderBy(F.desc("n"), "word").limit(COMMON).collect()
    scratch.drop("counts")
    total = sums["n"] or 0
    word = np.array([r["word"] for r in ranked], np.int64).view(_U)
    by = np.argsort(word)
    share = np.zeros(SIZE)
    share[: len(ranked)] = [r["n"] for r in ranked]
    share[COMMON:] = max(0, total - share.sum()) / MEMBERS
    share = share.reshape(CLASSES, MEMBERS) + 0.5
    rng = np.random.default_rng(seed)
    model = Model(
        word[by], by, rng.normal(0, 0.1, (len(AROUND), SIZE + 1, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32), np.log(share.sum(1) / share.sum()).astype(np.float32),
        rng.normal(0, 0.1, (SIZE, WIDTH)).astype(np.float32), np.log(share / share.sum(1, keepdims=True)).ravel().astype(np.float32),
    )
    groups = max(1, round(total / GROUP / ROUNDS))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    dealt = docs.select(F.col(text_col).alias("text"), F.xxhash64(*hashed).alias("h")).where(F.length("text") > 0)
    dealt = dealt.select("text", "h", F.pmod("h", F.lit(ROUNDS)).alias("turn"), F.pmod(F.shiftright("h", 20), F.lit(groups)).alias("dealt"))
    for turn in range(ROUNDS):
        own = dealt.where(F.col("turn") == turn).drop("turn").repartition(min(groups, TASKS), "dealt").sortWithinPartitions("dealt", "h", "text")
        parts = in_arrow(own, _learn(model), "n bigint, weights array<bigint>")
        sums = parts.select("n", F.posexplode("weights").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        rows = sums.select("i", (F.col("w") / F.col("n") / _FIX).alias("w")).toPandas()
        if len(rows):
            values = np.zeros(len(rows))
            values[rows["i"].to_numpy()] = rows["w"].to_numpy()
            model = model.replaced(values)
    return model


def _score(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            count, total = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for a, b in blocks(offsets):
                token, first = model.tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sums = np.append(0, np.cumsum(model.log_probs(token, model.contexts(token, first))))
                count[a:b], total[a:b] = np.diff(first), sums[first[1:]] - sums[first[:-1]]
            mean = pa.array(total / np.maximum(count, 1), mask=count == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(count), pa.array(total), mean], names=["doc", "n_tokens", "log_prob", "mean_log_prob"])

    return task


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """``doc`` (a struct of ``columns``, by default all), ``n_tokens``, ``log_prob`` and ``mean_log_prob`` (null without tokens).

    A null text has no token and a ``log_prob`` of 0.  Equal texts get equal
    scores, up to the rounding of sums.
    """
    columns = list(columns or docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(text_col).alias("text"))
    fields = T._parse_datatype_string("n_tokens bigint, log_prob double, mean_log_prob double").fields
    return in_arrow(rows, _score(model), T.StructType([rows.schema["doc"], *fields]))
