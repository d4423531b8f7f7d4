"""Collocations against counting every run of words."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from cinevox.llm import phrases
from cinevox.llm.phrases import collocations, frequent

from .conftest import rows_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(rows):
    """Occurrences of every run of one to four words, and words, by language."""
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    count[lang, tuple(words[i : i + n])] += 1
    return count, total


def best(rows, least, top=2000):
    count, total = runs(rows)
    known = {k: f for k, f in count.items() if f >= least}
    out = {}
    for (lang, words), a in known.items():
        if len(words) < 2:
            continue
        inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))  # noqa: E731, B023
        if any(o == lang and len(w) > len(words) and 100 * f >= 80 * a and inside(w) for (o, w), f in known.items()):
            continue
        cuts = [(2_000_000 * a // (count[lang, words[:k]] + count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]]))
    for lang, own in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, total[lang], -score


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def spoken(hard):
    rng = random.Random(5)
    words = ["New", "york", "été", "\U0001f600", "of", "the", "a", "b"]
    more = []
    for i in range(120):
        n = rng.choice([0, 1, 3, 40, 200])
        more.append((1000 + i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", " \x0b"]) for _ in range(n)), rng.choice(["xx", "yy", None, "und"]), None, None, None, None, None, None))
    return hard.unionByName(hard.sparkSession.createDataFrame(more, hard.schema)).drop("size").withColumnRenamed("source", "phrase").withColumnRenamed("key", "rank")


@pytest.mark.parametrize("least, top", [(30, 2000), (3, 2000), (3, 5)])
def test_collocations(spoken, least, top):
    """Clashing names, null languages, ties of score and of count, periodic and very long texts."""
    rows = [(r["text"], r["lang"]) for r in spoken.collect()]
    assert got(collocations(spoken, least=least, top=top)) == sorted(best(rows, least, top))


def test_a_sketch_that_is_too_small_loses_nothing(spoken, monkeypatch):
    count, _ = runs([(r["text"], r["lang"]) for r in spoken.collect()])
    monkeypatch.setattr(phrases, "NARROWEST", 64)
    monkeypatch.setattr(phrases, "WIDEST", 64)
    found = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in frequent(spoken, least=4).where("size > 0").collect()}
    assert found == {k: f for k, f in count.items() if f >= 4}


def test_long_texts_and_merging_in_parts(spoken, monkeypatch):
    rows = [(r["text"], r["lang"]) for r in spoken.collect()]
    monkeypatch.setattr(phrases, "FAN_IN", 12)
    assert got(collocations(spoken, least=300)) == sorted(best(rows, 300))
    batch = pa.RecordBatch.from_pydict({"text": ["ab cd. ef\n" * 200_000, None, "x " * 10, "y" * 700_000], "seed": pa.array([1, 2, 3, 4], pa.int64())})
    found = [(owner[run.row], run) for owner, run in phrases._blocks(batch)]
    assert len(found) > 3 and sum(len(run.word) for _, run in found) == 600_011
    assert Counter(np.concatenate([owner for owner, _ in found]).tolist()) == {0: 600_000, 2: 10, 3: 1}


def test_layout_does_not_matter(spoken):
    assert got(collocations(spoken.repartition(5), least=3)) == got(collocations(spoken.coalesce(1), least=3))


def test_what_a_task_sends_at_once_is_not_cut_finer_for_a_wider_sketch(monkeypatch):
    monkeypatch.setattr(phrases, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"word{i}" for i in range(100_000))], "seed": pa.array([1], pa.int64())})
    for width in (1 << 16, 1 << 22, phrases.WIDEST):
        rows = [row for sent in phrases._sketch(iter([batch]), width, 30, []) for row in sent.to_pylist()]
        assert len(rows) <= 512 and {row["part"] for row in rows} == {3}
        total = sum(int(phrases._unpacked(row["n"], row["counters"], 30)[1].sum()) for row in rows)
        assert total == phrases.DEPTH * (100_000 + 99_999)  # some may share a counter, none 30 of them


def test_counters_come_back_as_they_were_sent():
    rng = np.random.default_rng(1)
    width = phrases.WIDEST
    key = np.unique(np.concatenate([rng.integers(0, phrases.DEPTH * width, 1000), [0, 1, phrases.DEPTH * width - 1]])).astype(np.uint64)  # far apart, so that steps pass 16 bits
    for least in (30, 1 << 40):
        count = rng.integers(1, 1 << 35, len(key)).astype(np.uint64)
        back = []
        for row in phrases._packed(key, count, least, 0, phrases._slice(width)).to_pylist():
            place, counts = phrases._unpacked(row["n"], row["counters"], least)
            back += zip((place + row["slice"] * phrases._slice(width)).tolist(), counts.tolist(), strict=True)
        assert back == list(zip(key.tolist(), np.minimum(count, least).tolist(), strict=True))


def test_the_driver_reads_bits_that_all_tasks_have_merged(spoken, monkeypatch):
    """It takes one partition after another, which must not be made only then."""
    plans, read = [], type(spoken).toLocalIterator
    monkeypatch.setattr(type(spoken), "toLocalIterator", lambda self, *a: plans.append(self._jdf.queryExecution().toString()) or read(self, *a))
    assert frequent(spoken, least=4).count() > 0
    assert len(plans) == len(phrases.LEVELS) and not any("MapInArrow" in p for p in plans)


def test_words_of_all_lengths_have_hashes_of_their_own():
    words = ["a" * n for n in range(1, 150)] + ["b" + "a" * n for n in range(150)] + ["a" * n + "b" for n in range(1, 150)]
    texts = [" ".join(words), "x. " + "\t ".join(reversed(words))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    run = phrases.Runs(data, np.array([0, len(texts[0]), len(data)]), np.array([1, 1], np.uint64))
    found = {}
    for a, b, value in zip(run.start, run.end, run.word, strict=True):
        found.setdefault(bytes(data[a:b]).decode(), set()).add(int(value))
    assert set(found) == {*words, "x"} and all(len(v) == 1 for v in found.values())
    assert len(set.union(*found.values())) == len(found)


def test_hashes_with_the_same_first_bits_stay_apart():
    value = np.array([8, 9, 8, 1 << 60, 9, 8, (1 << 60) + 1, 1 << 60], np.uint64)
    order, first, ends = phrases._distinct(value)
    count = Counter()
    for a, n in zip(first, np.diff(ends), strict=True):
        count[int(value[order[a]])] += int(n)
    assert count == Counter(value.tolist()) and sorted(order.tolist()) == list(range(len(value)))
    assert [len(x) for x in phrases._distinct(value[:0])] == [0, 0, 1]


def test_no_texts(make):
    assert got(collocations(make([]))) == []
    assert got(collocations(make(rows_of([None, "", " . , \n "])))) == []
