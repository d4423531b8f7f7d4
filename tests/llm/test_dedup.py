"""Suffix dedup and near duplicates against brute force."""

import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cinevox.llm import skew
from cinevox.llm.minhash import near_duplicates, one_of_each_group
from cinevox.llm.suffix_dedup import remove_repeats

from .conftest import rows_of, sentence


@pytest.fixture
def dealt(monkeypatch):
    """Keys of more than three rows count as large, so that small tables take the way of large ones."""
    monkeypatch.setattr(skew, "LEAST", 3)
    monkeypatch.setattr(skew, "PIECES", 10**6)


def thue_morse(n):
    """Two texts of ``n`` letters that agree under every hash which is a polynomial modulo a power of two, if ``n`` is large."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[i] for i in ones), "".join("ba"[i] for i in ones)


def cut(texts, depth):
    """What is left of each text, the bytes removed and the number of runs, by counting every window."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if count[d[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def groups(rows, size, percent):
    """Number of shingles and least linked id of each ``(id, text)``."""
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), key) if x is not None), default=None)
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("depth", [100, 200])
def test_suffix_dedup_is_exact(hard, depth):
    rows = hard.collect()
    want = sorted((str(r["doc_id"]), *w) for r, w in zip(rows, cut([r["text"] for r in rows], depth), strict=True))
    got = remove_repeats(hard, depth=depth, columns=["doc_id", "id"]).collect()
    assert sorted((str(r["doc"]["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab", min_size=90, max_size=260), min_size=1, max_size=4), st.integers(0, 3))
def test_suffix_dedup_of_few_letters(make, texts, copies):
    texts = texts + ["xyz" * 20 + texts[0] + "q" * 130] * copies
    got = {r["doc"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(make(rows_of(texts)), depth=100).collect()}
    assert [got[i + 1] for i in range(len(texts))] == cut(texts, 100)


@pytest.mark.parametrize("n", [200, 256, 1024, 4096])
def test_suffix_dedup_of_texts_with_equal_polynomials(make, n):
    """The two texts share windows, as all their short factors are alike, but not at every place."""
    one, other = thue_morse(n)
    texts = [one + "x" * 7, "y" * 9 + other]
    got = {r["doc"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(make(rows_of(texts)), depth=200).collect()}
    assert [got[i + 1] for i in range(2)] == cut(texts, 200)


def test_suffix_dedup_of_a_passage_in_many_surroundings(make, dealt):
    """Passages a little shorter and longer than a window, each in other surroundings; all digits of them are large groups."""
    rng = random.Random(5)
    passages = [sentence(rng, 40)[:n] for n in (180, 199, 200, 230)]
    texts = [sentence(rng, 9) + p + sentence(rng, 40) for p in passages for _ in range(60)] + [passages[3] + " same end " * 8] * 20
    got = {r["doc"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(make(rows_of(texts)), depth=200).collect()}
    assert [got[i + 1] for i in range(len(texts))] == cut(texts, 200)


def test_suffix_dedup_of_nothing(make):
    assert remove_repeats(make([])).count() == 0


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_are_exact(hard, size):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    want = sorted((str(i), n, str(c), i == c) for (i, _), (n, c) in zip(rows, groups(rows, size, 80), strict=True))
    got = near_duplicates(hard, shingle=size).collect()
    assert sorted((str(r["id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == want


def test_chains_and_buckets_with_many_nodes(make):
    """Each text differs from the next by one word: links to near ones only, one component over all of them."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 100, 2)]
    chain = [" ".join(f"v{j}" for j in range(3 * i, 3 * i + 80)) for i in range(30)]
    rows = list(enumerate(texts + chain, 1))
    got = {r["id"]: r["component_id"] for r in near_duplicates(make(rows_of(texts + chain)), shingle=4).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(rows, groups(rows, 4, 80), strict=True)}


def test_words_with_equal_polynomials_are_not_linked(make):
    texts = [t for n in (256, 1024, 4096) for t in thue_morse(n)]
    assert [r["component_id"] for r in near_duplicates(make(rows_of(texts))).orderBy("id").collect()] == list(range(1, 7))


def test_large_groups_are_dealt_out(make, dealt):
    """Many exact copies, a hub of near copies, and one template with many fills: all pairs decide."""
    rng = random.Random(8)
    base = sentence(rng, 60).split()
    hub = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(60)]
    template = sentence(rng, 80)
    fills = [f"{template} {sentence(rng, n)}" for n in (4, 8, 10, 16, 22) for _ in range(12)]
    texts = [None, "", *[" ".join(base)] * 30, *hub, *fills]
    rows = list(enumerate(texts, 1))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make(rows_of(texts)), shingle=4).collect()}
    assert got == {i: (n, c if n else i) for (i, _), (n, c) in zip(rows, groups(rows, 4, 80), strict=True)}


def test_one_of_each_group_stays(hard):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    found = groups(rows, 5, 80)
    stay = one_of_each_group(hard, shingle=5)
    assert stay.columns == hard.columns
    ids = sorted(str(r["doc_id"]) for r in stay.collect())
    empty = [str(i) for (i, _), (n, _) in zip(rows, found, strict=True) if not n]
    assert ids == sorted([*empty, *{str(c) for n, c in found if n}])


def test_no_documents(make):
    assert near_duplicates(make([])).count() == 0
    assert one_of_each_group(make([])).count() == 0
