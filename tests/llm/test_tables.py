"""Mixing, token rollups, audio fingerprints and the whole pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cinevox.llm import audio
from cinevox.llm.mixing import mix, mixed_documents, targets, taken_by_document
from cinevox.llm.scratch import Scratch
from cinevox.llm.token_rollup import TokenRollup, changes

from .conftest import SEPARATED
from .test_dedup import cut, groups
from .test_texts import RANKS, counts
from cinevox.llm.byte_bpe import tokenizer

# --- mixing

def shares(sizes):
    """Targets by sharing again and again until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        out = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in full and out[s] > 2 * sizes[s]}
        if not above:
            return out
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"x": 7}, {None: 4, "B": 9, "a": 300, "é": 2, "z": 80}, {"a": 100, "b": 100, "c": 100}, {"a": 0, "b": 5}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in targets(table).collect()}
    assert got == {s: pytest.approx(t) for s, t in shares(sizes).items()}


def test_mix_of_hard_rows(hard):
    docs = hard.withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 2 == 0, "web").otherwise("book"))
    rows = taken_by_document(mix(docs)).collect()
    assert len(rows) == docs.count()
    by_source = {}
    for r in rows:
        assert r["size"] == len(SEPARATED.findall(r["doc"]["text"] or ""))
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault(r["doc"]["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    want = shares({s: sum(r["size"] for r in own) for s, own in by_source.items()})
    for s, own in by_source.items():
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert [r["target"] for r in own] == [pytest.approx(want[s])] * len(own)
        assert sum(r["taken"] for r in own) == pytest.approx(want[s], abs=2)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * total, abs=4)
    again = taken_by_document(mix(docs.repartition(7))).collect()
    assert sorted((str(r["doc"]["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc"]["doc_id"]), r["taken"]) for r in rows)


def test_mix_stays_native_and_in_order(hard, make):
    plan = mix(hard)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
    finish = [r["finish"] for r in mixed_documents(hard).collect()]
    assert finish == sorted(finish)
    assert mix(make([])).count() == mixed_documents(make([])).count() == 0


# --- token rollups

def test_rollup_batches_count_once(spark):
    rollup = TokenRollup(spark, Scratch(spark, "test-rollup").path("store"))
    row = "source string, lang string, tokenizer string, n_tokens bigint"
    first = spark.createDataFrame([("web", "en", "v1", 10), ("web", "en", "v1", 10), ("web", None, "v1", 5), (None, "en", "v2", None)], row)
    assert rollup.totals().count() == 0
    assert rollup.commit(1, changes(first, "insert")) and not rollup.commit(1, changes(first, "insert"))
    totals = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    assert totals() == {("web", "en", "v1"): (2, 20), ("web", None, "v1"): (1, 5), (None, "en", "v2"): (1, 0)}
    assert rollup.commit(3, changes(spark.createDataFrame([("web", None, "v1", 5)], row), "delete"))
    revised = spark.createDataFrame([("web", "en", "v1", 7, 10)], row + ", was bigint")
    assert rollup.commit(2, changes(revised, "revise"))
    assert totals() == {("web", "en", "v1"): (2, 17), (None, "en", "v2"): (1, 0)}


def test_unfinished_batch_does_not_count(spark):
    rollup = TokenRollup(spark, Scratch(spark, "test-rollup").path("store"))
    row = spark.createDataFrame([("web", "en", "v1", 10)], "source string, lang string, tokenizer string, n_tokens bigint")
    rollup.commit(1, changes(row, "insert"))
    row.select("source", "lang", "tokenizer", F.lit(1).cast("bigint").alias("n_docs"), "n_tokens").write.parquet(f"{rollup.path}/deltas/batch=2")
    assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(1, 10)]
    rollup.commit(2, changes(row, "insert"))
    assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(2, 20)]
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit(4, changes(row, "upsert"))


def test_compaction_keeps_totals_and_batches(spark, tmp_path):
    rows = lambda *r: changes(spark.createDataFrame(list(r), "source string, lang string, tokenizer string, n_tokens bigint, op string"), "insert")
    state = lambda rollup: {tuple(r) for r in rollup.totals().collect()}
    rollup = TokenRollup(spark, str(tmp_path / "store"))
    assert rollup.compact() is None
    rollup.commit(1, rows(("a", "x", "t", 5, "noise"), ("a", "x", "t", 5, "noise"), (None, None, None, None, None)))
    rollup.commit(2, rows(("b", "x", "t", 7, None)))
    rollup.commit(3, rows(("a", "x", "t", 1, None)).limit(0))
    before = state(rollup)
    assert before == {("a", "x", "t", 2, 10), ("b", "x", "t", 1, 7), (None, None, None, 1, 0)}
    assert rollup.compact() == 1 and state(rollup) == before
    assert not rollup.commit(2, rows(("b", "x", "t", 7, None))) and state(rollup) == before
    rollup.commit(4, rows(("b", "x", "t", 3, None)))
    after = (before - {("b", "x", "t", 1, 7)}) | {("b", "x", "t", 2, 10)}
    assert state(rollup) == after
    (tmp_path / "store/bases/base=9/totals").mkdir(parents=True)  # a compaction that failed
    assert state(rollup) == after and rollup.compact() == 2
    rollup.forget()
    assert state(rollup) == after and not rollup.commit(1, rows(("a", "x", "t", 5, None))) and state(rollup) == after
    rollup.commit(5, rows(("a", "x", "t", 4, None)))
    assert ("a", "x", "t", 3, 14) in state(rollup)


def test_rollup_of_repeated_rows_and_other_columns(spark):
    """Equal rows count each; columns with the rollup's own names are left out; an empty batch commits; forgotten batches stay committed."""
    rollup = TokenRollup(spark, Scratch(spark, "test-rollup").path("more"))
    rows = spark.createDataFrame([("web", "en", "v1", 7, "x", 9, 9)] * 3 + [(None, None, None, None, None, None, None)], "source string, lang string, tokenizer string, n_tokens bigint, op string, n_docs int, batch int")
    assert rollup.commit(5, changes(rows, "insert")) and rollup.commit(6, changes(rows.limit(0), "delete"))
    want = [("web", "en", "v1", 3, 21), (None, None, None, 1, 0)]
    totals = lambda: sorted((tuple(r) for r in rollup.totals().collect()), key=str)
    assert totals() == want
    rollup.compact()
    rollup.forget()
    assert totals() == want and not rollup.commit(5, changes(rows, "insert")) and not rollup.commit(6, changes(rows, "insert"))
    assert rollup.commit(7, changes(rows.limit(1), "delete")) and totals() == [("web", "en", "v1", 2, 14), want[1]]
    rollup.compact()
    rollup.forget()
    assert totals() == [("web", "en", "v1", 2, 14), want[1]] and rollup.committed(5) and rollup.committed(7) and not rollup.committed(8)


# --- audio

def tune(rng, n):
    time = np.arange(800) / 8000
    return np.concatenate([0.4 * np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 36) / 12) * time) for _ in range(n)])


def test_alignment_finds_what_brute_force_finds(spark):
    """Codes with planted bit errors and shifts, against every shift of every pair."""
    rng = np.random.default_rng(7)
    rows = {}
    for k in range(90):
        song = rng.integers(0, 2**32, (60, 34, 20)[k % 3])
        rows[k] = song
        copy = song[rng.integers(0, 5) :]
        flips = rng.random((len(copy), 32)) < (0.02, 0.05, 0.08, 0.1, 0.11)[k % 5]
        rows[100 + k] = copy ^ (flips * (1 << np.arange(32, dtype=np.int64))).sum(1)
    silence = int(audio.fingerprint(np.zeros((audio.SPAN, 12)))[0])
    rows[500], rows[501] = np.full(40, silence), np.full(50, silence)
    rows[600] = np.concatenate([rows[0][:20], rows[0][:20], rows[0][:20]])
    data = [(k, [int(v) for v in codes], "x") for k, codes in rows.items()] + [(700, [], "x"), (701, None, "x"), (None, [int(v) for v in rows[1]], "x"), (0, [int(v) for v in rows[0]], "x")]
    prints = spark.createDataFrame(data, "id bigint, codes array<bigint>, match string")
    found = {(r["id"], r["match"]): r for r in audio.align(prints, F.col("id") < 100).collect()}

    def errors(x, y, shift):
        start, end = max(0, shift), min(len(x), len(y) + shift)
        return (sum(int(a ^ b).bit_count() for a, b in zip(x[start:end], y[start - shift : end - shift])), end - start)

    wanted = {}
    for q in range(90):
        for m, y in rows.items():
            best = min(((2 * e - 32 * n, shift, e / (32 * n)) for shift in range(-len(y) + 16, len(rows[q]) - 15) for e, n in [errors(rows[q], y, shift)] if n >= 16 and e <= 0.12 * 32 * n), default=None)
            if best:
                wanted[q, m] = best
    assert set(found) <= set(wanted) and len(found) >= 0.95 * len(wanted) and (0, 600) in found
    copies = [k for k in wanted if k[1] - k[0] == 100]
    for n in (60, 34, 20):  # every length by itself
        own = [k for k in copies if len(rows[k[0]]) == n]
        assert len(own) > 20 and sum(k in found for k in own) >= 0.9 * len(own)
    assert all(found[k]["shift"] == wanted[k][1] and abs(found[k]["bit_errors"] - wanted[k][2]) < 1e-12 for k in found)
    assert found[0, 0]["n_members"] == 2 and found[1, 1]["n_members"] == 2
    assert audio.align(prints.limit(0), F.col("id") < 100).count() == 0


def test_alignment_of_motifs_and_long_recordings(spark):
    """Of shifts that fit equally well the least counts; a recording of 20,000 positions is found by a piece of it."""
    rng = np.random.default_rng(3)
    motif, long = rng.integers(0, 2**32, 20), rng.integers(0, 2**32, 20_000)
    rows = [(1, motif), (2, np.concatenate([motif, motif, motif])), (3, long), (4, long[12_000:12_050])]
    prints = spark.createDataFrame([(i, [int(v) for v in codes]) for i, codes in rows], "id bigint, codes array<bigint>")
    found = {(r["id"], r["match"]): (r["shift"], r["bit_errors"]) for r in audio.align(prints, F.col("id").isin(1, 4)).collect()}
    assert found == {(1, 1): (0, 0), (1, 2): (-40, 0), (4, 3): (-12_000, 0), (4, 4): (0, 0)}


def test_alignment_finds_errors_spread_over_every_position(spark):
    """Copies with three wrong bits in every integer, so that none is within two bits, are found."""
    rng = np.random.default_rng(5)
    songs = [rng.integers(0, 2**32, 34) for _ in range(40)]
    wrong = lambda song: song ^ np.array([sum(1 << int(k) for k in rng.choice(32, 3, replace=False)) for _ in song])
    rows = [(k, [int(v) for v in song]) for k, song in enumerate(songs)] + [(100 + k, [int(v) for v in wrong(song)]) for k, song in enumerate(songs)]
    found = {(r["id"], r["match"]): r["bit_errors"] for r in audio.align(spark.createDataFrame(rows, "id bigint, codes array<bigint>"), F.col("id") < 100).collect()}
    assert set(found) == {(k, m) for k in range(40) for m in (k, 100 + k)}
    assert all(found[k, 100 + k] == 3 / 32 for k in range(40))


def test_chance_meetings_do_not_grow_with_the_square(spark):
    """Integers with twelve random bits, at two sizes; every fifth recording is a query."""
    rng = np.random.default_rng(6)

    def votes(n):
        spread = np.array([1 << int(k) for k in np.linspace(0, 31, 12)])
        codes = (rng.integers(0, 2, (n, 34, 12)) * spread).sum(2)
        rows = [(i, [int(v) for v in row], 1, i % 5 == 0) for i, row in enumerate(codes)]
        classes = spark.createDataFrame(rows, "match bigint, codes array<bigint>, n_members bigint, asked boolean")
        return audio._votes(classes, Scratch(spark, "test-votes"), 0.12, 16, 2).count()

    small, large = votes(100), votes(500)
    assert 0 < large < 12 * small


def test_links_of_each_recording(spark):
    """Classes, numbers of links and the nearest one, against the list of ``align``; members of a class share them, rows without integers have none."""
    rng = np.random.default_rng(9)
    song, other = rng.integers(0, 2**32, 40), rng.integers(0, 2**32, 40)
    rows = {1: song, 2: song, 3: song[6:] ^ 1, 4: song[:30] ^ 6, 5: other, 6: other[3:], 7: rng.integers(0, 2**32, 40), 8: [], 9: None, None: song}
    rows |= {20 + k: song ^ (1 << k) for k in range(8)}
    data = [(i, None if codes is None else [int(v) for v in codes]) for i, codes in rows.items()]
    prints = spark.createDataFrame(data, "id bigint, codes array<bigint>")
    query = F.col("id").isin(2, 3, 6)
    each = {r["id"]: r for r in audio.linked(prints, query).collect()}
    assert set(each) == set(rows)
    least = {i: r["class_id"] for i, r in each.items()}
    assert least[1] == least[2] == least[None] == 1 and each[2]["n_members"] == 3 and least[8] is None and least[9] is None
    links = {}
    for r in audio.align(prints, query).collect():
        a, b = least[r["id"]], r["match"]
        if a != b:
            for x, y, shift in ((a, b, r["shift"]), (b, a, -r["shift"])):
                links.setdefault(x, {})[y] = min(links.get(x, {}).get(y, (9, 0)), (r["bit_errors"], shift))
    assert set(links[1]) == {3, 4, *range(20, 28)} and set(links[6]) == {5} and 7 not in links
    for i, r in each.items():
        own = links.get(least[i], {})
        assert r["n_links"] == len(own) and r["links_crc"] == sum(zlib.crc32(f"{m}:{shift}".encode()) for m, (_, shift) in own.items())
        best = min(((e, m, shift) for m, (e, shift) in own.items()), default=(None, None, None))
        assert (r["bit_errors"], r["match"], r["shift"]) == best
    assert audio.linked(prints.limit(0), query).count() == 0


def test_recordings_align(spark):
    rng = np.random.default_rng(1)
    song, other = tune(rng, 60), tune(rng, 60)
    shift = 20 * audio.HOP
    noisy = np.clip(song[shift:] + rng.normal(0, 0.005, len(song) - shift), -1, 1)
    rows = [(1, audio.wav(song, 8000)), (2, audio.wav(song, 8000)), (3, audio.wav(noisy, 8000)), (4, audio.wav(other, 8000)), (5, None), (6, b"no sound"), (7, audio.wav(song[:500], 8000))]
    prints = audio.fingerprints(spark.createDataFrame([(i, bytearray(w) if w is not None else None) for i, w in rows], "id bigint, wav binary"), "id", "wav")
    assert {r["id"] for r in prints.where(F.size("codes") == 0).collect()} == {5, 6, 7}
    found = {(r["id"], r["match"]): r for r in audio.align(prints, F.col("id") == 3).collect()}
    assert set(found) == {(3, 3), (3, 1)}
    assert found[3, 1]["n_members"] == 2 and found[3, 1]["shift"] == -20 and found[3, 1]["bit_errors"] < 0.2
    assert found[3, 3]["shift"] == 0 and found[3, 3]["bit_errors"] == 0


def test_recordings_made_where_they_are_fingerprinted(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, None if i == 3 else [None if i == 4 and k % 9 == 0 else float(v) for k, v in enumerate(rng.uniform(-1.2, 1.2, 64))]) for i in range(12)]
    prints = audio.fingerprints(spark.createDataFrame(vectors, "id bigint, v array<float>"), "id", "v", audio.melody)
    played = [(i, None if v is None else bytearray(audio.melody([None if x is None else float(np.float32(x)) for x in v]))) for i, v in vectors]
    stored = audio.fingerprints(spark.createDataFrame(played, "id bigint, wav binary"), "id", "wav")
    assert sorted(map(tuple, prints.collect())) == sorted(map(tuple, stored.collect()))
    plan = prints._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "binary" not in plan  # no recording passes through Spark


def test_integral_filters_equal_plain_sums():
    frames = np.random.default_rng(2).random((40, 12))
    codes = audio.fingerprint(frames)
    for at in (0, 7, 24):
        code = 0
        for kind, k, height, t, width in audio.FILTERS:
            block = frames[at + t : at + t + width, k : k + height]
            if kind == 0:
                part = block[: width // 2].sum()
            elif kind == 1:
                part = block[:, : height // 2].sum()
            elif kind == 2:
                third = width // 3
                part = block[third : width - third].sum() * width / (2 * (width - 2 * third))
            else:
                part = block[: width // 2, : height // 2].sum() + block[width // 2 :, height // 2 :].sum()
            level = np.searchsorted(audio.LEVELS, (2 * part - block.sum()) / block.sum())
            code = code << 2 | (0, 1, 3, 2)[level]
        assert codes[at] == code


# --- the pipeline

def test_pipeline_stage_by_stage(spark, sf_dir):
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, outputs = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        outputs.append(docs.collect())
        if name != "byte_bpe":
            assert docs.columns == columns
    start, good, single, short, mixed, encoded = outputs

    assert {r["doc_id"] for r in good} <= {r["doc_id"] for r in start if not counts(r["text"])[-1]}
    pairs = [(r["doc_id"], r["text"]) for r in good]
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, c in groups(pairs, 5, 80)})
    left = {r["doc_id"]: w[3].decode("utf-8", "ignore") for r, w in zip(single, cut([r["text"] for r in single], 200), strict=True)}
    assert {r["doc_id"]: r["text"] for r in short} == left
    assert all(r["n_chars"] == len(r["text"]) for r in short)

    size = {i: SEPARATED.findall(t) for i, t in left.items()}
    taken = {}
    for r in mixed:
        own = SEPARATED.findall(r["text"])
        assert own == size[r["doc_id"]][: len(own)] and r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(own)
    assert all(n <= 2 * len(size[i]) for i, n in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(map(len, size.values())), abs=8)

    bpe = tokenizer(RANKS)
    assert sorted((r["doc_id"], r["n_tokens"], bpe.decode(r["ids"]).decode(), r["round_trip"]) for r in encoded) == sorted((r["doc_id"], len(bpe.encode(r["text"])), r["text"], True) for r in mixed)


def test_pipeline_of_hard_rows(hard, spark, tmp_path):
    """Nulls, repeated rows and further columns pass through all stages; so does an empty table."""
    docs = hard
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() > 0
    docs = hard.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
