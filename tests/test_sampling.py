"""Sampling takes every point and fills its quotas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinevox.operators import sampling
from cinevox.operators.config import Config
from cinevox.plans.queries import QUERIES

SMALL = Config(half_size=(4, 4), nframes=(5, 5), ncat=3)
ROI = "movie_id int, cat int, roi_idx bigint, t int, y int, x int"


@pytest.fixture(scope="module")
def high_dir(spark, tmp_path_factory):
    """200 events of users 0 to 1592, in one movie."""
    path = str(tmp_path_factory.mktemp("high"))
    rows = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") * 8).alias("user_id"), F.lit("click").alias("event_type"), F.expr("timestamp_seconds(19723 * 86400 + (id % 30) * 86400)").alias("ts"))
    rows.write.parquet(f"{path}/events.parquet")
    return path


def test_points_of_every_height_are_sampled(spark, high_dir):
    assert sorted((r["cat"], r["n"]) for r in QUERIES["class_balance"](spark, high_dir).collect()) == [(1, 160), (2, 40)]
    assert sum(r["val"] + r["train"] for r in QUERIES["split_leakage"](spark, high_dir).collect()) == 200
    for name in ("sample_rois", "oversample"):
        own = QUERIES[name](spark, high_dir).where("not noisy").agg(F.max("y"), F.count("*")).first()
        assert own[0] > 1500 and own[1] > 100
    assert QUERIES["sample_nothing"](spark, high_dir).agg(F.max("y")).first()[0] > 1500


def test_rare_clear_places_fill_the_quota_of_nothing(spark):
    places = [(t, y, x) for t in range(5, 30, 5) for y in range(0, 60, 5) for x in range(0, 60, 5) if y > 10 or x > 10]
    movie = spark.createDataFrame([(1, 30, 60, 60)], "movie_id int, n_frames int, h int, w int")
    got = sampling.sample_nothing(spark.createDataFrame([(1, 1, i, *p) for i, p in enumerate(places)], ROI), movie, SMALL).collect()
    assert len(got) == len({r["seq"] for r in got}) == -(-len(places) * 6 // 5)
    for t, y, x in {(r["t"], r["y"], r["x"]) for r in got}:
        assert not any(t - 5 <= a <= t + 5 and y - 4 <= b <= y + 5 and x - 4 < c < x + 5 for a, b, c in places)


def test_free_places_are_those_of_a_plain_list(spark, monkeypatch):
    """Blocks of every kind, a movie without a free place, one too small, equal points, many draws; every free place can be drawn."""
    monkeypatch.setattr(sampling, "DRAWS", 50)
    rng = np.random.default_rng(7)
    config = Config(half_size=(2, 3), nframes=(2, 1), ncat=3)
    movies = {1: (9, 40, 50), 2: (4, 8, 60), 3: (9, 5, 5), 4: (2, 30, 30)}
    places = {m: [tuple(int(v) for v in rng.integers(0, size)) for _ in range(n)] for (m, size), n in zip(movies.items(), (60, 3000, 4, 4), strict=True)}
    places[1] += places[1][:20]
    rois = spark.createDataFrame([(m, 1, i, *p) for m, own in places.items() for i, p in enumerate(own)], ROI)
    sizes = spark.createDataFrame([(m, *size) for m, size in movies.items()], "movie_id int, n_frames int, h int, w int")
    free = {m: set() for m in movies}
    for m, (n, h, w) in movies.items():
        for t, y, x in np.ndindex(n, h, w):
            fits = t >= 2 and t + 1 <= n and y >= 2 and y + 3 <= h and x >= 3 and x + 4 <= w
            if fits and not any(t - 2 <= a <= t + 1 and y - 2 <= b <= y + 3 and x - 3 < c < x + 4 for a, b, c in places[m]):
                free[m].add((t, y, x))
    found = {m: 0 for m in movies}
    for r in sampling.free_blocks(rois, sizes, config).collect():
        found[r["movie_id"]] += r["n"]
    assert found == {m: len(own) for m, own in free.items()} and 0 < found[1] < 9 * 40 * 50
    got = sampling.sample_nothing(rois, sizes, config, naug=40).collect()
    drawn = {m: [(r["t"], r["y"], r["x"]) for r in got if r["movie_id"] == m] for m in movies}
    assert all(len(drawn[m]) == (-(-len(places[m]) * 48 * 1) if free[m] else 0) for m in movies)
    assert all(set(drawn[m]) <= free[m] for m in movies) and len(set(drawn[1])) > 0.9 * min(len(free[1]), len(drawn[1])) * (1 - np.exp(-1))


def test_rare_fitting_points_fill_the_quota_of_copies(spark):
    rois = spark.createDataFrame([(1, 1, i, 15, 30 if i == 0 else 0, 30) for i in range(100)], ROI)
    movie = spark.createDataFrame([(1, 30, 60, 60)], "movie_id int, n_frames int, h int, w int")
    assert sampling.sample_points(rois, movie, SMALL).where("noisy").count() == 100
    none = sampling.sample_points(rois.where("y = 0").limit(3), movie, SMALL)
    assert none.count() == 0


def test_draws_of_nothing_are_never_broadcast(spark):
    """The draws start from one row for each movie, so their size is underrated; they and the ranges they meet are as long as the quotas."""
    rois = spark.createDataFrame([(1, 1, i, i % 30, i % 10, 30) for i in range(2000)], ROI)
    movie = spark.createDataFrame([(1, 30, 600, 60)], "movie_id int, n_frames int, h int, w int")
    got = sampling.sample_nothing(rois, movie, SMALL)
    assert len(got.collect()) == 2400
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "range#" in line]
    assert joins and not any("Broadcast" in line for line in joins)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_few_more_copies_are_proposed_than_wanted(spark, monkeypatch, chunk):
    monkeypatch.setattr(sampling, "CHUNK", chunk)
    written = {}
    save = sampling.Scratch.save

    def counting(self, df, name):
        out = save(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(sampling.Scratch, "save", counting)
    rois = spark.createDataFrame([(1, 1, i, 15, 30, 30) for i in range(100)], ROI)
    movie = spark.createDataFrame([(1, 30, 60, 60)], "movie_id int, n_frames int, h int, w int")
    got = sampling.sample_points(rois, movie, SMALL, 3).where("noisy").collect()
    assert sorted(r["seq"] - 1000000000 for r in got) == list(range(1, 301))
    assert sum(n for name, n in written.items() if name.startswith("fit")) <= 600
