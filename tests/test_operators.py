"""Hand-computed expectations of the movie operators."""

import numpy as np
import pytest

from cinevox.operators import detect, matching, network, points, regions, resample, spacing
from cinevox.operators.config import Config, extend_catnames, parse_classes, parse_diameter, parse_oversample

POINT = "movie_id int, roi_idx bigint, t int, y int, x int"


def spots(spark, *places):
    return spark.createDataFrame([(1, i, *p) for i, p in enumerate(places)], POINT)


def test_config():
    config = Config()
    assert config.bounds == (1, 2, 6, 6) and config.window_shape == (10, 45, 45)
    assert Config.from_json(config.to_json()) == config
    old = Config.from_legacy("nb_temporal_frames = [4, 6] # frames\nwindow_half_size = (20, 20)\nother = 3\n")
    assert (old.nframes, old.half_size) == ((4, 6), (20, 20)) and not old.compatible(config)


def test_options():
    assert extend_catnames(["", "_a.zip"], ["", "_a.zip", "_b.zip"]) == ("", "_a.zip", "_b.zip")
    for new in (["", "_b.zip"], ["", "_a.zip", "_a.zip"]):
        with pytest.raises(ValueError):
            extend_catnames(["", "_a.zip"], new)
    assert parse_oversample(["a=b=2"]) == {"a=b": 2} and parse_classes(["a=_b=c.zip"]) == {"a": "_b=c.zip"}
    for bad in (["a=0"], ["=3"], ["a=2.5"]):
        with pytest.raises(ValueError):
            parse_oversample(bad)
    assert parse_diameter("auto") == "auto" and parse_diameter("25") == 25
    for bad in ("0", "nan", "x"):
        with pytest.raises(ValueError):
            parse_diameter(bad)


def test_matching(spark):
    truth = spots(spark, (10, 50, 50), (30, 80, 80))
    found = spots(spark, (11, 52, 49), (11, 52, 49), (60, 5, 5))
    row = matching.compare(found, truth, 15, 4).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 2, 1)
    assert sorted((r["t"], r["y"], r["x"]) for r in matching.false_positives(found, truth).collect()) == [(11, 52, 49), (60, 5, 5)]
    assert [(r["t"], r["y"], r["x"]) for r in matching.false_negatives(found, truth).collect()] == [(30, 80, 80)]
    none = matching.compare(found.limit(0), truth).first()
    assert (none["precision"], none["recall"], none["fn"]) == (0, 0, 2)


def test_matching_equals_a_plain_loop(spark):
    rng = np.random.default_rng(11)
    for n, m in ((0, 5), (3, 1), (9, 12), (20, 30)):
        d, g = (np.stack([rng.integers(0, k, size) for k in (20, 40, 40)], 1).tolist() for size in (n, m))
        taken, want = set(), []
        for p in d:
            near = [(np.hypot(p[1] - q[1], p[2] - q[2]) + abs(p[0] - q[0]), j) for j, q in enumerate(g) if j not in taken and abs(p[0] - q[0]) <= 4 and np.hypot(p[1] - q[1], p[2] - q[2]) <= 15]
            want.append(min(near)[1] if near else None)
            taken.add(want[-1])
        got = matching.matches(spots(spark, *map(tuple, d)), spots(spark, *map(tuple, g))).collect()
        assert [r["match"] for r in sorted(got, key=lambda r: r["roi_idx"])] == want


def _plain_matches(detected, truth, dxy=15, dt=4):
    """Detections in order against a grid of annotations: the nearest that is free."""
    cells = {}
    for g, q in enumerate(truth):
        cells.setdefault((q[0] // 20, q[1] // 20, q[2] // 20), []).append(g)
    taken, out = set(), []
    for p in detected:
        around = [g for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for g in cells.get((p[0] // 20 + a, p[1] // 20 + b, p[2] // 20 + c), [])]
        off = {g: np.hypot(p[1] - truth[g][1], p[2] - truth[g][2]) for g in around if g not in taken}
        near = [(o + abs(p[0] - truth[g][0]), g) for g, o in off.items() if o <= dxy and abs(p[0] - truth[g][0]) <= dt]
        out.append(min(near)[1] if near else None)
        taken.add(out[-1])
    return out


@pytest.mark.parametrize("shape, share", [("cloud", 60), ("one place", 60), ("chain", 20_000), ("dense", 1 << 17)])
def test_matching_in_shares(spark, shape, share):
    """Shares of every size give the sequential result: borders, points on one spot, a chain in which each match decides the next, one component of 100,000 pairs."""
    rng = np.random.default_rng(4)
    if shape == "cloud":
        d, g = (np.stack([rng.integers(0, k, 400) for k in (30, 120, 120)], 1).tolist() for _ in "dg")
    elif shape == "one place":
        d, g = [[3, 9, 9]] * 40, [[3, 9, 9 + i % 2] for i in range(30)]
    elif shape == "chain":
        d, g = [[0, 0, 10 * i] for i in range(25_000)], [[0, 0, 10 * i + 4] for i in range(-1, 25_000)]
    else:
        d, g = (np.stack([rng.integers(0, 30, 5600), rng.integers(0, 180, 5600), rng.integers(0, 180, 5600)], 1).tolist() for _ in "dg")
    rows = [(0, i, *p) for i, p in enumerate(d)], [(0, i, *p) for i, p in enumerate(g)]
    kind = "movie_id int, roi_idx int, t int, y int, x int"
    sides = [spark.createDataFrame(r, kind) for r in rows]
    if shape == "dense":
        assert matching.near_pairs(*sides, 15, 4).count() > 100_000
    got = {r["roi_idx"]: r["match"] for r in matching.matches(*sides, share=share).collect()}
    assert [got[i] for i in range(len(d))] == _plain_matches(d, g)


def test_points(spark):
    raw = spark.createDataFrame([(1, 5.4, 10.6, 20.2), (1, 5.4, 10.6, 20.2), (1, 0.0, 3.0, 4.0), (1, 999.0, -3.2, 130.7)], "movie_id int, t double, y double, x double")
    movie = spark.createDataFrame([(1, 36, 128, 128)], "movie_id int, n_frames int, h int, w int")
    assert sorted(tuple(r)[1:] for r in points.clean(raw, movie).collect()) == [(0, 3, 4), (5, 11, 20), (35, 0, 127)]
    sizes = "movie_id int, n_frames int, h int, w int, new_frames int, new_h int, new_w int"
    for place, size, want in (((39, 199, 299), (40, 200, 300, 40, 100, 150), (39, 99, 149)), ((20, 100, 150), (41, 201, 301, 21, 101, 151), (10, 50, 75)), ((3, 0, 9), (40, 1, 300, 40, 9, 1), (3, 0, 0))):
        got = points.prepare(spots(spark, place), spark.createDataFrame([(1, *size)], sizes)).first()
        assert (got["t"], got["y"], got["x"]) == want
    forty = spark.createDataFrame([(1, 40)], "movie_id int, n_frames int")
    once = points.reverse(spots(spark, (0, 3, 4), (12, 30, 41)), forty)
    assert sorted(r["t"] for r in once.collect()) == [27, 39]
    assert sorted(r["t"] for r in points.reverse(once, forty).collect()) == [0, 12]


def test_normalisation():
    ramp = np.linspace(7, 707, 90).reshape(1, 10, 3, 3)
    out = detect.normalise(ramp)
    assert out.min() == 0 and out.max() == 255
    assert not detect.normalise(np.full((1, 10, 3, 3), 9.0)).any()


def test_division_of_sums(spark):
    config = Config(half_size=(4, 4), nframes=(2, 2), ncat=2)
    sums = spark.createDataFrame([(1, 1, 4, 0, 0, 1.0, 2)], "movie_id int, cat int, t int, y int, x int, total double, n bigint")
    movie = spark.createDataFrame([(1, 4, 2, 2)], "movie_id int, n_frames int, h int, w int")
    got = {(r["t"], r["y"], r["x"]): r["p8"] for r in detect.divide(sums, movie, config, 1).collect()}
    assert len(got) == 16 and got.pop((2, 0, 0)) == 127 and not any(got.values())


def test_image_kernels(spark):
    rng = np.random.default_rng(5)
    mask = rng.random((4, 7, 6)) < 0.7
    places = np.argwhere(~mask)
    voxels = spark.createDataFrame([(1, *map(int, p), int(mask[tuple(p)])) for p in np.ndindex(mask.shape)], "movie_id int, t int, y int, x int, b int")
    far = {(r["t"], r["y"], r["x"]): r["d2"] for r in regions.edt(voxels, ["movie_id"]).collect()}
    assert far == {tuple(map(int, p)): ((places - p) ** 2).sum(1).min() for p in np.argwhere(mask)}
    labelled = {(r["t"], r["y"], r["x"]) for r in regions.label(voxels.where("b = 1"), ["movie_id"]).collect()}
    assert labelled == far.keys()
    block = np.zeros((12, 24, 24), int)
    block[3:8, 3:10, 3:10] = 200
    block[3:8, 14:21, 14:21] = 220
    maps = spark.createDataFrame([(1, 1, *map(int, p), int(block[p])) for p in np.ndindex(block.shape)], "movie_id int, cat int, t int, y int, x int, p8 int")
    found = {(r["t"], r["y"], r["x"]): r["label"] for r in regions.watershed_regions(maps, 3, 5).collect()}
    assert set(found.values()) == {1, 2} and all(block[p] for p in found)
    assert found[5, 6, 6] != found[5, 17, 17]


def test_resampling_and_frame_picks(spark):
    for order in (0, 1, 3):
        assert np.allclose(resample.matrix(9, 9, order), np.eye(9)) and np.allclose(resample.matrix(9, 14, order).sum(1), 1)
    assert np.allclose(resample.matrix(5, 9, 1) @ np.arange(5.0), np.linspace(0, 4, 9))
    movie = spark.createDataFrame([(1, 6)], "movie_id int, n_frames int")
    assert sorted(r["t"] for r in spacing.frame_picks(movie, 4).collect()) == [0, 1, 3, 5]


def test_network():
    weights = network.init(4, 2)
    again = network.loads(network.dumps(weights))
    assert all(np.array_equal(weights[k], again[k]) for k in weights)
    windows = np.random.default_rng(1).random((3, 4, 17, 17))
    p = network.softmax(network.logits(windows, weights))
    assert p.shape == (3, 4) and np.allclose(p.sum(1), 1)
    wider = network.with_extra_classes(weights, 6)
    assert np.allclose(network.logits(windows, wider)[:, :4], network.logits(windows, weights))
    assert all(k.startswith(("gru", "fc", "out")) for k in network.trainable(weights, True))
    kernel = np.arange(12.0).reshape(2, 6)
    gates = network.gru_from_zrh(kernel, np.ones((2, 6)), np.ones((2, 6)))
    assert gates["gru.weight_ih_l0"].T.tolist() == kernel[:, [2, 3, 0, 1, 4, 5]].tolist()
