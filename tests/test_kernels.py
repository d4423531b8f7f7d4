"""Kernels against plain versions that go voxel by voxel."""

import math
import time
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinevox.operators import augment, jobs, points, quantiles, regions, resample, sampling, spacing
from cinevox.operators.config import Config
from cinevox.functions.scalar import stem

SMALL = Config(half_size=(4, 4), nframes=(5, 5), ncat=3)


class Script:
    """Draws that are written down: ``random`` in order, then 1; the others by name."""

    def __init__(self, randoms, **others):
        self.randoms, self.others = list(randoms), others

    def random(self):
        return self.randoms.pop(0) if self.randoms else 1.0

    def __getattr__(self, name):
        return lambda *args: self.others[name]


def plain_blur(cube, sigma):
    reach = int(max(4 * sigma, 0.5) + 0.5)
    share = {i: 0.5 * (math.erf((i + 0.5) / sigma / math.sqrt(2)) - math.erf((i - 0.5) / sigma / math.sqrt(2))) for i in range(-reach, reach + 1)}
    out = np.zeros(cube.shape)
    for p in np.ndindex(cube.shape):
        for q in np.ndindex(cube.shape):
            steps = [b - a for a, b in zip(p, q, strict=True)]
            if all(abs(s) <= reach for s in steps):
                out[p] += cube[q] * math.prod(share[s] for s in steps)
    return out


def plain_gamma(values, power):
    low, high = min(values.ravel()), max(values.ravel())
    return np.array([low + (high - low) * ((v - low) / (high - low)) ** power for v in values.ravel()]).reshape(values.shape)


def test_each_augmentation():
    cube = np.random.default_rng(1).random((3, 6, 5)) * 200
    run = lambda *args, **kw: augment.augment(cube, Script(args, **kw))
    assert np.array_equal(run(), cube)
    assert np.allclose(run(0.24, uniform=0.7), plain_gamma(cube, 0.7))
    dark = run(1, 0.29, 0.5, integers=2)
    assert np.array_equal(dark[:2], cube[:2]) and np.allclose(dark[2], plain_gamma(cube[2], 0.75))
    assert np.allclose(run(1, 1, 0.24, 0.6), plain_blur(cube, 0.9))
    drawn = np.random.default_rng(2).normal(0, 1, cube.shape)
    assert np.allclose(run(1, 1, 1, 0.39, 0.4, normal=drawn), cube + plain_blur(drawn, 0.6))
    square = np.zeros(cube.shape, bool)
    square[:, 2:4, 2:4] = True
    assert np.array_equal(run(1, 1, 1, 1, 0.14, integers=2), np.where(square, 0, cube))
    assert np.array_equal(run(1, 1, 1, 1, 1, 0.14, integers=2), np.where(square, cube + 1, cube))
    assert np.allclose(run(1, 1, 0.1, 0.0), cube)  # the least sigma is no blur
    assert np.array_equal(augment.gamma(np.full((1, 2, 2), 3.0), 0.5), np.full((1, 2, 2), 3.0))


def test_noise_is_for_noisy_windows_and_not_of_the_layout(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 2, 4, 4, i % 2 == 0, (rng.random(32) * 100).tolist()) for i in range(40)]
    windows = spark.createDataFrame(rows, "win_id bigint, n int, h int, w int, noisy boolean, cube array<double>")
    one, many = ({r["win_id"]: r["cube"] for r in augment.noise(windows.repartition(n), 7).collect()} for n in (1, 5))
    assert one == many and all(one[r[0]] == r[5] for r in rows if not r[4])
    for r in rows:
        if r[4]:
            assert np.allclose(one[r[0]], augment.augment(np.array(r[5]).reshape(2, 4, 4), np.random.default_rng([7, r[0]])).ravel())
    assert any(one[r[0]] != r[5] for r in rows if r[4])


def test_distance_equals_all_pairs(spark):
    rng = np.random.default_rng(9)
    blocks = {1: rng.random((5, 6, 7)) < 0.95, 2: np.ones((4, 3, 3), bool), 3: np.ones((9, 2, 2), bool), 4: np.zeros((2, 2, 2), bool), 5: rng.random((2, 3, 12)) < 0.6}
    blocks[3][8, 1, 1] = False
    rows = [(m, *(int(v) for v in p), int(b[p])) for m, b in blocks.items() for p in np.ndindex(b.shape)]
    got = {tuple(r)[:4]: r["d2"] for r in regions.edt(spark.createDataFrame(rows, "movie_id int, t int, y int, x int, b int"), ["movie_id"]).collect()}
    want = {(m, *p): min(sum((a - c) ** 2 for a, c in zip(p, q, strict=True)) for q in map(tuple, np.argwhere(~b))) for m, b in blocks.items() if not b.all() for p in map(tuple, np.argwhere(b))}
    assert got == want


def mirrored(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def plain_smooth(image, sigma):
    n, reach = len(image), int(4 * sigma + 0.5)
    weight = np.array([math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)])
    line = np.zeros((n, n))
    for i in range(n):
        for k in range(-reach, reach + 1):
            line[i, mirrored(i + k, n)] += weight[k + reach] / weight.sum()
    return line @ image @ line.T


def plain_spacing(tile, sigma, prominence):
    n = len(tile)
    valid = (tile != 0).astype(float)
    taper = np.array([[(0.5 - 0.5 * math.cos(2 * math.pi * y / (n - 1))) * (0.5 - 0.5 * math.cos(2 * math.pi * x / (n - 1))) for x in range(n)] for y in range(n)])
    high = (tile - plain_smooth(tile * valid, sigma) / np.maximum(plain_smooth(valid, sigma), 1e-3)) * valid * taper

    def shifted(a, dy, dx):
        return sum(a[y, x] * a[y + dy, x + dx] for y in range(max(0, -dy), n - max(0, dy)) for x in range(max(0, -dx), n - max(0, dx)))

    rings = {}
    for dy, dx in product(range(-(n // 2) - 1, n // 2 + 2), repeat=2):
        if (r := round(math.hypot(dy, dx))) <= n // 2:
            rings.setdefault(r, []).append(shifted(high, dy, dx) / max(0.25, shifted(taper, dy, dx) / (taper**2).sum()))
    profile = [np.mean(rings[r]) for r in range(n // 2 + 1)]
    return plain_peak([v / profile[2] for v in profile], prominence) if profile[2] > 0 else math.nan


def plain_peak(profile, prominence):
    p = [sum(profile[max(0, i - 1) : i + 2]) / 3 for i in range(len(profile))]
    lowest = None
    for i in range(2, len(p) - 1):
        if lowest is None:
            lowest = p[i] if p[i] < p[i - 1] and p[i] <= p[i + 1] else None
            continue
        lowest = min(lowest, p[i])
        if p[i - 1] < p[i] >= p[i + 1] and p[i] - lowest >= prominence:
            top = np.polyfit([-1, 0, 1], p[i - 1 : i + 2], 2)
            return i + (min(0.5, max(-0.5, -top[1] / (2 * top[0]))) if top[0] else 0)
    return math.nan


def test_first_peak_equals_a_plain_walk():
    rng = np.random.default_rng(4)
    found = 0
    for n in (5, 9, 30):
        for _ in range(200):
            profile = rng.random(n)
            got, want = spacing.first_peak(profile, 0.15), plain_peak(list(profile), 0.15)
            assert got == pytest.approx(want, nan_ok=True)
            found += not math.isnan(got)
    assert found > 100 and math.isnan(spacing.first_peak(np.linspace(1, 0, 9), 0.1))


def test_tile_spacing_equals_sums_without_transforms():
    rng = np.random.default_rng(5)
    y, x = np.indices((24, 24))
    tiles = [rng.random((24, 24)) + 0.5, 3 + np.cos(2 * np.pi * y / 8) + np.cos(2 * np.pi * x / 8) + rng.random((24, 24)) / 5]
    tiles.append(np.where(rng.random((24, 24)) < 0.05, 0, tiles[1]))
    got = [spacing.tile_spacing(t, 6.0, 0.05) for t in tiles]
    assert got == pytest.approx([plain_spacing(t, 6.0, 0.05) for t in tiles], nan_ok=True)
    assert abs(got[1] - 8) < 1.2


def test_cubic_zoom_goes_through_its_pixels_and_is_a_spline():
    rng = np.random.default_rng(6)
    for n, m in ((2, 5), (6, 11), (7, 4)):
        line = rng.random(n)
        around = np.concatenate([line, line[-2:0:-1]])  # one period of the mirrored line
        ring = np.zeros(len(around))
        for shift, weight in ((0, 4 / 6), (1, 1 / 6), (-1, 1 / 6)):
            ring[shift] += weight
        c = np.real(np.fft.ifft(np.fft.fft(around) / np.fft.fft(ring)))
        want = []
        for at in np.arange(m) * (n - 1) / (m - 1):
            i = math.floor(at)
            u = at - i
            parts = ((1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3)
            want.append(sum(w * c[(i - 1 + k) % len(c)] for k, w in enumerate(parts)) / 6)
        assert np.allclose(resample.matrix(n, m, 3) @ line, want)
        assert np.allclose((resample.matrix(n, 2 * n - 1, 3) @ line)[::2], line)


@pytest.mark.parametrize(("frames", "pixels"), [(128, 1 << 16), (7, 5)])
def test_time_is_resized_in_runs_and_strips(spark, monkeypatch, frames, pixels):
    """As by the matrix over the whole movie, at the ends and between runs too."""
    monkeypatch.setattr(resample, "FRAMES", frames)
    monkeypatch.setattr(resample, "PIXELS", pixels)
    plans = [(90, 41), (41, 90), (1, 4), (5, 1), (2, 9), (150, 150), (3, 0)]
    stacks = [np.random.default_rng(n).random((n, 3, 4)) for n, _ in plans]
    images = spark.createDataFrame([(m, t, 3, 4, page.ravel().tolist()) for m, stack in enumerate(stacks) for t, page in enumerate(stack)], "movie_id int, t int, h int, w int, pixels array<double>").repartition(2).cache()
    sizes = spark.createDataFrame([(m, *plan) for m, plan in enumerate(plans)], "movie_id int, n_frames int, new_frames int")
    for order in (1, 3) if frames == 7 else (0, 3):
        got = {(r["movie_id"], r["t"]): r for r in resample.resize_time(images, sizes, order).collect()}
        assert sorted(got) == [(m, t) for m, (_, new) in enumerate(plans) for t in range(new)]
        for m, (n, new) in enumerate(plans):
            want = resample.matrix(n, new, order) @ stacks[m].reshape(n, 12) if new else []
            assert all((r["h"], r["w"]) == (3, 4) and np.allclose(r["pixels"], w, atol=1e-9) for w, r in zip(want, (got[m, t] for t in range(new)), strict=True))


@pytest.mark.parametrize("limit", [1 << 16, 200])
def test_quantiles_equal_sorting(spark, limit):
    """Ties, one value only, nulls and values that are not finite, wide and narrow ranges, groups above and below the limit."""
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(0, 1, 700), "ties": rng.integers(0, 3, 500).astype(float), "one": np.full(300, 7.5), "wide": 10.0 ** rng.integers(-300, 300, 400) * rng.choice([-1, 1], 400),
        "largest": np.array([-1.7e308, 1.7e308] * 60 + [0.0, 1.0]), "short": np.array([3.0, 1.0]), "none": np.zeros(0),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("none", None), ("ties", None), ("ties", math.nan), ("short", math.inf)]
    at = {"low": 0.01, "median": 0.5, "q75": 0.75, "high": 0.998, "last": 1.0}
    got = {r["g"]: [r[c] for c in at] for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", at, limit).collect()}
    assert set(got) == {k for k, v in groups.items() if len(v)}
    for k, found in got.items():
        values = np.sort(groups[k])
        for p, value in zip(at.values(), found, strict=True):
            place = p * (len(values) - 1)
            low, high = values[math.floor(place)], values[math.ceil(place)]
            assert value == pytest.approx(low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high, rel=1e-12)


def test_bounds_of_large_windows_are_sought_once(spark):
    """With the bounds sought for each value, one window of 65,610 values takes minutes."""
    config = Config(half_size=(40, 40), nframes=(5, 5), ncat=3)
    pixels = np.random.default_rng(3).integers(0, 5000, (10, 81, 81))
    frames = spark.createDataFrame([(1, t, 81, 81, p.ravel().tolist()) for t, p in enumerate(pixels)], "movie_id int, t int, h int, w int, pixels array<int>")
    began = time.monotonic()
    cube = jobs.sample_windows(spark.createDataFrame([(1, 5, 40, 40)], "movie_id int, t int, y int, x int"), frames, config).first()["cube"]
    assert time.monotonic() - began < 30
    whole = np.floor((pixels - pixels.min()) / (pixels.max() - pixels.min()) * 255)
    assert np.array_equal(np.array(cube), (whole / 255).ravel())


def test_training_windows_are_turned_over_and_then_made_noisy(spark, monkeypatch):
    """Flips come first and for all of the training side, noise for noisy ones, nothing for validation; neither depends on the layout."""
    config = Config(half_size=(1, 2), nframes=(1, 1), ncat=3)
    cube = np.arange(30.0).reshape(2, 3, 5)
    rows = [(1, 0, k, 5, 5, 5, 1, k % 2 == 0, "val" if k % 3 == 0 else "train", cube.ravel().tolist()) for k in range(120)]
    windows = spark.createDataFrame(rows, "movie_id int, rep int, seq bigint, t int, y int, x int, cat int, noisy boolean, split string, cube array<double>")
    got = {r["seq"]: np.array(r["cube"]).reshape(cube.shape) for r in augment.train_transforms(windows.repartition(3), config).collect()}
    turned = [cube, cube[:, ::-1], cube[:, :, ::-1], cube[:, ::-1, ::-1]]
    kinds = [0] * 4
    for _, _, k, *_, noisy, side, _ in rows:
        same = [np.array_equal(got[k], t) for t in turned]
        if side == "val":
            assert same[0]
        elif not noisy:
            assert sum(same) == 1
            kinds[same.index(True)] += 1
    assert min(kinds) > 0 and kinds[0] == max(kinds)
    changed = [k for _, _, k, *_, noisy, side, _ in rows if noisy and side == "train" and not any(np.array_equal(got[k], t) for t in turned)]
    assert len(changed) > 10
    again = {r["seq"]: np.array(r["cube"]).reshape(cube.shape) for r in augment.train_transforms(windows.coalesce(1), config).collect()}
    assert all(np.array_equal(got[k], again[k]) for k in got)
    other = {r["seq"]: np.array(r["cube"]).reshape(cube.shape) for r in augment.train_transforms(windows, config, epoch=1).collect()}
    assert any(not np.array_equal(got[k], other[k]) for k in got)
    plain = {r["seq"]: np.array(r["cube"]).reshape(cube.shape) for r in augment.train_transforms(windows, config, noise=False).collect()}
    assert all(any(np.array_equal(v, t) for t in turned) for v in plain.values())
    script = Script([0.0, 1.0] + [1.0] * 4 + [0.0, 1.0], integers=1)  # one flip, then only the black square
    want = cube[:, ::-1].copy()
    want[:, 1:2, 1:2] = 0
    assert np.array_equal(augment.transformed(cube, True, script), want)


def plain_regions(p8, dt, dxy, level):
    """Labels of one dense block, by sets of voxels."""
    inside = lambda p: all(0 <= a < n for a, n in zip(p, p8.shape, strict=True))
    bright = {p for p in np.ndindex(p8.shape) if p8[p] > level}
    mask = {(t, y, x) for t, y, x in bright if all((t, max(0, y - a), max(0, x - b)) in bright for a in (0, 1) for b in (0, 1))}
    rest = [p for p in np.ndindex(p8.shape) if p not in mask]
    far = {p: math.sqrt(min(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in rest)) if p in mask else 0.0 for p in np.ndindex(p8.shape)}
    near = lambda p, steps: [q for s in steps if inside(q := tuple(a + b for a, b in zip(p, s, strict=True)))]
    cube = [s for s in product((-1, 0, 1), repeat=3) if any(s)]
    faces = [s for s in cube if sum(map(abs, s)) == 1]

    def grown(start, steps, same):
        seen, todo = {start}, [start]
        while todo:
            for q in near(todo.pop(), steps):
                if q not in seen and same(q):
                    seen.add(q)
                    todo.append(q)
        return seen

    peaks = {p for p in mask if all(far[q] <= far[p] for r in grown(p, cube, lambda q: far[q] == far[p]) for q in near(r, cube))}
    spread = {(t + a, y + b, x + c) for t, y, x in peaks for a in range(-((dt - 1) // 2), dt // 2 + 1) for b in range(-((dxy - 1) // 2), dxy // 2 + 1) for c in range(-((dxy - 1) // 2), dxy // 2 + 1)}
    spread = {p for p in spread if inside(p)}
    label, n = {}, 0
    for p in sorted(spread):
        if p not in label:
            n += 1
            label |= dict.fromkeys(grown(p, faces, lambda q: q in spread), n)
    out = {p: label[p] for p in mask if p in label}
    waiting = [(-far[p], i, p) for i, p in enumerate(sorted(out))]
    turn = len(waiting)
    while waiting:
        waiting.remove(first := min(waiting))
        for q in near(first[2], sorted(faces)):
            if q in mask and q not in out:
                out[q] = out[first[2]]
                waiting.append((-far[q], turn, q))
                turn += 1
    return out


@pytest.mark.parametrize(("dt", "dxy"), [(3, 3), (1, 3)])
def test_watershed_regions_equal_sets_of_voxels(spark, dt, dxy):
    rng = np.random.default_rng(8)
    blocks = []
    for _ in range(3):
        block = np.zeros((7, 14, 14), int)
        for _ in range(4):
            t, y, x = rng.integers(0, 5), rng.integers(0, 9), rng.integers(0, 9)
            block[t : t + rng.integers(1, 4), y : y + rng.integers(3, 7), x : x + rng.integers(3, 7)] = rng.integers(130, 255)
        blocks.append(block)
    rows = [(m, 1, *p, int(b[p])) for m, b in enumerate(blocks) for p in map(lambda p: tuple(int(v) for v in p), np.ndindex(b.shape))]
    maps = spark.createDataFrame(rows, "movie_id int, cat int, t int, y int, x int, p8 int")
    found = {}
    for r in regions.watershed_regions(maps, dt, dxy).collect():
        found.setdefault((r["movie_id"], r["label"]), set()).add((r["t"], r["y"], r["x"]))
    want = {}
    for m, b in enumerate(blocks):
        for p, n in plain_regions(b, dt, dxy, regions.LEVEL).items():
            want.setdefault((m, n), set()).add(p)
    assert sorted((k[0], sorted(v)) for k, v in found.items()) == sorted((k[0], sorted(v)) for k, v in want.items())
    events = regions.watershed_events(maps, None, 5, 0, dt, dxy).collect()
    assert sorted((r["movie_id"], r["volume"], round(r["proba"], 6)) for r in events) == sorted(
        (m, len(v), round(float(np.mean([blocks[m][p] for p in v])), 6)) for (m, _), v in want.items() if len(v) > 5)


def components_of(values, steps):
    """Sets of equal neighbours, by first place in raster order."""
    seen, out = set(), []
    for p in sorted(values):
        if p not in seen:
            own, todo = {p}, [p]
            while todo:
                at = todo.pop()
                for s in steps:
                    q = tuple(a + b for a, b in zip(at, s, strict=True))
                    if q not in own and values.get(q) == values[p]:
                        own.add(q)
                        todo.append(q)
            seen |= own
            out.append(own)
    return out


@pytest.mark.parametrize("block", [{"t": 16, "y": 64, "x": 64}, {"t": 2, "y": 1, "x": 4}])
def test_components_and_plateaus_over_blocks(spark, monkeypatch, block):
    """A component that spans the movie, single voxels, plateaus that touch higher voxels in another block, a movie of one value."""
    monkeypatch.setattr(regions, "BLOCK", block)
    rng = np.random.default_rng(3)
    cube = [s for s in product((-1, 0, 1), repeat=3) if any(s)]
    faces = [s for s in cube if sum(map(abs, s)) == 1]
    movies = {0: {p: 1 for p in np.ndindex(5, 8, 9) if rng.random() < 0.55}, 1: {p: int(rng.integers(0, 3)) for p in np.ndindex(4, 7, 6)}, 2: {p: 4 for p in np.ndindex(3, 4, 5)}, 3: {(0, 0, 0): 1, (2, 2, 2): 1, (7, 7, 7): 2}}
    rows = [(m, *map(int, p), v) for m, voxels in movies.items() for p, v in voxels.items()]
    maps = spark.createDataFrame(rows, "movie_id int, t int, y int, x int, v int").repartition(3)
    keys = ["movie_id"]
    got = {}
    for r in regions.label(maps.where("movie_id <> 1"), keys).collect():
        got.setdefault((r["movie_id"], r["label"]), set()).add((r["t"], r["y"], r["x"]))
    want = {(m, n): own for m in (0, 2, 3) for n, own in enumerate(components_of(dict.fromkeys(movies[m], 1), faces), 1)}
    assert got == want and max(len(own) for own in want.values()) > 100
    for flat in (False, True):
        tops = set()
        for m, voxels in movies.items():
            if flat or len(set(voxels.values())) > 1:
                for own in components_of(voxels, cube):
                    near = {tuple(a + b for a, b in zip(p, s, strict=True)) for p in own for s in cube}
                    if all(voxels[q] <= voxels[min(own)] for q in near & voxels.keys()):
                        tops |= {(m, *p) for p in own}
        assert {tuple(r)[:4] for r in regions.maxima(maps, "v", keys, flat).collect()} == tops
    if block["t"] == 16:
        assert regions.label(maps.limit(0), keys).count() == regions.maxima(maps.limit(0), "v", keys).count() == 0


def test_files_names_and_diameters(spark):
    names = ["b_x.zip", "a_x.zip", "a_x.bak.zip", "a.tif", "ab_x.zip", "a_y.tif", "a_.zip"]
    files = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in points.point_files(files, F.lit("a")).collect()] == ["a_.zip", "a_x.zip"]
    assert [r[0] for r in files.sparkSession.createDataFrame([("m.b.tif",), ("m",), (None,)], "n string").select(stem(F.col("n"))).collect()] == ["m.b", "m", None]
    movies = spark.createDataFrame([("a", None), ("b", 20.0), ("c", None), ("d", None)], "movie_id string, cell_diameter double")
    estimates = spark.createDataFrame([("a", 17.0, 1.5, "ok"), ("b", 9.0, 2.0, "ok"), ("c", 12.0, None, "ok")], "movie_id string, spacing double, trend double, status string")
    got = {r[0]: tuple(r[1:]) for r in points.resolve_diameter(movies, estimates).select("movie_id", "cell_diameter", "warn", "status").collect()}
    assert got == {"a": (17.0, True, "ok"), "b": (20.0, False, "given"), "c": (12.0, False, "ok"), "d": (None, False, "no estimate")}


def test_hand_picked_negatives(spark):
    rows = [(1, 2, k, 10 + k % 5, 20 + k, 30) for k in range(10)]
    places = spark.createDataFrame(rows, "movie_id int, cat int, roi_idx bigint, t int, y int, x int")
    movie = spark.createDataFrame([(1, 30, 60, 60)], "movie_id int, n_frames int, h int, w int")
    assert sampling.sample_negatives(places, movie, SMALL, 1, 2).count() == 0
    own = sampling.sample_negatives(places, movie, SMALL, 3, 1).collect()
    assert len(own) == 10 and not any(r["noisy"] for r in own) and {r["cat"] for r in own} == {0}
    both = sampling.sample_negatives(places, movie, SMALL, 3, 2).collect()
    assert len(both) == 40 and sum(r["noisy"] for r in both) == 30
    near = [p for p in both if any(-2 <= p["t"] - t <= 2 and -1 <= p["y"] - y <= 1 and -1 <= p["x"] - x <= 1 for _, _, _, t, y, x in rows)]
    assert len(near) == 40
