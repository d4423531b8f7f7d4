"""Blocks of maps against going over every window of a movie."""

from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinevox.operators import detect
from cinevox.operators.config import Config

CONFIG = Config(half_size=(4, 7), nframes=(5, 6), ncat=3)


def brightness(windows, config):
    """Two scores that depend on all of a window."""
    mean = windows.reshape(len(windows), -1).mean(1) / 255
    return np.stack([mean, 1 - mean**2], 1)


def scaled(window):
    spread = window.max() - window.min()
    return np.floor((window - window.min()) / (spread or 1) * 255)


def plain(movie, config, models, dxy, dz):
    """Maps, and the range and normalised sum of every window, one window after another."""
    (f0, f1), (hy, hx), (back, ahead, by, bx) = config.nframes, config.half_size, config.bounds
    n, h, w = movie.shape
    padded = np.concatenate([movie[:1].repeat(f0, 0), movie, movie[-1:].repeat(f1, 0)])
    total, hits, ranges = np.zeros((2, *padded.shape)), np.zeros(padded.shape), {}
    for model in range(models):
        shift_t, shift_xy = detect.shifts(model, models, dxy, dz)
        steps = [max(0, ceil(v / s)) for v, s in ((n - shift_t, dz), (h - 2 * hy - 1 - shift_xy, dxy), (w - 2 * hx - 1 - shift_xy, dxy))]
        for k, j, i in np.ndindex(*steps):
            t, y, x = f0 + shift_t + dz * k, hy + shift_xy + dxy * j, hx + shift_xy + dxy * i
            window = padded[t - f0 : t + f1, y - hy : y + hy + 1, x - hx : x + hx + 1]
            whole = scaled(window)
            ranges[model, (k * steps[1] + j) * steps[2] + i] = window.min(), window.max(), whole.sum()
            place = slice(t - back, t + ahead), slice(y - by, y + by + 1), slice(x - bx, x + bx + 1)
            total[(slice(None), *place)] += brightness(whole[None].astype(np.uint8), config)[0][:, None, None, None]
            hits[place] += 1
    return np.floor(total[:, f0 : f0 + n] / np.maximum(hits[f0 : f0 + n], 1) * 255), ranges


@pytest.fixture(scope="module")
def movies():
    rng = np.random.default_rng(9)
    flat = np.full((4, 12, 20), 7.0)
    return {1: rng.integers(0, 4000, (17, 33, 41)).astype(float), 2: flat, 3: rng.random((1, 20, 30)), 4: np.zeros((5, 6, 50))}


@pytest.fixture(scope="module")
def frames(spark, movies):
    rows = [(m, t, *page.shape, page.ravel().tolist()) for m, movie in movies.items() for t, page in enumerate(movie)]
    return spark.createDataFrame(rows, "movie_id int, t int, h int, w int, pixels array<double>").repartition(3)


@pytest.mark.parametrize("chunk, tile, group", [(32, 512, 512), (4, 10, 7), (3, 17, 1)])
def test_blocks_make_the_maps_of_the_whole_movie(frames, movies, chunk, tile, group):
    """Blocks of every size, windows that reach several of them, flat, short and too small movies."""
    blocks = detect.detect_blocks(frames, CONFIG, [brightness] * 2, 2, dxy=3, dz=2, chunk=chunk, tile=tile, group=group).cache()
    got = {(r["movie_id"], r["cat"], r["t"]): np.array(r["pixels"]).reshape(r["h"], r["w"]) for r in detect.block_frames(blocks).collect()}
    assert sorted(got) == sorted((m, c, t) for m, movie in movies.items() for c in (1, 2) for t in range(len(movie)))
    for m, movie in movies.items():
        want, _ = plain(movie, CONFIG, 2, 3, 2)
        for c in (1, 2):
            assert all(np.abs(got[m, c, t] - want[c - 1, t]).max() <= 1 for t in range(len(movie)))
            assert np.mean([np.mean(got[m, c, t] != want[c - 1, t]) for t in range(len(movie))]) < 1e-3
    voxels = detect.detect(frames, CONFIG, [brightness] * 2, 2, dxy=3, dz=2, chunk=chunk, tile=tile)
    assert voxels.where("movie_id = 1").count() == 2 * 17 * 33 * 41
    assert voxels.agg(F.sum("p8")).first()[0] == sum(int(v.sum()) for v in got.values())


@pytest.mark.parametrize("chunk, tile", [(32, 512), (4, 10)])
def test_ranges_of_windows(frames, movies, chunk, tile):
    got = detect.window_ranges(frames, CONFIG, n_models=2, dxy=3, dz=2, chunk=chunk, tile=tile).collect()
    want = {(m, *key): value for m, movie in movies.items() for key, value in plain(movie, CONFIG, 2, 3, 2)[1].items()}
    assert len(got) == len(want)
    assert {(r["movie_id"], r["model_id"], r["win_id"]): (r["low"], r["high"], r["total"]) for r in got} == want


@pytest.mark.parametrize("shape, size", [((7, 9, 11), (3, 4, 5)), ((3, 3, 3), (3, 3, 3)), ((4, 5, 6), (1, 1, 1)), ((2, 9, 9), (3, 2, 2))])
def test_sliding_extrema(shape, size):
    cube = np.random.default_rng(1).random(shape)
    for pick in (np.minimum, np.maximum):
        got = detect.sliding(cube, size, pick)
        if any(a < b for a, b in zip(shape, size, strict=True)):
            assert got.size == 0
        else:
            windows = np.lib.stride_tricks.sliding_window_view(cube, size)
            assert np.array_equal(got, pick.reduce(windows.reshape(*windows.shape[:3], -1), axis=3))


def test_splat_adds_what_each_window_adds(spark):
    rng = np.random.default_rng(2)
    rows = [(1, int(c), *map(int, p), float(v)) for c, p, v in zip(rng.integers(1, 3, 200), rng.integers(0, 12, (200, 3)), rng.integers(0, 9, 200), strict=True)]
    back, ahead, by, bx = CONFIG.bounds
    want = {}
    for m, c, t, y, x, v in rows:
        for dt in range(-back, ahead):
            for dy in range(-by, by + 1):
                for dx in range(-bx, bx + 1):
                    s, n = want.get((m, c, t + dt, y + dy, x + dx), (0, 0))
                    want[m, c, t + dt, y + dy, x + dx] = s + v, n + 1
    got = detect.splat(spark.createDataFrame(rows, "movie_id int, cat int, t int, y int, x int, p double"), CONFIG)
    assert {(r["movie_id"], r["cat"], r["t"], r["y"], r["x"]): (r["total"], r["n"]) for r in got.collect()} == want
