import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinevox.operators import jobs, network, resample, spacing
from cinevox.operators.config import Config
from cinevox.sources import files, models, stacks
from cinevox.sources import tiff as form

SMALL = Config(half_size=(2, 2), nframes=(1, 2), ncat=3)
FRAMES = "movie_id string, t int, h int, w int, pixels array<float>"


def movie(spark, name, stack):
    return spark.createDataFrame([(name, t, *page.shape, [float(v) for v in page.ravel()]) for t, page in enumerate(stack)], FRAMES)


def tiff(pages, order=">", packed=False, note=b"", one_directory=False):
    """A file made by hand: pixels first, then the directories."""
    data = bytearray(struct.pack(f"{order}2sHI", b"MM" if order == ">" else b"II", 42, 0))
    places = []
    for page in pages:
        raw = page.astype(page.dtype.newbyteorder(order)).tobytes()
        raw = zlib.compress(raw) if packed else raw
        places.append((len(data), len(raw)))
        data += raw
    link = 4
    at_note = len(data)
    data += note
    for page, (start, size) in list(zip(pages, places, strict=True))[: 1 if one_directory else None]:
        struct.pack_into(f"{order}I", data, link, len(data))
        tags = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 3, 1, page.dtype.itemsize * 8), (259, 3, 1, 8 if packed else 1), (273, 4, 1, start), (279, 4, 1, size)]
        if note:
            tags.append((270, 2, len(note), at_note))
        data += struct.pack(f"{order}H", len(tags))
        for tag, kind, n, value in tags:
            data += struct.pack(f"{order}HHI", tag, kind, n) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
        link = len(data)
        data += bytes(4)
    return bytes(data)


@pytest.mark.parametrize("options", [{}, {"order": "<"}, {"packed": True}, {"one_directory": True, "note": b"ImageJ=1.11a\nimages=3\nframes=3\n\0"}])
def test_pages_of_other_writers(options):
    stack = np.arange(3 * 4 * 5, dtype=np.uint16).reshape(3, 4, 5) * 1000
    assert np.array_equal(np.array(list(files.pages(tiff(stack, **options)))), stack)


def test_pages_that_are_no_grey_movie():
    stack = np.zeros((2, 3, 3), np.uint8)
    for data in (b"", b"II*\0", b"GIF89a..", tiff(stack, note=b"ImageJ=1.11a\nimages=2\nchannels=2\n\0")):
        with pytest.raises(ValueError):
            list(files.pages(data))


@pytest.mark.parametrize("kind", ["u1", "u2", "f4"])
def test_movie_round_trip(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 200, (4, 5, 7)), rng.integers(0, 200, (2, 3, 3))
    both = movie(spark, "a.b", a).unionByName(movie(spark, "c", b))
    done = files.write_movies(both, str(tmp_path), kind=kind)
    assert {r["file"]: r["n"] for r in done.collect()} == {"a.b.tif": 4, "c.tif": 2}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.b.tif", "c.tif"]
    back = files.read_movies(spark, str(tmp_path))
    got = {(r["movie_id"], r["t"]): (np.array(r["pixels"]).reshape(r["h"], r["w"]), r["kind"]) for r in back.collect()}
    assert len(got) == 6 and all(k == kind for _, k in got.values())
    assert all(np.array_equal(got["a.b", t][0], a[t]) for t in range(4)) and all(np.array_equal(got["c", t][0], b[t]) for t in range(2))
    assert files.check_movies(back).where("error is null").count() == 2


def lzw(data):
    """A plain encoder: codes of 9 to 12 bits, the table begun anew before it is full."""
    codes, bits = [], ""
    table, width = {bytes([i]): i for i in range(256)}, 9
    put = lambda code: format(code, f"0{width}b")
    bits, word, following = put(256), b"", 258
    for k in range(len(data)):
        byte = data[k : k + 1]
        if word + byte in table:
            word += byte
            continue
        bits += put(table[word])
        table[word + byte] = following
        following += 1
        width = {512: 10, 1024: 11, 2048: 12}.get(following, width)
        if following == 4094:
            bits += put(256)
            table, width, following = {bytes([i]): i for i in range(256)}, 9, 258
        word = byte
    bits += put(table[word]) if word else ""
    following += 1
    width = {512: 10, 1024: 11, 2048: 12}.get(following, width)
    bits += put(257)
    bits += "0" * (-len(bits) % 8)
    del codes
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("packing", [1, 5, 8])
@pytest.mark.parametrize("kind", ["u1", "u2", "i4", "f4", "f8"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_strips_tiles_and_packings(kind, packing, tile):
    """Pieces of every form, with and without differences, put together by hand."""
    rng = np.random.default_rng(2)
    page = np.cumsum(rng.integers(-3, 4, (37, 70)), axis=1).astype(kind)
    for predictor in (1, 2) if kind[0] in "ui" else (1,):
        h, w = tile or (10, 70)
        pieces = []
        for y in range(0, 37, h):
            for x in range(0, 70, w):
                piece = page[y : y + h, x : x + w]
                if tile:
                    piece = np.pad(piece, ((0, h - piece.shape[0]), (0, w - piece.shape[1])))
                if predictor == 2:
                    piece = np.diff(piece, axis=1, prepend=piece.dtype.type(0))
                raw = np.ascontiguousarray(piece).tobytes()
                pieces.append(raw if packing == 1 else lzw(raw) if packing == 5 else zlib.compress(raw))
        data = bytearray(struct.pack("<2sHI", b"II", 42, 0))
        offsets = []
        for raw in pieces:
            offsets.append(len(data))
            data += raw
        at = {}
        for name, values in (("offsets", offsets), ("lengths", [len(p) for p in pieces])):
            at[name] = len(data)
            data += struct.pack(f"<{len(values)}I", *values)
        n = len(pieces)
        tags = [(256, 1, 70), (257, 1, 37), (258, 1, page.dtype.itemsize * 8), (259, 1, packing), (317, 1, predictor), (339, 1, {"u": 1, "i": 2, "f": 3}[kind[0]])]
        tags += [(322, 1, w), (323, 1, h), (324, n, at["offsets"]), (325, n, at["lengths"])] if tile else [(278, 1, h), (273, n, at["offsets"]), (279, n, at["lengths"])]
        struct.pack_into("<I", data, 4, len(data))
        data += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", tag, 4, items, value) for tag, items, value in tags) + bytes(4)
        (got,) = files.pages(bytes(data))
        assert got.dtype == page.dtype and np.array_equal(got, page)


def test_ranges_conditions_and_picked_pages(spark, tmp_path):
    """Pages dealt out by bytes come once each; conditions and the index spare pixels, as pages that cannot be read show."""
    stack = np.random.default_rng(5).integers(0, 65535, (30, 24, 24))
    files.write_movies(movie(spark, "a", stack).unionByName(movie(spark, "b", stack[:9])), str(tmp_path), kind="u2")
    frames = stacks.read_stacks(spark, str(tmp_path), split=3000)
    assert frames.rdd.getNumPartitions() > 12
    got = {(r["movie_id"], r["t"]): r["pixels"] for r in frames.collect()}
    assert sorted(got) == [("a", t) for t in range(30)] + [("b", t) for t in range(9)]
    assert all(np.array_equal(got["a", t], stack[t].ravel()) for t in range(30))
    data = bytearray((tmp_path / "a.tif").read_bytes())
    for page in form.layout(io.BytesIO(bytes(data))):
        if page.t not in (2, 7, 8):  # these lose their pixels: lengths that the file does not have
            where = data.index(struct.pack("<HHII", 279, 4, 1, page.lengths[0]), max(0, page.offsets[0] - 400))
            struct.pack_into("<I", data, where + 8, 1 << 30)
    (tmp_path / "a.tif").write_bytes(data)
    some = frames.where("movie_id = 'a' and t in (2, 7, 8)")
    assert "PushedFilters: []" not in some._jdf.queryExecution().toString()
    assert sorted(r["t"] for r in some.collect()) == [2, 7, 8]
    assert sorted(r["t"] for r in frames.where("movie_id = 'a' and t > 6 and t <= 8").collect()) == [7, 8]
    assert sorted((r["movie_id"], r["t"]) for r in frames.where("movie_id in ('b', 'c') and t >= 4 and t < 6 and h = 24").collect()) == [("b", 4), ("b", 5)]
    index = stacks.page_index(spark, str(tmp_path))
    assert index.count() == 39 and [(r["movie_id"], r["index"], r["n_frames"]) for r in stacks.movie_index(index).orderBy("index").collect()] == [("a", 0, 30), ("b", 1, 9)]
    picked = stacks.read_pages(index.where("t in (2, 8)")).collect()
    assert sorted((r["movie_id"], r["t"]) for r in picked) == [("a", 2), ("a", 8), ("b", 2), ("b", 8)]
    assert all(np.array_equal(r["pixels"], stack[r["t"]].ravel()) for r in picked)
    with pytest.raises(Exception, match="a.tif"):
        frames.collect()


def test_size_estimate_reads_the_picked_pages_only(spark, tmp_path):
    """Of 40 pages the 12 that are picked have pixels."""
    y, x = np.mgrid[:96, :96]
    stack = np.stack([100 + 50 * np.cos(x / 2.5) * np.cos(y / 2.5) + t % 3 for t in range(40)])
    files.write_movies(movie(spark, "m", stack), str(tmp_path), kind="f4")
    want = jobs.estimate_size(files.read_movies(spark, str(tmp_path)), tile=48).collect()
    picks = {r["t"] for r in spacing.frame_picks(spark.createDataFrame([("m", 40)], "movie_id string, n_frames int"), 12).collect()}
    data = bytearray((tmp_path / "m.tif").read_bytes())
    for page in form.layout(io.BytesIO(bytes(data))):
        if page.t not in picks:
            struct.pack_into("<I", data, data.index(struct.pack("<HHII", 279, 4, 1, page.lengths[0]), max(0, page.offsets[0] - 400)) + 8, 1 << 30)
    (tmp_path / "m.tif").write_bytes(data)
    assert len(picks) == 12 and jobs.estimate_size_of_files(spark, str(tmp_path), tile=48).collect() == want


def test_stack_of_several_parts(spark, tmp_path):
    """Parts written by several tasks make the file that one task makes; a write that fails leaves nothing."""
    stack = np.random.default_rng(6).integers(0, 255, (23, 8, 9))
    both = movie(spark, "a", stack).repartition(5)
    files.write_movies(both, str(tmp_path / "one"), kind="u1")
    done = stacks.write_stacks(both, str(tmp_path / "many"), kind="u1", part=2000)
    assert [tuple(r) for r in done.collect()] == [("a.tif", 23)]
    assert (tmp_path / "one" / "a.tif").read_bytes() == (tmp_path / "many" / "a.tif").read_bytes()
    assert [p.name for p in (tmp_path / "many").iterdir()] == ["a.tif"]
    assert np.array_equal(np.array(list(files.pages((tmp_path / "many" / "a.tif").read_bytes()))), stack)
    broken = both.withColumn("pixels", F.when(F.col("t") == 11, F.expr("slice(pixels, 1, 3)")).otherwise(F.col("pixels")))
    (tmp_path / "bad").mkdir()
    with pytest.raises(Exception, match="pixels"):
        stacks.write_stacks(broken, str(tmp_path / "bad"), kind="u1", part=2000)
    assert list((tmp_path / "bad").iterdir()) == []
    mixed = both.unionByName(movie(spark, "a", stack[:1, :2, :2]).withColumn("t", F.lit(99)))
    with pytest.raises(ValueError, match="several sizes"):
        stacks.write_stacks(mixed, str(tmp_path / "bad"))
    assert stacks.write_stacks(both.limit(0), str(tmp_path / "bad")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_movies(spark, str(tmp_path / "bad"))


def test_large_stacks_are_big():
    """Places of pages that stand behind 4 GB."""
    kind, first = np.dtype("<u2"), form.note(3000)
    assert form.is_big(3000, 1024, 1024, kind) and not form.is_big(1000, 1024, 1024, kind)
    start = [form.place(k, 3000, 1024, 1024, kind, first, True) for k in (0, 1, 2, 2999)]
    one = len(form.page_head(1024, 1024, kind, start[1], False, b"", True)) + 2 * 1024 * 1024
    assert start[0] == 16 and start[2] - start[1] == one and start[3] == start[1] + 2998 * one > 2**32


def test_rounding_and_checks(spark, tmp_path):
    files.write_movies(movie(spark, "m", np.array([[[-3.0, 1.5]], [[300.0, 2.4]]])), str(tmp_path), kind="u1")
    assert [r["pixels"] for r in files.read_movies(spark, str(tmp_path)).orderBy("t").collect()] == [[0.0, 2.0], [255.0, 2.0]]
    odd = movie(spark, "one", np.zeros((1, 2, 2))).unionByName(movie(spark, "two", np.zeros((2, 2, 2))).withColumn("pixels", F.slice("pixels", 1, 3)))
    assert {r["movie_id"]: r["error"] for r in files.check_movies(odd).collect()} == {"one": "one frame", "two": "pixels do not fill the frame"}
    assert files.check_movies(odd.limit(0)).count() == 0


def test_points_round_trip_and_backup(spark, tmp_path):
    rows = [("m_cell_death.zip", 1, 4, 30, 20), ("m_cell_death.zip", 1, 4, 30, 20), ("m_cell_death.zip", 1, 0, 0, 0), ("n_x.zip", 7, 9, 2, 3)]
    points = spark.createDataFrame(rows, "file string, cat int, t int, y int, x int")
    assert {r["file"]: r["n"] for r in files.write_points(points, str(tmp_path)).collect()} == {"m_cell_death.zip": 3, "n_x.zip": 1}
    got = files.read_points(spark, str(tmp_path)).orderBy("file", "roi_idx").collect()
    assert [(r["file"], r["roi_idx"], r["t"], r["y"], r["x"]) for r in got] == [("m_cell_death.zip", 0, 0, 0, 0), ("m_cell_death.zip", 1, 4, 30, 20), ("m_cell_death.zip", 2, 4, 30, 20), ("n_x.zip", 0, 9, 2, 3)]
    files.write_points(points.where("file = 'n_x.zip'").withColumn("t", F.lit(1)), str(tmp_path), backup=True)
    assert (tmp_path / "n_x.bak.zip").exists()
    assert files.read_points(spark, str(tmp_path)).where("file = 'n_x.zip'").first()["t"] == 1
    assert files.read_points(spark, str(tmp_path)).where("file like '%.bak.zip'").count() == 0
    assert files.region(files.region_bytes(3, -2, 5, astime=False)) == (3, -2, 5) and files.region(b"Iout") is None


def test_history_and_summaries(spark, tmp_path):
    files.write_history(spark.createDataFrame([(2, 0.1, 1.5, 0.5, None, None), (1, 0.1, 2.0, 0.25, None, None)], "epoch int, lr double, loss double, acc double, val_loss double, val_acc double"), str(tmp_path))
    assert (tmp_path / "history.csv").read_text().split() == ["epoch,lr,loss,acc,val_loss,val_acc", "1,0.1,2.0,0.25,nan,nan", "2,0.1,1.5,0.5,nan,nan"]


def test_time_is_resized_as_by_the_whole_matrix(spark):
    rng = np.random.default_rng(2)
    stack = rng.random((90, 2, 3)).astype(np.float32)
    sizes = spark.createDataFrame([("m", 90, 41)], "movie_id string, n_frames int, new_frames int")
    for order in (1, 3):
        got = resample.resize_time(movie(spark, "m", stack), sizes, order).orderBy("t").collect()
        want = resample.matrix(90, 41, order) @ stack.reshape(90, 6)
        assert np.allclose([r["pixels"] for r in got], want, atol=1e-9)


def test_prepare_and_reverse(spark, tmp_path):
    rng = np.random.default_rng(3)
    stack = rng.integers(0, 255, (6, 8, 10)).astype(np.float32)
    points = spark.createDataFrame([("m", "m_cell_death.zip", 0, 1, 7, 9), ("m", "m_cell_sop.zip", 0, 2, 3, 4)], "movie_id string, file string, roi_idx int, t int, y int, x int")
    scales = spark.createDataFrame([("m", 50.0, 9.0)], "movie_id string, cell_diameter double, extrusion_duration double")
    scaled, moved, summary = jobs.prepare(movie(spark, "m", stack), points, scales, Config())
    want = np.einsum("ot,py,qx,tyx->opq", resample.matrix(6, 3, 3), resample.matrix(8, 4, 3), resample.matrix(10, 5, 3), stack)
    got = scaled.orderBy("t").collect()
    assert [(r["t"], r["h"], r["w"]) for r in got] == [(t, 4, 5) for t in range(3)] and np.allclose([r["pixels"] for r in got], want.reshape(3, -1), atol=1e-6)
    assert {(r["file"], r["t"], r["y"], r["x"]) for r in moved.collect()} == {("m_cell_death.zip", 0, 3, 4), ("m_cell_sop.zip", 1, 1, 2)}
    row = summary.first()
    assert (row["ratio_xy"], row["shape_in"], row["shape_out"], row["rois"]) == (0.5, [6, 8, 10], [3, 4, 5], {"m_cell_death.zip": 1, "m_cell_sop.zip": 1})
    files.write_texts(jobs.summary_files(summary, ".prepare.json"), str(tmp_path))
    assert json.loads((tmp_path / "m.prepare.json").read_text())["shape_out"] == [3, 4, 5]

    frames, turned, summary = jobs.reverse(movie(spark, "m", stack), points)
    assert [tuple(r) for r in turned.select("movie_id", "file", "t", "y", "x").collect()] == [("m_rev", "m_rev_cell_delamination.zip", 4, 7, 9)]
    assert np.array_equal([r["pixels"] for r in frames.orderBy("t").collect()], stack[::-1].reshape(6, -1))
    assert (summary.first()["dropped"], summary.first()["rois"]) == (["m_cell_sop.zip"], {"m_rev_cell_delamination.zip": 1})


def test_size_estimate(spark):
    y, x = np.indices((96, 96))
    page = 100 + 50 * np.cos(2 * np.pi * y / 16) + 50 * np.cos(2 * np.pi * x / 16)
    frames = movie(spark, "grid", np.stack([page] * 5)).unionByName(movie(spark, "blank", np.zeros((3, 96, 96))))
    got = {r["movie_id"]: r for r in jobs.estimate_size(frames, n=4, tile=96, min_tiles=2).collect()}
    assert got["grid"]["status"] == "ok" and abs(got["grid"]["cell_diameter"] - 16) < 16 * 0.15 and got["grid"]["n_frames"] == 4
    assert got["blank"]["status"] == "no estimate" and got["blank"]["cell_diameter"] is None


def test_windows_of_samples(spark, tmp_path):
    rng = np.random.default_rng(4)
    stack = rng.integers(0, 1000, (12, 20, 20)).astype(np.float32)
    frames = movie(spark, "m", stack)
    points = spark.createDataFrame([("m", 1 + k % 2, k, 5, 6 + k, 9) for k in range(6)], "movie_id string, cat int, roi_idx int, t int, y int, x int")
    samples = jobs.sample_all(points, points.limit(2), jobs.sizes(frames), SMALL, 2, 2, 0.3, 0, {"m": 2}).persist()
    assert samples.where("cat = 0").count() > 0 and samples.where("rep = 1 and split = 'val'").count() == 0
    assert samples.count() == samples.select("rep", "seq", "cat").distinct().count()
    got = jobs.sample_windows(samples, frames, SMALL, 1.0).collect()
    assert len(got) == samples.count()
    for r in got:
        win = stack[r["t"] - 1 : r["t"] + 2, r["y"] - 2 : r["y"] + 3, r["x"] - 2 : r["x"] + 3].astype(float)
        eight = np.floor((win - win.min()) / (np.ptp(win) or 1) * 255)
        assert np.allclose(np.array(r["cube"]).reshape(win.shape), (eight - eight.min()) / (np.ptp(eight) or 1))
    overlap = {(r["cat"], r["t"], r["y"], r["x"]) for r in jobs.split_overlap(samples).collect()}
    sides = [{(r["cat"], r["t"], r["y"], r["x"]) for r in samples.where(F.col("split") == s).collect()} for s in ("train", "val")]
    assert overlap == sides[0] & sides[1]


def test_models_and_detections(spark, tmp_path):
    weights = network.init(3, 4)
    for name in ("b", "a"):
        models.save_model(f"{tmp_path}/{name}", weights, SMALL)
    (tmp_path / "empty").mkdir()
    assert models.resolve_models(str(tmp_path)) == [f"{tmp_path}/a", f"{tmp_path}/b"] and models.resolve_models(f"{tmp_path}/a") == [f"{tmp_path}/a"]
    back, config = models.load_model(f"{tmp_path}/a")
    assert config == SMALL and all(np.array_equal(back[k], weights[k]) for k in weights)
    for missing in (models.load_model, models.resolve_models):
        with pytest.raises(FileNotFoundError):
            missing(f"{tmp_path}/empty")

    maps = spark.createDataFrame([("m", 1, t, y, x, t + 2 * y + x) for t in range(2) for y in range(2) for x in range(3)], "movie_id string, cat int, t int, y int, x int, p8 int")
    events = spark.createDataFrame([("m", 1, 1, 0, 2)], "movie_id string, cat int, t int, y int, x int")
    done = jobs.write_detections(f"{tmp_path}/out", Config(), maps, events, maps)
    assert {r["file"] for r in done.collect()} == {"m_cell_death_rawproba.tif", "m_cell_death_cleaned_proba.tif", "m_cell_death.zip"}
    got = files.read_movies(spark, f"{tmp_path}/out/m_cell_death_rawproba.tif").orderBy("t").collect()
    assert [r["pixels"] for r in got] == [[0, 1, 2, 2, 3, 4], [1, 2, 3, 3, 4, 5]]
    assert [r["file"] for r in files.read_points(spark, f"{tmp_path}/out/*.zip").collect()] == ["m_cell_death.zip"]
