"""Movies as TIFF stacks and points as archives of ImageJ regions, read as tables and written from them.

Stacks are read and written page by page (``stacks``).  Archives and texts are
small: they are read by Spark's ``binaryFile`` source and written each by one
task, under a name of its own that becomes the final one when the file is
complete, so a task that is repeated leaves one whole file.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stacks, tiff
from .scratch import Scratch

# Fixed values of the region format: places of fields in the header and its second part, stroke colours by class.
COLOURS = {1: 0xFFFF0000, 2: 0xFF0000FF, 3: 0xFF00FF00}
REGION_VERSION, POINT = 227, 10


def stem(path: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def pages(data: bytes) -> Iterator[np.ndarray]:
    """The grey pages of a TIFF file; others are an error."""
    file = io.BytesIO(data)
    for page in tiff.layout(file):
        yield tiff.read_page(file, page)


def read_movies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Frames ``movie_id, path, t, h, w, pixels, kind`` of TIFF files (``stacks.read_stacks``).

    Where only Spark's own readers reach the files, each is read whole by one
    task and must be under 2 GB.
    """
    try:
        for one in [path] if isinstance(path, str) else path:
            pafs.FileSystem.from_uri(one)
    except pa.ArrowException:
        return _whole_files(spark, path)
    return stacks.read_stacks(spark, path)


def _whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                file = io.BytesIO(content.as_py())
                try:
                    for page in tiff.layout(file):
                        yield stacks._frame(page, name, file)
                except (ValueError, struct.error, zlib.error, IndexError) as error:
                    raise ValueError(f"{name}: {error}") from error

    found = spark.read.format("binaryFile").load(path)
    return found.where(F.lower("path").rlike(r"\.tiff?$")).select("path", "content").mapInArrow(task, stacks.FRAME)


def check_movies(frames: DataFrame) -> DataFrame:
    """``movie_id, n_frames, h, w, error``: why rows are no grey movie (a single frame, frames of several sizes, wrong pixel counts), or null."""
    odd = F.sum((F.coalesce(F.size("pixels"), F.lit(-1)) != F.col("h") * F.col("w")).cast("int"))
    stats = frames.groupBy("movie_id").agg(F.count("*").cast("int").alias("n_frames"), F.max("h").alias("h"), F.max("w").alias("w"), (F.min("h").eqNullSafe(F.max("h")) & F.min("w").eqNullSafe(F.max("w"))).alias("same"), odd.alias("odd"), F.max("t").alias("last"))
    error = F.when(F.col("n_frames") < 2, "one frame").when(~F.col("same"), "frames of several sizes").when(F.col("odd") > 0, "pixels do not fill the frame").when(F.col("last") != F.col("n_frames") - 1, "frames are missing or repeated")
    return stats.select("movie_id", "n_frames", "h", "w", error.alias("error"))


class _Target:
    """A file below a folder, visible under its name when closed."""

    def __init__(self, folder: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.part = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.stream, self.size = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.final)


def _written(rows: DataFrame, order: list[str], folder: str, encode) -> DataFrame:
    """Runs ``encode(target, rows)`` for each file of ``rows``, sorted by ``order``; ``file, n`` of the files written."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                for k in range(len(batch)):
                    yield batch.slice(k, 1).to_pydict()

        row, source = None, each()
        row = next(source, None)
        while row is not None:
            name, n, after = row["file"][0], 0, None

            def own() -> Iterator[dict]:
                nonlocal n, row, after
                while row is not None and row["file"][0] == name:  # noqa: B023
                    n += 1
                    after = next(source, None)
                    yield row
                    row = after

            target = _Target(folder, name)
            encode(target, own())
            target.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]})

    sorted_rows = rows.repartition("file").sortWithinPartitions("file", *order)
    return Scratch(rows.sparkSession, "files").save(sorted_rows.mapInArrow(task, "file string, n bigint"), "written")


write_movies = stacks.write_stacks


def region(data: bytes) -> tuple[int, int, int] | None:
    """Frame (from 0), row and column of an ImageJ region; None for other data."""
    if len(data) < 64 or data[:4] != b"Iout":
        return None
    top, left = struct.unpack_from(">hh", data, 8)
    position, second = struct.unpack_from(">ii", data, 56)
    z = t = 0
    if 0 < second <= len(data) - 16:
        z, t = struct.unpack_from(">ii", data, second + 8)
    return max(position, z, t) - 1, top, left


def region_bytes(t: int, y: int, x: int, cat: int = 0, name: str | None = None, astime: bool = True) -> bytes:
    """A point region, its outline coloured by class."""
    label = (name or f"{t + 1:04d}-{y:04d}-{x:04d}").encode("utf-16-be")
    head = bytearray(64)
    struct.pack_into(">4shBB4hh", head, 0, b"Iout", REGION_VERSION, POINT, 0, y, x, y, x, 1)
    struct.pack_into(">h", head, 34, 3)
    struct.pack_into(">I", head, 40, COLOURS.get(cat, 0))
    struct.pack_into(">ii", head, 56, t + 1, 68)
    second = bytearray(64)
    struct.pack_into(">5i", second, 4, 1, 1 if astime else t + 1, t + 1 if astime else 1, 132, len(label) // 2)
    return bytes(head) + bytes(4) + bytes(second) + label


def read_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Points ``path, file, roi_idx, t, y, x`` of region archives (``.zip``) and single regions (``.roi``).

    Archives named ``.bak.zip`` are left out; entries that are no regions are skipped.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        entries = [archive.read(e) for e in archive.namelist()]
                else:
                    entries = [content]
                places = np.array([p for p in map(region, entries) if p is not None], np.int32).reshape(-1, 3)
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(places[:, k]) for k in range(3))], names=["path", "roi_idx", "t", "y", "x"])

    found = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(zip|roi)$") & ~F.lower("path").endswith(".bak.zip"))
    return found.select("path", "content").mapInArrow(task, "path string, roi_idx int, t int, y int, x int").select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "roi_idx", "t", "y", "x")


def write_points(points: DataFrame, folder: str, backup: bool = False) -> DataFrame:
    """Writes points ``file, t, y, x`` (``cat``, if there, colours them) as one archive for each ``file``.

    Regions are in order of time and place; equal points get names of their own.
    With ``backup`` a file that is there already is kept as ``<name>.bak.zip``.
    Coordinates are of 16 bits, as the format has them.  Returns ``file, n``.
    """
    rows = points.select("file", *[F.col(c).cast("int").alias(c) for c in "tyx"], (F.col("cat").cast("int") if "cat" in points.columns else F.lit(0)).alias("cat"))

    def encode(target: _Target, own_rows: Iterator[dict]) -> None:
        if backup and target.fs.get_file_info(target.final).type == pafs.FileType.File:
            target.fs.copy_file(target.final, re.sub(r"\.zip$", "", target.final) + ".bak.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            before, again = None, 0
            for row in own_rows:
                t, y, x = (row[c][0] for c in "tyx")
                again = again + 1 if before == (t, y, x) else 0
                before = t, y, x
                name = f"{t + 1:04d}-{y:04d}-{x:04d}" + (f"-{again}" if again else "")
                archive.writestr(zipfile.ZipInfo(f"{name}.roi"), region_bytes(t, y, x, row["cat"][0] or 0, name))

    return _written(rows, ["t", "y", "x"], folder, encode)


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """Writes ``file, text`` rows as small files, such as summaries in JSON; ``file, n``."""
    return _written(texts.select("file", "text"), [], folder, lambda target, rows: [target.write((r["text"][0] or "").encode() + b"\n") for r in rows])


def write_history(epochs: DataFrame, folder: str) -> DataFrame:
    """Writes ``history.csv`` of training: ``epoch, lr, loss, acc, val_loss, val_acc``, a row for each epoch."""
    columns = ["epoch", "lr", "loss", "acc", "val_loss", "val_acc"]
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])
    rows = epochs.select(F.lit("history.csv").alias("file"), F.col("epoch").cast("bigint").alias("place"), line.alias("text"))
    head = epochs.sparkSession.createDataFrame([("history.csv", -1, ",".join(columns))], "file string, place bigint, text string")
    return _written(head.unionByName(rows), ["place"], folder, lambda target, own: [target.write((r["text"][0] + "\r\n").encode()) for r in own])
