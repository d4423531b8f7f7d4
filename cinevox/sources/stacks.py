"""Movies in TIFF stacks as a Spark data source, page by page.

Reading deals out ranges of bytes: a task walks a file's directories, which are
small, and reads the pixels of the pages that begin in its range, so files of any
size are read by many tasks and the driver sees names and sizes only.  Conditions
on ``movie_id`` and ``t`` are pushed down; pages they leave out are not read.
``page_index`` lists pages without reading pixels, and ``read_pages`` reads those
of any table of them.

Writing knows where each page will stand, as all pages of a stack are equal.
Tasks encode runs of pages from Arrow buffers into parts in a hidden folder of
the job; the job's commit lists them, abort and the end of the write remove the
folder.  A stack of one part is moved to its name; parts of a longer one are
appended by one task a stack, a few megabytes at a time.
"""

from __future__ import annotations

import fnmatch
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.window import Window

from . import tiff
from .scratch import Scratch

SPLIT = 64 << 20
"""Bytes of a file that one task reads."""
PART = 64 << 20
"""Bytes of pages that make one part of a stack that is written."""
COPY = 8 << 20
FRAME = "movie_id string, path string, t int, h int, w int, pixels array<float>, kind string"
INDEX = "movie_id string, path string, t int, h int, w int, kind string, packing int, predictor int, piece_h int, piece_w int, offsets array<bigint>, lengths array<bigint>"
_FRAME_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string()]
_INDEX_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 4, *[pa.list_(pa.int64())] * 2]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _found(path: str) -> list[tuple[str, int]]:
    """TIFF files of a folder, of a pattern in its last part, or the file itself, by name, with their sizes."""
    fs, base = pafs.FileSystem.from_uri(path)
    scheme = path[: len(path) - len(base)] if path.endswith(base) else ""
    if any(c in base.rsplit("/", 1)[-1] for c in "*?["):
        folder, pattern = base.rsplit("/", 1)
        infos = [i for i in fs.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatchcase(i.base_name, pattern)]
    else:
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = fs.get_file_info(pafs.FileSelector(base)) if info.type == pafs.FileType.Directory else [info]
    tiffs = [i for i in infos if i.type == pafs.FileType.File and i.base_name.lower().endswith((".tif", ".tiff")) and not i.base_name.startswith((".", "_"))]
    return sorted((scheme + i.path, i.size) for i in tiffs)


def _open(path: str):
    fs, base = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(base)


def _frame(page: tiff.Page, path: str, file) -> pa.RecordBatch:
    pixels = tiff.read_page(file, page).ravel().astype(np.float32)
    values = [[_name(path)], [path], [page.t], [page.h], [page.w], pa.ListArray.from_arrays(pa.array([0, len(pixels)], pa.int32()), pa.array(pixels)), [page.kind[1:]]]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, _FRAME_TYPES, strict=True)], names=FRAME.replace(",", "").split()[::2])


def _entry(page: tiff.Page, path: str) -> pa.RecordBatch:
    values = [_name(path), path, page.t, page.h, page.w, page.kind, page.packing, page.predictor, page.piece_h, page.piece_w, page.offsets, page.lengths]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _INDEX_TYPES, strict=True)], names=INDEX.replace(",", "").split()[::2])


@contextmanager
def _errors_of(path: str) -> Iterator[None]:
    try:
        yield
    except (ValueError, struct.error, zlib.error, IndexError) as error:
        raise ValueError(f"{path}: {error}") from error


@dataclass
class Range(InputPartition):
    """Pages of a file that begin at bytes from ``start`` up to ``end``; the last range of a file has no end."""

    path: str
    start: int
    end: float


@dataclass
class Wanted:
    """What pushed conditions ask for."""

    names: set | None = None
    times: set | None = None
    least: float = -np.inf
    most: float = np.inf

    def take(self, filter_: Filter) -> bool:
        """Takes a condition in, if it is one of those that pages are chosen by."""
        column, value = getattr(filter_, "attribute", ()), getattr(filter_, "value", None)
        values = {value} if isinstance(filter_, EqualTo) else set(value) if isinstance(filter_, In) else None
        if column == ("movie_id",) and values is not None:
            self.names = values if self.names is None else self.names & values
        elif column == ("t",) and values is not None:
            self.times = values if self.times is None else self.times & values
        elif column == ("t",) and isinstance(filter_, (GreaterThan, GreaterThanOrEqual)):
            self.least = max(self.least, value + isinstance(filter_, GreaterThan))
        elif column == ("t",) and isinstance(filter_, (LessThan, LessThanOrEqual)):
            self.most = min(self.most, value - isinstance(filter_, LessThan))
        else:
            return False
        return True

    def has(self, t: int) -> bool:
        return self.least <= t <= self.most and (self.times is None or t in self.times)


@dataclass
class StackReader(DataSourceReader):
    paths: list[str]
    pixels: bool
    split: int
    wanted: Wanted = field(default_factory=Wanted)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for one in filters:
            if not self.wanted.take(one):
                yield one

    def partitions(self) -> list[Range]:
        """Of the files' sizes only; where no pixels are asked for, a file is one range."""
        files = sorted({f for path in self.paths for f in _found(path)})
        step = lambda size: self.split if self.pixels else max(1, size)
        own = [(path, size) for path, size in files if self.wanted.names is None or _name(path) in self.wanted.names]
        starts = lambda size: range(0, max(1, size), step(size))
        return [Range(path, at, at + step(size) if at + step(size) < size else np.inf) for path, size in own for at in starts(size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with _open(partition.path) as file, _errors_of(partition.path):
            for page in tiff.layout(file):
                if partition.start <= page.offsets[0] < partition.end and self.wanted.has(page.t):
                    yield _frame(page, partition.path, file) if self.pixels else _entry(page, partition.path)


@dataclass
class Parts(WriterCommitMessage):
    parts: list[str]


@dataclass
class StackWriter(DataSourceArrowWriter):
    """Writes rows ``file, part, position, pages, h, w, kind, pixels``, sorted by these, as parts of stacks below ``folder``."""

    folder: str
    astime: bool

    def write(self, batches: Iterator[pa.RecordBatch]) -> Parts:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        now, stream, written = None, None, []
        try:
            for batch in batches:
                columns = {c: batch.column(c).to_pylist() for c in ("file", "part", "position", "pages", "h", "w", "kind")}
                pixels = batch.column("pixels")
                for k in range(len(batch)):
                    name, part, position, pages, h, w, kind = (columns[c][k] for c in columns)
                    if now != (name, part):
                        if stream is not None:
                            stream.close()
                        now = name, part
                        written.append(f"{part:06d}-{uuid.uuid4().hex}-{name}")
                        stream = fs.open_output_stream(f"{base}/{written[-1]}", compression=None)
                    stream.write(_encoded(pixels[k].values.to_numpy(zero_copy_only=False), position, pages, h, w, kind, self.astime))
            if stream is not None:
                stream.close()
        except BaseException:
            if stream is not None and not stream.closed:
                stream.close()
            for part in written:
                fs.delete_file(f"{base}/{part}")
            raise
        return Parts(written)

    def commit(self, messages: list[Parts | None]) -> None:
        """Names the parts that count; others are of tasks that were repeated."""
        fs, base = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/committed", compression=None) as out:
            for message in messages:
                out.write("".join(f"{part}\n" for part in message.parts).encode() if message else b"")

    def abort(self, messages: list[Parts | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        if fs.get_file_info(base).type == pafs.FileType.Directory:
            fs.delete_dir(base)


def _encoded(values: np.ndarray, position: int, pages: int, h: int, w: int, kind: str, astime: bool) -> bytes:
    """A page with its directory; whole-number types are rounded half up and clipped."""
    form = np.dtype("<" + kind)
    if len(values) != h * w:
        raise ValueError(f"{len(values)} pixels do not fill a frame of {h} by {w}")
    if form.kind != "f":
        values = np.clip(np.floor(values + 0.5), np.iinfo(form).min, np.iinfo(form).max)
    big, first = tiff.is_big(pages, h, w, form), tiff.note(pages, astime)
    start = tiff.place(position, pages, h, w, form, first, big)
    head = tiff.page_head(h, w, form, start, position == pages - 1, b"" if position else first, big)
    return (b"" if position else tiff.header(big)) + head + values.astype(form).tobytes()


class TiffStacks(DataSource):
    """``spark.read.format("tiff_stack")``: option ``paths`` (a JSON list) or ``path``, ``pixels`` and ``split``."""

    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def schema(self) -> str:
        return FRAME if self._pixels() else INDEX

    def _pixels(self) -> bool:
        return self.options.get("pixels", "true").lower() == "true"

    def reader(self, schema) -> StackReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return StackReader(paths, self._pixels(), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> StackWriter:
        return StackWriter(self.options["path"], self.options.get("astime", "true").lower() == "true")


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets it take conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffStacks)


def _loaded(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    register(spark)
    paths = [path] if isinstance(path, str) else list(path)
    if not any(_found(p) for p in paths):
        raise FileNotFoundError(f"no TIFF file in {', '.join(paths)}")
    return spark.read.format("tiff_stack").options(paths=json.dumps(paths), **options).load()


def read_stacks(spark: SparkSession, path: str | list[str], split: int = SPLIT) -> DataFrame:
    """Frames ``movie_id`` (name without suffix), ``path, t, h, w, pixels, kind`` (sample type) of TIFF files.

    ``path`` is a folder, whose ``.tif`` and ``.tiff`` files are taken, a file, a
    pattern or a list of them, at a place that every executor reaches.  No file
    at all is an error; so is one that is no grey movie, by name, when it is read.
    """
    return _loaded(spark, path, split=split)


def page_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All pages of TIFF files and where their pixels are, without these: ``movie_id, path, t, h, w, kind`` and their layout."""
    return _loaded(spark, path, pixels=False)


def movie_index(pages: DataFrame) -> DataFrame:
    """``movie_id, path, index, n_frames, h, w``: movies numbered by path."""
    each = pages.groupBy("movie_id", "path").agg(F.count("*").cast("int").alias("n_frames"), F.max("h").alias("h"), F.max("w").alias("w"))
    return each.select("movie_id", "path", (F.row_number().over(Window.orderBy("path")) - 1).alias("index"), "n_frames", "h", "w")  # a row for each movie


def read_pages(pages: DataFrame) -> DataFrame:
    """Frames, as ``read_stacks`` gives them, of the rows of ``page_index`` that ``pages`` has; only these are read."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, file = row["path"], _open(row["path"])
                page = tiff.Page(*(row[c] for c in ("t", "h", "w", "kind", "packing", "predictor", "piece_h", "piece_w", "offsets", "lengths")))
                with _errors_of(path):
                    yield _frame(page, path, file)

    columns = INDEX.replace(",", "").split()[::2]
    return pages.select(*columns).repartition("path", "t").sortWithinPartitions("path", "t").mapInArrow(task, FRAME)


def write_stacks(frames: DataFrame, folder: str, file: Column | None = None, kind: str | None = None, astime: bool = True, part: int = PART) -> DataFrame:
    """Writes frames ``movie_id, t, h, w, pixels`` as one stack for each ``file`` (by default ``<movie_id>.tif``).

    ``folder`` is a path or URI that every executor reaches.  Samples are of type
    ``kind``, or of the frames' column ``kind``, or 32-bit floats; whole-number types
    are rounded half up and clipped.  Frames of several sizes or types in one file
    are an error before anything is written.  Returns ``file, n`` (pages).
    """
    spark = frames.sparkSession
    register(spark)
    name = F.concat(F.col("movie_id").cast("string"), F.lit(".tif")) if file is None else file
    own = F.lit(kind) if kind else F.col("kind") if "kind" in frames.columns else F.lit("f4")
    rows = frames.select(name.alias("file"), "t", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), own.alias("kind"), F.col("pixels").cast("array<float>").alias("pixels"))
    plan = rows.select("file", "t", "h", "w", "kind")
    odd = plan.groupBy("file").agg(F.countDistinct("h", "w", "kind").alias("n"), F.count_if(F.col("t").isNull()).alias("lost"), (F.count("*") - F.countDistinct("t")).alias("twice")).where("n > 1 or lost > 0 or twice > 0").limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0]['file']}: frames of several sizes or types, or several frames of one time")
    pages = F.count("*").over(Window.partitionBy("file")).cast("int")
    position = F.row_number().over(Window.partitionBy("file").orderBy("t")) - 1  # rows without pixels
    size = F.element_at(F.map_from_arrays(F.array(*map(F.lit, (f"{k}" for k in set(tiff.SAMPLES.values())))), F.array(*[F.lit(np.dtype(k).itemsize) for k in set(tiff.SAMPLES.values())])), F.col("kind"))
    each = F.greatest(F.lit(1), F.lit(part) / (F.col("h") * F.col("w") * size + 512)).cast("int")
    placed = plan.select("file", "t", pages.alias("pages"), position.alias("position"), F.floor(position / each).cast("int").alias("part"))
    whole = rows.join(placed, ["file", "t"]).select("file", "part", "position", "pages", "h", "w", "kind", "pixels")
    staging = f"{folder.rstrip('/')}/.stack-{uuid.uuid4().hex}"
    fs, base = pafs.FileSystem.from_uri(staging)
    try:
        whole.repartition("file", "part").sortWithinPartitions("file", "part", "position").write.format("tiff_stack").option("astime", astime).mode("append").save(staging)
        listed = spark.read.text(f"{staging}/committed").select(F.col("value").alias("part_name"), F.expr("substring(value, 41)").alias("file"), F.expr("substring(value, 1, 6)").alias("part"))
        joined = listed.groupBy("file").agg(F.array_sort(F.collect_list("part_name")).alias("parts"))
        done = Scratch(spark, "files").save(joined.repartition("file").mapInArrow(_joining(folder, staging), "file string, parts int"), "written")
    finally:
        if fs.get_file_info(base).type == pafs.FileType.Directory:
            fs.delete_dir(base)
    return done.select("file").join(plan.groupBy("file").agg(F.count("*").alias("n")), "file")


def _joining(folder: str, staging: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        hidden = pafs.FileSystem.from_uri(staging)[1]
        for batch in batches:
            for row in batch.to_pylist():
                source = f"{hidden}/{row['parts'][0]}"
                if len(row["parts"]) > 1:
                    source = f"{hidden}/joined-{uuid.uuid4().hex}"
                    with fs.open_output_stream(source, compression=None) as out:
                        for part in row["parts"]:
                            with fs.open_input_stream(f"{hidden}/{part}", compression=None) as one:
                                while data := one.read(COPY):
                                    out.write(data)
                elif fs.get_file_info(source).type == pafs.FileType.NotFound:
                    if fs.get_file_info(f"{base}/{row['file']}").type == pafs.FileType.NotFound:
                        raise FileNotFoundError(source)
                    source = None  # an earlier attempt of this task has moved it
                if source:
                    fs.move(source, f"{base}/{row['file']}")
                yield pa.RecordBatch.from_pydict({"file": [row["file"]], "parts": pa.array([len(row["parts"])], pa.int32())})

    return task
