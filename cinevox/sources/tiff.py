"""The TIFF format: directories of pages, their pixels, and pages to be written."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import BinaryIO

import numpy as np

# Fixed values of the TIFF format: bytes and struct codes of its field types, its sample types, its tags.
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}
SAMPLES = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (16, 3): "f2", (32, 3): "f4", (64, 3): "f8"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, PER_PIXEL, STRIP_ROWS, LENGTHS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_LENGTHS, FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946

AHEAD = 4096
"""Bytes read at a directory at once."""


@dataclass(frozen=True)
class Page:
    """Where a page's pixels are: pieces of ``piece_h`` by ``piece_w`` (strips are as wide as the page), row by row."""

    t: int
    h: int
    w: int
    kind: str
    packing: int
    predictor: int
    piece_h: int
    piece_w: int
    offsets: tuple[int, ...]
    lengths: tuple[int, ...]


def _at(file: BinaryIO, offset: int, n: int) -> bytes:
    file.seek(offset)
    data = file.read(n)
    if len(data) < n:
        raise ValueError("the file ends too early")
    return data


def _directories(file: BinaryIO) -> Iterator[tuple[str, dict[int, tuple], bool]]:
    """Byte order and tags of each page, and whether it is the last."""
    file.seek(0)
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(f"{order}H", head, 2)[0] if order and len(head) >= 8 else 0
    if version not in (42, 43) or version == 43 and len(head) < 16:
        raise ValueError("not a TIFF file")
    word, count, entry = ("Q", "Q", 20) if version == 43 else ("I", "H", 12)
    wide = struct.calcsize(word)
    at, seen = struct.unpack_from(order + word, head, 8 if version == 43 else 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        file.seek(at)
        data = file.read(AHEAD)
        n = struct.unpack_from(order + count, data)[0]
        first = struct.calcsize(count)
        if len(data) < first + n * entry + wide:
            data = _at(file, at, first + n * entry + wide)
        tags = {}
        for k in range(n):
            tag, kind, items = struct.unpack_from(f"{order}HH{word}", data, first + k * entry)
            if kind not in SIZES:
                continue
            form, where = f"{order}{items}{SIZES[kind]}", first + k * entry + 4 + wide
            size = struct.calcsize(form)
            if size <= wide:
                tags[tag] = struct.unpack_from(form, data, where)
            else:
                where = struct.unpack_from(order + word, data, where)[0]
                inside = at <= where and where + size <= at + len(data)
                tags[tag] = struct.unpack(form, data[where - at :][:size] if inside else _at(file, where, size))
        at = struct.unpack_from(order + word, data, first + n * entry)[0]
        yield order, tags, not at or at in seen


def layout(file: BinaryIO) -> Iterator[Page]:
    """The grey pages of a file, read from its directories only; files that are no grey movie are an error.

    A stack with one directory for all its pages, as ImageJ writes large ones, gives all of them.
    """
    for t, (order, tags, last) in enumerate(_directories(file)):
        one = lambda tag, default=None: tags.get(tag, (default,))[0]  # noqa: B023, E731
        if one(PER_PIXEL, 1) != 1 or one(PHOTOMETRIC, 1) > 1:
            raise ValueError("expected a grey movie (t, y, x), got several samples a pixel")
        note = (one(DESCRIPTION) or b"").decode("latin-1")
        axes = {name: int(n) for name, n in re.findall(r"^(images|channels|slices|frames)=(\d+)", note, re.M)}
        if axes.get("channels", 1) > 1 or (axes.get("slices", 1) > 1 and axes.get("frames", 1) > 1):
            raise ValueError("expected a grey movie (t, y, x), got more axes")
        kind, h, w = SAMPLES.get((one(BITS, 1), one(FORMAT, 1))), one(HEIGHT), one(WIDTH)
        tiled = TILE_OFFSETS in tags
        offsets, lengths = (tags.get(TILE_OFFSETS if tiled else OFFSETS), tags.get(TILE_LENGTHS if tiled else LENGTHS))
        if kind is None or one(COMPRESSION, 1) not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE) or one(PREDICTOR, 1) not in (1, 2) or not (offsets and lengths and h and w):
            raise ValueError("this TIFF file's samples or packing are not supported")
        piece = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, h), h), w)
        page = Page(t, h, w, order + kind, one(COMPRESSION, 1), one(PREDICTOR, 1), *piece, offsets, lengths)
        size = h * w * np.dtype(kind).itemsize
        if not t and last and axes.get("images", 1) > 1 and page.packing == PLAIN:
            for k in range(axes["images"]):
                yield replace(page, t=k, piece_h=h, piece_w=w, offsets=(offsets[0] + k * size,), lengths=(size,))
        else:
            yield page


def unlzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 begins the table anew, 257 ends it."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, held, bits, width, before = [], 0, 0, 9, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, None
            continue
        if before is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("broken LZW data")
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
            width = min(12, (len(table) + 1).bit_length()) if len(table) >= 511 else 9
        out.append(entry)
        before = entry
    return b"".join(out)


def read_page(file: BinaryIO, page: Page) -> np.ndarray:
    """A page's pixels, of which only its own pieces are read."""
    kind = np.dtype(page.kind)
    across = -(-page.w // page.piece_w)
    out = np.zeros((-(-page.h // page.piece_h) * page.piece_h, across * page.piece_w), kind.newbyteorder("="))
    for k in range(-(-page.h // page.piece_h) * across):
        raw = _at(file, page.offsets[k], page.lengths[k])
        raw = raw if page.packing == PLAIN else unlzw(raw) if page.packing == LZW else zlib.decompress(raw)
        y, x = k // across * page.piece_h, k % across * page.piece_w
        rows = page.piece_h if page.piece_w < page.w or across > 1 or len(raw) >= page.piece_h * page.piece_w * kind.itemsize else page.h - y
        values = np.frombuffer(raw, kind, rows * page.piece_w).reshape(rows, page.piece_w)
        if page.predictor == 2:
            if kind.kind == "f":
                raise ValueError("this TIFF file's samples or packing are not supported")
            values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
        out[y : y + rows, x : x + page.piece_w] = values
    return out[: page.h, : page.w]


def header(big: bool) -> bytes:
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)


def note(pages: int, astime: bool = True) -> bytes:
    """The first page's description, by which other programs know the axis."""
    return f"ImageJ=1.11a\nimages={pages}\n{'frames' if astime else 'slices'}={pages}\n".encode().ljust(24) + b"\0"


def page_head(h: int, w: int, kind: np.dtype, start: int, last: bool, text: bytes, big: bool) -> bytes:
    """A page's directory and description, which stand at byte ``start`` and before its pixels."""
    word, long = ("Q", 16) if big else ("I", 4)
    nbytes = h * w * kind.itemsize
    entries = [(WIDTH, 4, 1, w), (HEIGHT, 4, 1, h), (BITS, 3, 1, kind.itemsize * 8), (COMPRESSION, 3, 1, PLAIN), (PHOTOMETRIC, 3, 1, 1)]
    entries += [(DESCRIPTION, 2, len(text), None)] if text else []
    entries += [(OFFSETS, long, 1, None), (PER_PIXEL, 3, 1, 1), (STRIP_ROWS, 4, 1, h), (LENGTHS, long, 1, nbytes), (FORMAT, 3, 1, {"u": 1, "i": 2, "f": 3}[kind.kind])]
    head = struct.calcsize("<Q" if big else "<H") + len(entries) * (20 if big else 12) + struct.calcsize("<" + word)
    places = {DESCRIPTION: start + head, OFFSETS: start + head + len(text)}
    out = struct.pack("<Q" if big else "<H", len(entries))
    for tag, form, n, value in entries:
        out += struct.pack(f"<HH{word}{word}", tag, form, n, places.get(tag, value))
    following = 0 if last else start + head + len(text) + nbytes
    return out + struct.pack("<" + word, following) + text


def place(position: int, pages: int, h: int, w: int, kind: np.dtype, first: bytes, big: bool) -> int:
    """Byte at which the page at ``position`` begins, in a file of ``pages`` equal pages whose first has the description ``first``."""
    own = len(page_head(h, w, kind, 0, False, b"", big)) + h * w * kind.itemsize
    extra = len(page_head(h, w, kind, 0, False, first, big)) + h * w * kind.itemsize - own
    return len(header(big)) + position * own + (extra if position else 0)


def is_big(pages: int, h: int, w: int, kind: np.dtype) -> bool:
    return pages * (h * w * kind.itemsize + 512) >= 2**32 - 2**16
