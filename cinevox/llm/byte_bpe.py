"""Byte-level BPE by sentencepiece, on a model written out from a rank file.

A rank file lists byte strings by merge rank.  The same vocabulary is serialised
here as a sentencepiece BPE model: every byte is one printable character, a piece
is the characters of its bytes, and its score is its negative rank, so that the
best-scored merge is the one of least rank.  The normaliser is the identity.
Texts are split by the tokenizer's pattern first and each match is encoded alone;
ids decode by the inverse of the byte mapping.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import in_arrow
from .textkit import blocks, utf8

CACHE = 1 << 18
"""Pre-tokens whose ids a task keeps, and a sixteenth of their ids; beyond so many it starts anew."""


@lru_cache
def byte_characters() -> list[str]:
    """The printable character of each byte: itself if it is one, else the next free one from U+0100 on."""
    out, free = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file, by rank; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    pieces = [b""] * len(pairs)
    for token, rank in pairs:
        pieces[int(rank)] = base64.b64decode(token)
    if not all(pieces) or len(set(pieces)) != len(pieces):
        raise ValueError(f"{path}: ranks or pieces repeat")
    return pieces


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | str | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(pieces: Sequence[bytes]) -> bytes:
    """The vocabulary as a serialised sentencepiece model; the id after the last rank is for unknown pieces."""
    character = byte_characters()
    # Fixed values of the public model format: piece (text 1, score 2, type 3; 1 normal, 2 unknown); trainer
    # (model type 3, here 2 for BPE; size 4; ids of unknown, begin, end, padding 40 to 43); normaliser (name 1,
    # dummy prefix 3, white space removed 4, white space escaped 5).
    out = [_field(1, _field(1, "".join(character[b] for b in p)) + _field(2, float(-i)) + _field(3, 1)) for i, p in enumerate(pieces)]
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    out.append(_field(2, _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, -1) + _field(42, -1) + _field(43, -1)))
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.pieces = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.pieces))
        self._map = {b: c for b, c in enumerate(byte_characters())}
        self._forget()
        length = np.array([len(p) for p in self.pieces])
        self._length, self._start = length, np.cumsum(length) - length
        self._bytes = np.frombuffer(b"".join(self.pieces), np.uint8)

    def _mapped(self, token: str) -> str:
        return token.encode().decode("latin-1").translate(self._map)

    def _forget(self) -> None:
        self._code: dict[str, int] = {}
        self._text: list[str] = []
        self._ids = np.zeros(0, np.int32)
        self._ends = np.zeros(1, np.int64)
        self._size = self._used = 0

    def _learn(self, tokens: list[str]) -> None:
        """Keeps the ids of each token: of the token with code ``c`` those up to ``_ends[c + 1]``."""
        ids = self._model.encode([self._mapped(t) for t in tokens], out_type=int, num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        if self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids[: self._used], np.empty(self._used + len(flat), np.int32)])
        if self._size + len(tokens) >= len(self._ends):
            self._ends = np.concatenate([self._ends[: self._size + 1], np.empty(self._size + len(tokens), np.int64)])
        self._ids[self._used : self._used + len(flat)] = flat
        self._ends[self._size + 1 : self._size + len(tokens) + 1] = self._used + np.cumsum([len(x) for x in ids])
        self._text += [" ".join(map(str, x)) for x in ids]
        self._code.update(zip(tokens, range(self._size, self._size + len(tokens)), strict=True))
        self._size, self._used = self._size + len(tokens), self._used + len(flat)

    def encode_many(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of each text, and the same in decimal, joined by one space; new pre-tokens of all texts are encoded together."""
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self._code)
        if new:
            if self._size + len(new) > CACHE or self._used > 16 * CACHE:
                self._forget()
                new = set().union(*split)
            self._learn(list(new))
        for tokens in split:
            codes = list(map(self._code.__getitem__, tokens))
            code = np.array(codes, np.int64)
            start, length = self._ends[code], self._ends[code + 1] - self._ends[code]
            ends = np.cumsum(length)
            total = int(ends[-1]) if len(ends) else 0
            yield self._ids[np.arange(total) + np.repeat(start - (ends - length), length)], " ".join(map(self._text.__getitem__, codes))

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))[0]

    def decode(self, ids: Sequence[int]) -> bytes:
        ids = np.asarray(ids, np.int64)
        length = self._length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self._bytes[np.arange(total) + np.repeat(self._start[ids] - (ends - length), length)].tobytes()


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    """One for each task process."""
    return ByteBPE(path, pattern)


def _encode(path: str, pattern: str, decoded: bool = True):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for a, texts in _texts(batch):
                lists = [ids for ids, _ in bpe.encode_many(texts)]
                ends = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
                back = [bpe.decode(x) for x in lists]
                last = pa.array(back, pa.binary()) if decoded else pa.array([x == t.encode() for x, t in zip(back, texts, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(a, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))), last],
                    names=["doc", "ids", "decoded" if decoded else "exact"],
                )

    return task


def _digest(path: str, pattern: str):
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for a, texts in _texts(batch):
                rows = [(len(ids), digest(line.encode()), digest(bpe.decode(ids))) for ids, line in bpe.encode_many(texts)]
                n, ids, decoded = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    return task


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Texts in blocks, each with the number of its first row."""
    data, offsets = utf8(batch.column("text"))
    for a, b in blocks(offsets, 1 << 20):
        yield a, [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(a, b)]


def _run(docs: DataFrame, make, fields: str, text_col: str, path: str | None, pattern: str, columns: Sequence[str] | None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    columns = list(columns or docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(text_col).alias("text"))
    return in_arrow(rows, make(path, pattern), T.StructType([rows.schema["doc"], *T._parse_datatype_string(fields).fields]))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, columns: Sequence[str] | None = None, decoded: bool = True) -> DataFrame:
    """``doc`` (a struct of ``columns``, by default all), ``ids`` and ``decoded``, the bytes that the ids stand for.

    Without ``decoded`` there is ``exact`` instead: whether they are the text's.
    One row per input row, without special tokens.  A null text counts as an
    empty one and has no ids.
    """
    fields = "ids array<int>, decoded binary" if decoded else "ids array<int>, exact boolean"
    return _run(docs, partial(_encode, decoded=decoded), fields, text_col, path, pattern, columns)


def encode_digests(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, columns: Sequence[str] | None = None) -> DataFrame:
    """As ``encode``, with ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and ``decoded_sha256``."""
    return _run(docs, _digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", text_col, path, pattern, columns)
