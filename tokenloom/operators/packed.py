"""Text tokens of whole Arrow batches, in numpy: the kernel under searches and windows that need a file's tokens in order.

A file is one row, so its tokens are in order where its text is read and nothing need be shuffled to put them so. The tokens
are those of ``lexer.text_tokens``: maximal runs of ASCII letters, digits and ``_``, and single other characters. Texts are
compared exactly, by their places in a dictionary of the chunk; no Python string is made for a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_BYTES = np.arange(256)
_SPACE, _WORD, _OTHER, _MORE = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[(_BYTES >= 128) & (_BYTES < 192)] = _MORE  # within a character
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES == 95)] = _WORD
#: Bytes of text lexed at once; a longer text is a chunk by itself.
SIZE = 1 << 20
#: Buckets of hashes in which packed rows are shuffled, and how many rows are packed at once.
BUCKETS, ROWS = 1 << 10, 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ mix(b + np.uint64(0xD1B54A32D192ED03)))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values: those of 1, 2, 4 .. by doubling, n put together from the powers of two in it."""
    out, at, size = None, 0, 1
    while len(h) and at < n:
        if n & size:
            part = h[at:]
            out = part if out is None else _joined(out[: len(part)], part)
            at += size
        h, size = _joined(h[: max(0, len(h) - size)], h[size:]), 2 * size
    return h[:0] if out is None or at < n else out


def slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """Least or greatest of each w consecutive values."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x, done = f(x[: max(0, len(x) - step)], x[step:]), done + step
    return x


class Chunk:
    """Some rows' tokens: ``row`` and ``seq`` of each, ``codes`` of their texts in ``words``, lines on demand."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        kind = _CLASS[data]
        word = kind == _WORD
        first = word.copy()
        first[1:] &= ~word[:-1]
        edge = bounds[bounds < len(data)]
        first[edge] = word[edge]
        self.starts = np.flatnonzero(first | (kind == _OTHER))
        kept = kind != _SPACE
        at = (np.cumsum(kept) - 1)[self.starts] if len(self.starts) else self.starts
        letters = data[kept]
        offsets = np.append(at, len(letters)).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
        coded = texts.dictionary_encode()
        self.codes, self.words = coded.indices.to_numpy(), coded.dictionary
        ends = np.searchsorted(self.starts, bounds)
        self.first = ends[:-1]
        self.row = np.repeat(np.arange(len(bounds) - 1), np.diff(ends))
        self.seq = np.arange(len(self.starts)) - self.first[self.row]

    def hashes(self, key: str) -> np.ndarray:
        """64 bits of each token's text, by a key of 16 letters."""
        words = self.words.to_numpy(zero_copy_only=False)
        return mix(pd.util.hash_array(words, hash_key=key, categorize=False).astype(np.uint64))[self.codes] if len(words) else np.zeros(0, np.uint64)

    def code(self, text: str) -> int:
        """The code of a text, -1 if no token has it."""
        return pc.index(self.words, pa.scalar(text, self.words.type)).as_py()

    @cached_property
    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of line ends, and how many of them come before each row."""
        ends = np.flatnonzero(self.data == 10)
        return ends, np.searchsorted(ends, self.bounds)

    def lines(self, at: np.ndarray) -> np.ndarray:
        """Lines of the tokens of these numbers, from 1 in each row."""
        ends, before = self._ends
        return (np.searchsorted(ends, self.starts[at]) - before[self.row[at]] + 1).astype(np.int32)

    def whole(self, n: int) -> np.ndarray:
        """Whether a token and the n - 1 after it are of one row, for each that has so many after it."""
        return self.row[: max(0, len(self.row) - n + 1)] == self.row[n - 1 :]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = SIZE) -> Iterator[tuple[slice, Chunk]]:
    """Rows of about ``size`` bytes at a time, as a slice of the batch, and their tokens; a null text has none."""
    a = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield slice(i, j), Chunk(data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers with 0 for a null, and which are none."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


# packed rows: the JVM takes longest over single values, so that it is given many rows in one


def pack(rows: Iterator[tuple[np.ndarray, ...]], kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(bucket, rows) of columns of these numpy types, wide ones first; the bucket is the last bits of the first column, a hash."""
    held, n = [], 0

    def put() -> pa.RecordBatch:
        cols = [np.concatenate(x).astype(k, copy=False) for x, k in zip(zip(*held, strict=True), kinds, strict=True)]
        bucket = (cols[0] & (BUCKETS - 1)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cols, ends = [x[order] for x in cols], np.append(0, np.cumsum(np.bincount(bucket, minlength=BUCKETS)))
        some = np.flatnonzero(np.diff(ends))
        blobs = [b"".join([x[ends[k] : ends[k + 1]].tobytes() for x in cols]) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "rows"])

    for cols in rows:
        for i in range(0, len(cols[0]), ROWS):
            held.append([x[i : i + ROWS] for x in cols])
            n += len(held[-1][0])
            if n >= ROWS:
                yield put()
                held, n = [], 0
    if held:
        yield put()


PACKED = "bucket int, rows binary"


def shuffled(df: DataFrame) -> DataFrame:
    """Packed rows with each bucket in one task, bucket by bucket."""
    return df.repartition("bucket").sortWithinPartitions("bucket")


def unpack(it: Iterator[pa.RecordBatch], kinds: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket's rows, of what ``shuffled`` gives."""
    width = sum(np.dtype(k).itemsize for k in kinds)

    def columns(blobs: list[pa.Buffer]) -> list[np.ndarray]:
        parts, at = [[] for _ in kinds], [0] * len(blobs)
        for part, k in zip(parts, kinds, strict=True):
            for i, x in enumerate(blobs):
                part.append(np.frombuffer(x, k, len(x) // width, at[i]))
                at[i] += part[-1].nbytes
        return [np.concatenate(x) for x in parts]

    held, last = [], None
    for b in it:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if bucket != last and held:
                yield columns(held)
                held = []
            last = bucket
            held.append(blob.as_buffer())
    if held:
        yield columns(held)
