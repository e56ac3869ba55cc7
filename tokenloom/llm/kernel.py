"""Words and rolling hashes of whole Arrow batches, in numpy.

A batch's texts are one run of bytes; words, their hashes and the hashes of
word n-grams come from cumulative sums over it, without Python strings.
A word is a maximal run of ASCII letters, digits, ``_`` and bytes of non-ASCII
characters; ASCII letters are folded to lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CACHE: dict[str, np.ndarray] = {}
_BYTES = np.arange(256)
_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES == 95) | (_BYTES >= 128)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(1)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if "p" not in _CACHE or len(_CACHE["p"]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("p", _BASE), ("i", _INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _CACHE[name] = np.cumprod(x, dtype=np.uint64)
    return _CACHE["p"][:n], _CACHE["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; len(h) - k + 1 of them, or none."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    p, i = powers(n + 1)
    s = _sums(h * p[:n])
    return mix((s[k:] - s[: n - k + 1]) * i[: n - k + 1] + np.uint64(k))


class Chunk:
    """Some texts: ``data`` bytes, ``bounds`` of each text, words ``ws:we`` with
    hashes ``h``; ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, spaces: bool = False):
        self.data, self.bounds, self.ids = data, bounds, ids
        n = len(data)
        mask = ~_SPACE[data] if spaces else _WORD[data]
        before = np.zeros(n, bool)
        before[1:] = mask[:-1]
        inner = bounds[(bounds > 0) & (bounds < n)]
        before[inner] = False
        self.ws = np.flatnonzero(mask & ~before)
        after = np.zeros(n, bool)
        after[:-1] = mask[1:]
        after[inner - 1] = False
        self.we = np.flatnonzero(mask & ~after) + 1
        p, i = powers(n + 1)
        s = _sums(_LOWER[data] * p[:n])
        self.h = mix((s[self.we] - s[self.ws]) * i[self.ws])
        self.first = np.searchsorted(self.ws, bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-grams that lie in one text, and their first words' numbers."""
        g = ngrams(self.h, k)
        at = np.flatnonzero(self.doc[: len(g)] == self.doc[k - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
        return g[at], at


def chunks(batch: pa.RecordBatch, column: str = "text", ids: str = "doc_id", size: int = 1 << 20, spaces: bool = False) -> Iterator[Chunk]:
    """Runs of rows of about ``size`` bytes; a longer text is a chunk by itself. ``ids`` must have no nulls."""
    a = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    key = batch.column(batch.schema.get_field_index(ids)).to_numpy(zero_copy_only=False)
    a = a.fill_null("")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield Chunk(data[off[i] : off[j]], (off[i : j + 1] - off[i]).astype(np.int64), key[i:j], spaces)
        i = j


def slide(x: np.ndarray, w: int, f: np.ufunc = np.minimum) -> np.ndarray:
    """Minimum (or another idempotent f) of each w consecutive values."""
    n, done, y = len(x) - w + 1, 1, x
    if n <= 0:
        return x[:0]
    while done < w:
        step = min(done, w - done)
        y = f(y[: len(y) - step], y[step:])
        done += step
    return y[:n]
