"""Duplicate fragments of at least n tokens: windows, diagonals, islands.

The operators take tokens or files of text (fid, fnm, text). Of files no token is
shuffled: a file's windows are hashed where its text is read, and only those are
that can repeat, many packed in one row by the last bits of their hash. A window's
sign is the least hash of the runs of half its length in it; windows alike have
signs alike. The signs of all files (a few for each n tokens) are counted, and
windows whose sign stands at too few places are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packed
from .windows import in_order

_KEYS = ("tokenloom-keys-1", "tokenloom-keys-2")
#: Windows of one Arrow batch.
BATCH = 1 << 17


def abstracted(tokens: DataFrame, *kinds: str) -> DataFrame:
    """Tokens of the given types stand for their type alone."""
    of = F.when(F.col("typ").startswith("const"), "const").otherwise(F.col("typ"))
    return tokens.withColumn("txt", F.when(of.isin(*kinds), F.concat(F.lit("@"), of)).otherwise(F.col("txt")))


def windows(tokens: DataFrame, n: int) -> DataFrame:
    """(fid, seq, lnr, key, key2) of each run of n tokens; the keys are 128 bits of hash of its texts.

    Hashes of runs of 1, 2, 4 .. tokens are made by doubling, each of two of half its length, over one window; the run of n
    is put together from those of the powers of two in n. So no text is collected, and a token costs a logarithm of n.
    """
    w = in_order()
    out = tokens.select("fid", "seq", "lnr", F.xxhash64("txt").alias("key"), F.xxhash64("txt", F.lit(1)).alias("key2"))
    for name in ("key", "key2"):
        out = out.withColumn(f"_all_{name}", F.lit(None).cast("long"))
    at, size = 0, 1
    while True:
        if n & size:
            for name in ("key", "key2"):
                here = F.lead(name, at).over(w)
                out = out.withColumn(f"_all_{name}", here if at == 0 else F.when(here.isNotNull(), F.xxhash64(f"_all_{name}", here)))
            at += size
        if 2 * size > n:
            break
        for name in ("key", "key2"):
            other = F.lead(name, size).over(w)
            out = out.withColumn(name, F.when(other.isNotNull(), F.xxhash64(name, other)))
        size *= 2
    return out.where("_all_key is not null").select("fid", "seq", "lnr", F.col("_all_key").alias("key"), F.col("_all_key2").alias("key2"))


def _signs(c: packed.Chunk, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the run at each token, and the sign of the window at each; whether a window ends in its row isn't asked."""
    runs = packed.runs(h, max(1, n // 2))
    return runs, packed.slide(runs, n - max(1, n // 2) + 1, np.minimum)


#: Packed rows: sign, fid, times, whether there is a fid; window, fid, seq, whether there is a fid, line; place and next place.
_SIGN, _WINDOW, _PAIR = ("i8", "i8", "i4", "?"), ("i8", "i8", "i8", "i4", "i4", "?"), ("i8", "i8", "i8", "i4", "i4")


def _sign_rows(n: int):
    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in it:
            fid, known = packed.ids(b.column(0))
            for part, c in packed.chunks(b):
                runs, sign = _signs(c, c.hashes(_KEYS[0]), n)
                if not len(sign):
                    continue
                # a run is counted where it is the sign of a window that holds it
                edge = np.zeros(len(runs) - len(sign), np.uint64)
                most = packed.slide(np.concatenate([edge, np.where(c.whole(n), sign, np.uint64(0)), edge]), len(edge) + 1, np.maximum)
                at = np.flatnonzero(most == runs)
                pair = np.lexsort((runs[at], c.row[at]))
                at = at[pair]
                new = np.ones(len(at), bool)
                new[1:] = (runs[at[1:]] != runs[at[:-1]]) | (c.row[at[1:]] != c.row[at[:-1]])
                one = np.flatnonzero(new)
                times = np.diff(np.append(one, len(at))).astype(np.int32)
                row = c.row[at[one]]
                yield runs[at[one]].view(np.int64), fid[part][row], times, known[part][row]

    return lambda it: packed.pack(rows(it), _SIGN)


def _window_rows(n: int, lines: bool):
    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in it:
            fid, known = packed.ids(b.column(0))
            for part, c in packed.chunks(b):
                h = c.hashes(_KEYS[0])
                _, sign = _signs(c, h, n)
                at = np.flatnonzero(c.whole(n) & np.isin(sign, b.column(2)[part].flatten().to_numpy().view(np.uint64)))
                key, key2 = packed.runs(h, n)[at], packed.runs(c.hashes(_KEYS[1]), n)[at]
                row = c.row[at]
                yield key.view(np.int64), key2.view(np.int64), fid[part][row], c.seq[at], c.lines(at) if lines else np.zeros(len(at), np.int32), known[part][row]

    return lambda it: packed.pack(rows(it), _WINDOW)


def _frequent(least: int):
    """(fid, sign) of the signs that stand at ``least`` or more places."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sign, fid, times, known in packed.unpack(it, _SIGN):
            order = np.argsort(sign)
            first, size = _steps(sign[order])
            at = order[np.repeat(np.add.reduceat(times[order], first, dtype=np.int64) >= least, size)]
            yield from pa.table({"fid": pa.array(fid[at], mask=~known[at]), "sign": sign[at]}).to_batches(BATCH)

    return run


def _steps(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values other than the ones before begin, and how many are alike from there."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _alike(key: np.ndarray, key2: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the windows that stand at ``least`` or more places, those of one window together, and the sizes of the windows."""
    order = np.argsort(key)
    first, size = _steps(key[order])
    both, _ = _steps(key[order], key2[order])
    if len(both) > len(first):  # a key of two windows
        order = np.lexsort((key2, key))
        first, size = _steps(key[order], key2[order])
    return order[np.repeat(size >= least, size)], size[size >= least]


def text_windows(files: DataFrame, n: int, least: int = 2, lines: bool = False) -> DataFrame:
    """As ``windows``, of files of text by the text lexer: all that stand at ``least`` or more places, and few others; packed
    and shuffled, all places of a window being in one bucket.

    A row is a file; a null text has no tokens. ``lines``: with lnr, else 0.
    """
    files = files.select(F.col("fid").cast("long").alias("fid"), F.col("text").cast("string").alias("text"))
    signs = packed.shuffled(files.mapInArrow(_sign_rows(n), packed.PACKED))
    kept = signs.mapInArrow(_frequent(least), "fid long, sign long").groupBy(F.col("fid").alias("_f")).agg(F.collect_set("sign").alias("signs"))
    some = files.join(kept, F.col("fid").eqNullSafe(F.col("_f"))).select("fid", "text", "signs")
    return packed.shuffled(some.mapInArrow(_window_rows(n, lines), packed.PACKED))


def _copies(lines: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, key2, fid, seq, lnr, known in packed.unpack(it, _WINDOW):
            at, size = _alike(key, key2, 2)
            out = {"fid": pa.array(fid[at], mask=~known[at]), "seq": seq[at].astype(np.int64)}
            if lines:
                out |= {"lnr": lnr[at], "key": key[at], "key2": key2[at]}
            yield from pa.table(out | {"copies": np.repeat(size, size)}).to_batches(BATCH)

    return run


def repeated(tokens: DataFrame, n: int, whole: bool = True) -> DataFrame:
    """(fid, seq, copies) of windows whose text stands at two or more places, and if they are ``whole`` lnr, key, key2. Of
    tokens, they are counted before they are shuffled; of files, once they are, a bucket of windows at a time in memory."""
    names = ["fid", "seq", *(["lnr", "key", "key2"] if whole else []), "copies"]
    if "text" in tokens.columns:
        return text_windows(tokens, n, lines=whole).mapInArrow(_copies(whole), ", ".join(f"{c} {'int' if c == 'lnr' else 'long'}" for c in names))
    every = windows(tokens, n)
    many = every.groupBy("key", "key2").agg(F.count("*").alias("copies")).where("copies > 1")
    return every.join(many, ["key", "key2"]).select(*names)


def _next_places(n: int):
    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for key, key2, fid, seq, _, _ in packed.unpack(it, _WINDOW):
            at, size = _alike(key, key2, 2)
            if not len(at):
                continue
            nr, fid, seq = np.repeat(np.arange(len(size)), size), fid[at], seq[at].astype(np.int64)
            order = np.lexsort((seq, fid, nr))
            nr, fid, seq = nr[order], fid[order], seq[order]
            first, size = _steps(nr, fid)  # a window's places in a file
            isle, span = np.repeat(np.arange(len(first)), size), int(seq.max()) + n + 1
            here = np.searchsorted(isle * span + seq, isle * span + seq + n)
            in_file = here < np.repeat(first + size, size)
            there = np.append(first, len(nr))[isle + 1]
            on = in_file | (np.append(nr, -1)[there] == nr)
            to = np.where(in_file, here, there)[on]
            a, b, x, y = fid[on], fid[to], seq[on], seq[to]
            line = packed.mix(packed.mix(packed.mix(a.view(np.uint64)) ^ b.view(np.uint64)) ^ (y - x).view(np.uint64))
            yield line.view(np.int64), a, b, x, y

    return lambda it: packed.pack(rows(it), _PAIR)


def _islands(n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b, x, y in packed.unpack(it, _PAIR):
            x, off = x.astype(np.int64), y.astype(np.int64) - x
            order = np.lexsort((x, off, b, a))
            a, b, off, x = a[order], b[order], off[order], x[order]
            first, size = _steps(a, b, off)
            nr = np.repeat(np.arange(len(first)), size)
            i = x - np.arange(len(x)) + first[nr]
            if ((i[1:] < i[:-1]) & (nr[1:] == nr[:-1])).any():  # places that stand twice, in rows of one fid
                order = np.lexsort((x, i, nr))
                a, b, off, x, i = a[order], b[order], off[order], x[order], i[order]
            first, size = _steps(nr, i)
            last = x[first + size - 1]
            a, b, x, off = a[first], b[first], x[first], off[first]
            out = {"a_fid": a, "a_from": x, "a_upto": last + n - 1, "b_fid": b, "b_from": x + off, "b_upto": last + n - 1 + off, "n_tokens": last + n - x}
            yield from pa.table(out).to_batches(BATCH)

    return run


def _pairs(tokens: DataFrame, n: int) -> DataFrame:
    """(fid, seq, b_fid, b_seq) of tokens: each place of a repeated window and the next one that doesn't overlap it."""
    d = repeated(tokens, n).where("fid is not null")
    # in the reverse order: a frame that ends in UNBOUNDED FOLLOWING is computed anew for each row, the square of a window's copies
    key = Window.partitionBy("key", "key2")
    here = F.min("seq").over(Window.partitionBy("key", "key2", "fid").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -n))
    there = F.min(F.struct("fid", "seq")).over(key.orderBy(F.desc("fid")).rangeBetween(Window.unboundedPreceding, -1))
    pairs = d.withColumn("_here", here).withColumn("_there", there)
    return pairs.withColumn("b_fid", F.when(F.col("_here").isNotNull(), F.col("fid")).otherwise(F.col("_there.fid"))).withColumn("b_seq", F.coalesce("_here", "_there.seq")).where("b_fid is not null")


def fragments(tokens: DataFrame, n: int = 100) -> DataFrame:
    """(a_fid, a_from, a_upto, b_fid, b_from, b_upto, n_tokens): longest common runs of at least n tokens of two places.

    Each place is held against the next place of the same window that doesn't overlap it: in its own file, else the first
    one in the next file. So copies of one fragment form a chain and the pairs stay linear in them; runs along a diagonal
    (equal distance) are one fragment.
    """
    if "text" in tokens.columns:
        pairs = packed.shuffled(text_windows(tokens.where("fid is not null"), n).mapInArrow(_next_places(n), packed.PACKED))
        return pairs.mapInArrow(_islands(n), ", ".join(f"{c} long" for c in ("a_fid", "a_from", "a_upto", "b_fid", "b_from", "b_upto", "n_tokens")))
    pairs = _pairs(tokens, n).withColumn("diagonal", F.col("b_seq") - F.col("seq"))
    line = Window.partitionBy("fid", "b_fid", "diagonal").orderBy("seq")
    isle = pairs.withColumn("_i", F.col("seq") - F.row_number().over(line)).groupBy("fid", "b_fid", "diagonal", "_i")
    out = isle.agg(F.min("seq").alias("a_from"), F.max("seq").alias("_last"))
    return out.select(
        F.col("fid").alias("a_fid"), "a_from", (F.col("_last") + n - 1).alias("a_upto"),
        "b_fid", (F.col("a_from") + F.col("diagonal")).alias("b_from"), (F.col("_last") + n - 1 + F.col("diagonal")).alias("b_upto"), (F.col("_last") + n - F.col("a_from")).alias("n_tokens"),
    )


def report(fragments_: DataFrame, tokens: DataFrame) -> DataFrame:
    """``n match of k tokens a:l1-l2 <-> b:l3-l4`` lines."""
    at = tokens.select(F.col("fid").alias("_f"), F.col("seq").alias("_s"), "fnm", "lnr")
    out = fragments_
    for side in "ab":
        for end in ("from", "upto"):
            x = at.select("_f", "_s", *([F.col("fnm").alias(f"{side}_fnm")] if end == "from" else []), F.col("lnr").alias(f"{side}_l{end}"))
            out = out.join(x, (F.col(f"{side}_fid") == F.col("_f")) & (F.col(f"{side}_{end}") == F.col("_s"))).drop("_f", "_s")
    w = Window.orderBy(F.desc("n_tokens"), "a_fid", "a_from", "b_fid", "b_from")
    return out.withColumn("nr", F.row_number().over(w)).select("nr", F.format_string("%d match of %d tokens %s:%d-%d <-> %s:%d-%d", "nr", "n_tokens", "a_fnm", "a_lfrom", "a_lupto", "b_fnm", "b_lfrom", "b_lupto").alias("report"))


def patches(fragments_: DataFrame, gap: int = 25) -> DataFrame:
    """Successive fragments of the same two files less than ``gap`` tokens apart in both."""
    w = Window.partitionBy("a_fid", "b_fid").orderBy("a_from", "b_from")
    out = fragments_.withColumn("a_gap", F.col("a_from") - F.lag("a_upto").over(w) - 1).withColumn("b_gap", F.col("b_from") - F.lag("b_upto").over(w) - 1)
    return out.where(F.col("a_gap").between(0, gap - 1) & F.col("b_gap").between(0, gap - 1))


def _clones(least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, key2, fid, seq, _, known in packed.unpack(it, _WINDOW):
            at, size = _alike(key, key2, least)
            nr, fid, seq, known = np.repeat(np.arange(len(size)), size), fid[at], seq[at].astype(np.int64), known[at]
            order = np.lexsort((seq, fid, known, nr))  # places of no file first, as in the order of Spark
            some = order[known[order]]
            of = nr[some][_steps(nr[some], fid[some])[0]]
            one = order[np.cumsum(size) - size]
            out = {"copies": size, "files": np.bincount(of, minlength=len(size)), "first_fid": pa.array(fid[one], mask=~known[one]), "first_seq": seq[one]}
            yield from pa.table(out).to_batches(BATCH)

    return run


def multiclones(tokens: DataFrame, n: int = 100, least: int = 3) -> DataFrame:
    """(copies, files, first_fid, first_seq) of each window that stands at ``least`` or more places, with the first of them."""
    if "text" in tokens.columns:
        return text_windows(tokens, n, least).mapInArrow(_clones(least), "copies long, files long, first_fid long, first_seq long")
    out = windows(tokens, n).groupBy("key", "key2").agg(F.count("*").alias("copies"), F.countDistinct("fid").alias("files"), F.min(F.struct("fid", "seq")).alias("at"))
    return out.where(F.col("copies") >= least).select("copies", "files", F.col("at.fid").alias("first_fid"), F.col("at.seq").alias("first_seq"))
