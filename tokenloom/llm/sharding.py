"""Operator 3: a reproducible global shuffle into shards.

Documents get dense global row numbers in the order of (doc_id, then the other
columns' hash, for repeated ids). A Feistel network over the smallest even
number of bits that covers them, walked along its cycle until the value is in
range, permutes the row numbers: shard and slot of any row can be computed from
its number alone, and back.

An id of which there are more rows than in a range (a null id too) is several
ranges, by the hash of the other columns, so no id is one task's work.

Nulls: a null doc_id orders before all others; null texts are kept. Empty texts
are documents like any other. Ties: rows equal in every column are
interchangeable, and each gets a number of its own. An empty table gives an
empty result. Extra columns are kept; if one is called ``row_num``, ``shard``
or ``slot``, the operator's column takes the first free name with a digit behind.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, buckets, schema, unused

ROUNDS = 4
#: Ids that begin a range, at most (as many shuffle partitions are beyond any use); the driver gets a count for each range.
RANGES = 1 << 15
_MUL = 1_103_515_245


def keys(seed: int) -> list[int]:
    return [(seed * 2_654_435_761 + r * 40_503 + 12_345) % (1 << 31) for r in range(1, ROUNDS + 1)]


def half_bits(n: int) -> int:
    """Half the bits of the domain: the least w with 4**w >= n."""
    w = 1
    while 4**w < n:
        w += 1
    return w


def feistel(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permutation of 0..n-1, by cycle walking over 0..4**w-1."""
    w = half_bits(n)
    mask = np.int64((1 << w) - 1)
    x = x.astype(np.int64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> w, x[todo] & mask
        for k in keys(seed):
            f = right * _MUL + k
            left, right = right, left ^ ((f ^ (f >> 15)) & mask)
        x[todo] = y = (left << w) | right
        todo = todo[y >= n]
    return x


def unfeistel(y: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The inverse of feistel: which row number stands at a place."""
    w = half_bits(n)
    mask = np.int64((1 << w) - 1)
    y = y.astype(np.int64)
    todo = np.arange(len(y))
    while len(todo):
        left, right = y[todo] >> w, y[todo] & mask
        for k in reversed(keys(seed)):
            f = left * _MUL + k
            left, right = right ^ ((f ^ (f >> 15)) & mask), left
        y[todo] = x = (left << w) | right
        todo = todo[x >= n]
    return y


def _longs(x: list) -> Column:
    """A literal array (of arrays) of longs, one expression whatever its length."""
    return F.from_json(F.lit(json.dumps(x)), "array<array<bigint>>" if x and isinstance(x[0], list) else "array<bigint>")


def _search(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are <= x: a look at every root-th bound, then at those between two."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    run = F.greatest(F.size(F.filter(_longs([r[0] for r in runs]), lambda b: b <= x)), F.lit(1))
    return (run - 1) * step + F.size(F.filter(F.element_at(_longs(runs), run), lambda b: b <= x))


def row_numbers(docs: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``row_num`` as the last column, 0-based and dense; and the number of rows.

    Ranges of doc_id (bounds from approximate quantiles, one number per
    partition) are numbered apart and shifted by the counts before them. An id
    that is several quantiles is a range by itself, cut by the hash that orders it.
    """
    parts = min(buckets(docs.sparkSession), RANGES)
    key = F.col("doc_id").cast("long")
    rest = [F.col(f"`{c}`").cast("string") for c in sorted(docs.columns) if c != "doc_id" and not dict(docs.dtypes)[c].startswith(("map", "variant"))]
    found = docs.select(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts)), F.count("*"), F.count(key)).head()
    cuts = Counter(found[0] or [])
    hot = {x: n for x, n in cuts.items() if n > 1}
    bounds = sorted({*cuts, *(x + 1 for x in hot if x < (1 << 63) - 1)})
    at = {x: i + 1 for i, x in enumerate(bounds)}
    # the first number of each range, null ids being the first; a hot id has several
    pieces = [1] * (len(bounds) + 2)
    pieces[0] = max(1, math.ceil(parts * (found[1] - found[2]) / max(found[1], 1)))
    for x, n in hot.items():
        pieces[at[x] + 1] = n + 1
    starts = [0, *np.cumsum(pieces).tolist()]
    names = [unused(docs, n) for n in ("hash", "range")]
    h, part = (F.col(n) for n in names)
    of = F.when(key.isNull(), 0).otherwise(_search(key, bounds) + 1)
    place = lambda x: F.element_at(_longs(x), (of + 1).cast("int"))
    high = F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 32)  # the hash's order, as 32 bits
    marked = docs.withColumn(names[0], F.xxhash64(*rest) if rest else F.lit(0).cast("long")).withColumn(names[1], place(starts) + F.shiftright(high * place(pieces), 32))
    counts = dict(marked.groupBy(part).count().collect())  # at most 4 x RANGES rows
    before, total = [], 0
    for p in range(starts[-1]):
        before.append(total)
        total += counts.get(p, 0)
    w = Window.partitionBy(part).orderBy(key, h)
    out = marked.withColumn(unused(docs, "row_num"), F.row_number().over(w) - 1 + F.element_at(_longs(before), (part + 1).cast("int")))
    return out.drop(*names), total


def _place(n: int, per: int, seed: int, names: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = feistel(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), n, seed)
            yield b.append_column(names[-2], pa.array(at // per, pa.int64())).append_column(names[-1], pa.array(at % per, pa.int64()))

    return run


def shard(docs: DataFrame, shards: int = 64, seed: int = 17) -> DataFrame:
    """All rows and columns of ``docs``, with ``row_num``, ``shard`` and ``slot``.

    Each shard has ceil(n / shards) slots, so all but the last ones are full.
    """
    numbered, n = row_numbers(docs)
    per = max(1, -(-n // shards))
    out = T.StructType([*numbered.schema, *schema(**{unused(docs, k): LONG for k in ("shard", "slot")})])
    return numbered.mapInArrow(_place(n, per, seed, out.names), out)


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(shards: int = 64, seed: int = 17) -> str:
    """The same by a recursive walk; ids are unique in the table that it is for."""
    left, right = "(v >> w)", "(v & mask)"
    steps, l, r = [], "l0", "r0"
    for i, k in enumerate(keys(seed), 1):
        f = f"(r{i - 1} * {_MUL} + {k})"
        steps.append(f"SELECT row_num, w, mask, n, {r} AS l{i}, xor({l}, (xor({f}, {f} >> 15)) & mask) AS r{i} FROM ")
        l, r = f"l{i}", f"r{i}"
    inner = f"(SELECT row_num, w, mask, n, {left} AS l0, {right} AS r0 FROM walk WHERE v >= n OR step = 0)"
    for i, s in enumerate(steps, 1):
        inner = f"({s}{inner} s{i})"
    return f"""WITH RECURSIVE size AS (SELECT count(*)::BIGINT AS n, greatest(1, ceil(log2(greatest(count(*), 2)) / 2))::INT AS w FROM documents),
walk AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_num, row_number() OVER (ORDER BY doc_id) - 1 AS v, 0 AS step, w, ((1::BIGINT << w) - 1) AS mask, n FROM documents, size
  UNION ALL SELECT row_num, (l{ROUNDS} << w) | r{ROUNDS} AS v, 1 AS step, w, mask, n FROM {inner} t),
done AS (SELECT row_num, v, n FROM walk WHERE step = 1 AND v < n),
ids AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_num FROM documents)
SELECT doc_id, text, lang, source, n_chars, ids.row_num, v // ((n + {shards - 1}) // {shards}) AS shard, v % ((n + {shards - 1}) // {shards}) AS slot FROM ids JOIN done USING (row_num)"""
