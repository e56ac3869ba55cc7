"""Operator 1: exact passage dedup over a distributed sparse suffix array.

Communication-efficient string sorting (Bingmann, Sanders, Schimek, 2020) on
suffixes at word positions. Passages of ``LENGTH`` (50) words that stand in two
or more documents are found, exactly:

1. Anchors. A position is kept if the hash of its 25-gram is the least of some
   window of 26 positions, so every passage of 50 words holds an anchor whose
   25-gram lies within it (winnowing). Only their suffixes are sorted.
2. Duplicate detection: anchors whose 25-gram stands in one document only have a
   unique distinguishing prefix already; they leave.
3. Exchange. Every task sorts its suffixes by (25-gram hash, words), front-codes
   the sorted runs (common prefix with the one before, then the rest) and sends
   them to the bucket of their hash.
4. Merge. A loser tree whose nodes know the common prefix with the last winner
   merges a bucket's runs; strings with unequal known prefixes are ordered
   without a look at them, others compared only from there on. Its by-product is
   the LCP array.
5. A passage that begins t words before an anchor repeats if two suffixes agree
   in 50 - t words (an interval of the LCP array) and the t words before agree
   (likewise, in the sorted left contexts). Spans are united by document.

Result: (doc_id, start_word, end_word, n_words), maximal unions of repeated
passages, in words as the text kernel counts them.

Nulls: rows without an id or text take no part. Empty and short texts repeat
nothing. Very long texts are processed whole. Rows of one doc_id count as one
document, so repeated rows don't repeat each other. Repeats within one document
alone are not reported. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BIN, INT, LONG, buckets, materialize, schema, texts
from .kernel import Chunk, chunks, slide

LENGTH, GRAM = 50, 25
WINDOW = LENGTH - GRAM + 1
#: Bytes of suffixes that a task sorts at once.
RUN = 48 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def anchors(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word number of the chunk's anchors."""
    g, at = c.grams(GRAM)
    if len(g) < WINDOW:
        return g[:0], at[:0]
    doc = c.doc[at]
    least = np.where(doc[: len(g) - WINDOW + 1] == doc[WINDOW - 1 :], slide(g, WINDOW), np.uint64(0))
    edge = np.zeros(WINDOW - 1, np.uint64)
    on = slide(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == g
    return g[on], at[on]


def _anchor_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for c in chunks(b):
            g, at = anchors(c)
            doc = c.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.ids[doc], pa.int64()), pa.array((at - c.first[doc]).astype(np.int32))], ["h", "doc_id", "pos"])


def encode(run: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run, front-coded: (key, left, doc, pos) -> one compressed blob."""
    lcp, rest, lefts, before = [], [], [], b""
    for key, left, _, _ in run:
        n = common(before, key, 0)
        lcp.append(n)
        rest.append(key[n:])
        lefts.append(left)
        before = key
    t = pa.record_batch([pa.array(lcp, pa.int32()), pa.array(rest, pa.binary()), pa.array(lefts, pa.binary()), pa.array([r[2] for r in run], pa.int64()), pa.array([r[3] for r in run], pa.int32())], ["lcp", "rest", "left", "doc", "pos"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(t)
    return sink.getvalue().to_pybytes()


def decode(blob: bytes) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(common prefix with the one before, key, left, doc, pos) in order."""
    t = pa.ipc.open_stream(blob).read_all()
    key = b""
    for n, rest, left, doc, pos in zip(*(t.column(i).to_pylist() for i in range(5)), strict=True):
        key = key[:n] + rest
        yield n, key, left, doc, pos


def common(a: bytes, b: bytes, n: int) -> int:
    """Length of the common prefix, of which n bytes are known."""
    end = min(len(a), len(b))
    if a[n:end] == b[n:end]:
        return end
    step = 64
    while step:
        if n + step <= end and a[n : n + step] == b[n : n + step]:
            n += step
        else:
            step >>= 1
    return n


def merge(runs: list[Iterator[tuple[int, bytes, bytes, int, int]]]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """Merge sorted runs; each result carries its common prefix with the one before.

    A tree of losers: node x holds the run that lost there and the length of its
    common prefix with the run that won against it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # common prefix of each head with the last winner
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common(x[1], y[1], known[a])
        if x[1][n : n + 1] <= y[1][n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = play(build(2 * node), build(2 * node + 1))
        tree[node] = lose
        return win

    win = build(1)
    while (head := heads[win]) is not None:
        yield (known[win], *head[1:])
        heads[win] = following = next(runs[win], None)
        known[win] = following[0] if following else 0
        node = (win + k) // 2
        while node:
            win, tree[node] = play(win, tree[node])
            node //= 2


def repeats(items: list[tuple[int, bytes, bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and word ranges of repeated passages, from sorted suffixes with their LCPs."""
    n = len(items)
    doc = np.array([x[3] for x in items], np.int64)
    pos = np.array([x[4] for x in items], np.int64)
    words = np.array([x[1].count(b" ", 8, x[0]) if x[0] > 8 else 0 for x in items])  # common with the one before
    group = np.cumsum(words < GRAM)
    order = sorted(range(n), key=lambda i: (group[i], items[i][2]))
    left = np.zeros(n, np.int64)
    for x, y in zip(order, order[1:]):
        if group[x] == group[y]:
            a, b = items[x][2], items[y][2]
            left[y] = a.count(b" ", 0, common(a, b, 0))
    length, order = np.array([x[2].count(b" ") for x in items]), np.array(order)
    low, high = np.full(n, -1), np.full(n, -1)
    for t in range(WINDOW):
        right = np.cumsum(words < LENGTH - t)
        cls = np.empty(n, np.int64)
        cls[order] = np.cumsum((left[order] < t) | (group[order] != np.roll(group[order], 1)))
        ok = np.flatnonzero(length >= t)
        key = right[ok] * (n + 1) + cls[ok]
        by = ok[np.argsort(key, kind="stable")]
        key = np.sort(key)
        if len(by):
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.minimum.reduceat(doc[by], start) != np.maximum.reduceat(doc[by], start)
            hit = by[np.repeat(many, np.diff(np.append(start, len(by))))]
            low[hit[low[hit] < 0]] = t
            high[hit] = t
    hit = np.flatnonzero(high >= 0)
    return doc[hit], pos[hit] - high[hit], pos[hit] - low[hit] + LENGTH


def _send(parts: int):
    def flush(held: dict[int, list]) -> pa.RecordBatch:
        keys = sorted(held)
        for x in held.values():
            x.sort()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([encode(held[x]) for x in keys], pa.binary())], ["bucket", "run"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for b in it:
            lists = b.column(b.schema.get_field_index("at"))
            row = 0
            for c in chunks(b):
                low = c.data.tobytes().translate(_FOLD)
                g = dict(zip(*(x.tolist() for x in anchors(c)[::-1]), strict=True))
                for d in range(len(c.ids)):
                    first, end, doc = int(c.first[d]), int(c.first[d + 1]), int(c.ids[d])
                    w = [low[x:y] + b" " for x, y in zip(c.ws[first:end].tolist(), c.we[first:end].tolist(), strict=True)]
                    for p in {*lists[row].as_py()}:
                        if (h := g.get(first + p)) is not None and p < len(w):
                            key = h.to_bytes(8, "big") + b"".join(w[p : p + LENGTH])
                            left = b"".join(w[max(0, p - LENGTH + GRAM) : p][::-1])
                            held.setdefault(h % parts, []).append((key, left, doc, p))
                            size += len(key) + len(left) + 200
                    row += 1
                    if size > RUN:
                        yield flush(held)
                        held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _merge(key, t):  # no annotations: Spark would read them
    found = repeats(list(merge([decode(x.as_py()) for x in t.column("run")])))
    return pa.table({"doc_id": pa.array(found[0], pa.int64()), "a": pa.array(found[1].astype(np.int32)), "b": pa.array(found[2].astype(np.int32))})


def passages(docs: DataFrame) -> DataFrame:
    rows = texts(docs)
    found = rows.mapInArrow(_anchor_rows, schema(h=LONG, doc_id=LONG, pos=INT))
    w = Window.partitionBy("h")
    twice = found.withColumn("x", F.min("doc_id").over(w)).withColumn("y", F.max("doc_id").over(w)).where("x < y")
    at = materialize(twice.groupBy("doc_id").agg(F.collect_list("pos").alias("at")), "anchors")
    runs = rows.join(at, "doc_id").mapInArrow(_send(4 * buckets(docs.sparkSession)), schema(bucket=INT, run=BIN))
    spans = runs.groupBy("bucket").applyInArrow(_merge, schema(doc_id=LONG, a=INT, b=INT))
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    isle = spans.withColumn("new", F.when(F.col("a") <= before, 0).otherwise(1)).withColumn("isle", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = isle.groupBy("doc_id", "isle").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def query(spark, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    return f"""WITH docs AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents WHERE text IS NOT NULL),
wins AS (SELECT doc_id, i - 1 AS a, array_to_string(list_slice(w, i, i + {LENGTH - 1}), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM docs)),
twice AS (SELECT doc_id, a FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS x, max(doc_id) OVER (PARTITION BY s) AS y FROM wins) WHERE x < y),
isles AS (SELECT doc_id, a, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS isle FROM (SELECT doc_id, a, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + {LENGTH} THEN 0 ELSE 1 END AS new FROM twice))
SELECT doc_id, min(a)::INT AS start_word, (max(a) + {LENGTH})::INT AS end_word, (max(a) + {LENGTH} - min(a))::INT AS n_words FROM isles GROUP BY doc_id, isle"""
