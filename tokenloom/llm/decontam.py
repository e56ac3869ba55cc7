"""Operator 10: benchmark decontamination by BM25 with block-max WAND.

The test items are an inverted index of word 2-grams with BM25 weights, in
posting blocks that know their greatest weight. Every training document is cut
into passages of 2s words, s apart, s being at least the longest item, so any
copy of an item lies whole in one passage. Every passage is a query; all items
with at least ``share`` of the score that the item itself would get are
retrieved (block-max WAND skips what cannot reach that), and verified in windows
sized like the passages, but by the item's own length (64 words at least): in
one of them it must reach its share of the score, and half of the distinct
3-grams of its question and half of the 2-grams of its answer (its last
sentence) must stand. A question or answer of fewer words is one run of words
that must stand there.

An upper bound summed over the passage's words by numpy settles most passages
before any list is opened; it skips only what WAND could not return either.

Nulls: rows without an id or a text take no part, on both sides. Empty texts and
items of fewer than two words match nothing. Very long texts are cut like any
other. Repeated items are items of their own; of repeated rows of a document the
best score counts. Empty tables give an empty result. Extra columns are ignored
by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DBL, LONG, schema, texts, without
from .kernel import Chunk, chunks, ngrams

K1, B, BLOCK = 1.2, 0.75, 16
#: Words of the shortest passage step.
LEAST = 64
#: Items per index; a larger benchmark is searched in several passes.
SHARD_ITEMS = 50_000
#: Bytes of items that the driver takes; test sets are small beside a corpus, and more is an error, not a cut.
MOST_BYTES = 256 << 20


def _hashes(text: str, k: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return ngrams(Chunk(data, np.array([0, len(data)]), np.zeros(1)).h, k)


def parts(text: str) -> tuple[str, str]:
    """Question and answer: all sentences but the last, and the last; of one sentence, its halves."""
    s = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if re.search(r"\w", x)]
    if len(s) > 1:
        return " ".join(s[:-1]), s[-1]
    w = text.split()
    return " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])


def grams_of(text: str, k: int) -> tuple[int, set[int]]:
    """The distinct k-grams of a text and k; of a text of fewer words, all its words as one."""
    k = max(1, min(k, len(_hashes(text, 1))))
    return k, {*_hashes(text, k).tolist()}


class Index:
    """Postings of some items; df, N and mean length are those of the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], stats: tuple[dict[int, int], int, float], share: float):
        df, n, mean = stats
        rows = []
        for key, text in items:
            terms, tf = np.unique(_hashes(text, 2), return_counts=True)
            if len(terms):
                idf = np.array([np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
                w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / mean))
                rows.append((float(w.sum()), key, terms, w, text))
        rows.sort(key=lambda r: (r[0], r[1]))  # neighbours have alike thresholds
        self.keys = [r[1] for r in rows]
        self.theta = [share * r[0] for r in rows]
        self.least = min(self.theta, default=np.inf)
        self.qa = [tuple(grams_of(x, k) for x, k in zip(parts(r[4]), (3, 2), strict=True)) for r in rows]
        self.size = [max(LEAST, len(_hashes(r[4], 1))) for r in rows]
        self.weights = [dict(zip(r[2].tolist(), r[3].tolist(), strict=True)) for r in rows]
        at: dict[int, tuple[list[int], list[float]]] = {}
        for i, r in enumerate(rows):
            for t, w in zip(r[2].tolist(), r[3].tolist(), strict=True):
                p = at.setdefault(t, ([], []))
                p[0].append(i)
                p[1].append(w)
        self.lists = {t: (ids, ws, max(ws), [max(ws[k : k + BLOCK]) for k in range(0, len(ws), BLOCK)]) for t, (ids, ws) in at.items()}
        self.terms = np.array(sorted(self.lists), np.uint64)
        self.bound = np.array([self.lists[t][2] for t in self.terms.tolist()], float)


def wand(index: Index, terms: set[int]) -> list[tuple[int, float]]:
    """All items whose score under these terms reaches their threshold."""
    cursors = [[0, *index.lists[t]] for t in terms if t in index.lists]  # position, ids, weights, greatest, by block
    out, theta, least = [], index.theta, index.least * (1 - 1e-12)
    while True:
        cursors = [c for c in cursors if c[0] < len(c[1])]
        cursors.sort(key=lambda c: c[1][c[0]])
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += c[3]
            if total >= least:
                pivot = i
                break
        if pivot < 0:
            return out
        item = cursors[pivot][1][cursors[pivot][0]]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
            pivot += 1
        for c in cursors[: pivot + 1]:  # to the pivot, block by block
            while c[0] < len(c[1]) and c[1][c[0]] < item:
                end = min(len(c[1]), (c[0] // BLOCK + 1) * BLOCK)
                if c[1][end - 1] < item:
                    c[0] = end
                else:
                    c[0] += 1
        here = [c for c in cursors[: pivot + 1] if c[0] < len(c[1]) and c[1][c[0]] == item]
        if sum(c[4][c[0] // BLOCK] for c in here) >= theta[item] * (1 - 1e-12):
            score = sum(c[2][c[0]] for c in here)
            if score >= theta[item] * (1 - 1e-12):
                out.append((item, score))
        for c in here:
            c[0] += 1


def passages(words: int, s: int) -> list[tuple[int, int]]:
    """Word ranges: 2s words, s apart; the last one reaches the end."""
    return [(a, min(words, a + 2 * s)) for a in range(0, max(1, words - s), s)]


def verified(index: Index, item: int, h: np.ndarray) -> Iterator[tuple[float, float, float]]:
    """Score and overlaps of question and answer in each of the item's windows of these words that holds it."""
    n, size = len(h), index.size[item]
    g = ngrams(h, 2)
    weight = index.weights[item]
    own = np.fromiter((t in weight for t in g.tolist()), bool, len(g))
    for a, b in passages(n, size):
        if not own[a : b - 1].any():
            continue
        score = sum(weight[t] for t in {*g[a : b - 1][own[a : b - 1]].tolist()})
        if score >= index.theta[item] * (1 - 1e-12):
            qo, ao = (len(x & {*ngrams(h[a:b], k).tolist()}) / len(x) if x else 1.0 for k, x in index.qa[item])
            if qo >= 0.5 and ao >= 0.5:
                yield score, qo, ao


def _search(index: Index, s: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for c in chunks(b):
                if len(c.h) < 2 or not len(index.terms):
                    continue
                g = ngrams(c.h, 2)
                at = np.minimum(np.searchsorted(index.terms, g), len(index.terms) - 1)
                hit = (index.terms[at] == g) & (c.doc[:-1] == c.doc[1:])
                total = np.concatenate([[0.0], np.cumsum(np.where(hit, index.bound[at], 0.0))])
                n = np.diff(c.first)
                each = np.maximum(1, -(-(n - s) // s)) * (n > 1)
                doc = np.repeat(np.arange(len(n)), each)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                low = c.first[doc] + k * s
                high = np.minimum(c.first[doc + 1], low + 2 * s)
                for d, x, y in zip(*(v[np.flatnonzero(total[high - 1] - total[low] >= index.least * (1 - 1e-9))] for v in (doc, low, high)), strict=True):
                    terms = {*g[x : y - 1][hit[x : y - 1]].tolist()}
                    for item, _ in wand(index, terms):
                        rows += [(int(c.ids[d]), index.keys[item], *v) for v in verified(index, item, c.h[x:y])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "score", "question", "answer"])

    return run


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, question, answer) of each document and test item that it contains."""
    spark = docs.sparkSession
    some = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    if (size := some.agg(F.sum(F.octet_length("text"))).head()[0] or 0) > MOST_BYTES:
        raise ValueError(f"the test items have {size} bytes; at most {MOST_BYTES} are taken at once")
    rows = sorted((int(k), t) for k, t in some.collect())  # at most MOST_BYTES
    df: dict[int, int] = {}
    length, longest = 0, 0
    for _, t in rows:
        h = _hashes(t, 2)
        length, longest = length + len(h), max(longest, len(h) + 1)
        for x in np.unique(h).tolist():
            df[x] = df.get(x, 0) + 1
    out = schema(doc_id=LONG, item_id=LONG, score=DBL, question=DBL, answer=DBL)
    found = spark.createDataFrame([], out)
    for i in range(0, len(rows), SHARD_ITEMS):
        index = Index(rows[i : i + SHARD_ITEMS], (df, len(rows), max(1.0, length / len(rows))), share)
        found = found.union(texts(docs).mapInArrow(_search(index, max(LEAST, longest)), out))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("question").alias("question"), F.max("answer").alias("answer"))


def clean(docs: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """``docs`` without those that contain a test item; all columns stay."""
    return without(docs, leaks(docs, items, share).select("doc_id"))


def query(spark, sf_dir: str) -> DataFrame:
    d = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return d.withColumn("score", F.round("score", 6)).withColumn("question", F.round("question", 6)).withColumn("answer", F.round("answer", 6))
