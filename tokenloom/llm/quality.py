"""Operator 8: quality classifier on random-indexing word vectors.

Every word has a sparse random index vector; a word's vector is the sum of the
index vectors of the words around it, over all documents (random indexing). Words
are hashed to one of ``WORDS`` (65,536) such vectors of ``DIM`` (16) dimensions,
so what the driver holds doesn't grow with the corpus; words of one hash share a
vector. The README has the held-out accuracy at growing sizes. Sums are of whole
numbers, so they don't depend on the partitions. The
shape of a word (case, digits and marks, runs folded; ``SHAPES`` of them) is a
second word with a vector of its own, which also speaks for words that are rare. A document is the
mean and spread of both kinds of vectors; a network with one hidden layer, in
numpy, is fit on a bounded sample of labelled documents (``sample`` rows a
class), and its temperature on a part that training did not see; all labels
together give the share of the classes.

Ties: of several labels of one document the lowest counts. Nulls: rows without a label or text are not trained on; a null text scores as an
empty one, and texts without words have quality 0. Very long texts are pooled
whole. Repeated rows score alike. Without labels of two classes, all documents
with words have quality 1. Empty tables give an empty result. Extra columns
stay; if one is called ``p_quality``, the operator's is ``p_quality1`` (or the next free name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, DBL, INT, LONG, below, materialize, schema, unused
from .kernel import Chunk, _sums, chunks, mix, powers

DIM, WORDS, SHAPES = 16, 1 << 16, 1 << 12
_SUMS = [f"v{d}" for d in range(DIM)]
_CLASS = np.arange(256)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 57, 65, 97, 97
_CLASS = _CLASS.astype(np.uint64) + np.uint64(1)


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse ternary vectors: two of +1 and two of -1 each."""
    r = np.random.default_rng(seed)
    at = r.random((n, DIM)).argsort(1)[:, :4]
    out = np.zeros((n, DIM), np.float32)
    np.put_along_axis(out, at, np.array([1, 1, -1, -1], np.float32)[None].repeat(n, 0), 1)
    return out


def terms(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and of its shape."""
    kind = _CLASS[c.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[c.ws] = True
    at = np.flatnonzero(keep)
    p, i = powers(len(at) + 1)
    s = _sums(kind[at] * p[: len(at)])
    a, b = np.searchsorted(at, c.ws), np.searchsorted(at, c.we)
    shape = mix((s[b] - s[a]) * i[a])
    return (c.h % np.uint64(WORDS)).astype(np.int64), (shape % np.uint64(SHAPES)).astype(np.int64)


def around(v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The sum of the two vectors before and the two after, within a text."""
    out = np.zeros_like(v)
    for k in (1, 2):
        if len(v) > k:
            m = (doc[k:] == doc[:-k])[:, None]
            out[k:] += v[:-k] * m
            out[:-k] += v[k:] * m
    return out


def _gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [(np.zeros((n, DIM), np.int64), index_vectors(n, n)) for n in (WORDS, SHAPES)]
    for b in it:
        for c in chunks(b, spaces=True):
            for (sums, index), t in zip(tables, terms(c), strict=True):
                v = around(index[t], c.doc)
                for d in range(DIM):
                    sums[:, d] += np.bincount(t, v[:, d], len(sums)).astype(np.int64)
    both = np.concatenate([t[0] for t in tables])
    on = np.flatnonzero(both.any(1))
    if len(on):
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), *(pa.array(both[on, d]) for d in range(DIM))], ["term", *_SUMS])


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors of words and shapes, summed over all documents, centred and of length one."""
    some = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sums = some.mapInArrow(_gather, schema(term=INT, **{n: LONG for n in _SUMS})).groupBy("term").agg(*[F.sum(n).alias(n) for n in _SUMS])
    x = np.zeros((WORDS + SHAPES, DIM))
    t = sums.toArrow()  # at most WORDS + SHAPES rows, 9 MB
    x[t.column(0).to_numpy()] = np.stack([c.to_numpy() for c in t.columns[1:]], 1)
    out = []
    for v in (x[:WORDS], x[WORDS:]):
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        v = v - v[np.abs(v).sum(1) > 0].mean(0) if v.any() else v
        out.append(v.astype(np.float32))
    out[1] = np.concatenate([out[1], index_vectors(SHAPES, SHAPES + 1)], 1)
    return out[0], out[1]


def features(c: Chunk, vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean and spread of the words' and the shapes' vectors of each text; zeros of a text without words."""
    n = np.diff(c.first)
    out, some = [], np.flatnonzero(n)
    for t, v in zip(terms(c), vectors, strict=True):
        x = v[t]
        mean, square = np.zeros((len(n), v.shape[1])), np.zeros((len(n), v.shape[1]))
        if len(some):
            mean[some] = np.add.reduceat(x, c.first[some], 0) / n[some, None]
            square[some] = np.add.reduceat(x * x, c.first[some], 0) / n[some, None]
        out += [mean, np.sqrt(np.maximum(square - mean**2, 0))]
        if v.shape[1] == DIM:  # how alike neighbours are: repeated words
            pairs = np.zeros_like(x)
            pairs[1:] = x[1:] * x[:-1] * (c.doc[1:] == c.doc[:-1])[:, None]
            near = np.zeros_like(mean)
            if len(some):
                near[some] = np.add.reduceat(pairs, c.first[some], 0) / n[some, None]
            out.append(near)
    return np.concatenate(out, 1).astype(np.float32)


@dataclass
class Model:
    vectors: tuple[np.ndarray, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]
    temperature: float = 1.0
    prior: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature + self.prior, -50, 50)))


def fit(vectors, x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 400, seed: int = 3) -> Model:
    """Adam on the log loss with weight decay; every fifth row is held out for the temperature."""
    r = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    m = Model(vectors, x.mean(0), x.std(0) + 1e-3, [r.normal(0, 0.1, (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, 0.1, hidden), np.zeros(())])
    z, t = (x[~held] - m.mean) / m.scale, y[~held]
    mom, vel = [0.0] * 4, [0.0] * 4
    for s in range(1, steps + 1):
        h = np.tanh(z @ m.w[0] + m.w[1])
        e = (1 / (1 + np.exp(-(h @ m.w[2] + m.w[3]))) - t) / len(t)
        back = np.outer(e, m.w[2]) * (1 - h**2)
        grads = [z.T @ back + 1e-3 * m.w[0], back.sum(0), h.T @ e + 1e-3 * m.w[2], e.sum()]
        for k, g in enumerate(grads):
            mom[k] = 0.9 * mom[k] + 0.1 * g
            vel[k] = 0.999 * vel[k] + 0.001 * g * g
            m.w[k] = m.w[k] - 0.01 * (mom[k] / (1 - 0.9**s)) / (np.sqrt(vel[k] / (1 - 0.999**s)) + 1e-8)
    if held.any():
        g, best = m.logit(x[held]), np.inf
        for temp in np.geomspace(0.2, 10, 60):
            p = np.clip(1 / (1 + np.exp(-np.clip(g / temp, -50, 50))), 1e-6, 1 - 1e-6)
            loss = -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))
            if loss < best:
                best, m.temperature = loss, float(temp)
    return m


def _featurise(vectors):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            y = b.column(b.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            x = [features(c, vectors) for c in chunks(b, spaces=True)]
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), pa.array([v.tobytes() for v in np.concatenate(x)], pa.binary())], ["doc_id", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> Model | None:
    """sample: labelled documents of each class that are used, those of the least hashes of their ids."""
    vectors = word_vectors(docs)
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    all_, order = dict(y.groupBy("y").count().collect()), F.xxhash64("id")
    # a few times the sample leave the tasks, whatever their number
    one = [y.where(F.col("y") == k).where(below(order, 4 * sample / max(all_.get(k, 0), 1))).orderBy(order, "id").limit(sample) for k in (0, 1)]
    picked = materialize(one[0].union(one[1]), "labelled")  # at most 2 x sample rows
    label_of = dict(picked.collect())
    texts_ = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts_.join(F.broadcast(picked.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    # one row an id, that of the least features: as many rows as labels
    got = rows.mapInArrow(_featurise(vectors), schema(doc_id=LONG, x=BIN)).groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: (r.doc_id % (1 << 64) * 2654435761 % 4294967291, r.doc_id))
    x, label = np.array([np.frombuffer(r.x, np.float32) for r in got]), np.array([label_of[r.doc_id] for r in got], float)
    if not len(label) or min(label.sum(), (1 - label).sum()) < 2:
        return None
    model = fit(vectors, x, label)
    model.prior = float(np.log(all_[1] / all_[0]) - np.log(label.sum() / (1 - label).sum()))  # the sample is more even than the labels
    return model


def _score(model: Model | None, name: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = b.column(b.schema.get_field_index("text"))
            some = pa.RecordBatch.from_arrays([text, pa.array(np.zeros(b.num_rows, np.int64))], ["text", "doc_id"])
            p = [np.zeros(0)]
            for c in chunks(some, spaces=True):
                p.append(np.where(np.diff(c.first) > 0, model.probability(features(c, model.vectors)) if model else 1.0, 0.0))
            yield b.append_column(name, pa.array(np.concatenate(p), pa.float64()))

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """``docs`` with the probability ``p_quality`` that a document is of good quality."""
    return _scored(docs, train(docs, labels, sample), unused(docs, "p_quality"))


def _scored(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    return docs.mapInArrow(_score(model, name), T.StructType([*docs.schema, *schema(**{name: DBL})]))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = 3000) -> DataFrame:
    """``docs`` without those of a lower quality than ``least``; all columns stay, whatever their names."""
    name = unused(docs, "p")
    return _scored(docs, train(docs, labels, sample), name).where(F.col(name) >= least).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", F.round("p_quality", 6).alias("p_quality"), (F.col("p_quality") >= 0.5).alias("keep"))
