"""Operator 4: language identification by a bidirectional GRU over bytes.

Two gated recurrent layers, one forward and one backward, read the bytes; a
softmax on both states labels every byte, and the mean of these probabilities
over a document is its probability of each language. Trained by truncated
backpropagation through time in numpy with Adam, on a bounded sample of
documents whose ``lang`` is known (``sample``): each step takes stretches of
``TRAIN_SPAN`` bytes from anywhere in the whole texts of some of them.
Documents are read whole, in stretches of ``SPAN`` bytes that run side by side;
each direction begins a stretch with a run-up of ``RUN`` bytes before it, whose
labels don't count, instead of carrying its state through the whole text.
``runs`` gives the label of every byte, as runs; ``identify`` the pooled result.

Nulls: rows without a language are not trained on but are labelled; a null or
empty text gets the language null and probability 0. Very long texts are read
whole. Repeated rows are labelled alike; ties go to the first language in
alphabetical order. Without a known language all results are null. Empty tables
give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DBL, LONG, STR, below, schema, texts
from .kernel import chunks

HIDDEN, SPAN, RUN, TRAIN_SPAN = 8, 384, 24, 96
PAD = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(labels: int, seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    out = {}
    for side in "fb":
        out[f"x{side}"] = r.normal(0, 0.3, (256, 3 * HIDDEN))
        out[f"u{side}"] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        out[f"c{side}"] = np.zeros(3 * HIDDEN)
    out["v"] = r.normal(0, 0.3, (2 * HIDDEN, labels))
    out["d"] = np.zeros(labels)
    return {k: v.astype(np.float32) for k, v in out.items()}


def forward(p: dict, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
    """States after each of the bytes x (time x lanes); the backward side reads from the end.

    Rows of gates are [reset, update, candidate]; ``keep`` gets what the way back needs.
    """
    steps, lanes = x.shape
    table, u, hid = p[f"x{side}"] + p[f"c{side}"], p[f"u{side}"], HIDDEN
    out = np.empty((steps, lanes, hid), np.float32)
    h = np.zeros((lanes, hid), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        a = table[x[t]]
        b = h @ u
        g = np.tanh(0.5 * (a[:, : 2 * hid] + b[:, : 2 * hid]))
        g *= 0.5
        g += 0.5
        un = b[:, 2 * hid :]
        n = np.tanh(a[:, 2 * hid :] + g[:, :hid] * un)
        new = n + g[:, hid:] * (h - n)
        if keep is not None:
            keep.append((t, h, g, un, n))
        out[t] = h = new
    return out


def backward(p: dict, x: np.ndarray, side: str, keep: list, dout: np.ndarray) -> dict[str, np.ndarray]:
    """Backpropagation through time: gradients of one side's weights."""
    hid = HIDDEN
    dx, du = np.zeros_like(p[f"x{side}"]), np.zeros_like(p[f"u{side}"])
    dh = np.zeros(dout.shape[1:], np.float32)
    das = np.empty((*x.shape, 3 * hid), np.float32)
    for t, h, g, un, n in reversed(keep):
        r, z = g[:, :hid], g[:, hid:]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        das[t] = np.concatenate([dr, dz, dn], 1)
        db = np.concatenate([dr, dz, dn * r], 1)
        du += h.T @ db
        dh = dh * z + db @ p[f"u{side}"].T
    np.add.at(dx, x.ravel(), das.reshape(-1, 3 * hid))
    return {f"x{side}": dx, f"u{side}": du, f"c{side}": das.sum((0, 1))}


def fit(data: np.ndarray, bounds: np.ndarray, y: np.ndarray, labels: int, steps: int = 350, batch: int = 96, seed: int = 7) -> dict[str, np.ndarray]:
    """data, bounds: the bytes of all texts and where each begins; y: the language of each."""
    p, r = init(labels), np.random.default_rng(seed)
    data = np.concatenate([data, np.zeros(TRAIN_SPAN, np.uint8)])
    mom, vel = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for s in range(1, steps + 1):
        pick = r.integers(0, len(y), batch)
        low, high, t = bounds[pick], bounds[pick + 1], y[pick]
        low = low + (r.random(batch) * np.maximum(1, high - low - TRAIN_SPAN + 1)).astype(np.int64)
        at = low + np.arange(TRAIN_SPAN)[:, None]
        b = np.where(at < high, data[np.minimum(at, len(data) - 1)], PAD).astype(np.uint8)
        kf, kb = [], []
        h = np.concatenate([forward(p, b, "f", kf), forward(p, b, "b", kb)], 2)
        e = np.exp((o := h @ p["v"] + p["d"]) - o.max(2, keepdims=True))
        e /= e.sum(2, keepdims=True)
        e[:, np.arange(len(t)), t] -= 1
        e *= (b != PAD)[:, :, None] / max(1, (b != PAD).sum())
        dh = e @ p["v"].T
        grads = backward(p, b, "f", kf, dh[:, :, :HIDDEN]) | backward(p, b, "b", kb, dh[:, :, HIDDEN:])
        grads |= {"v": np.einsum("tbh,tbl->hl", h, e), "d": e.sum((0, 1))}
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * min(1.0, 2 * (1 - s / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1 / (norm + 1e-9))
            mom[k] = 0.9 * mom[k] + 0.1 * g
            vel[k] = 0.99 * vel[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (mom[k] / (1 - 0.9**s)) / (np.sqrt(vel[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
    return p


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes as lanes of RUN + SPAN + RUN (time x lanes, padded by zeros beyond a text's ends), the text of each lane, and where its own bytes begin."""
    n = np.diff(bounds)
    each = -(-n // SPAN)
    doc = np.repeat(np.arange(len(n)), each)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    start = bounds[doc] + k * SPAN
    at = start[None] + np.arange(-RUN, SPAN + RUN)[:, None]
    there = (at >= bounds[doc]) & (at < bounds[doc + 1])
    return np.where(there, data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else 0, PAD).astype(np.uint8), doc, start


def labelled(p: dict, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Step by step the probabilities (lanes x languages) of the lanes' own bytes: place in the stretch, and they."""
    f, b = forward(p, x[: RUN + SPAN], "f"), forward(p, x[RUN:], "b")
    vf, vb = p["v"][:HIDDEN], p["v"][HIDDEN:]
    for t in range(SPAN):
        o = f[RUN + t] @ vf + b[t] @ vb + p["d"]
        e = np.exp(o - o.max(1, keepdims=True))
        yield t, e / e.sum(1, keepdims=True)


def pooled(p: dict, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the mean probability of each language over its bytes, and how many bytes are labelled as each."""
    labels = p["v"].shape[1]
    x, doc, start = stretches(data, bounds)
    prob, hard = np.zeros((len(bounds) - 1, labels)), np.zeros((len(bounds) - 1, labels))
    if not len(doc):
        return prob, hard
    size = np.minimum(SPAN, bounds[doc + 1] - start)
    sums, counts = np.zeros((len(doc), labels)), np.zeros((len(doc), labels))
    for t, e in labelled(p, x):
        there = (t < size).astype(np.float32)
        sums += e * there[:, None]
        counts[np.arange(len(e)), e.argmax(1)] += there
    for i in range(labels):
        prob[:, i] = np.bincount(doc, sums[:, i], len(prob))
        hard[:, i] = np.bincount(doc, counts[:, i], len(prob))
    return prob / np.maximum((prob.sum(1, keepdims=True)), 1e-9), hard


def labels_of(p: dict, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The language of every byte."""
    x, doc, start = stretches(data, bounds)
    out = np.zeros(len(data), np.int64)
    for t, e in labelled(p, x) if len(doc) else ():
        on = start + t < bounds[doc + 1]
        out[(start + t)[on]] = e.argmax(1)[on]
    return out


def train(docs: DataFrame, sample: int = 2400) -> tuple[list[str], dict] | None:
    """sample: documents trained on, those of the least hashes, whole."""
    t = F.col("text").cast("string")
    h = F.xxhash64(F.col("doc_id").cast("long"), F.lit(5))
    known = docs.where("lang is not null").count()
    # a few times the sample leave the tasks, whatever their number
    few = docs.where("lang is not null").where(below(h, 4 * sample / max(known, 1))).where("length(text) > 0")
    few = few.select(F.col("lang").cast("string").alias("lang"), h.alias("h"), F.xxhash64(t).alias("k"), t.alias("text"))
    rows = few.orderBy("h", "k").limit(sample).collect()
    names = sorted({r.lang for r in rows})
    if not names:
        return None
    raw = [r.text.encode() for r in rows]
    at = {n: i for i, n in enumerate(names)}
    return names, fit(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.array([at[r.lang] for r in rows]), len(names))


def _label(names: list[str], p: dict):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for c in chunks(b, size=1 << 19):
                prob, hard = pooled(p, c.data, c.bounds)
                best, some = prob.argmax(1), np.diff(c.bounds) > 0
                rows = np.arange(len(best))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c.ids, pa.int64()),
                        pa.array([names[i] if ok else None for i, ok in zip(best, some, strict=True)], pa.string()),
                        pa.array(np.where(some, prob[rows, best], 0.0)),
                        pa.array(hard[rows, best].astype(np.int64)),
                        pa.array(np.diff(c.bounds), pa.int64()),
                    ],
                    ["doc_id", "language", "probability", "bytes_labelled", "bytes"],
                )

    return run


def _runs(names: list[str], p: dict):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for c in chunks(b, size=1 << 19):
                y = labels_of(p, c.data, c.bounds)
                new = np.zeros(len(y), bool)
                new[1:] = y[1:] != y[:-1]
                new[c.bounds[:-1][np.diff(c.bounds) > 0]] = True
                start = np.flatnonzero(new)
                doc = np.searchsorted(c.bounds, start, "right") - 1
                end = np.append(start[1:], len(y))
                yield pa.RecordBatch.from_arrays([pa.array(c.ids[doc], pa.int64()), pa.array(start - c.bounds[doc]), pa.array(end - c.bounds[doc]), pa.array(np.array(names, object)[y[start]], pa.string())], ["doc_id", "start", "end", "language"])

    return run


def runs(docs: DataFrame, sample: int = 2400) -> DataFrame:
    """(doc_id, start, end, language) of the maximal runs of bytes with one label, of every row with an id and a text; none without a known language."""
    model, out = train(docs, sample), schema(doc_id=LONG, start=LONG, end=LONG, language=STR)
    if model is None:
        return docs.sparkSession.createDataFrame([], out)
    return texts(docs).mapInArrow(_runs(*model), out)


def identify(docs: DataFrame, sample: int = 2400) -> DataFrame:
    """(doc_id, language, probability, bytes_labelled as that language, bytes) of every row with an id."""
    model = train(docs, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.lit(0).cast("long").alias("bytes_labelled"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return rows.mapInArrow(_label(*model), schema(doc_id=LONG, language=STR, probability=DBL, bytes_labelled=LONG, bytes=LONG))


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")).withColumn("probability", F.round("probability", 4))
