"""Operator 2: near-duplicates by min-max hashing (Ji et al., ICCV 2013).

Word 3-gram shingles are hashed by 64 permutations; both the least and the
greatest value under each are kept, 128 signature values from 64 evaluations.
Each value of two signatures agrees with the probability of their Jaccard
similarity. Documents of one shingle set (by a 128-bit sum over it) are one
text; only texts are compared, so thousands of copies cost no more than one.

1. Bands of four values bring texts together. In each band bucket all pairs are
   compared by their signatures, of which the low byte of each value is sent (256
   to 1 against a chance agreement of a value, for which the estimate allows).
   Those that agree in ``threshold`` less ``SLACK``, a loose bound of almost four
   standard errors, are connected; connected components are families.
2. Within a family all pairs that pass the same bound are verified: texts with a
   true Jaccard similarity of at least ``threshold`` are linked. Connected
   components of the links are the groups.

Both steps work on blocks of a bucket or family against each other, so a hot one
is many tasks of bounded size. A task sends the links it counted for each text
and a spanning forest of them, never the pairs: what is shuffled grows with the
texts and the blocks of their family, not with the pairs.

Nulls: rows without a doc_id or text take no part. Texts without words belong to
no group; one or two words are a single shingle. Rows of one doc_id are one
document, with all its texts. Ties: the least doc_id of a group stays. Empty
tables give an empty result. Extra columns are ignored by ``groups`` and kept by
``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, LONG, discard, forest, groups_of, materialize, only, schema, texts, without
from .graph import components
from .kernel import Chunk, chunks, mix, ngrams

PERMUTATIONS, BAND, SHINGLE, SLACK = 64, 4, 3, 0.15
#: Members of a band bucket that are compared with as many others at a time.
BLOCK = 1024
#: Bytes of 3-gram sets that a verifying task holds of each of two blocks; a set counts as 2 KB at least.
BLOCK_BYTES = 4 << 20


def coefficients(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(c: Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams and the text of each; of a shorter text, all its words as one."""
    g, at = c.grams(k)
    doc = c.doc[at]
    count = np.diff(c.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        more = np.array([ngrams(c.h[c.first[i] : c.first[i + 1]], int(count[i]))[0] for i in short], np.uint64)
        g, doc = np.concatenate([g, more]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def signatures(g: np.ndarray, doc: np.ndarray, n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their signatures (texts x 2n, uint32): least, greatest in turn."""
    which, start = np.unique(doc, return_index=True)
    sig = np.zeros((len(which), 2 * n), np.uint32)
    if len(which):
        for j, (a, b) in enumerate(zip(*coefficients(n), strict=True)):
            v = ((g * a + b) >> np.uint64(32)).astype(np.uint32)
            sig[:, 2 * j] = np.minimum.reduceat(v, start)
            sig[:, 2 * j + 1] = np.maximum.reduceat(v, start)
    return which, sig


def bands(sig: np.ndarray, rows: int = BAND) -> np.ndarray:
    """A hash for each band of each signature."""
    n = sig.shape[1] // rows
    out = np.zeros((len(sig), n), np.uint64)
    x = sig.reshape(len(sig), n, rows).astype(np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(31) + x[:, :, r] + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def unique(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, in order."""
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], doc[new]


def fingerprints(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each text's distinct shingles."""
    start = np.unique(doc, return_index=True)[1]
    return np.stack([np.add.reduceat(mix(g ^ np.uint64(x)), start) for x in (0, 0x5851F42D4C957F2D)], 1)


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for c in chunks(b):
            g, doc = unique(*shingles(c))
            which, sig = signatures(g, doc)
            if len(which):
                band = bands(sig).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c.ids[which], pa.int64()),
                        pa.array([x.tobytes() for x in fingerprints(g, doc)], pa.binary()),
                        pa.array(np.bincount(doc, minlength=len(c.ids))[which]),
                        pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, band.size + 1, band.shape[1], dtype=np.int32), pa.array(band.ravel(), pa.int64())),
                    ],
                    ["doc_id", "key", "grams", "sig", "bands"],
                )


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for c in chunks(b):
            g, doc = unique(*shingles(c))
            which, start = np.unique(doc, return_index=True)
            if len(which):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids[which], pa.int64()), pa.array([x.tobytes() for x in fingerprints(g, doc)], pa.binary()), pa.array([x.tobytes() for x in np.split(g, start[1:])], pa.binary())],
                    ["doc_id", "key", "set"],
                )


class _Blocks:
    """A block p and a block q of a bucket or family, as rows (.., p, q, block, doc_id, sig)."""

    def __init__(self, t: pa.Table, at: int, least: float):
        self.p, self.q = t.column(at)[0].as_py(), t.column(at + 1)[0].as_py()
        block, self.doc = t.column(at + 2).to_numpy(), t.column(at + 3).to_numpy()
        self.sig = np.frombuffer(b"".join(t.column(at + 4).to_pylist()), np.uint8).reshape(t.num_rows, -1)
        self.left, self.right = np.flatnonzero(block == self.p), np.flatnonzero(block == self.q)
        self.cutoff = (least * (1 - 1 / 256) + 1 / 256) * self.sig.shape[1]  # equal by chance

    def likely(self) -> Iterator[tuple[int, np.ndarray]]:
        """A row of the left block and those of the right that agree with it in enough of their signatures; each pair once."""
        right = np.ascontiguousarray(self.sig[self.right])
        for k, i in enumerate(self.left):
            low = k + 1 if self.p == self.q else 0
            on = np.flatnonzero((right[low:] == self.sig[i]).sum(1, dtype=np.int32) >= self.cutoff) + low
            on = self.right[on]
            on = on[self.doc[on] != self.doc[i]]
            if len(on):
                yield i, on


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _connect(least: float):
    """Rows (band, p, q, block, doc_id, sig), sorted by the first three: what connects the likely pairs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(it, 3):
            x = _Blocks(t, 1, least)
            pairs = [(x.doc[on], np.full(len(on), x.doc[i])) for i, on in x.likely()]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in _edges(*zip(*pairs, strict=True))], ["a", "b"])

    return run


def _verify(threshold: float, least: float):
    """Rows (family, p, q, block, doc_id, sig, set), sorted by the first three: links of each text (b null), and edges that connect what is linked (links null)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(it, 3):
            x = _Blocks(t, 1, least)
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column(6)]
            size = np.array([len(v) for v in sets])
            start = np.concatenate([[0], np.cumsum(size)])
            code = np.unique(np.concatenate(sets), return_inverse=True)[1]
            mine, links, a, b = np.zeros(code.max(initial=-1) + 1, np.int32), np.zeros(len(sets), np.int64), [], []
            for i, on in x.likely():
                own = code[start[i] : start[i + 1]]
                mine[own] = 1
                n = size[on]
                at = np.repeat(start[on], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                both = np.add.reduceat(mine[code[at]], np.cumsum(n) - n)
                mine[own] = 0
                on = on[both >= threshold * (size[i] + n - both)]
                if len(on):
                    links[i] += len(on)
                    links[on] += 1
                    a.append(x.doc[on])
                    b.append(np.full(len(on), x.doc[i]))
            if a:
                hi, lo = _edges(a, b)
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([hi, x.doc[on]])), pa.array(np.concatenate([lo, np.zeros(len(on), np.int64)]), mask=np.arange(len(hi) + len(on)) >= len(hi)), pa.array(np.concatenate([np.zeros(len(hi), np.int64), links[on]]))],
                    ["a", "b", "links"],
                )

    return run


def _paired(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Rows (key, doc_id, text, .., blocks) once for each pair of blocks p <= q of their key that has their own."""
    block = F.pmod(F.xxhash64("doc_id", "key"), F.col(blocks))
    each = rows.withColumn("block", block).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    return each.withColumn("p", F.least("block", "k")).withColumn("q", F.greatest("block", "k")).drop("k", blocks)


def near(docs: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of the texts (rep, links); the edges that connect them (a, b); which documents have which text (doc_id, rep)."""
    pair, least = schema(a=LONG, b=LONG), threshold - SLACK
    signed = materialize(texts(docs).mapInArrow(_sign, schema(doc_id=LONG, key=BIN, grams=LONG, sig=BIN, bands=T.ArrayType(LONG))), "signatures")
    first = materialize(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("grams").alias("grams"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count("*").alias("n")), "texts")
    copies = signed.select("key", "doc_id").join(first.where("n > 1").select("key", "rep"), "key").select("doc_id", "rep").distinct()
    copies = materialize(copies, "copies")
    discard(signed)
    # rows of several documents and texts, so the text's node is its least document
    rows = first.select(F.col("rep").alias("doc_id"), "key", F.explode("bands").alias("band"))
    hot = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    member = _paired(rows.join(hot, "band"), "band", "blocks").join(first.select(F.col("rep").alias("doc_id"), "key", "sig"), ["doc_id", "key"])
    member = member.select("band", "p", "q", "block", "doc_id", "sig").repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    family = components(member.mapInArrow(_connect(least), pair))
    family = materialize(family.union(family.select("root", "root").distinct()).toDF("doc_id", "family"), "families")
    of = first.select(F.col("rep").alias("doc_id"), "key", "grams", "sig").join(family, "doc_id")
    blocks = of.groupBy("family").agg(F.ceil(F.sum(F.greatest(F.col("grams") * 8, F.lit(2048))) / BLOCK_BYTES).alias("blocks"))
    placed = _paired(of.join(blocks, "family").drop("grams"), "family", "blocks")
    some = only(texts(docs), family.select("doc_id")).mapInArrow(_sets, schema(doc_id=LONG, key=BIN, set=BIN)).dropDuplicates(["doc_id", "key"])
    placed = placed.join(some, ["doc_id", "key"]).select("family", "p", "q", "block", "doc_id", "sig", "set")
    placed = placed.repartition("family", "p", "q").sortWithinPartitions("family", "p", "q", "block", "doc_id")
    found = materialize(placed.mapInArrow(_verify(threshold, least), schema(a=LONG, b=LONG, links=LONG)), "links")
    discard(family)
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    return links, found.where("b is not null").select("a", "b"), copies


def groups(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, keeper) of every document in a group of two or more; the keeper's row has its own id in both."""
    _, edges, copies = near(docs, threshold)
    return _members(edges, copies)


def _members(edges: DataFrame, copies: DataFrame) -> DataFrame:
    found = components(edges.union(copies.where("doc_id <> rep").select("doc_id", "rep")))
    return found.union(found.select("root", "root").distinct()).toDF("doc_id", "keeper")


def linked(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, keeper, group_size, n_links) of every document in a group: how many
    documents the group has, and how many other texts the document's texts are
    linked with (copies of a text are one text, so exact copies alone have none)."""
    links, edges, copies = near(docs, threshold)
    g = materialize(_members(edges, copies), "groups")
    size = g.groupBy("keeper").agg(F.count("*").alias("group_size"))
    of = copies.join(links, "rep").select("doc_id", "links").union(links.join(copies.select("rep").distinct(), "rep", "left_anti").select("rep", "links"))
    of = of.groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    return g.join(size, "keeper").join(of, "doc_id", "left").select("doc_id", "keeper", "group_size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the members of groups that aren't its keeper; all columns stay."""
    return without(docs, groups(docs, threshold).where("doc_id <> keeper").select("doc_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
