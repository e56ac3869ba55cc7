"""Operator 7: near-duplicate embeddings by a subspace pigeonhole join.

Vectors are brought to length one and turned by a fixed random rotation, which
spreads their variance evenly, then cut into blocks of ``WIDTH`` dimensions. Two
vectors within squared distance d have a block within d x its share of the
dimensions. Each block is a range join of its own: halving the block's first
dimensions at zero makes cells, as many as there are vectors for; a vector lives
in one and visits those that its budget ball reaches, but of two cells only the
one with the lesser number, so each pair meets once. In a cell both sides are
split on, dimension by dimension at the median; what a visitor's distance from
its side uses up of its budget is kept, and it goes no further when that is
spent. Pairs within the block's budget are candidates, and verified on the whole
vectors where they meet; a pair that meets in several blocks counts in the first.

Equal vectors are one. A cell with many vectors is several tasks, block against
block. A task sends how many links it counted for each vector and a spanning
forest of them, never the pairs; connected components of the links are the
classes. No pair is missed.

Result of ``linked``: (vec_id, class_id, class_size, n_links) of every vector
in a class of two or more ids: the least id of the class, how many ids it has,
and with how many other vectors the vector has a cosine of ``least`` or more
(equal vectors are one vector, and no link of each other).

Nulls: rows without an id or vector, and vectors with nulls, NaN or infinities,
or of length zero, take no part. Vectors of different dimensions are never near;
each dimension is joined by itself. Rows of one vec_id are one node with all its
vectors; an id is never its own partner. Ties: all pairs at the threshold (to
1e-9) are links. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIN, INT, LONG, forest, groups_of, materialize, schema
from .graph import components

WIDTH = 16
#: Vectors of a cell that a task compares with as many visitors at a time.
BLOCK = 8192
#: Below so many pairs a cell isn't split on.
LEAF = 1 << 16


def rotation(dim: int, seed: int = 23) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


def slices(dim: int) -> list[slice]:
    return [slice(i, min(dim, i + WIDTH)) for i in range(0, dim, WIDTH)]


def turned(raw: np.ndarray) -> np.ndarray:
    """Of length one, and rotated."""
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)) @ rotation(raw.shape[1])


def visits(y: np.ndarray, depth: int, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the cells of the first ``depth`` dimensions that its ball of squared radius ``budget`` reaches.

    Row numbers, cells, and whether the row lives there; of the cells it only visits, those of lesser number than its own.
    """
    row, cell, used = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y))
    home = np.zeros(len(y), np.int64)
    for d in range(depth):
        side, gap = (y[:, d] >= 0).astype(np.int64), y[:, d] ** 2
        home = home * 2 + side
        over = used + gap[row]
        on = over <= budget
        row, cell, used = np.concatenate([row, row[on]]), np.concatenate([cell * 2 + side[row], (cell * 2 + 1 - side[row])[on]]), np.concatenate([used, over[on]])
    keep = cell <= home[row]
    return row[keep], cell[keep], (cell == home[row])[keep]


def close(h: np.ndarray, p: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs within squared distance ``budget``: of h and of p; splits both until few are left."""
    todo = [(np.arange(len(h)), np.arange(len(p)), np.zeros(len(p), np.float32), 0)]
    while todo:
        a, b, used, d = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= LEAF or d == h.shape[1] or len(a) < 64:
            for i in range(0, len(a), max(1, (1 << 20) // len(b))):
                x, y = h[a[i : i + max(1, (1 << 20) // len(b))]], p[b]
                gap = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
                m, n = np.nonzero(gap <= budget)
                if len(m):
                    yield a[i + m], b[n]
            continue
        at = np.median(h[a, d])
        high = h[a, d] >= at
        off = p[b, d] - at
        for side, mine in ((high, off >= 0), (~high, off < 0)):
            cost = np.where(mine, used, used + off * off)
            on = cost <= budget
            todo.append((a[side], b[on], cost[on], d + 1))


def _cells(dim: int, d2: float, depth: int, single: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw = _raw(b.column(1), dim, single)
            for at in range(0, len(raw), 4096):
                u, ids = turned(raw[at : at + 4096]), b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                for i, s in enumerate(slices(dim)):
                    y = u[:, s]
                    row, cell, lives = visits(y, min(depth, y.shape[1]), d2 * y.shape[1] / dim * (1 + 1e-6) + 1e-9)
                    cell = cell + (i << 32)
                    # those that live there are compared with one another too: they are on both sides
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([cell, cell[lives]])), pa.array(np.concatenate([np.where(lives, 2, 1), np.zeros(lives.sum(), int)]).astype(np.int32)), pa.array(np.concatenate([ids[row], ids[row[lives]]]), pa.int64())],
                        ["cell", "role", "node"],
                    )

    return run


def _raw(column: pa.Array, dim: int, single: bool) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32 if single else np.float64).reshape(-1, dim).astype(np.float64)


def _compare(dim: int, d2: float, least: float, single: bool):
    """Rows (cell, hb, pb, role, node, id, v), sorted by the first three: links of each node (b null), and edges between ids that connect what is linked."""
    parts = slices(dim)
    budgets = np.array([d2 * (s.stop - s.start) / dim for s in parts])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(it, 3):
            i = t.column(0)[0].as_py() >> 32
            role, node, ids = (t.column(k).to_numpy() for k in (3, 4, 5))
            raw = _raw(t.column(6), dim, single)
            u = turned(raw)
            h, p = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
            y = np.ascontiguousarray(u[:, parts[i]], dtype=np.float32)
            count, a, b = np.zeros(t.num_rows, np.int64), [], []
            for m, n in close(y[h], y[p], float(budgets[i] * (1 + 1e-4) + 1e-6)):
                m, n = h[m], p[n]
                on = (role[n] == 1) | (node[m] < node[n])
                m, n = m[on], n[on]
                for k in range(0, len(m), 1 << 15):
                    x, z = m[k : k + (1 << 15)], n[k : k + (1 << 15)]
                    gap = (u[x] - u[z]) ** 2
                    block = np.add.reduceat(gap, [s.start for s in parts], 1)
                    first = (block <= budgets * (1 + 1e-9) + 1e-12).argmax(1)
                    ok = (1 - gap.sum(1) / 2 >= least - 1e-9) & (first == i) & (ids[x] != ids[z])
                    x, z = x[ok], z[ok]
                    if len(x):
                        np.add.at(count, x, 1)
                        np.add.at(count, z, 1)
                        a.append(ids[x])
                        b.append(ids[z])
            if a:
                hi, lo = forest(np.concatenate(a), np.concatenate(b))
                on = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([hi, node[on]])), pa.array(np.concatenate([lo, np.zeros(len(on), np.int64)]), mask=np.arange(len(hi) + len(on)) >= len(hi)), pa.array(np.concatenate([np.zeros(len(hi), np.int64), count[on]]))],
                    ["a", "b", "links"],
                )

    return run


def _usable(dim: int, single: bool):
    kind = np.float32 if single else np.float64

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            rows = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim).astype(kind)
            size = np.linalg.norm(rows.astype(np.float64), axis=1)
            ok = np.isfinite(size) & (size > 0)
            rows = rows + kind(0)  # no negative zeros
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in rows], pa.binary())], ["id", "v"]).filter(pa.array(ok))

    return run


def near(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of each node (node, links), the edges that connect their ids (a, b), and which ids have which node (id, node, rep)."""
    spark = vectors.sparkSession
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    kind = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v")).where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null)")
    dims = sorted(r.n for r in rows.select(F.size("v").alias("n")).distinct().limit(1000).collect())  # as many as there are dimensions
    if len(dims) == 1000:
        raise ValueError("vectors of a thousand dimensions and more: is this a column of embeddings?")
    links = spark.createDataFrame([], "node long, links long")
    edges = spark.createDataFrame([], "a long, b long")
    ids = spark.createDataFrame([], "id long, node long, rep long")
    d2 = 2 - 2 * least + 1e-9
    for dim in dims:
        good = rows.where(F.size("v") == dim).mapInArrow(_usable(dim, single), schema(id=LONG, v=BIN))
        good = materialize(good.distinct(), "vectors")
        one = good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
        one = materialize(one, "nodes")
        n = one.count()
        depth = max(0, min(WIDTH, math.ceil(math.log2(max(1, n) / BLOCK))))
        cells = one.select("node", "v").mapInArrow(_cells(dim, d2, depth, single), schema(cell=LONG, role=INT, node=LONG))
        cells = materialize(cells, "cells")
        size = cells.groupBy("cell").agg(*[F.ceil(F.sum(F.when(x, 1).otherwise(0)) / BLOCK).alias(k) for k, x in (("h", F.col("role") == 0), ("p", F.col("role") > 0))])
        some = cells.join(size.where("h > 0"), "cell")
        mine = F.when(F.col("role") == 0, F.pmod(F.hash("node"), F.col("h"))).otherwise(F.pmod(F.hash("node"), F.col("p")))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, F.col("p")).otherwise(F.col("h")) - 1))
        some = some.withColumn("mine", mine.cast("long")).withColumn("other", other)
        some = some.select("cell", *[F.when((F.col("role") == 0) == x, F.col("mine")).otherwise(F.col("other")).alias(k) for k, x in (("hb", True), ("pb", False))], "role", "node")
        sent = some.join(one.select("node", F.col("rep").alias("id"), "v"), "node").select("cell", "hb", "pb", "role", "node", "id", "v")
        sent = sent.repartition("cell", "hb", "pb").sortWithinPartitions("cell", "hb", "pb")
        found = materialize(sent.mapInArrow(_compare(dim, d2, least, single), schema(a=LONG, b=LONG, links=LONG)), "links")
        of = good.join(one.where("n > 1").select("v", "node", "rep"), "v").select("id", "node", "rep").union(one.where("n = 1").select("rep", "node", "rep"))
        of = of.withColumn("node", F.col("node") * len(dims) + dims.index(dim)) if len(dims) > 1 else of
        here = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        links = links.union(here.withColumn("node", F.col("node") * len(dims) + dims.index(dim)) if len(dims) > 1 else here)
        edges, ids = edges.union(found.where("b is not null").select("a", "b")), ids.union(of)
    return links, edges, ids


def linked(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, class_size, n_links) of every id in a class of two or more."""
    links, edges, ids = near(vectors, least, id_col, vec_col)
    found = components(edges.union(ids.where("id <> rep").select("id", "rep")))
    of = materialize(found.union(found.select("root", "root").distinct()).toDF("vec_id", "class_id"), "classes")
    size = of.groupBy("class_id").agg(F.count("*").alias("class_size"))
    n = ids.join(links, "node").groupBy(F.col("id").alias("vec_id")).agg(F.sum("links").alias("n_links"))
    return of.join(size, "class_id").join(n, "vec_id", "left").select("vec_id", "class_id", "class_size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def query(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(least: float = 0.95) -> str:
    """The same by all pairs and a recursive reach."""
    return f"""WITH RECURSIVE u AS (SELECT DISTINCT vec_id, embedding, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
nodes AS (SELECT embedding, any_value(v) AS v, min(vec_id) AS rep FROM u GROUP BY embedding),
near AS (SELECT a.rep AS x, a.embedding AS e, b.rep AS y FROM nodes a JOIN nodes b ON a.rep <> b.rep WHERE list_inner_product(a.v, b.v) >= {least} - 1e-9),
edges AS (SELECT x, y FROM near UNION SELECT y, x FROM near UNION SELECT u.vec_id, rep FROM u JOIN nodes USING (embedding) WHERE vec_id <> rep UNION SELECT rep, u.vec_id FROM u JOIN nodes USING (embedding) WHERE vec_id <> rep),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
class AS (SELECT x AS vec_id, least(x, min(y)) AS class_id FROM reach GROUP BY x),
links AS (SELECT vec_id, sum(n)::BIGINT AS n_links FROM u JOIN (SELECT e AS embedding, count(*) AS n FROM near GROUP BY e) USING (embedding) GROUP BY vec_id)
SELECT vec_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, coalesce(n_links, 0) AS n_links FROM class LEFT JOIN links USING (vec_id)"""
