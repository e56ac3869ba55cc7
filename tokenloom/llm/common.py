"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder; on a
    cluster a machine-local folder would be wrong, so that is an error.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tokenloom-"))
        at = sc.getCheckpointDir()
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage, and the rows survive the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialize`` returned."""
    jvm = df.sparkSession.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f.rpartition("/")[0])
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession) -> int:
    """As many as the shuffle partitions, which are set in proportion to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def below(h: Column, share: float) -> Column:
    """Of rows with a 64-bit hash those in the lowest ``share``."""
    return F.shiftrightunsigned(h, 11) < F.lit(int(min(1.0, share) * (1 << 53)))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, for work columns beside the caller's."""
    have = {c.lower() for c in df.columns}
    return next(n for k in range(len(have) + 1) if (n := f"{stem}{k or ''}") not in have)


#: Ids that a broadcast may hold: some 100 MB as a hashed relation.
BROADCAST_IDS = 2_000_000


def _held(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    name = unused(docs, "held")
    held = materialize(ids.toDF(name).distinct(), "ids")
    held = F.broadcast(held) if held.count() <= BROADCAST_IDS else held
    return docs.join(held, F.col(id_col).cast("long") == F.col(name), how)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is among ``ids`` (one column of longs); all columns stay.

    The ids are written and counted: up to BROADCAST_IDS are broadcast, so no text
    is shuffled; more are joined by shuffle, with the same result.
    """
    return _held(docs, ids, id_col, "left_anti")


def only(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids``, joined like ``without``."""
    return _held(docs, ids, id_col, "left_semi")


def groups_of(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows alike in the first ``keys`` columns (longs without nulls), of batches sorted by them."""
    left: list[pa.RecordBatch] = []
    last = None
    for b in it:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), b.num_rows]
        if last is not None and (k[0] != last).any():
            yield pa.Table.from_batches(left)
            left = []
        for low, high in zip(cut, cut[1:]):
            if low:
                yield pa.Table.from_batches(left)
                left = []
            left.append(b.slice(low, high - low))
        last = k[-1]
    if left:
        yield pa.Table.from_batches(left)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (greater, lesser) of fewest number that connect what the edges a, b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # each edge pulls the greater root to the lesser
        p, q = root[x], root[y]
        low, high = np.minimum(p, q), np.maximum(p, q)
        on = low < high
        if not on.any():
            break
        np.minimum.at(root, high[on], low[on])
        while (root[root] != root).any():
            root = root[root]
    on = root != np.arange(len(nodes))
    return nodes[on], nodes[root[on]]


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text alone (and ``extra``); rows without an id or a text go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).where("doc_id is not null and text is not null")


LONG, INT, DBL, STR, BIN = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType()


def schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])
