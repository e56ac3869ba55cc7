"""MatchFrame: named sets of token intervals and their algebra.

Interval relations that an equality or an aggregate can decide are such joins;
containment becomes a look-up over a window of the union of both sides, so that
pairs of a file are not compared. Overlap is decided by a kernel over a file's
matches in order. Sets that were taken from one frame of matches (``of``) are
held against each other in one pass over it, so that it is computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frame import TokenFrame

BINDING = T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("def_seq", T.LongType()), T.StructField("ref_seq", T.LongType()), T.StructField("all_refs", T.ArrayType(T.LongType()))])
MATCHES = T.StructType(
    [
        T.StructField("set", T.StringType()), T.StructField("fid", T.LongType()), T.StructField("from_seq", T.LongType()), T.StructField("upto_seq", T.LongType()),
        T.StructField("from_lnr", T.IntegerType()), T.StructField("upto_lnr", T.IntegerType()), T.StructField("msg", T.StringType()), T.StructField("bindings", T.ArrayType(BINDING)),
    ]
)
_KEY = ("fid", "from_seq", "upto_seq")


def complete(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MATCHES])


def _highest(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest of x[low:high] for each pair, which must not be empty: from runs of powers of two."""
    out, size = np.zeros(len(low), np.int64), high - low
    step = 1
    while True:
        on = (size >= step) & (size < 2 * step)
        out[on] = np.maximum(x[low[on]], x[high[on] - step])
        if step * 2 > (size.max() if len(size) else 0):
            return out
        x = np.maximum(x[:-step], x[step:])
        step *= 2


def _overlap(fid: np.ndarray, f: np.ndarray, u: np.ndarray, other: np.ndarray, starts: bool) -> np.ndarray:
    """Which rows (of whole files, numbered by fid) overlap a row of other, as MatchFrame.overlaps or overlapped_by says."""
    span = int(u.max()) + 2 if len(u) else 1
    if not starts:  # in the reverse order of places an end is a start
        f, u = span - 1 - u, span - 1 - f
    b = np.flatnonzero(other)
    b = b[np.argsort(fid[b] * span + f[b], kind="stable")]
    place, end = fid[b] * span + f[b], u[b]
    low, high = np.searchsorted(place, fid * span + f, "right" if starts else "left"), np.searchsorted(place, fid * span + u, "right")
    some = ~other & (low < high)
    some[some] = _highest(end, low[some], high[some]) >= u[some] + (not starts)
    return some


def _overlapping(starts: bool, rows: int = 1 << 18):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            fid, f, u, o = (t.column(n).combine_chunks() for n in ("fid", "from_seq", "upto_seq", "_o"))
            nr = fid.dictionary_encode("encode").indices.to_numpy().astype(np.int64)
            on = _overlap(nr, f.to_numpy(), u.to_numpy(), o.to_numpy() == 1, starts)
            yield from t.filter(pa.array(on)).drop_columns("_o").to_batches()

        held, n = [], 0
        for b in it:
            held.append(b)
            n += b.num_rows
            if n >= rows:  # all but the last file, which may go on
                t = pa.Table.from_batches(held)
                fid = t.column("fid").combine_chunks().dictionary_encode("encode").indices.to_numpy()
                cut = int(np.searchsorted(fid, fid[-1]))
                yield from found(t[:cut])
                held, n = t[cut:].to_batches(), len(t) - cut
        if n:
            yield from found(pa.Table.from_batches(held))

    return run


class MatchFrame:
    def __init__(self, df: DataFrame, base: DataFrame | None = None, sets: frozenset[str] = frozenset()):
        """``base``, ``sets``: the frame of matches of which these are all those of the sets, if they were taken from one."""
        self.df, self._base, self._sets = complete(df), base, sets

    @classmethod
    def from_marks(cls, tokens: TokenFrame | DataFrame, name: str, msg: str | None = None) -> MatchFrame:
        """Each longest run of adjacent marks is one match."""
        df = tokens.df if isinstance(tokens, TokenFrame) else tokens
        w = Window.partitionBy("fid").orderBy("seq")
        runs = df.where(F.col("mark") > 0).withColumn("_i", F.col("seq") - F.row_number().over(w)).groupBy("fid", "_i")
        out = runs.agg(F.min("seq").alias("from_seq"), F.max("seq").alias("upto_seq"), F.min("lnr").alias("from_lnr"), F.max("lnr").alias("upto_lnr"))
        return cls(out.withColumn("set", F.lit(name)).withColumn("msg", F.lit(msg).cast("string")))

    def _keep(self, df: DataFrame) -> MatchFrame:
        return MatchFrame(df)

    def of(self, name: str) -> MatchFrame:
        if self._base is not None:
            return self._taken(self._base, self._sets & {name})
        return self._taken(self.df, frozenset({name}))

    @staticmethod
    def _taken(base: DataFrame, sets: frozenset[str]) -> MatchFrame:
        return MatchFrame(base.where(F.col("set").isin(*sorted(sets))), base, sets)

    def _one(self, other: MatchFrame) -> bool:
        return self._base is not None and self._base is other._base

    def named(self, name: str, msg: str | None = None) -> MatchFrame:
        df = self.df.withColumn("set", F.lit(name))
        return self._keep(df if msg is None else df.withColumn("msg", F.lit(msg)))

    caption = named

    def delete(self, name: str) -> MatchFrame:
        return self._keep(self.df.where(F.lit(False) if name in ("*", "all") else F.col("set") != name))

    def rename(self, old: str, new: str) -> MatchFrame:
        return self._keep(self.df.withColumn("set", F.when(F.col("set") == old, new).otherwise(F.col("set"))))

    def summary(self) -> DataFrame:
        """Names, counts and captions of the sets."""
        return self.df.groupBy("set").agg(F.count("*").alias("patterns"), F.first("msg", ignorenulls=True).alias("caption"))

    def exists(self, name: str) -> bool:
        return bool(self.df.where(F.col("set") == name).take(1))

    def add(self, fid: int, from_seq: int, upto_seq: int, name: str) -> MatchFrame:
        """One more match; an exact repeat of it is left out."""
        row = self.df.sparkSession.createDataFrame([(name, fid, from_seq, upto_seq)], "set string, fid long, from_seq long, upto_seq long")
        new = complete(row).join(self.df.select("set", *_KEY), ["set", *_KEY], "left_anti").select(*MATCHES.names)
        return self._keep(self.df.unionByName(new))

    def remove(self, fid: int, from_seq: int, upto_seq: int, name: str) -> MatchFrame:
        return self._keep(self.df.where(~((F.col("set") == name) & (F.col("fid") == fid) & (F.col("from_seq") == from_seq) & (F.col("upto_seq") == upto_seq))))

    @classmethod
    def from_list(cls, spark, ranges: list[tuple[int, int, int]], name: str) -> MatchFrame:
        return cls(spark.createDataFrame([(name, *r) for r in ranges], "set string, fid long, from_seq long, upto_seq long"))

    # set algebra

    def union(self, other: MatchFrame) -> MatchFrame:
        """Duplicates stay."""
        if self._one(other) and not self._sets & other._sets:
            return self._taken(self._base, self._sets | other._sets)
        return self._keep(self.df.unionByName(other.df))

    def distinct(self) -> MatchFrame:
        return self._keep(self.df.dropDuplicates(["set", *_KEY]))

    def minus(self, other: MatchFrame) -> MatchFrame:
        if self._one(other):
            return self._equal(other, F.col("_v").isNull() | F.col("fid").isNull())
        return self._keep(self.df.join(other.df.select(*_KEY), [*_KEY], "left_anti"))

    def intersect(self, other: MatchFrame) -> MatchFrame:
        if self._one(other):
            return self._equal(other, F.col("_v").isNotNull() & F.col("fid").isNotNull())
        return self._keep(self.df.join(other.df.select(*_KEY), [*_KEY], "left_semi"))

    def _equal(self, other: MatchFrame, test: Column) -> MatchFrame:
        """Rows of self that pass the test, ``_v`` being 1 where some row of other has their interval; both of one frame."""
        w = Window.partitionBy("fid").orderBy("from_seq", "upto_seq").rangeBetween(Window.currentRow, Window.currentRow)
        both = self._base.where(F.col("set").isin(*sorted(self._sets | other._sets)))
        both = both.withColumn("_v", F.max(F.when(F.col("set").isin(*sorted(other._sets)), 1)).over(w))
        return self._keep(both.where(F.col("set").isin(*sorted(self._sets)) & test))

    # interval algebra: rows of self that stand in the relation to some row of other

    def _events(self, other: MatchFrame) -> DataFrame:
        """Rows of self with ``_o`` 0 and of other with 1; of one frame, they are told apart in a pass over it."""
        if not self._one(other):
            return self.df.withColumn("_o", F.lit(0)).unionByName(complete(other.df).withColumn("_o", F.lit(1)))
        both = self._base.where(F.col("set").isin(*sorted(self._sets | other._sets)))
        roles = [F.when(F.col("set").isin(*sorted(m._sets)), o) for o, m in enumerate((self, other))]
        if self._sets & other._sets:
            return both.withColumn("_o", F.explode(F.filter(F.array(*roles), lambda x: x.isNotNull())))
        return both.withColumn("_o", F.coalesce(*roles))

    def _sweep(self, other: MatchFrame, order: list[Column], value: Column, best, test: Column, near: bool = False) -> MatchFrame:
        """Rows of self whose ``best`` value over the rows of other before them in the order passes the test; ``near``: over those at their place."""
        w = Window.partitionBy("fid").orderBy(*order)
        w = w.rangeBetween(Window.currentRow, Window.currentRow) if near else w.rowsBetween(Window.unboundedPreceding, 0)
        both = self._events(other).withColumn("_v", best(F.when(F.col("_o") == 1, value)).over(w))
        return self._keep(both.where((F.col("_o") == 0) & test))

    def containing(self, other: MatchFrame) -> MatchFrame:
        """a.from <= b.from and b.upto <= a.upto."""
        # among the b that start at or after a, the least end is within a
        order = [F.desc("from_seq"), F.desc("_o")]
        return self._sweep(other, order, F.col("upto_seq"), F.min, F.col("_v") <= F.col("upto_seq"))

    def inside(self, other: MatchFrame, strict: bool = False) -> MatchFrame:
        """Within some b (``strict``: b without its end tokens)."""
        if strict:
            other = MatchFrame(other.df.withColumn("from_seq", F.col("from_seq") + 1).withColumn("upto_seq", F.col("upto_seq") - 1).where("from_seq <= upto_seq"))
        return self._sweep(other, [F.col("from_seq"), F.desc("_o")], F.col("upto_seq"), F.max, F.col("_v") >= F.col("upto_seq"))

    def not_inside(self, other: MatchFrame) -> MatchFrame:
        return self.minus(self.inside(other, strict=True))

    def meets(self, other: MatchFrame) -> MatchFrame:
        """a ends right before some b."""
        if self._one(other):
            at = F.when(F.col("_o") == 0, F.col("upto_seq") + 1).otherwise(F.col("from_seq"))
            return self._sweep(other, [at], F.lit(1), F.max, F.col("_v").isNotNull(), near=True)
        b = other.df.select(F.col("fid").alias("_f"), F.col("from_seq").alias("_b")).distinct()
        return self._keep(self.df.join(b, F.col("fid").eqNullSafe(F.col("_f")) & (F.col("upto_seq") + 1 == F.col("_b")), "left_semi"))

    def following(self, other: MatchFrame) -> MatchFrame:
        """a begins right after some b."""
        if self._one(other):
            at = F.when(F.col("_o") == 0, F.col("from_seq")).otherwise(F.col("upto_seq") + 1)
            return self._sweep(other, [at], F.lit(1), F.max, F.col("_v").isNotNull(), near=True)
        b = other.df.select(F.col("fid").alias("_f"), F.col("upto_seq").alias("_b")).distinct()
        return self._keep(self.df.join(b, F.col("fid").eqNullSafe(F.col("_f")) & (F.col("from_seq") == F.col("_b") + 1), "left_semi"))

    def not_following(self, other: MatchFrame) -> MatchFrame:
        return self.minus(self.following(other))

    def precedes(self, other: MatchFrame) -> MatchFrame:
        """a ends before some b of its file begins: an aggregate by file decides."""
        if self._one(other):
            at = F.when(F.col("_o") == 0, F.col("upto_seq")).otherwise(F.col("from_seq"))
            return self._sweep(other, [at.desc(), F.desc("_o")], F.col("from_seq"), F.max, F.col("_v") > F.col("upto_seq"))
        b = other.df.groupBy(F.col("fid").alias("_f")).agg(F.max("from_seq").alias("_b"))
        return self._keep(self.df.join(b, F.col("fid").eqNullSafe(F.col("_f")) & (F.col("upto_seq") < F.col("_b")), "left_semi"))

    def follows(self, other: MatchFrame) -> MatchFrame:
        """Some b of its file ends before a begins."""
        if self._one(other):
            at = F.when(F.col("_o") == 0, F.col("from_seq")).otherwise(F.col("upto_seq"))
            return self._sweep(other, [at, F.desc("_o")], F.col("upto_seq"), F.min, F.col("_v") < F.col("from_seq"))
        b = other.df.groupBy(F.col("fid").alias("_f")).agg(F.min("upto_seq").alias("_b"))
        return self._keep(self.df.join(b, F.col("fid").eqNullSafe(F.col("_f")) & (F.col("_b") < F.col("from_seq")), "left_semi"))

    def overlaps(self, other: MatchFrame) -> MatchFrame:
        """a starts before some b and ends within it: a.from < b.from <= a.upto <= b.upto."""
        return self._ranges(other, True)

    def overlapped_by(self, other: MatchFrame) -> MatchFrame:
        """Some b starts before a and ends within it."""
        return self._ranges(other, False)

    def _ranges(self, other: MatchFrame, starts: bool) -> MatchFrame:
        """The overlaps: files are brought together and read in order, and a kernel asks for the best b in a range of places."""
        both = self._events(other).where("from_seq is not null and upto_seq is not null")
        have = [f for f in MATCHES if f.name in both.columns]
        found = both.repartition("fid").sortWithinPartitions("fid").select(*(f.name for f in have), "_o").mapInArrow(_overlapping(starts), T.StructType(have))
        return self._keep(found)

    def nested(self, level: int) -> MatchFrame:
        """Matches that lie within at least ``level`` others of the set, one in the other."""
        out = self
        for _ in range(level):
            out = out._keep(out.df.join(self.df.select(F.col("fid").alias("_f"), F.col("from_seq").alias("_b"), F.col("upto_seq").alias("_e")), F.col("fid").eqNullSafe(F.col("_f")) & (F.col("_b") < F.col("from_seq")) & (F.col("upto_seq") < F.col("_e")), "left_semi"))
        return out

    # tokens

    def tokens(self, tokens: DataFrame) -> DataFrame:
        """The tokens of each match: an equi join on exploded places."""
        at = self.df.select("set", "fid", "from_seq", "upto_seq", F.explode(F.sequence("from_seq", "upto_seq")).alias("seq"))
        return at.join(tokens, ["fid", "seq"])

    def having(self, tokens: DataFrame, condition: Column) -> MatchFrame:
        """Matches with at least one token that satisfies the condition: those that contain such a token as an interval."""
        at = tokens.where(F.coalesce(condition, F.lit(False))).select("fid", F.col("seq").alias("from_seq"), F.col("seq").alias("upto_seq"))
        return self.containing(MatchFrame(at))

    def within_marks(self, tokens: TokenFrame) -> MatchFrame:
        """Matches all of whose tokens are marked."""
        whole = self.having(tokens.df, F.col("mark") == 0)
        return self.minus(whole)

    def places(self, bits: bool = False) -> DataFrame:
        """(fid, seq, mark) of the tokens of all matches, each once; ``bits``: 1 in a match, 2 its start, 8 its end, 4 a use and 16 a definition of a bound name."""
        at = self.df.select("fid", F.explode(F.sequence("from_seq", "upto_seq")).alias("seq"), "from_seq", "upto_seq", "bindings")
        bit = F.lit(1)
        if bits:
            some = lambda f: F.exists(F.coalesce("bindings", F.array()), f)
            bit = F.lit(1).bitwiseOR(F.when(F.col("seq") == F.col("from_seq"), 2).otherwise(0)).bitwiseOR(F.when(F.col("seq") == F.col("upto_seq"), 8).otherwise(0))
            bit = bit.bitwiseOR(F.when(some(lambda b: F.array_contains(b["all_refs"], F.col("seq"))), 4).otherwise(0)).bitwiseOR(F.when(some(lambda b: b["def_seq"] == F.col("seq")), 16).otherwise(0))
        return at.select("fid", "seq", bit.alias("mark")).groupBy("fid", "seq").agg(F.bit_or("mark").alias("mark"))

    def to_marks(self, tokens: TokenFrame, bits: bool = False) -> TokenFrame:
        """Mark the tokens of all matches, as ``places`` does; that is enough where the marks' texts aren't asked for."""
        got = self.places(bits).select(F.col("fid").alias("_f"), F.col("seq").alias("_s"), F.col("mark").alias("_m"))
        df = tokens.df
        out = df.join(got, df.fid.eqNullSafe(F.col("_f")) & (F.col("seq") == F.col("_s")), "left")
        return TokenFrame(out.withColumn("mark", F.coalesce("_m", F.lit(0)).cast("int")).drop("_f", "_s", "_m"), tokens)

    def display(self, fnm: DataFrame | None = None, least: int = 0, most: int | None = None, nth: int | None = None, only: str | None = None) -> DataFrame:
        """Matches of between ``least`` and ``most`` lines, numbered; ``nth`` picks one of each set, ``only`` (with ``fnm``) those of one file."""
        df = self.df.withColumn("n_lines", F.col("upto_lnr") - F.col("from_lnr") + 1)
        df = df.where((F.col("n_lines") >= least) & (F.lit(True) if most is None else F.col("n_lines") <= most))
        df = df.withColumn("nr", F.row_number().over(Window.partitionBy("set").orderBy(*_KEY)))
        if fnm is not None:
            df = df.join(fnm.select("fid", "fnm"), "fid")
            df = df if only is None else df.where(F.col("fnm") == only)
        return df if nth is None else df.where(F.col("nr") == nth)
