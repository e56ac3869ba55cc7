"""Inline programs: what a per-token program computes, as Spark plans.

Bodies of the shape "for each token that .., count / sum / keep the best by key"
become grouped aggregates, whose partial and final steps stand for the copies of
each core and their merging. Bodies that move the cursor run as a Python
function over one file at a time. User functions and variables are Python's.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import expr


class Program:
    def __init__(self, tokens: DataFrame):
        self.df = tokens

    def filter(self, condition: str | Column) -> Program:
        """The rest of the body runs for these tokens only (``if .. Next``)."""
        return Program(self.df.where(expr.column(condition) if isinstance(condition, str) else condition))

    def between(self, first: int, last: int) -> Program:
        return Program(self.df.where(F.col("seq").between(first, last)))

    def let(self, **values: Column) -> Program:
        """New variables, or fields written."""
        return Program(self.df.withColumns(values))

    def chain(self, path: str) -> Column:
        """``nxt.nxt.txt``, ``prv.lnr``: neighbours as windows."""
        *steps, name = path.strip(".").split(".")
        if any(s not in ("nxt", "prv") for s in steps):
            raise ValueError("only nxt and prv can be followed as a column; use follow() for jmp and bound")
        k = steps.count("nxt") - steps.count("prv")
        w = Window.partitionBy("fid").orderBy("seq")
        return F.col(name) if k == 0 else F.lead(name, k).over(w) if k > 0 else F.lag(name, -k).over(w)

    def follow(self, pointer: str, field: str, into: str) -> Program:
        """``.jmp.txt`` or ``.bound.txt``: a look-up by equality."""
        other = self.df.select(F.col("fid").alias("_f"), F.col("seq").alias("_s"), F.col(field).alias(into))
        return Program(self.df.join(other, F.col("fid").eqNullSafe(F.col("_f")) & (F.col(pointer) == F.col("_s")), "left").drop("_f", "_s"))

    def count_by(self, *keys: str | Column) -> DataFrame:
        """``A[k1, k2]++``: one row a key."""
        cols = [F.col(k) if isinstance(k, str) else k for k in keys]
        return self.df.groupBy(*cols).agg(F.count("*").alias("n"))

    def sum_by(self, value: str | Column, *keys: str | Column) -> DataFrame:
        v = F.col(value) if isinstance(value, str) else value
        return self.df.groupBy(*[F.col(k) if isinstance(k, str) else k for k in keys]).agg(F.sum(v).alias("total"))

    def unify(self, key: str, number: Column | None = None, text: Column | None = None) -> DataFrame:
        """Merged copies of an array: numbers are added, of texts the first that isn't empty stays."""
        aggs = ([F.sum(number).alias("number")] if number is not None else []) + ([F.min_by(text, F.when(text != "", F.struct("fid", "seq"))).alias("text")] if text is not None else [])
        return self.df.groupBy(key).agg(*aggs)

    def first_by(self, key: str, value: str) -> DataFrame:
        return self.df.groupBy(key).agg(F.min_by(value, F.struct("fid", "seq")).alias(value))

    def max_by(self, value: str, by: Column) -> DataFrame:
        return self.df.agg(F.max_by(value, F.struct(by, F.col(value))).alias(value), F.max(by).alias("best"))

    def keys(self, key: str) -> DataFrame:
        """Keys of an array in the order of iteration: the newest first; nr numbers them from 0."""
        first = self.df.groupBy("fid", key).agg(F.min("seq").alias("_s")).groupBy(key).agg(F.min(F.struct("fid", "_s")).alias("_first"))
        return first.withColumn("nr", F.row_number().over(Window.orderBy(F.desc("_first"))) - 1).drop("_first")

    @staticmethod
    def unset(array: DataFrame, **keys) -> DataFrame:
        """``unset A[k]``: an array (a row a key) without the rows of these keys; without keys, ``unset A``: no rows."""
        if not keys:
            return array.limit(0)
        hit = F.lit(True)
        for k, v in keys.items():
            hit = hit & F.col(k).eqNullSafe(F.lit(v))
        return array.where(~hit)

    def ends(self) -> DataFrame:
        """First and last token of each file."""
        return self.df.groupBy("fid").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))

    def printed(self, form: str, *cols: str | Column) -> DataFrame:
        return self.df.select("fid", "seq", F.format_string(form, *cols).alias("out"))

    def assert_(self, condition: Column, message: str) -> Program:
        return Program(self.df.where(F.assert_true(condition, message).isNull()))

    def run(self, body: Callable[[Cursor], Iterator[dict] | None], schema: str) -> DataFrame:
        """A body that moves its cursor: called once for each file with a Cursor, yields rows of the schema."""

        names = [c.split()[0] for c in schema.split(",")]

        def kernel(t: pa.Table) -> pa.Table:
            rows = list(body(Cursor(Tokens(t))) or ())
            return pa.Table.from_arrays([pa.array([r.get(n) for r in rows], f.type) for n, f in zip(names, arrow, strict=True)], names=names)

        arrow = to_arrow_schema(self.df.sparkSession.createDataFrame([], schema).schema)
        return self.df.groupBy("fid").applyInArrow(kernel, schema)


class Token(dict):
    """One token of a table: a field is read when it is asked for; what a body writes stays with the token."""

    __slots__ = ("_of", "_at")

    def __init__(self, of: Tokens, at: int):
        self._of, self._at = of, at

    def __missing__(self, name: str):
        self[name] = v = self._of.values(name)[self._at]
        return v

    def get(self, name: str, default=None):
        return self[name] if dict.__contains__(self, name) or name in self._of.names else default

    def copy(self) -> dict:
        """All fields, those of the table first."""
        return {n: self[n] for n in self._of.names} | {k: dict.__getitem__(self, k) for k in dict.keys(self)}

    def __contains__(self, name) -> bool:
        return dict.__contains__(self, name) or name in self._of.names

    def __iter__(self):
        return iter(self.copy())

    def __len__(self) -> int:
        return len(self.copy())

    def keys(self):
        return self.copy().keys()

    def values(self):
        return self.copy().values()

    def items(self):
        return self.copy().items()

    def __or__(self, other: dict) -> dict:
        return self.copy() | dict(other)

    def __ror__(self, other: dict) -> dict:
        return other | self.copy()

    def __eq__(self, other) -> bool:
        return self.copy() == (other.copy() if isinstance(other, Token) else other)

    def __repr__(self) -> str:
        return repr(self.copy())

    def __reduce__(self):
        return dict, (self.copy(),)


class Tokens(Sequence):
    """The tokens of one file in order, over Arrow columns of which only those that a body reads become Python's."""

    def __init__(self, table: pa.Table):
        seqs = table.column("seq").to_numpy()
        self.table = table.sort_by("seq") if (seqs[1:] < seqs[:-1]).any() else table
        self.names, self._values, self._made = {*table.column_names}, {}, [None] * table.num_rows

    def values(self, name: str) -> list:
        if name not in self._values:
            if name not in self.names:
                raise KeyError(name)
            self._values[name] = self.table.column(name).to_pylist()
        return self._values[name]

    def __len__(self) -> int:
        return len(self._made)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        if self._made[i] is None:
            self._made[i] = Token(self, i % len(self._made))
        return self._made[i]


class Cursor:
    """The tokens of one file, with a place that a body may move, associative arrays and lists of its own."""

    def __init__(self, tokens: Sequence[dict]):
        self.tokens, self.at = tokens, 0
        self.lists: dict[str, deque] = {}

    def __iter__(self) -> Iterator[dict]:
        """The implicit scan: from wherever the body has left the cursor, to the next token."""
        while self.at < len(self.tokens):
            yield self.tokens[self.at]
            self.at += 1

    @cached_property
    def _where(self) -> dict[int, int]:
        seqs = self.tokens.values("seq") if isinstance(self.tokens, Tokens) else [t["seq"] for t in self.tokens]
        return {s: i for i, s in enumerate(seqs)}

    def peek(self, k: int = 1) -> dict:
        i = self.at + k
        return self.tokens[i] if 0 <= i < len(self.tokens) else {"txt": "", "typ": "", "seq": -1}

    def move(self, k: int = 1) -> dict:
        self.at = min(max(0, self.at + k), len(self.tokens))
        return self.peek(0)

    def jump(self, t: dict | None = None) -> bool:
        """To the partner of the token."""
        j = (t or self.peek(0)).get("jmp")
        if j is None or j != j or j not in self._where:
            return False
        self.at = self._where[j]
        return True

    def stop(self) -> None:
        self.at = len(self.tokens)

    def new(self, **fields) -> dict:
        return {"txt": "", "typ": "", "lnr": 0, "seq": -1, "mark": 0} | fields

    def push(self, name: str, t: dict) -> None:
        self.lists.setdefault(name, deque()).appendleft(t)

    def append(self, name: str, t: dict) -> None:
        self.lists.setdefault(name, deque()).append(t)

    def pop(self, name: str) -> dict | None:
        q = self.lists.get(name)
        return q.popleft() if q else None

    def chop(self, name: str) -> dict | None:
        q = self.lists.get(name)
        return q.pop() if q else None

    def top(self, name: str) -> dict | None:
        q = self.lists.get(name)
        return q[0] if q else None

    def bot(self, name: str) -> dict | None:
        q = self.lists.get(name)
        return q[-1] if q else None

    def length(self, name: str) -> int:
        return len(self.lists.get(name, ()))
