"""Checks along the paths of a function: memory used after it was freed, locals read before they have a value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import structure
from ..operators.match import MATCHES, MatchFrame

_NEED = ("fid", "seq", "lnr", "txt", "typ", "curly", "jmp")
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "++", "--"}


class Body:
    """A function body as tokens and, for each, those that may come next.

    if, else, while, for, do, switch, break, continue, goto and return are
    followed; an expression is a straight run of tokens.
    """

    def __init__(self, toks: list[dict]):
        self.toks = toks
        self.at = {t["seq"]: i for i, t in enumerate(toks)}
        self.next: list[set[int]] = [{i + 1} for i in range(len(toks))]
        self.labels = {t["txt"]: i for i, t in enumerate(toks[:-1]) if t["typ"] == "ident" and toks[i + 1]["txt"] == ":"}
        self._block(1, len(toks) - 1, len(toks), None, None)

    def pair(self, i: int) -> int:
        return self.at.get(self.toks[i]["jmp"], i)

    def _block(self, i: int, end: int, out: int, brk: int | None, cont: int | None) -> None:
        while i < end:
            i = self._statement(i, end, brk, cont)

    def _statement(self, i: int, end: int, brk: int | None, cont: int | None) -> int:
        """Wires the statement at i; returns where it ends."""
        w = self.toks[i]["txt"]
        if w == "{":
            j = self.pair(i)
            self._block(i + 1, j, j + 1, brk, cont)
            return j + 1
        if w in ("if", "while", "for", "switch") and i + 1 < end and self.toks[i + 1]["txt"] == "(":
            close = self.pair(i + 1)
            body = close + 1
            stop = self._length(body, end)
            if w == "if":
                self._statement(body, end, brk, cont)
                if stop < end and self.toks[stop]["txt"] == "else":
                    last = self._length(stop + 1, end)
                    self._statement(stop + 1, end, brk, cont)
                    self.next[close] = {body, stop + 1}
                    self.next[stop - 1] = {last if x == stop else x for x in self.next[stop - 1]}
                    return last
                self.next[close] |= {stop}
                return stop
            if w == "switch":
                self._statement(body, end, stop, cont)
                cases = {k for k in range(body, stop) if self.toks[k]["txt"] in ("case", "default")}
                full = any(self.toks[k]["txt"] == "default" for k in cases)
                self.next[close] = cases | (set() if full else {stop}) or {stop}
                return stop
            self._statement(body, end, stop, i)
            self.next[close] = {body, stop}
            self.next[stop - 1] = {i if x == stop else x for x in self.next[stop - 1]}
            return stop
        if w == "do":
            stop = self._length(i + 1, end)
            self._statement(i + 1, end, self._semi(stop, end), stop)
            last = self._semi(stop, end)
            self.next[last - 1] = {i, last}
            return last
        last = self._semi(i, end)
        if w == "return":
            self.next[last - 1] = {len(self.toks)}
        elif w == "goto":
            self.next[last - 1] = {self.labels.get(self.toks[i + 1]["txt"], last)}
        elif w in ("break", "continue"):
            self.next[last - 1] = {(brk if w == "break" else cont) or last}
        return last

    def _semi(self, i: int, end: int) -> int:
        while i < end and self.toks[i]["txt"] != ";":
            i = self.pair(i) + 1 if self.toks[i]["txt"] in ("(", "{", "[") and self.pair(i) > i else i + 1
            if self.toks[i - 1]["txt"] == ":" and i < end:  # a label or a case
                return i
        return min(end, i + 1)

    def _length(self, i: int, end: int) -> int:
        """Where the statement at i ends."""
        if i >= end:
            return end
        w = self.toks[i]["txt"]
        if w == "{":
            return self.pair(i) + 1
        if w in ("if", "while", "for", "switch") and i + 1 < end:
            stop = self._length(self.pair(i + 1) + 1, end)
            return self._length(stop + 1, end) if w == "if" and stop < end and self.toks[stop]["txt"] == "else" else stop
        return self._semi(self._length(i + 1, end), end) if w == "do" else self._semi(i, end)

    def walk(self, start: int, stops, hits) -> int | None:
        """The first token along any path from start that hits, unless it stops before."""
        todo, seen = [start], {start}
        while todo:
            i = todo.pop()
            if i >= len(self.toks):
                continue
            if hits(i):
                return i
            if stops(i):
                continue
            for x in sorted(self.next[i], reverse=True):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return None

    def txt(self, i: int) -> str:
        return self.toks[i]["txt"] if 0 <= i < len(self.toks) else ""

    def writes(self, i: int) -> bool:
        """Whether the name at i gets a value: assigned, or its address is given away."""
        return self.txt(i + 1) == "=" or (self.txt(i - 1) == "&" and self.txt(i - 2) in ("(", ",", "="))


def _freed(b: Body):
    for i in range(len(b.toks) - 3):
        if b.txt(i) == "free" and b.txt(i + 1) == "(" and b.toks[i + 2]["typ"] == "ident" and b.txt(i + 3) == ")":
            v = b.txt(i + 2)
            same = lambda k, v=v: b.txt(k) == v and b.txt(k - 1) not in ("->", ".")
            if (hit := b.walk(i + 4, lambda k: same(k) and b.writes(k), lambda k: same(k) and not b.writes(k))) is not None:
                yield i + 2, hit


def _locals(b: Body):
    """Places of locals that are declared without a value."""
    for i in range(1, len(b.toks) - 2):
        if b.toks[i]["typ"] == "type" and b.toks[i + 1]["typ"] == "ident" and b.txt(i + 2) in (";", ",") and b.txt(i - 1) in ("{", "}", ";", "const", "unsigned", "signed", "long", "short"):
            k = i + 1
            while b.txt(k + 1) == "," and b.toks[k + 2]["typ"] == "ident":
                yield k
                k += 2
            if b.txt(k + 1) == ";":
                yield k


def _unset(b: Body):
    for i in _locals(b):
        v = b.txt(i)
        same = lambda k, v=v: b.txt(k) == v and b.txt(k - 1) not in ("->", ".") and b.txt(k + 1) != ":"
        quiet = lambda k: b.writes(k) or b.txt(k - 2) == "sizeof"
        if (hit := b.walk(i + 1, lambda k: same(k) and quiet(k), lambda k: same(k) and not quiet(k))) is not None:
            yield i, hit


def _unread(b: Body):
    for i in _locals(b):
        v = b.txt(i)
        uses = [k for k in range(i + 1, len(b.toks)) if b.txt(k) == v and b.txt(k - 1) not in ("->", ".")]
        if uses and all(b.txt(k + 1) in _ASSIGN - {"++", "--"} and b.txt(k - 1) in ("{", "}", ";") for k in uses):
            yield i, uses[-1]


def _checker(find):
    def run(tokens: DataFrame) -> MatchFrame:
        src = structure.source(tokens)
        f = structure.functions(src).select(F.col("fid").alias("_f"), F.col("body_seq").alias("_a"), F.col("end_seq").alias("_b"))
        t = src.select(*_NEED)
        # functions of a file don't overlap, so a token is in one at most: the last that began before it
        both = t.withColumn("_k", F.lit(1)).unionByName(f.select(F.col("_f").alias("fid"), F.col("_a").alias("seq"), F.lit(0).alias("_k"), F.col("_a"), F.col("_b")), allowMissingColumns=True)
        w = structure.Window.partitionBy("fid").orderBy("seq", "_k")
        both = both.withColumn("_from", F.last("_a", True).over(w)).withColumn("_upto", F.last("_b", True).over(w)).where("_k = 1 and seq between _from and _upto")
        return MatchFrame(both.select(*_NEED, "_from").groupBy("fid", "_from").applyInPandas(lambda pdf: _found(find, pdf), MATCHES))

    return run


def _found(find, pdf: pd.DataFrame) -> pd.DataFrame:
    toks = pdf.sort_values("seq").to_dict("records")
    b = Body(toks)
    rows = [("x", toks[0]["fid"], toks[i]["seq"], toks[j]["seq"], toks[i]["lnr"], toks[j]["lnr"], None, None) for i, j in find(b)]
    return pd.DataFrame(rows, columns=MATCHES.names)


use_after_free = _checker(_freed)
uninitialised = _checker(_unset)
never_read = _checker(_unread)
