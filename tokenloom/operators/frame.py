"""TokenFrame: the mark commands over a token table.

Every command returns a new frame whose plan extends the last one; marks, bounds
and the four registers are columns, so most commands are windows over one
partitioning of the files (by fid, in the order of seq), which Spark shuffles
once. Moves stay within a file. Predicates are a word, ``/regex``, ``@type``,
``\\word`` (literal), ``(expression)``, or a Column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ere import to_java
from ..functions.scalar import type_is
from ..plans import expr
from .lexer import TOKENS, with_defaults
from .windows import after, before, in_order, upto

QUALIFIERS = ("no", "ir", "and", "top", "up")


def predicate(p: str | Column) -> Column:
    """One token's predicate as a condition."""
    if isinstance(p, Column):
        return F.coalesce(p, F.lit(False))
    if p.startswith("(") and p.endswith(")") and len(p) > 2:
        return F.coalesce(expr.column(p), F.lit(False))
    if p.startswith("/") and len(p) > 1:
        return F.col("txt").rlike(to_java(p[1:]))
    if p.startswith("@") and len(p) > 1:
        return type_is(F.coalesce("typ", F.lit("")), p[1:])
    return F.col("txt") == (p[1:] if p.startswith("\\") and len(p) > 1 else p)


def chain(*ps: str | Column) -> Column:
    """Consecutive tokens that satisfy each predicate in turn."""
    if not ps:
        raise ValueError("a predicate is needed")
    parts = [predicate(ps[0])]
    for k, p in enumerate(ps[1:], 1):
        parts.append(F.coalesce(F.lead(predicate(p), k).over(in_order()), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def dest() -> Column:
    """The end of a token's range: its bound if that is later, else its partner."""
    return F.when(F.col("bound") > F.col("seq"), F.col("bound")).otherwise(F.col("jmp"))


def _level(txt: Column, top: bool) -> Column:
    """(kind, level) in which an anchor looks for tokens."""
    kind = F.when(txt == "(", "r").when(txt == "[", "b").otherwise("c")
    n = F.when(txt == "(", F.col("round")).when(txt == "[", F.col("bracket")).otherwise(F.col("curly"))
    return F.struct(kind.alias("k"), (n if top else n - 1).cast("int").alias("n"))


def _sent(df: DataFrame, to: str, value: Column) -> DataFrame:
    """Adds _got: some ``value`` of a row of the file whose column ``to`` is this row's seq, else null.

    A row with a target goes out twice, the second time as a letter that stands right before the target in the file's order. So
    the file's one partitioning serves, and no plan is run a second time as for a self-join.
    """
    kind = "struct<_k:int,_s:bigint,_v:bigint>"
    row = F.struct(F.lit(1).alias("_k"), F.col("seq").alias("_s"), F.lit(None).cast("long").alias("_v"))
    letter = F.struct(F.lit(0).alias("_k"), F.col(to).cast("long").alias("_s"), value.cast("long").alias("_v"))
    out = df.withColumn("_e", F.explode(F.when(F.col(to).isNotNull(), F.array(row.cast(kind), letter.cast(kind))).otherwise(F.array(row.cast(kind)))))
    w = Window.partitionBy("fid").orderBy("_e._s", "_e._k")
    before_it = F.when((F.lag("_e._k").over(w) == 0) & (F.lag("_e._s").over(w) == F.col("_e._s")), F.lag("_e._v").over(w))
    return out.withColumn("_got", before_it).where("_e._k = 1").select(*df.columns, "_got")


class TokenFrame:
    def __init__(self, df: DataFrame, previous: TokenFrame | None = None):
        self.df = df if {f.name for f in TOKENS} <= {*df.columns} else with_defaults(df)
        self._previous = previous

    def _next(self, df: DataFrame) -> TokenFrame:
        return TokenFrame(df, self)

    def _marked(self, mark: Column) -> TokenFrame:
        return self._next(self.df.withColumn("mark", mark.cast("int")))

    @staticmethod
    def _check(**on: bool) -> None:
        if on.get("top") and on.get("up"):
            raise ValueError("top and up exclude each other")
        if on.get("no") and on.get("ir"):
            raise ValueError("no and ir exclude each other")
        if on.get("no") and on.get("and_"):
            raise ValueError("no and & exclude each other")

    # marks

    def mark(self, *ps: str | Column, and_: bool = False, no: bool = False, ir: bool = False) -> TokenFrame:
        """Add marks where the predicates hold; ``and_`` keeps only marks where they do, ``no`` takes such away,
        ``ir`` replaces all marks by tokens strictly inside of marked ranges (with ``and_``: those already marked)."""
        self._check(no=no, ir=ir, and_=and_)
        p, m = chain(*ps), F.col("mark")
        if ir:
            inside = self._inside()
            hit = p & (F.col("_in") > 0) & ((m > 0) if and_ else F.lit(True))
            return self._next(inside.withColumn("mark", F.when(hit, 1).otherwise(0)).drop("_in"))
        if no:
            return self._marked(F.when(p, 0).otherwise(m))
        if and_:
            return self._marked(F.when((m > 0) & p, m).otherwise(0))
        return self._marked(F.when(p & (m == 0), 1).otherwise(m))

    def unmark(self, *ps: str | Column) -> TokenFrame:
        return self.mark(*ps, no=True)

    def where(self, expression: str) -> TokenFrame:
        """Marks that satisfy the expression stay (``with``)."""
        return self.mark(f"({expression})", and_=True)

    def _inside(self) -> DataFrame:
        """Adds _in: how many marked ranges hold the token strictly inside; a prefix sum over range ends."""
        r = self.df.where(F.col("mark") > 0).select("fid", F.col("seq").alias("_a"), dest().alias("_b")).where(F.col("_b") > F.col("_a") + 1)
        ends = r.select("fid", F.explode(F.array(F.struct((F.col("_a") + 1).alias("s"), F.lit(1).alias("d")), F.struct(F.col("_b").alias("s"), F.lit(-1).alias("d")))).alias("e"))
        net = ends.groupBy(F.col("fid").alias("_f"), F.col("e.s").alias("_s")).agg(F.sum("e.d").alias("_d"))
        out = self.df.join(net, self.df.fid.eqNullSafe(F.col("_f")) & (F.col("seq") == F.col("_s")), "left")
        return out.withColumn("_in", F.sum(F.coalesce("_d", F.lit(0))).over(upto())).drop("_f", "_s", "_d")

    def next(self, *ps: str | Column) -> TokenFrame:
        """Each mark moves to the next token, or to the first match at or after it."""
        m = F.col("mark") > 0
        if not ps:
            return self._marked(F.coalesce(F.lag("mark").over(in_order()), F.lit(0)))
        df = self.df.withColumn("_p", chain(*ps))
        last_p = F.coalesce(F.max(F.when(F.col("_p"), F.col("seq"))).over(before()), F.lit(-1))
        last_m = F.max(F.when(m, F.col("seq"))).over(upto())
        return self._next(df.withColumn("mark", F.when(F.col("_p") & (last_m > last_p), 1).otherwise(0)).drop("_p"))

    def back(self, *ps: str | Column) -> TokenFrame:
        """Each mark moves to the token before, or to the nearest match strictly before it."""
        m = F.col("mark") > 0
        if not ps:
            return self._marked(F.coalesce(F.lead("mark").over(in_order()), F.lit(0)))
        df = self.df.withColumn("_p", chain(*ps))
        next_p = F.min(F.when(F.col("_p"), F.col("seq"))).over(after())
        next_m = F.min(F.when(m, F.col("seq"))).over(after())
        hit = F.col("_p") & next_m.isNotNull() & (next_p.isNull() | (next_m <= next_p))
        return self._next(df.withColumn("mark", F.when(hit, 1).otherwise(0)).drop("_p"))

    def jump(self) -> TokenFrame:
        """Each mark moves to the end of its range; marks without one stay where they are no more."""
        got = _sent(self.df.withColumn("_d", F.when(F.col("mark") > 0, dest())), "_d", F.lit(1))
        return self._next(got.withColumn("mark", F.when(F.col("_got").isNotNull(), 1).otherwise(0)).drop("_d", "_got"))

    def extend(self, *ps: str | Column) -> TokenFrame:
        """Marks stay if the following tokens match."""
        following = chain(F.lit(True), *ps)
        return self._marked(F.when((F.col("mark") > 0) & following, F.col("mark")).otherwise(0))

    def stretch(self, *ps: str | Column, top: bool = False, up: bool = False) -> TokenFrame:
        """Each mark gets the first later match (at its own level, or one up) as its bound, and that its mark's place; marks without one vanish."""
        self._check(top=top, up=up)
        m, df = F.col("mark") > 0, self.df.withColumn("_p", chain(*ps))
        if not (top or up):
            to = F.min(F.when(F.col("_p"), F.col("seq"))).over(after())
            last_p = F.coalesce(F.max(F.when(F.col("_p"), F.col("seq"))).over(before()), F.lit(-1))
            frm = F.max(F.when(m, F.col("seq"))).over(before())
            out = df.withColumn("_to", F.when(m, to)).withColumn("_from", F.when(F.col("_p") & (frm >= last_p), frm))
        else:
            # candidates stand under (kind, level) for each kind of bracket, anchors under their own
            rows = df.where(m | F.col("_p"))
            inside = lambda n, close: (F.col(n) - F.when(F.col("txt") == close, 0).otherwise(1)).cast("int")
            if top:
                levels = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("n")) for k, v in (("r", inside("round", ")")), ("b", inside("bracket", "]")), ("c", F.when(F.col("txt") == "}", F.col("curly")).otherwise(F.col("curly"))))])
                # after an anchor "{" a token one deeper is at its level; after others one of the same depth is
                levels = F.concat(levels, F.array(F.struct(F.lit("{").alias("k"), inside("curly", "}").alias("n"))))
            else:
                levels = F.array(*[F.struct(F.lit(k).alias("k"), F.col(n).cast("int").alias("n")) for k, n in (("r", "round"), ("b", "bracket"), ("c", "curly"), ("{", "curly"))])
            kind = F.when(F.col("txt") == "(", "r").when(F.col("txt") == "[", "b").when(F.col("txt") == "{", "{").otherwise("c")
            own = _level(F.col("txt"), top)
            own = F.struct(kind.alias("k"), own["n"].alias("n"))
            events = rows.select("fid", "seq", F.explode(F.concat(F.when(m, F.array(F.struct(own.alias("l"), F.lit(1).alias("a")))).otherwise(F.array()), F.when(F.col("_p"), F.transform(levels, lambda x: F.struct(x.alias("l"), F.lit(0).alias("a")))).otherwise(F.array()))).alias("e"))
            w = Window.partitionBy("fid", "e.l.k", "e.l.n").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
            hits = events.withColumn("_to", F.min(F.when(F.col("e.a") == 0, F.col("seq"))).over(w)).where("e.a = 1 and _to is not null").select(F.col("fid").alias("_f"), F.col("seq").alias("_a"), "_to")
            back = hits.groupBy("_f", "_to").agg(F.max("_a").alias("_from")).select("_f", F.col("_to").alias("_s"), "_from")
            both = hits.select("_f", F.col("_a").alias("_s"), "_to").join(back, ["_f", "_s"], "full")
            out = df.join(both, df.fid.eqNullSafe(F.col("_f")) & (F.col("seq") == F.col("_s")), "left").drop("_f", "_s")
        out = out.withColumn("bound", F.coalesce("_to", "_from", "bound")).withColumn("mark", F.when(m & F.col("_to").isNotNull(), F.col("mark")).otherwise(0))
        return self._next(out.drop("_p", "_to", "_from"))

    def contains(self, *ps: str | Column, no: bool = False, and_: bool = False, top: bool = False, up: bool = False) -> TokenFrame:
        """Marked ranges that hold a match strictly inside stay (``no``: that hold none); ``and_`` marks the matches instead.

        A range holds a match if the first one after its start comes before its end: a window, no join.
        """
        self._check(no=no, and_=and_, top=top, up=up)
        if top or up or and_:
            return self._contains_join(ps, no, and_, top, up)
        m, to = F.col("mark") > 0, F.min(F.when(F.col("_p"), F.col("seq"))).over(after())
        df = self.df.withColumn("_p", chain(*ps)).withColumn("_to", to).withColumn("_d", dest())
        hit = F.coalesce(F.col("_to") < F.col("_d"), F.lit(False))
        keep = m & (F.col("_d") > F.col("seq")) & (~hit if no else hit)
        return self._next(df.withColumn("mark", F.when(keep, F.col("mark")).otherwise(0)).drop("_p", "_to", "_d"))

    def _contains_join(self, ps, no: bool, and_: bool, top: bool, up: bool) -> TokenFrame:
        df = self.df.withColumn("_p", chain(*ps))
        r = df.where(F.col("mark") > 0).select(F.col("fid").alias("_f"), F.col("seq").alias("_a"), dest().alias("_b"), F.col("txt").alias("_t"), F.col("curly").alias("_c"), F.col("round").alias("_r"), F.col("bracket").alias("_k")).where("_b > _a")
        c = df.where("_p").select("fid", "seq", "txt", "curly", "round", "bracket")
        on = c.fid.eqNullSafe(F.col("_f")) & (F.col("seq") > F.col("_a")) & (F.col("seq") < F.col("_b"))
        if top:
            same = lambda n, close: n - F.when(F.col("txt") == close, 0).otherwise(1)
            on &= F.when(F.col("_t") == "{", F.col("_c") == same(F.col("curly"), "}")).when(F.col("_t") == "(", F.col("_r") == same(F.col("round"), ")")).when(F.col("_t") == "[", F.col("_k") == same(F.col("bracket"), "]")).otherwise(F.col("_c") == F.col("curly"))
        if up:
            on &= F.when(F.col("_t") == "(", F.col("_r") == F.col("round") + 1).when(F.col("_t") == "[", F.col("_k") == F.col("bracket") + 1).otherwise(F.col("_c") == F.col("curly") + 1)
        hit = r.join(c, on)
        if and_:
            keys = hit.select("fid", "seq").distinct()
        elif no:
            keys = r.join(hit.select("_f", "_a"), ["_f", "_a"], "left_anti").select(F.col("_f").alias("fid"), F.col("_a").alias("seq"))
        else:
            keys = hit.select(F.col("_f").alias("fid"), F.col("_a").alias("seq")).distinct()
        keys = keys.select(F.col("fid").alias("_f"), F.col("seq").alias("_s"))
        out = df.join(keys, df.fid.eqNullSafe(F.col("_f")) & (F.col("seq") == F.col("_s")), "left")
        return self._next(out.withColumn("mark", F.when(F.col("_s").isNotNull(), 1).otherwise(0)).drop("_p", "_f", "_s"))

    def reset(self, bounds: bool = False) -> TokenFrame:
        df = self.df.withColumn("mark", F.lit(0))
        return self._next(df.withColumn("bound", F.lit(None).cast("long")) if bounds else df)

    def undo(self) -> TokenFrame:
        if self._previous is None:
            raise ValueError("nothing to undo")
        return self._previous

    def struct_body(self, name: str) -> TokenFrame:
        """Mark the body of ``struct name { .. }``, outside of ( ) and [ ]."""
        f = TokenFrame(self.df.withColumn("mark", F.lit(0))).mark("struct", name, "{").next("{")
        inside = f._inside()
        return self._next(inside.withColumn("mark", F.when((F.col("_in") > 0) & (F.col("round") == 0) & (F.col("bracket") == 0), 1).otherwise(0)).drop("_in"))

    # registers: columns, so that saving and restoring needs no join

    def _register(self, n: int) -> tuple[str, str]:
        if n not in (1, 2, 3):
            raise ValueError("registers are 1, 2 and 3")
        return f"mset{n}", f"mbnd{n}"

    def _with_register(self, n: int) -> DataFrame:
        m, b = self._register(n)
        return self.df if m in self.df.columns else self.df.withColumn(m, F.lit(0)).withColumn(b, F.lit(None).cast("long"))

    def save(self, n: int, op: str = "=") -> TokenFrame:
        """Register n becomes (or is joined |, met &, lessened ^ by) the marks."""
        m, b = self._register(n)
        df, old, new = self._with_register(n), F.col(m), F.col("mark")
        value = {"=": new, "|": F.when(old > 0, old).otherwise(new), "&": F.when((old > 0) & (new > 0), old).otherwise(0), "^": F.when(new > 0, 0).otherwise(old)}[{"+": "|", "*": "&", "-": "^"}.get(op, op)]
        return self._next(df.withColumn(m, value).withColumn(b, F.col("bound") if op == "=" else F.coalesce(b, "bound")))

    def restore(self, n: int, op: str = "=") -> TokenFrame:
        m, b = self._register(n)
        df, old, new = self._with_register(n), F.col("mark"), F.col(m)
        value = {"=": new, "|": F.when(old > 0, old).otherwise(new), "&": F.when((old > 0) & (new > 0), old).otherwise(0), "^": F.when(new > 0, 0).otherwise(old)}[{"+": "|", "*": "&", "-": "^"}.get(op, op)]
        return self._next(df.withColumn("mark", value).withColumn("bound", F.col(b) if op == "=" else F.coalesce("bound", b)))

    # results

    def marks(self) -> DataFrame:
        return self.df.where(F.col("mark") > 0)

    def count(self, n: int = 0) -> DataFrame:
        """One row: the marks of a register (0: the current ones)."""
        c = F.col("mark") if n == 0 else F.col(self._register(n)[0])
        return self._with_register(n or 1).agg(F.count_if(c > 0).alias("marks"))

    def inspect(self, fnm: str, lnr: int) -> DataFrame:
        return self.df.where((F.col("fnm") == fnm) & (F.col("lnr") == lnr)).orderBy("fid", "seq").select("seq", "txt", "typ")

    def list(self, n: int | None = None) -> DataFrame:
        """One row for each (file, line) with marks, numbered from 1; n picks one."""
        w = Window.partitionBy("fid", "lnr").orderBy("seq")
        first = self.marks().withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
        # lines before this file's: a prefix sum over one number a file
        numbered = first.withColumn("nr", F.row_number().over(in_order()))
        sizes = first.groupBy("fid").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("fid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        out = numbered.join(sizes.select(F.col("fid").alias("_f"), "_before"), F.col("fid").eqNullSafe(F.col("_f"))).withColumn("nr", (F.col("nr") + F.col("_before")).cast("long"))
        out = out.select("nr", "fid", "fnm", "lnr", "seq", "txt", "fct")
        return out if n is None else out.where(F.col("nr") == n)

    def display(self, lines: DataFrame, context: int = 0, n: int | None = None) -> DataFrame:
        """The listed lines with ``context`` lines before and after, from a (fid, lnr, line) table."""
        at = self.list(n).select("nr", "fid", F.explode(F.sequence(F.greatest(F.lit(1), F.col("lnr") - context), F.col("lnr") + context)).alias("lnr"), F.col("lnr").alias("hit"))
        return at.join(lines.select("fid", "lnr", "line"), ["fid", "lnr"]).select("nr", "fid", "lnr", "line", (F.col("lnr") == F.col("hit")).alias("marked"))

    def reprint(self, context: int = 0) -> DataFrame:
        """The listed lines, put together from their tokens."""
        at = self.list().select("nr", "fid", F.explode(F.sequence(F.greatest(F.lit(1), F.col("lnr") - context), F.col("lnr") + context)).alias("lnr"))
        text = self.df.groupBy("fid", "lnr").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "txt"))), lambda t: t["txt"]), " ").alias("line"))
        return at.join(text, ["fid", "lnr"]).select("nr", "fid", "lnr", "line")

    def ranges(self) -> DataFrame:
        """Adds ``range``: lines from a token to the end of its range, 0 if it has none."""
        df = self.df.withColumn("_d", dest())
        ends = self.df.select(F.col("fid").alias("_f"), F.col("seq").alias("_s"), F.col("lnr").alias("_l"))
        return df.join(ends, df.fid.eqNullSafe(F.col("_f")) & (F.col("_d") == F.col("_s")), "left").withColumn("range", F.coalesce(F.col("_l") - F.col("lnr"), F.lit(0))).drop("_d", "_f", "_s", "_l")
