"""Taint: which variables hold external data, and where it reaches what it should not.

Facts are rows (fid, fct, name); each round joins them with assignments, call
arguments, parameters and returns; what is new goes on. Rounds end with a
written table, so no lineage grows and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import structure
from ..operators.windows import in_order, upto

SOURCES = ("getenv", "read", "recv", "recvfrom", "fgets", "gets", "fread", "scanf", "fscanf", "getchar", "getc", "argv")
TARGETS = ("strcpy", "strcat", "sprintf", "vsprintf", "memcpy", "gets", "system", "popen", "exec", "execl", "execv", "alloca")


def parse_config(text: str) -> dict[str, list[tuple[str, str, str]]]:
    """Sections (sources, importers, propagators, ignore, targets) of rows (name, from, into); a headline begins one."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    now = None
    for line in text.splitlines():
        words = line.split("#")[0].replace(",", " ").split()
        if not words:
            continue
        head = words[0].strip("%[]:=").lower()
        if head in ("sources", "importers", "propagators", "ignore", "targets"):
            now = out.setdefault(head, [])
        elif now is not None:
            now.append((words[0], words[1] if len(words) > 1 else "", words[2] if len(words) > 2 else ""))
    return out


def assignments(tokens: DataFrame) -> DataFrame:
    """(fid, fct, seq, lhs, rhs): each name in the statement after ``lhs =``."""
    t = structure.with_function(structure.source(tokens))
    stop = F.sum(F.when(F.col("txt").isin(";", "{", "}"), 1).otherwise(0)).over(upto())
    t = t.withColumn("_st", stop).withColumn("_n", F.lead("txt").over(in_order()))
    left = F.max(F.when((F.col("typ") == "ident") & F.col("_n").isin("=", "+=", "|="), F.struct("seq", F.col("txt").alias("name")))).over(Window.partitionBy("fid", "_st").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("_l", left).where("typ = 'ident' and _l is not null").select("fid", "fct", "seq", F.col("_l.name").alias("lhs"), F.col("txt").alias("rhs"))


def arguments(tokens: DataFrame) -> DataFrame:
    """(fid, fct, callee, seq, arg, pos): names in the arguments of calls, by place."""
    t = structure.source(tokens)
    c = structure.calls(tokens).select(F.col("fid").alias("_f"), "caller", "callee", (F.col("seq") + 1).alias("_o"))
    o = t.where("txt = '(' and jmp is not null").select(F.col("fid").alias("_f"), F.col("seq").alias("_o"), F.col("jmp").alias("_e"), F.col("round").alias("_r"))
    x = c.join(o, ["_f", "_o"])
    j = t.join(x, F.col("fid").eqNullSafe(F.col("_f")) & (F.col("seq") > F.col("_o")) & (F.col("seq") < F.col("_e")))
    pos = F.sum(F.when((F.col("txt") == ",") & (F.col("round") == F.col("_r") + 1), 1).otherwise(0)).over(Window.partitionBy("_f", "_o").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumn("pos", pos).where("typ = 'ident'").select("fid", F.col("caller").alias("fct"), "callee", "seq", F.col("txt").alias("arg"), "pos")


def parameters(tokens: DataFrame) -> DataFrame:
    """(fct, name, pos): the last name of each parameter."""
    f = structure.functions(tokens).select(F.col("fid").alias("_f"), F.col("name").alias("fct"), "name_seq", "body_seq")
    t = structure.source(tokens)
    j = t.drop("fct").join(f, F.col("fid").eqNullSafe(F.col("_f")) & (F.col("seq") > F.col("name_seq")) & (F.col("seq") < F.col("body_seq")))
    pos = F.sum(F.when((F.col("txt") == ",") & (F.col("round") == 1), 1).otherwise(0)).over(Window.partitionBy("_f", "name_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumn("pos", pos).where("typ = 'ident'").groupBy("fct", "pos").agg(F.max_by("txt", "seq").alias("name"))


def returned(tokens: DataFrame) -> DataFrame:
    """(fct, name): names in return statements."""
    t = structure.with_function(structure.source(tokens))
    last = F.last(F.when(F.col("txt") == "return", 1).when(F.col("txt").isin(";", "{", "}"), 0), ignorenulls=True).over(upto())
    return t.withColumn("_r", last).where("_r = 1 and typ = 'ident' and fct <> 'global'").select("fct", F.col("txt").alias("name")).distinct()


def tainted(tokens: DataFrame, sources: tuple[str, ...] = SOURCES, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fct, name, source): variables that may hold external data; a fixpoint over assignments, calls and returns.

    cut: what ends a round, a written table or checkpoint; a plain checkpoint by default.
    """
    spark = tokens.sparkSession
    cut = cut or (lambda d: d.checkpoint() if spark.sparkContext.getCheckpointDir() else d.persist())
    asg, args = cut(assignments(tokens)), cut(arguments(tokens))
    par, ret = cut(parameters(tokens)), cut(returned(tokens))
    start = asg.where(F.col("rhs").isin(*sources)).select("fct", F.col("lhs").alias("name"), F.col("rhs").alias("source"))
    start = start.union(args.where(F.col("callee").isin(*sources)).select("fct", F.col("arg").alias("name"), F.col("callee").alias("source")))
    known = cut(start.dropDuplicates(["fct", "name"]))
    new = known
    while True:
        n = new.select("fct", "name", "source")
        by_assign = asg.join(n.withColumnRenamed("name", "rhs"), ["fct", "rhs"]).select("fct", F.col("lhs").alias("name"), "source")
        by_call = args.join(n.withColumnRenamed("name", "arg"), ["fct", "arg"]).select(F.col("callee").alias("_c"), "pos", "source").join(par.withColumnRenamed("fct", "_c"), ["_c", "pos"]).select(F.col("_c").alias("fct"), "name", "source")
        back = ret.join(n, ["fct", "name"]).select(F.col("fct").alias("rhs"), "source").distinct()
        by_return = asg.join(back, "rhs").select("fct", F.col("lhs").alias("name"), "source")
        step = by_assign.union(by_call).union(by_return).dropDuplicates(["fct", "name"]).join(known, ["fct", "name"], "left_anti")
        new = cut(step)
        if not new.take(1):
            return known
        known = cut(known.union(new.select("fct", "name", "source")))


def findings(tokens: DataFrame, sources: tuple[str, ...] = SOURCES, targets: tuple[str, ...] = TARGETS, cut=None) -> DataFrame:
    """(fid, fct, target, seq, name, source): external data in the arguments of a dangerous call."""
    t = tainted(tokens, sources, cut)
    return arguments(tokens).where(F.col("callee").isin(*targets)).join(t.withColumnRenamed("name", "arg"), ["fct", "arg"]).select("fid", "fct", F.col("callee").alias("target"), "seq", F.col("arg").alias("name"), "source")
