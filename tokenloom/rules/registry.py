"""Rules: id, pack, language, caption and how to find it: a pattern, or a function of tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lexer
from ..operators.match import MatchFrame
from ..plans import pattern

RULES: dict[str, Rule] = {}
PLUGINS: dict[str, Callable[[DataFrame], DataFrame]] = {}


@dataclass(frozen=True)
class Rule:
    name: str
    pack: str
    caption: str
    body: str | Callable[[DataFrame], MatchFrame]
    language: str = "c"
    hit: str | None = None
    miss: str | None = None


def add(pack: str, name: str, caption: str, body, language: str = "c", hit: str | None = None, miss: str | None = None) -> None:
    """hit, miss: a snippet that the rule finds something in, and one that it leaves alone."""
    RULES[name] = Rule(name, pack, caption, body, language, hit, miss)


def plugin(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a checker of one's own: tokens in, findings out."""
    PLUGINS[f.__name__] = f
    return f


def packs() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in RULES.values():
        out.setdefault(r.pack, []).append(r.name)
    return out


def run(tokens: DataFrame, *names: str) -> MatchFrame:
    """All matches of the named rules or packs; their patterns share one pass over each file."""
    chosen = [r for r in RULES.values() if r.name in names or r.pack in names]
    if not chosen:
        raise ValueError(f"no such rule or pack: {names}")
    # rules of one body are one search; a small table gives their names
    bodies = list(dict.fromkeys(r.body for r in chosen))
    names_of = tokens.sparkSession.createDataFrame([(str(bodies.index(r.body)), r.name, r.caption) for r in chosen], "_body string, _name string, _caption string")
    texts = [(str(i), b, None) for i, b in enumerate(bodies) if isinstance(b, str)]
    out = pattern.search_all(tokens, texts) if texts else None
    for i, b in enumerate(bodies):
        if not isinstance(b, str):
            m = b(tokens).named(str(i), None)
            out = m if out is None else out.union(m)
    df = out.df.join(F.broadcast(names_of), F.col("set") == F.col("_body"))  # a row a rule
    return pattern.suppressed(MatchFrame(df.withColumn("set", F.col("_name")).withColumn("msg", F.col("_caption"))), tokens)


def on_examples(spark, *languages: str) -> DataFrame:
    """(rule, snippet, found): whether each rule finds something in its snippets ``hit`` and ``miss``."""
    out = None
    for language in languages or sorted({r.language for r in RULES.values()}):
        rules = [r for r in RULES.values() if r.language == language and r.hit is not None]
        texts = list(dict.fromkeys(x for r in rules for x in (r.hit, r.miss)))
        of = [(r.name, kind, texts.index(x)) for r in rules for kind, x in (("hit", r.hit), ("miss", r.miss))]
        files = spark.createDataFrame([(i, f"{i}.{language}", x) for i, x in enumerate(texts)], "fid long, fnm string, text string")
        seen = run(lexer.code_tokens(files, language), *(r.name for r in rules)).df.select(F.col("set").alias("rule"), F.col("fid").alias("_fid"), F.lit(True).alias("_found")).distinct()
        asked = spark.createDataFrame(of, "rule string, snippet string, _fid long")
        df = asked.join(seen, ["rule", "_fid"], "left").select("rule", "snippet", F.coalesce("_found", F.lit(False)).alias("found"))
        out = df if out is None else out.union(df)
    return out


def summary(matches: MatchFrame) -> DataFrame:
    """``ps list``: names, counts, captions, of rules without matches as well."""
    spark = matches.df.sparkSession
    all_ = spark.createDataFrame([(r.name, r.caption) for r in RULES.values()], "set string, caption string")
    return all_.join(matches.df.groupBy("set").agg(F.count("*").alias("patterns")), "set", "left").fillna(0, ["patterns"])
