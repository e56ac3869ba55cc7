"""Operator 5: mixing sources to target weights by iterative proportional fitting.

The corpus is a table of token counts by (source, lang, topic). A cell's documents
are kept with the probability min(1, a x b x c), one factor for its source, one
for its language and one for its topic. Raking sets the factors of the three
dimensions in turn such that the expected tokens of each category are its target,
until all hold: cells that are kept whole are counted as such while the factors
of the others rise, so the cap of one costs no marginal its target. The keyed
hash of a doc_id decides, so a run can be repeated.

If the targets can't be met with the budget ``keep`` (a category has fewer tokens
than it is to give), the budget is lowered: first to what each category allows by
itself, then by 5 % at a time until raking converges. Categories without tokens in
the corpus can't be met at all: they leave the targets, with a warning.

Up to DRIVER_CELLS cells are raked on the driver, more by Spark jobs: the same
steps with the same stopping rule, hence the same probabilities.

Nulls: a null source or language is a category of its own; a null text has no
tokens. Documents without tokens take the probability of their cell (of cells
without any token: 0). Ties and repeated rows: rows of one doc_id get the same
number from the hash; a null doc_id counts as one id. Empty texts have no tokens,
very long ones are counted whole. An empty table gives an empty sample. Extra
columns pass through; if one is called ``_tokens``, ``_topic`` or ``_p``, the
operator's column takes the first free name with a digit behind.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, unused

DIMS = ("source", "lang", "topic")
#: Beyond so many cells the raking runs as Spark jobs instead of on the driver.
DRIVER_CELLS = 200_000
#: A topic and the marks that speak for it; most different marks win, then the earlier topic.
TOPICS = {
    "legal": ("icense", "opyright", "ights reserved", "arranty", "Permission "),
    "contact": ("@", "token = ", "http", "key = ", "+1 ("),
    "tabular": (" | ", "\t", ";;"),
    "markup": ("</", "/>", "{", "```"),
}


def tokens(text: Column) -> Column:
    """Words between blanks and line ends: one more than there are separators, 0 of an empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.translate(t, " \n", "")) + 1).cast("long")


def topic(text: Column, topics: dict[str, tuple[str, ...]] | None = None) -> Column:
    """What a document is about: the topic most of whose marks stand in it; of none, prose."""
    t, topics = F.coalesce(text, F.lit("")), TOPICS if topics is None else topics
    score = {k: sum((t.contains(m).cast("int") for m in marks), F.lit(0)) for k, marks in topics.items()}
    top = F.greatest(*score.values(), F.lit(0), F.lit(0))
    out = F.when(top == 0, "prose")
    for k, x in score.items():
        out = out.when(x == top, k)
    return out


def tempered(shares: dict[str, float], power: float) -> dict[str, float]:
    """Shares raised to a power and normalised: below 1 it lifts the rare ones."""
    x = {k: v**power for k, v in shares.items() if v > 0}
    return {k: v / sum(x.values()) for k, v in x.items()}


ROUNDS, TOLERANCE, NEAR_ENOUGH = 200, 1e-10, 1e-7


def rake(t: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Unbounded products q of factors such that t x min(1, q) meets the goals (tokens by category of each dimension); the largest share of t that is off.

    The factor of a category solves goal = whole + factor x rest for its cells as
    they are now capped or not (a Newton step on a concave function); where the
    capped ones alone exceed the goal, all are scaled below it first.
    """
    q, total, off = np.full(len(t), 0.5), max(float(t.sum()), 1e-300), np.inf
    for _ in range(ROUNDS):
        off = 0.0
        for c, goal in zip(codes, goals, strict=True):
            n = len(goal)
            whole, rest, all_ = np.bincount(c, np.where(q >= 1, t, 0), n), np.bincount(c, np.where(q < 1, t * q, 0), n), np.bincount(c, t * q, n)
            off = max(off, float(np.abs(whole + rest - goal).max(initial=0)) / total)
            with np.errstate(divide="ignore", invalid="ignore"):
                f = np.where(goal <= 0, 0.0, np.where(goal <= whole, np.where(all_ > 0, goal / all_, 1.0), np.where(rest > 0, (goal - whole) / rest, 1.0)))
            f = np.where((rest <= 0) & (goal == whole) & (goal > 0), 1.0, f)
            q = q * f[c]
        if off < TOLERANCE:
            break
    return q, off


def _rake_spark(cells: DataFrame, goals: dict[str, DataFrame], total: float) -> tuple[DataFrame, float]:
    """The same for tables too large for the driver, with one written table a round: cells with q."""
    w, off = cells.withColumn("q", F.lit(0.5)), np.inf
    old = None
    for _ in range(ROUNDS):
        most = []
        for d in DIMS:
            capped = F.col("q") >= 1
            now = w.groupBy(d).agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0.0)).alias("whole"), F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("q"))).alias("rest"), F.sum(F.col("tokens") * F.col("q")).alias("all"))
            now = now.join(goals[d], d, "left").withColumn("goal", F.coalesce("goal", F.lit(0.0)))
            f = F.when(F.col("goal") <= 0, 0.0).when((F.col("rest") <= 0) & (F.col("goal") == F.col("whole")), 1.0)
            f = f.when(F.col("goal") <= F.col("whole"), F.when(F.col("all") > 0, F.col("goal") / F.col("all")).otherwise(1.0)).otherwise(F.when(F.col("rest") > 0, (F.col("goal") - F.col("whole")) / F.col("rest")).otherwise(1.0))
            now = now.withColumn("f", f).withColumn("off", F.abs(F.col("whole") + F.col("rest") - F.col("goal")) / total)
            w = w.join(now.select(d, "f", F.col("off").alias(f"off_{d}")), d).withColumn("q", F.col("q") * F.col("f")).drop("f")
            most.append(F.max(f"off_{d}"))
        new = materialize(w, "rake")
        off = new.agg(F.greatest(*most)).head()[0] or 0.0
        w = new.select(*DIMS, "tokens", "q")
        if old is not None:
            discard(old)
        old = new
        if off < TOLERANCE:
            break
    return w, off


def allowed(keep: float, shares: dict[str, dict[str, float]], seen: dict[str, dict[str, float]]) -> float:
    """The budget that each category can give by itself."""
    total = sum(seen["source"].values()) or 1.0
    return min([keep, *(seen[d][k] / total / v for d in DIMS for k, v in shares[d].items() if v > 0)])


def _shares(seen: dict[str, dict[str, float]], targets: dict[str, dict[str, float]] | None, powers: dict[str, float]) -> dict[str, dict[str, float]]:
    """Target shares by dimension, of categories that have tokens."""
    out = {}
    for d in DIMS:
        total = sum(seen[d].values()) or 1.0
        x = (targets or {}).get(d) or tempered({k: v / total for k, v in seen[d].items()}, powers[d])
        if gone := sorted(k for k, v in x.items() if v > 0 and not seen[d].get(k)):
            warnings.warn(f"no tokens of {d} {gone[:5]}: they leave the targets", stacklevel=3)
        x = {k: v for k, v in x.items() if seen[d].get(k)}
        out[d] = {k: v / (sum(x.values()) or 1) for k, v in x.items()}
    return out


def probabilities(cells: DataFrame, keep: float, targets: dict[str, dict[str, float]] | None, powers: dict[str, float]) -> DataFrame:
    """Cells (source, lang, topic, tokens) with the probability p of their documents."""
    spark = cells.sparkSession
    cells = materialize(cells, "cells")
    # one row for each source, language or topic
    seen = {d: {k: float(v or 0) for k, v in cells.groupBy(d).agg(F.sum("tokens")).collect()} for d in DIMS}
    shares, total = _shares(seen, targets, powers), sum(seen["source"].values())
    budget, local = allowed(keep, shares, seen), cells.count() <= DRIVER_CELLS
    if local:
        rows = sorted(cells.collect())
        t = np.array([r.tokens for r in rows], float)
        names = [sorted({r[d] for r in rows}) for d in DIMS]
        at = [{k: i for i, k in enumerate(n)} for n in names]
        codes = [np.array([a[r[d]] for r in rows], int) for d, a in zip(DIMS, at, strict=True)]
    while True:
        goals = {d: {k: v * budget * total for k, v in shares[d].items()} for d in DIMS}
        if local:
            q, off = rake(t, codes, [np.array([goals[d].get(k, 0.0) for k in n]) for d, n in zip(DIMS, names, strict=True)])
        else:
            w, off = _rake_spark(cells, {d: spark.createDataFrame(list(goals[d].items()), f"{d} string, goal double") for d in DIMS}, total)
        if off < NEAR_ENOUGH or budget < 1e-6:
            break
        budget *= 0.95
    if local:
        p = np.where(t > 0, np.minimum(1, q), 0.0) if len(t) else t
        out = spark.createDataFrame([(*(r[d] for d in DIMS), float(x)) for r, x in zip(rows, p, strict=True)], "source string, lang string, topic string, p double")
        return F.broadcast(out)  # of at most DRIVER_CELLS rows
    return w.select(*DIMS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("q"))).otherwise(0.0).alias("p"))


def uniform(seed: int) -> Column:
    """A number in [0, 1) for each doc_id."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(seed)), 11) / F.lit(float(1 << 53))


def cell_keys(docs: DataFrame) -> dict[str, Column]:
    return {"source": F.coalesce(F.col("source").cast("string"), F.lit("\0")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("\0")), "topic": topic(F.col("text").cast("string"))}


def mix(docs: DataFrame, keep: float = 0.7, targets: dict[str, dict[str, float]] | None = None, powers: dict[str, float] | None = None, seed: int = 29) -> DataFrame:
    """The sampled rows of ``docs``, with ``_tokens``, ``_topic`` and ``_p``.

    keep: share of all tokens to expect. targets: by dimension (source, lang,
    topic) the wanted shares; a dimension that is not given takes its present
    shares raised to its power (source 0.9, lang 0.7, topic 0.8).
    """
    key = cell_keys(docs)
    size = tokens(F.col("text").cast("string"))
    cells = docs.groupBy(*[v.alias(k) for k, v in key.items()]).agg(F.sum(size).alias("tokens"))
    p = probabilities(cells, keep, targets, {"source": 0.9, "lang": 0.7, "topic": 0.8} | (powers or {}))
    work = {d: unused(docs, f"cell_{d}") for d in DIMS}
    own = [unused(docs, n) for n in ("_tokens", "_topic", "_p")]
    p = p.select(*[F.col(d).alias(work[d]) for d in DIMS], F.col("p").alias(own[2]))
    named = docs.withColumns({own[0]: size, own[1]: key["topic"]})
    on = [(F.col(own[1]) if d == "topic" else v) == F.col(work[d]) for d, v in key.items()]
    return named.join(p, on).where(uniform(seed) < F.col(own[2])).select(*[f"`{c}`" for c in named.columns], own[2])


def query(spark, sf_dir: str) -> DataFrame:
    d = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))
    return d.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_p", 9).alias("probability"))
