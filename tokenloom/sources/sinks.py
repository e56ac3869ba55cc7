"""Sinks: findings as JSON, JUnit and SARIF; token listings and text."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.match import MatchFrame

FINDING = ("type", "message", "file", "line", "source", "bindings", "place")


def findings(matches: MatchFrame, tokens: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(type, message, file, line, source, bindings, place); with lines, the first source line."""
    names = tokens.where("seq = 0").select(F.col("fid").alias("_f"), "fnm")
    first = tokens.groupBy(F.col("fid").alias("_g"), F.col("lnr").alias("_l")).agg(F.min("seq").alias("_s"))
    out = matches.df.join(names, F.col("fid").eqNullSafe(F.col("_f"))).join(first, F.col("fid").eqNullSafe(F.col("_g")) & (F.col("from_lnr") == F.col("_l")))
    out = out.withColumn("place", F.format_string("no_cpp %d %d", F.col("from_seq") - F.col("_s"), F.col("upto_seq") - F.col("from_seq") + 1))
    out = out.withColumn("bindings", F.array_join(F.transform(F.coalesce("bindings", F.array()), lambda b: F.concat(b["name"], F.lit("="), b["text"])), ", "))
    if lines is not None:
        src = lines.select(F.col("fid").alias("_h"), F.col("lnr").alias("_m"), F.col("line").alias("source"))
        out = out.join(src, F.col("fid").eqNullSafe(F.col("_h")) & (F.col("from_lnr") == F.col("_m")), "left")
    else:
        out = out.withColumn("source", F.lit(None).cast("string"))
    return out.select(F.col("set").alias("type"), F.coalesce("msg", "set").alias("message"), F.col("fnm").alias("file"), F.col("from_lnr").alias("line"), "source", "bindings", "place")


def to_json(found: DataFrame, plus: bool = False) -> DataFrame:
    """One JSON record a row; ``plus`` adds source and bindings."""
    names = [c for c in FINDING if plus or c not in ("source", "bindings")]
    return found.select(F.to_json(F.struct(*[F.col("line").cast("string").alias("line") if c == "line" else F.col(c) for c in names])).alias("json"))


def write_json(found: DataFrame, path: str, plus: bool = False) -> None:
    to_json(found, plus).withColumnRenamed("json", "value").write.mode("errorifexists").text(path)


def write_text(df: DataFrame, path: str) -> None:
    """A text listing; an existing one is not overwritten."""
    df.select(F.concat_ws("\t", *df.columns).alias("value")).write.mode("errorifexists").text(path)


def sarif_results(found: DataFrame, base: str = "") -> DataFrame:
    """(ruleId, ruleIndex, result) with a SARIF result object as JSON; indexes follow the order of the rules."""
    rules = found.select("type").distinct()
    numbered = rules.withColumn("ruleIndex", F.row_number().over(_by("type")) - 1)  # one row a rule
    loc = F.array(F.struct(F.struct(F.struct(F.concat(F.lit(base), F.col("file")).alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    out = found.join(numbered, "type")
    return out.select(F.col("type").alias("ruleId"), "ruleIndex", F.to_json(F.struct(F.col("type").alias("ruleId"), "ruleIndex", F.lit("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), loc.alias("locations"))).alias("result"))


def _by(*names: str):
    from pyspark.sql import Window

    return Window.orderBy(*names)


def sarif(found: DataFrame, tool: str = "tokenloom", base: str = "") -> str:
    """A whole SARIF document; for reports, not for tables."""
    rows = sarif_results(found, base).orderBy("ruleIndex", "result").collect()
    rules = ",".join(f'{{"id":"{r}"}}' for r in dict.fromkeys(x.ruleId for x in rows))
    return f'{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":[{rules}]}}}},"results":[{",".join(r.result for r in rows)}]}}]}}'


def junit(found: DataFrame) -> str:
    """A JUnit report, one suite a rule."""
    out = []
    suites = found.groupBy("type").agg(F.sort_array(F.collect_list(F.struct("file", "line", "message"))).alias("cases")).orderBy("type").collect()
    for s in suites:
        cases = "".join(f'<testcase classname={quoteattr(c.file or "")} name={quoteattr(f"line {c.line}")}><failure message={quoteattr(c.message or "")}/></testcase>' for c in s.cases)
        out.append(f'<testsuite name={quoteattr(s.type)} tests="{len(s.cases)}" failures="{len(s.cases)}">{cases}</testsuite>')
    return f'<?xml version="1.0" encoding="UTF-8"?><testsuites>{"".join(out)}</testsuites>'


def token_listing(tokens: DataFrame) -> DataFrame:
    """line, type, length and text of each token."""
    return tokens.select("fid", "seq", F.format_string("%d\t%s\t%d\t%s", "lnr", "typ", "len", "txt").alias("value"))


def scrubbed(found: DataFrame) -> DataFrame:
    return found.select(F.format_string("%s:%d: %s", "file", "line", "message").alias("value"))
