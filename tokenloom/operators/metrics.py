"""Metrics and text analytics: histograms, sizes, complexity, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import structure
from .windows import in_order



def histogram(tokens: DataFrame, by: str | Column = "txt", words: list[str] | None = None) -> DataFrame:
    """(key, n) of a token column; of the given words only, if there are any."""
    key = F.col(by) if isinstance(by, str) else by
    out = tokens.where(key.isin(words)) if words is not None else tokens
    return out.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def statement_kinds(tokens: DataFrame) -> DataFrame:
    return histogram(tokens, words=["if", "else", "for", "while", "do", "switch", "case", "default", "goto", "return", "break", "continue"])


def halstead(tokens: DataFrame) -> DataFrame:
    """Operators (n1, N1) and operands (n2, N2), and what follows from their numbers, by file."""
    operand = (F.col("typ") == "ident") | F.col("typ").startswith("const") | F.col("typ").isin("str", "chr")
    operator = ~operand & ~F.coalesce("typ", F.lit("")).isin("cmnt", "cpp") & ~F.col("txt").isin(")", "]", "}")
    d = tokens.groupBy("fid").agg(
        F.countDistinct(F.when(operator, F.col("txt"))).alias("n1"), F.countDistinct(F.when(operand, F.col("txt"))).alias("n2"),
        F.count_if(operator).alias("N_1"), F.count_if(operand).alias("N_2"),
    )
    v = (F.col("N_1") + F.col("N_2")) * F.log2(F.greatest(F.col("n1") + F.col("n2"), F.lit(1)))
    d = d.withColumn("volume", v).withColumn("difficulty", F.when(F.col("n2") > 0, F.col("n1") / 2 * F.col("N_2") / F.col("n2")).otherwise(0.0))
    return d.withColumn("level", F.when(F.col("difficulty") > 0, 1 / F.col("difficulty"))).withColumn("effort", F.col("difficulty") * F.col("volume")).withColumn("time", F.col("effort") / 18).withColumn("bugs", F.pow("effort", F.lit(2 / 3)) / 3000)


def source_lines(tokens: DataFrame) -> DataFrame:
    """Physical lines, statements (;) and comments by file, and in total (fid null)."""
    by = tokens.groupBy("fid").agg(F.max("lnr").alias("lines"), F.count_if(F.col("txt") == ";").alias("statements"), F.count_if(F.col("typ") == "cmnt").alias("comments"))
    return by.unionByName(by.agg(F.sum("lines").alias("lines"), F.sum("statements").alias("statements"), F.sum("comments").alias("comments")).withColumn("fid", F.lit(None).cast("long")))


def comment_stats(tokens: DataFrame) -> DataFrame:
    c = tokens.where(F.col("typ") == "cmnt")
    at = F.struct("fid", "lnr")
    return c.agg(F.count("*").alias("n"), F.min("len").alias("shortest"), F.max("len").alias("longest"), F.avg("len").alias("mean"), F.max_by(at, F.struct("len", "fid", "lnr")).alias("longest_at"), F.min_by(at, F.struct("len", "fid", "lnr")).alias("shortest_at"))


def function_lengths(tokens: DataFrame) -> DataFrame:
    return structure.functions(tokens).select("fid", "name", (F.col("upto_lnr") - F.col("from_lnr") + 1).alias("lines"), F.length("name").alias("name_length"))


def top(df: DataFrame, by: str, k: int = 10, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def parameter_counts(tokens: DataFrame) -> DataFrame:
    """(params, functions): how many functions have so many parameters."""
    f = structure.functions(tokens).select(F.col("fid").alias("_f"), "name", "name_seq", "body_seq")
    t = structure.source(tokens)
    inner = t.join(f, F.col("fid").eqNullSafe(F.col("_f")) & (F.col("seq") > F.col("name_seq")) & (F.col("seq") < F.col("body_seq")))
    commas = inner.groupBy("_f", "name", "name_seq").agg(F.count_if((F.col("txt") == ",") & (F.col("round") == 1)).alias("c"), F.count_if(F.col("round") >= 1).alias("inside"), F.count_if((F.col("txt") == "void") & (F.col("round") == 1)).alias("v"))
    # inside counts the closing bracket? no: it carries the opener's depth
    params = F.when((F.col("inside") == 0) | ((F.col("inside") == 1) & (F.col("v") == 1)), 0).otherwise(F.col("c") + 1)
    return commas.groupBy(params.alias("params")).agg(F.count("*").alias("functions"))


def functions_per_file(tokens: DataFrame) -> DataFrame:
    return structure.functions(tokens).groupBy("fid").agg(F.count("*").alias("functions"))


def identifier_lengths(tokens: DataFrame, width: int = 1, most: int = 13, words: Column | None = None) -> DataFrame:
    """(bucket, n) of identifier lengths; the last bucket is open."""
    ids = tokens.where(F.col("typ") == "ident" if words is None else words)
    return ids.groupBy(F.least(F.floor(F.length("txt") / width), F.lit(most)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def longest_identifier(tokens: DataFrame, words: Column | None = None) -> DataFrame:
    ids = tokens.where(F.col("typ") == "ident" if words is None else words)
    return ids.agg(F.max_by("txt", F.struct(F.length("txt"), "txt")).alias("txt"), F.max(F.length("txt")).alias("len"))


def identifiers_per_file(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("typ") == "ident").groupBy("fid").agg(F.count("*").alias("identifiers"), F.countDistinct("txt").alias("distinct_identifiers"))


def nesting(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("fid").agg(F.max("curly").alias("deepest"), F.avg("curly").alias("mean"), F.max_by("lnr", F.struct("curly", -F.col("seq"))).alias("at_line"))


def statements_per_line(tokens: DataFrame) -> DataFrame:
    """(statements, lines): how many lines hold so many statements; the ; of for heads don't count."""
    by = tokens.where((F.col("txt") == ";") & (F.col("round") == 0)).groupBy("fid", "lnr").agg(F.count("*").alias("statements"))
    return by.groupBy("statements").agg(F.count("*").alias("lines"))


def cases_per_switch(tokens: DataFrame) -> DataFrame:
    """(fid, seq, cases) of each switch: its cases lie one level deeper than it, up to its closing brace."""
    t = structure.source(tokens)
    w = Window.partitionBy("fid", "curly").orderBy("seq")
    s = t.where(F.col("txt").isin("switch", "case", "default")).withColumn("curly", F.when(F.col("txt") == "switch", F.col("curly") + 1).otherwise(F.col("curly")))
    s = s.withColumn("_s", F.max(F.when(F.col("txt") == "switch", F.col("seq"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.where("_s is not null").groupBy("fid", F.col("_s").alias("seq")).agg(F.count_if(F.col("txt") != "switch").alias("cases"))


def crosstab(findings: DataFrame, rows: str = "file", columns: str = "type") -> DataFrame:
    """Counts by row, by column, by both and in total (nulls stand for all)."""
    return findings.cube(rows, columns).agg(F.count("*").alias("n"))


def ngrams(tokens: DataFrame, n: int = 3, column: str = "txt") -> DataFrame:
    """(gram, n) of n successive tokens of a file."""
    parts = [F.lead(column, k).over(in_order()) for k in range(n)]
    d = tokens.select("fid", "seq", *[p.alias(f"_{k}") for k, p in enumerate(parts)]).where(F.col(f"_{n - 1}").isNotNull())
    return d.groupBy(F.concat_ws(" ", *[f"_{k}" for k in range(n)]).alias("gram")).agg(F.count("*").alias("n"))


def word_count(lines: DataFrame) -> DataFrame:
    """Lines, words, numbers and characters by file."""
    words = F.filter(F.split("line", "[ \t]+"), lambda w: w != "")
    return lines.groupBy("fid").agg(F.count("*").alias("lines"), F.sum(F.size(words)).alias("words"), F.sum(F.size(F.filter(words, lambda w: w.rlike("^[0-9]+$")))).alias("numbers"), F.sum(F.length("line")).alias("chars"))


def fields(lines: DataFrame, *picks: int, sep: str = "[ \t]+") -> DataFrame:
    """Fields of each line by number, from 1, as awk does."""
    parts = F.filter(F.split("line", sep), lambda w: w != "")
    return lines.select("fid", "lnr", *[F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit("")).alias(f"f{k}") for k in picks])


def keyword_complexity(tokens: DataFrame) -> DataFrame:
    """1 + branches by function; a case right after a case adds none."""
    t = structure.with_function(structure.source(tokens))
    before = F.lag("txt").over(in_order())
    through = F.col("txt").isin("case", "default") & (before == ":")
    branch = F.col("txt").isin("if", "while", "for") | (F.col("txt").isin("case", "default") & ~F.coalesce(through, F.lit(False)))
    return t.withColumn("_b", branch.cast("int")).where("fct <> 'global'").groupBy("fid", "fct").agg((F.sum("_b") + 1).alias("complexity"))


def function_pairs(calls: DataFrame, least: int = 2) -> DataFrame:
    """(first, second, together, share): how often a call of ``second`` follows one of ``first`` in a body."""
    one = calls.groupBy("fid", "caller", "callee").agg(F.min("seq").alias("s"), F.max("seq").alias("e"))
    a, b = one.select("fid", "caller", F.col("callee").alias("first"), "s"), one.select("fid", "caller", F.col("callee").alias("second"), "e")
    both = a.join(b, ["fid", "caller"]).where("first <> second and s < e").groupBy("first", "second").agg(F.count("*").alias("together"))
    return both.join(one.groupBy(F.col("callee").alias("first")).agg(F.count("*").alias("bodies")), "first").where(F.col("together") >= least).withColumn("share", F.col("together") / F.col("bodies")).drop("bodies")


def loop_patterns(tokens: DataFrame) -> DataFrame:
    """(pattern, n): the heads of for loops with names in the order of their appearance as V1, V2, .. and constants as C."""
    t = structure.source(tokens)
    heads = t.withColumn("_p", F.lag("txt").over(in_order())).where("txt = '(' and _p = 'for' and jmp is not null").select(F.col("fid").alias("_f"), F.col("seq").alias("_a"), F.col("jmp").alias("_b"))
    inner = t.join(heads, F.col("fid").eqNullSafe(F.col("_f")) & (F.col("seq") > F.col("_a")) & (F.col("seq") < F.col("_b")))
    first = Window.partitionBy("fid", "_a", "txt", "typ")
    inner = inner.withColumn("_1st", F.when(F.col("typ") == "ident", F.min("seq").over(first)))
    inner = inner.withColumn("_v", F.dense_rank().over(Window.partitionBy("fid", "_a", F.col("typ") == "ident").orderBy("_1st")))
    word = F.when(F.col("typ") == "ident", F.concat(F.lit("V"), F.col("_v"))).when(F.col("typ").startswith("const"), "C").otherwise(F.col("txt"))
    text = inner.groupBy("fid", "_a").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", word.alias("w")))), lambda x: x["w"]), " ").alias("pattern"))
    return text.groupBy("pattern").agg(F.count("*").alias("n"))


def outliers(patterns: DataFrame, reference: DataFrame, least: int = 1) -> DataFrame:
    """Patterns that the reference model (count, pattern) has fewer than ``least`` times."""
    return patterns.join(reference.where(F.col("count") >= least).select("pattern"), "pattern", "left_anti")


def pairing(tokens: DataFrame, first: str, second: str) -> DataFrame:
    """(fct, good, bad): calls of ``first`` that a ``second`` follows in the function before the next ``first``."""
    t = structure.with_function(structure.source(tokens)).where(F.col("txt").isin(first, second))
    n = F.lead("txt").over(Window.partitionBy("fid", "fct").orderBy("seq"))
    return t.withColumn("_n", n).where(F.col("txt") == first).groupBy("fid", "fct").agg(F.count_if(F.col("_n") == second).alias("good"), F.count_if(F.coalesce(F.col("_n"), F.lit("")) != second).alias("bad"))


def set_modules(matches: DataFrame) -> DataFrame:
    """(sets, files): which sets occur together in how many files."""
    return matches.groupBy("fid").agg(F.array_join(F.sort_array(F.collect_set("set")), "+").alias("sets")).groupBy("sets").agg(F.count("*").alias("files"))


def scope_check(tokens: DataFrame) -> DataFrame:
    """Global names that one file, or one function alone, uses."""
    s = structure.symbols(tokens).where("class = 'global' or class = 'none'")
    t = structure.with_function(structure.source(tokens)).select("fid", "seq", "fct")
    g = structure.symbols(tokens).where("class = 'global' and seq = decl_seq").select("name").distinct()
    use = s.where("decl_seq is null or seq <> decl_seq").join(g, "name", "left_semi").join(t, ["fid", "seq"])
    return use.groupBy("name").agg(F.countDistinct("fid").alias("files"), F.countDistinct("fid", "fct").alias("functions"), F.min("fct").alias("function")).where("files = 1")


def renamed(tokens: DataFrame) -> DataFrame:
    """Identifiers become n_k, k by first appearance in the file."""
    first = F.min("seq").over(Window.partitionBy("fid", "txt", F.col("typ") == "ident"))
    d = tokens.withColumn("_1", F.when(F.col("typ") == "ident", first))
    k = F.dense_rank().over(Window.partitionBy("fid", F.col("typ") == "ident").orderBy("_1"))
    return d.withColumn("txt", F.when(F.col("typ") == "ident", F.concat(F.lit("n_"), k)).otherwise(F.col("txt"))).drop("_1")


def shadowed(tokens: DataFrame) -> DataFrame:
    """Names declared as a local or parameter and in another scope of the file as well."""
    d = structure.symbols(tokens).where("seq = decl_seq")
    return d.groupBy("fid", "name").agg(F.count("*").alias("declared"), F.collect_set("class").alias("classes")).where("declared > 1")


def matching_lines(tokens: DataFrame, matches: DataFrame, files_only: bool = False) -> DataFrame:
    """Counts of matches by file name, or the names alone."""
    names = tokens.where("seq = 0").select("fid", "fnm")
    out = matches.join(names, "fid").groupBy("fnm").agg(F.count("*").alias("n"))
    return out.select("fnm") if files_only else out
