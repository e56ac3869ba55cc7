"""Queries over a small C file that is written here; their SQL states what a reader of the file would answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar
from .operators import lexer, metrics, structure
from .operators.frame import TokenFrame
from .plans import pattern
from .plans.program import Program
from .queries import query
from .rules import registry, taint
from .rules import packs  # noqa: F401  the rules register themselves

CODE = """#include <stdio.h>
#define TWICE(x) ((x) * 2)
int total; /* all of it */
static int add(int a, int b) { return a + b; }
int fact(int n) {
	if (n < 2) { return 1; } else { return n * fact(n - 1); }
}
void pick(int k) {
	int i;
	char *name;
	switch (k) { case 1: total = 1; break; case 2: total = 2; }
	for (i = 0; i < k; i++) { total = add(total, i); }
	while (total > 9) total--; // shrink
	if (k) goto out;
	name = getenv("X");
	strcpy(buf, name);
out: return;
}
int main(void) { pick(fact(0x1F)); return 017; }
"""


def code(spark, text: str = CODE, language: str = "c", **kw):
    return lexer.code_tokens(spark.createDataFrame([(1, "t.c", text)], "fid long, fnm string, text string"), language, **kw)


def rows(columns: str, *values: tuple) -> str:
    """SQL of these rows."""
    def one(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, v)) + ')' for v in values)}) t({columns})"


# lexing


@query("code_types", rows("typ, n", ("type", 2), ("ident", 3), ("const_hex", 1), ("key", 1), ("const_oct", 1)))
def _(spark, sf):
    return code(spark).where("lnr = 19 and typ is not null and typ not in ('', 'cpp')").groupBy("typ").agg(F.count("*").alias("n"))


@query("code_operators", rows("txt, n", ("<", 3), ("+", 1), ("-", 1), ("*", 3), ("=", 5), ("++", 1), ("--", 1), (">", 2)))
def _(spark, sf):
    return code(spark).where(F.col("txt").isin("<", ">", "+", "-", "*", "=", "++", "--")).groupBy("txt").agg(F.count("*").alias("n"))


@query("code_directives", rows("lnr, txt", (1, "#include"), (2, "#define")))
def _(spark, sf):
    return code(spark).where(F.col("txt").startswith("#")).select("lnr", "txt")


@query("code_macros", rows("lnr, txt", (1, "# include <stdio.h>"), (2, "# define TWICE(x) ((x) * 2)")))
def _(spark, sf):
    return code(spark, macros=True).where("typ = 'cpp' and txt like '# %'").select("lnr", "txt")


@query("code_comments", rows("lnr, txt", (3, "/* all of it */"), (13, "// shrink")))
def _(spark, sf):
    return lexer.comments_only(code(spark)).select("lnr", "txt")


@query("code_source_only", rows("comments, numbered_through", (0, True)))
def _(spark, sf):
    t = lexer.source_only(code(spark))
    return t.agg(F.sum(F.when(F.col("typ") == "cmnt", 1).otherwise(0)).alias("comments"), (F.max("seq") + 1 == F.count("*")).alias("numbered_through"))


@query("code_prune", rows("txt", ("a",), ("c",)))
def _(spark, sf):
    return lexer.prune_if_zero(code(spark, "int a;\n#if 0\nint b;\n#endif\nint c;\n")).where("typ = 'ident'").select("txt")


@query("code_typedefs", rows("lnr, typ", (2, "type"), (3, "ident")))
def _(spark, sf):
    return code(spark, "typedef int number;\nnumber y;\nint z;\n").where("(lnr = 2 and txt = 'number') or txt = 'z'").select("lnr", "typ")


@query("code_line_markers", rows("lnr, txt", (7, "x"), (8, "y")))
def _(spark, sf):
    return code(spark, '# 7 "b.c"\nx\ny\n').where("typ = 'ident'").select("lnr", "txt")


@query("code_without_types", rows("txt, typ", ("unsigned", "ident"), ("int", "ident"), ("total", "ident")))
def _(spark, sf):
    return lexer.without_types(code(spark, "unsigned int total;"), "type", "modifier").where("typ = 'ident'").select("txt", "typ")


@query("code_nesting", rows("curly, round, unpaired", (2, 2, 0)))
def _(spark, sf):
    t = code(spark)
    return t.agg(F.max("curly").alias("curly"), F.max("round").alias("round"), F.sum(F.when(F.col("txt").isin("(", ")", "{", "}", "[", "]") & F.col("jmp").isNull(), 1).otherwise(0)).alias("unpaired"))


# structure


@query("code_functions", rows("name, from_lnr, upto_lnr", ("add", 4, 4), ("fact", 5, 7), ("pick", 8, 18), ("main", 19, 19)))
def _(spark, sf):
    return structure.functions(code(spark)).select("name", "from_lnr", "upto_lnr")


@query("code_calls", rows("caller, callee", ("fact", "fact"), ("pick", "add"), ("pick", "getenv"), ("pick", "strcpy"), ("main", "pick"), ("main", "fact")))
def _(spark, sf):
    return structure.calls(code(spark)).select("caller", "callee")


@query("code_owner", rows("fct, n", ("global", 1), ("pick", 6)))
def _(spark, sf):
    return structure.with_function(code(spark)).where("txt = 'total'").groupBy("fct").agg(F.count("*").alias("n"))


@query("code_source_of", rows("n, first_line", (3, "int fact(int n) {")))
def _(spark, sf):
    lines = lexer.lines(spark.createDataFrame([(1, "t.c", CODE)], "fid long, fnm string, text string"))
    return structure.function_source(code(spark), lines, "fact").agg(F.count("*").alias("n"), F.min_by("line", "lnr").alias("first_line"))


@query("code_context", rows("kind, name", ("called by", "main"), ("calls", "add"), ("calls", "getenv"), ("calls", "strcpy")))
def _(spark, sf):
    return structure.context(structure.calls(code(spark)), "pick").toDF("kind", "name")


@query("code_reach", rows("caller, callee", ("main", "pick"), ("pick", "add")))
def _(spark, sf):
    return structure.reach(structure.calls(code(spark)), "main", "add").select("caller", "callee")


@query("code_cyclomatic", rows("fct, cyclomatic", ("add", 1), ("fact", 2), ("pick", 6), ("main", 1)))
def _(spark, sf):
    return structure.cyclomatic(structure.control_flow(code(spark))).select("fct", "cyclomatic")


@query("code_keyword_complexity", rows("fct, complexity", ("add", 1), ("fact", 2), ("pick", 6), ("main", 1)))
def _(spark, sf):
    return metrics.keyword_complexity(code(spark)).select("fct", "complexity")


@query("code_declarations", rows("name, type", ("total", "int"), ("i", "int"), ("name", "char *")))
def _(spark, sf):
    return structure.declarations(code(spark)).where(F.col("name").isin("total", "i", "name")).select("name", "type")


@query("code_symbols", rows("name, class, uses", ("total", "global", 6), ("i", "local", 4), ("k", "param", 3), ("n", "param", 3), ("a", "param", 1), ("b", "param", 1), ("name", "local", 2)))
def _(spark, sf):
    s = structure.symbols(code(spark)).where("decl_seq <> seq").where(F.col("name").isin("total", "i", "k", "n", "a", "b", "name"))
    return s.groupBy("name", "class").agg(F.count("*").alias("uses"))


@query("code_links", rows("txt, lnr, target, target_lnr", ("if", 6, "else", 6), ("break", 11, "for", 12), ("goto", 14, "out", 17), ("switch", 11, "for", 12), ("if", 14, "name", 15), ("case", 11, "case", 11)))
def _(spark, sf):
    t = lexer.source_only(code(spark))
    at = t.select(F.col("seq").alias("_s"), "txt", "lnr")
    to = t.select(F.col("seq").alias("_t"), F.col("txt").alias("target"), F.col("lnr").alias("target_lnr"))
    out = structure.links(t).withColumnRenamed("target", "_to").join(at, F.col("seq") == F.col("_s")).join(to, F.col("_to") == F.col("_t"))
    return out.where("txt in ('if', 'break', 'goto', 'switch') or (txt = 'case' and target = 'case')").select("txt", "lnr", "target", "target_lnr")


# marks, patterns, programs


@query("code_contains_top", rows("lnr", (8,)))
def _(spark, sf):
    return TokenFrame(structure.source(code(spark))).mark("{").contains("goto", top=True).marks().select("lnr")


@query("code_contains_any_level", rows("lnr", (8,), (11,)))
def _(spark, sf):
    return TokenFrame(structure.source(code(spark))).mark("{").contains("break").marks().select("lnr")


@query("code_mark_type", rows("lnr, txt", (15, '"X"')))
def _(spark, sf):
    return TokenFrame(code(spark)).mark("@str").marks().select("lnr", "txt")


_FOUND = {
    "alternation": ("goto \\| break", [14, 11]),
    "any": ("return . ;", [6, 19]),
    "constraint": ("@ident ( @1 (.lnr > 15)", [16, 19, 19, 19]),
    "brackets": ("for ( .* ) { .* }", [12]),
    "negation": ("switch ( .* ) { ^default* }", [11]),
    "binding": ("v:@ident = add ( :v", [12]),
    "repeated": ("( ( x ) \\* 2 )", [2]),
    "option": ("static\\? int add", [4, 4]),
}


@query("code_patterns", rows("name, lnr", *((k, n) for k, (_, at) in _FOUND.items() for n in at)))
def _(spark, sf):
    m = pattern.search_all(code(spark), [(k, p, None) for k, (p, _) in _FOUND.items()])
    return m.df.select(F.col("set").alias("name"), F.col("from_lnr").alias("lnr"))


@query("code_regular", rows("lnr", (11,), (14,)))
def _(spark, sf):
    return pattern.search(code(spark), "(goto|break) .", regular=True).df.select(F.col("from_lnr").alias("lnr"))


@query("code_bindings", rows("name, text, refs", ("v", "total", 1)))
def _(spark, sf):
    b = pattern.search(code(spark), "v:@ident = add ( :v").df.select(F.explode("bindings").alias("b"))
    return b.select("b.name", "b.text", F.size("b.all_refs").alias("refs"))


@query("code_cursor", rows("txt, lnr, next_txt", ("if", 6, "{"), ("switch", 11, "{"), ("for", 12, "{"), ("while", 13, "total"), ("if", 14, "goto")))
def _(spark, sf):
    def body(c):
        for t in c:
            if t["txt"] in ("if", "switch", "for", "while"):
                c.move(1)
                c.jump()
                yield {"txt": t["txt"], "lnr": t["lnr"], "next_txt": c.peek(1)["txt"]}

    return Program(structure.source(code(spark))).run(body, "txt string, lnr int, next_txt string")


_TEXTS = ("ab", "B", "", "1.6x", "7")


@query("scalar_texts", rows("s, sign, whole, near, hit, parts", ("ab", -1, 0, 0, True, 1), ("B", -1, 0, 0, True, 1), ("", -1, 0, 0, False, 0), ("1.6x", -1, 1, 2, False, 2), ("7", -1, 7, 7, False, 1)))
def _(spark, sf):
    d = spark.createDataFrame([(x,) for x in _TEXTS], "s string")
    s = F.col("s")
    return d.select("s", scalar.strcmp(s, F.lit("b")).alias("sign"), scalar.atoi(s).cast("int").alias("whole"), scalar.toint(s).cast("int").alias("near"), scalar.match(s, "/^[a-zA-Z]+$").alias("hit"), F.size(scalar.split(s, ".")).alias("parts"))


@query("scalar_bits", rows("a, b, either, common, one, up, down, inverse", (6, 3, 7, 2, 5, 48, 0, -7), (0, 1, 1, 0, 1, 0, 0, -1), (-4, 1, -3, 0, -3, -8, -2, 3)))
def _(spark, sf):
    d = spark.createDataFrame([(6, 3), (0, 1), (-4, 1)], "a int, b int")
    of = {"either": "|", "common": "&", "one": "^", "up": "<<", "down": ">>"}
    return d.select("a", "b", *[scalar.bits(F.col("a"), op, F.col("b")).cast("int").alias(k) for k, op in of.items()], scalar.bits(F.col("a"), "~").cast("int").alias("inverse"))


@query("code_equal_kinds", rows("a, b, same", ("1", "1.0", True), ("a", "a", True), ("a", "1", False)))
def _(spark, sf):
    d = spark.createDataFrame([("1", "1.0"), ("a", "a"), ("a", "1")], "a string, b string")
    return d.select("a", "b", scalar.equal(F.col("a"), F.col("b")).alias("same"))


@query("prog_arrays", rows("txt, n", ("fact", 3), ("pick", 2), ("main", 1)))
def _(spark, sf):
    a = Program(structure.source(code(spark))).filter(F.col("txt").isin("add", "fact", "pick", "main")).count_by("txt")
    return Program.unset(a, txt="add")


@query("prog_sums", rows("txt, total", ("add", 16), ("fact", 30)))
def _(spark, sf):
    return Program(structure.source(code(spark))).filter(F.col("txt").isin("add", "fact")).sum_by("lnr", "txt").select("txt", "total")


@query("code_registers", rows("step, n", ("union", 5), ("meet", 1), ("less", 1), ("undone", 2)))
def _(spark, sf):
    f = TokenFrame(structure.source(code(spark)))
    jumps = f.mark(F.col("txt").isin("goto", "break"))
    steps = {"union": f.mark("return").where(".lnr < 7").save(1).reset().mark(F.col("txt").isin("goto", "break")).restore(1, "|"), "meet": jumps.save(1).reset().mark("goto").restore(1, "&"), "less": jumps.save(1).reset().mark("goto").save(2).restore(1).restore(2, "^"), "undone": jumps.reset().undo()}
    out = None
    for k, x in steps.items():
        df = x.count().select(F.lit(k).alias("step"), F.col("marks").alias("n"))
        out = df if out is None else out.union(df)
    return out


@query("code_find_name", rows("lnr, fct", (11, "pick"), (11, "pick"), (12, "pick"), (12, "pick"), (13, "pick"), (13, "pick")))
def _(spark, sf):
    return structure.find_name(code(spark), "total", "pick").select("lnr", "fct")


@query("code_fields", rows("lnr", (12,)))
def _(spark, sf):
    return TokenFrame(structure.with_function(structure.source(code(spark)))).mark("add").where(".fct == pick && .txt == /^a.d && .typ == ident && .len == 3").marks().select("lnr")


@query("code_printed", rows("out", ("4 add",), ("12 add",)))
def _(spark, sf):
    return Program(structure.source(code(spark))).filter(F.col("txt") == "add").printed("%d %s", "lnr", "txt").select("out")


@query("code_lists", rows("first, last, rest", ("goto", "while", 2)))
def _(spark, sf):
    def body(c):
        for t in c:
            if t["txt"] in ("for", "while", "goto"):
                c.push("seen", t)  # the newest is on top
            if t["txt"] == "main":
                c.stop()
        top = c.top("seen")
        c.pop("seen")
        yield {"first": top["txt"], "last": c.top("seen")["txt"], "rest": c.length("seen")}

    return Program(structure.source(code(spark))).run(body, "first string, last string, rest int")


# metrics, taint, rules


@query("code_parameters", rows("params, functions", (0, 1), (1, 2), (2, 1)))
def _(spark, sf):
    return metrics.parameter_counts(code(spark)).select("params", "functions")


@query("code_switches", rows("cases", (2,)))
def _(spark, sf):
    return metrics.cases_per_switch(code(spark)).select("cases")


@query("code_taint", rows("fct, name", ("pick", "name")))
def _(spark, sf):
    return taint.tainted(code(spark)).select("fct", "name").distinct()


@query("code_taint_targets", rows("target, name", ("strcpy", "name")))
def _(spark, sf):
    return taint.findings(code(spark)).select("target", "name")


@query("code_pairing", rows("fct, good, bad", ("pick", 1, 0)))
def _(spark, sf):
    return metrics.pairing(code(spark), "getenv", "strcpy").select("fct", "good", "bad")


def _rules(*languages: str) -> str:
    """Every rule finds something in its one snippet and nothing in the other."""
    return rows("rule, snippet, found", *((r.name, s, s == "hit") for r in registry.RULES.values() if r.language in languages for s in ("hit", "miss")))


@query("rules_c", _rules("c"))
def _(spark, sf):
    return registry.on_examples(spark, "c")


@query("rules_cpp", _rules("cpp"))
def _(spark, sf):
    return registry.on_examples(spark, "cpp")


@query("rules_java_python", _rules("java", "python"))
def _(spark, sf):
    return registry.on_examples(spark, "java", "python")
