"""Lexers, patterns, structure, rules, reports, scripts and streams on snippets."""

import json

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import ere, scalar
from tokenloom.operators import duplicates, lexer, markup, metrics, structure
from tokenloom.operators.frame import TokenFrame
from tokenloom.plans import expr, pattern
from tokenloom.plans.program import Program
from tokenloom.plans.script import Session
from tokenloom.rules import flow, packs, registry, taint
from tokenloom.sources import readers, sinks
from tokenloom.streaming import stream

CODE = """#include <stdio.h>
int total; /* a comment */
int add(int a, int b) { return a + b; }
int twice(int a) {
	int x;
	char *p;
	if (a > 0) { x = add(a, a); } else x = 0;
	switch (a) { case 1: x = 2; break; case 2: x = 3; }
	for (int i = 0; i < 9; i++) { i = i + 1; }
	while (a) a--; // @suppress nothing
	total += x;
	return twice(x);
}
void leak(char *s) { char *q; q = malloc(3); goto out; out: x = getenv(s); strcpy(q, x); }
"""


def code(spark, text=CODE, language="c", **kw):
    return lexer.code_tokens(spark.createDataFrame([(1, "t.c", text)], "fid long, fnm string, text string"), language, **kw)


def found(spark, p, text=CODE, **kw):
    return sorted((r.from_seq, r.upto_seq) for r in pattern.search(code(spark, text), p, **kw).df.collect())


def words(text):
    return [(t, k) for _, t, k in lexer.lex(text, eof=False)]


def test_lexer_types():
    assert words("int x = 0x1F + 017 - 3.5e2;") == [("int", "type"), ("x", "ident"), ("=", "oper"), ("0x1F", "const_hex"), ("+", "oper"), ("017", "const_oct"), ("-", "oper"), ("3.5e2", "const_flt"), (";", "")]
    assert words('a->b <<= "s\\"t" \'c\' // end') == [("a", "ident"), ("->", "oper"), ("b", "ident"), ("<<=", "oper"), ('"s\\"t"', "str"), ("'c'", "chr"), ("// end", "cmnt")]
    assert words("#define A(x) f(x) \\\n+ g()\n")[:2] == [("#define", "cpp"), ("A", "ident")]
    assert words("#define A(x) f(x) \\\n+ g()\n")[-1] == ("EOL", "cpp")
    assert lexer.lex("#define A 1\nx", macros=True, eof=False) == [(1, "# define A 1", "cpp"), (2, "x", "ident")]
    assert [t for _, t, k in lexer.lex("if x:\n  y\n", "python") if k == "IND"] == ["  "]
    assert lexer.lex("a -- b\nc", "ada", eof=False)[1] == (1, "-- b", "cmnt")
    assert [t for _, t, _ in lexer.lex("a >>> 1", "java", eof=False)] == ["a", ">>>", "1"]
    assert lexer.lex('# 7 "b.c"\nx', eof=False)[1] == (7, "x", "ident")
    assert lexer.lex("", eof=False) == [] and lexer.lex("x")[-1] == (1, "EOF", "cpp")
    assert lexer.harvest(["typedef", "int", "T", ";", "T", "y"], ["key", "type", "ident", "", "ident", "ident"])[4] == "type"


def test_streams_of_source_and_comments(spark):
    t = code(spark)
    c = lexer.comments_only(t).collect()
    s = lexer.source_only(t).orderBy("seq").collect()
    assert [r.txt for r in c] == ["/* a comment */", "// @suppress nothing"]
    assert s[c[0].bound].txt == "int" and [r.seq for r in s] == list(range(len(s)))
    assert all(s[r.jmp].jmp == r.seq for r in s if r.jmp is not None)
    pruned = lexer.prune_if_zero(code(spark, "a\n#if 0\nb\n#endif\nc\n", eof=False))
    assert "b" not in {r.txt for r in pruned.collect()} and {"a", "c"} <= {r.txt for r in pruned.collect()}


def test_braces_pair_in_patterns(spark):
    text = "f ( { a { b } c } d )"
    assert found(spark, "{ .* }", text) == [(2, 8), (4, 6)]
    assert found(spark, "( .* )", text) == [(1, 10)]
    assert found(spark, "{ ^c* }", text) == [(4, 6)]
    assert found(spark, "{@1 .* }", text) == [(4, 6)]


def test_bindings_alternatives_and_constraints(spark):
    assert found(spark, "v:@ident = :v", "a = a ; a = b ;") == [(0, 2)]
    assert found(spark, "a \\( b \\| c \\) d", "a b d a c d a e d") == [(0, 2), (3, 5)]
    assert found(spark, "a b\\+ c", "a b b c a c") == [(0, 3)]
    assert found(spark, "a b\\? c", "a b c a c a b b c") == [(0, 2), (3, 4)]
    assert found(spark, "(a|b) c", "a c b c", regular=True) == [(0, 1), (2, 3)]
    assert found(spark, "@ident ^> @1 (.len == 1)", "ab x y") != []
    r = pattern.search(code(spark), "for ( v:@ident .* ) { .* :v = .* }").df.collect()
    assert r == [] or r[0].bindings[0]["name"] == "v"
    one = pattern.search(code(spark, "for ( i = 0 ; i < 3 ; i ++ ) { i = 2 ; }"), "for ( v:@ident .* ) { .* :v = .* }").df.collect()[0]
    assert one.bindings[0]["text"] == "i" and one.bindings[0]["all_refs"] == [14]


def test_functions_calls_and_reach(spark):
    t = code(spark)
    f = {r.name: r for r in structure.functions(t).collect()}
    assert {*f} == {"add", "twice", "leak"} and (f["twice"].from_lnr, f["twice"].upto_lnr) == (4, 13)
    calls = structure.calls(t)
    assert {(r.caller, r.callee) for r in calls.collect()} == {("twice", "add"), ("twice", "twice"), ("leak", "malloc"), ("leak", "getenv"), ("leak", "strcpy")}
    assert {(r.caller, r.callee) for r in structure.reach(calls, "twice", "add").collect()} == {("twice", "add"), ("twice", "twice")}
    assert {tuple(r) for r in structure.context(calls, "add").collect()} == {("called by", "twice")}
    assert structure.with_function(t).where("txt = 'total' and fct = 'twice'").count() == 1


def test_links_flow_and_symbols(spark):
    t = code(spark)
    text = {r.seq: r.txt for r in t.collect()}
    links = {(text[r.seq], text[r.target]) for r in structure.links(t).collect()}
    assert ("if", "else") in links and ("break", "for") in links and ("goto", "out") in links and ("case", "case") in links
    c = {r.fct: r.cyclomatic for r in structure.cyclomatic(structure.control_flow(t)).collect()}
    assert c["add"] == 1 and c["twice"] >= 5
    d = {(r.name, r.type) for r in structure.declarations(t).collect()}
    assert {("total", "int"), ("x", "int"), ("p", "char *")} <= d
    s = {(r.name, r["class"]) for r in structure.symbols(t).where("decl_seq <> seq").collect()}
    assert {("total", "global"), ("x", "local"), ("a", "param")} <= s


def test_rules_report(spark):
    t = code(spark)
    got = {r.set for r in registry.run(t, "suspicious", "p10").df.collect()}
    assert {"C06", "C15", "P10_1a", "P10_1b"} <= got and "C11" not in got  # its loop declares i
    loop = code(spark, "for (i = 0; i < 3; i++) { i = 2; }")
    assert "C11" in {r.set for r in registry.run(loop, "suspicious").df.collect()}
    assert "cwe_120_1" in {r.set for r in registry.run(t, "cwe").df.collect()}
    assert registry.summary(registry.run(t, "basic")).where("set = 'switch_default'").head().patterns >= 1
    assert packs is not None
    for lang in ("java", "python"):
        assert registry.run(code(spark, "try { } catch (Exception e) { }", lang), f"{lang}_rules").df.count() >= (lang == "java")


@pytest.mark.parametrize("language", ["c", "cpp", "java", "python"])
def test_every_rule_finds_its_hit_and_leaves_its_miss(spark, language):
    assert all(r.hit and r.miss for r in registry.RULES.values())
    assert [tuple(r) for r in registry.on_examples(spark, language).collect() if r.found != (r.snippet == "hit")] == []


def test_paths_of_a_function(spark):
    def lines_of(check, body):
        return sorted((r.from_lnr, r.upto_lnr) for r in check(code(spark, "void f(int a)\n{\n" + body + "\n}\n")).df.collect())

    free = flow.use_after_free
    assert lines_of(free, "free(p);\nif (a) { p = 0; }\ng(p);") == [(3, 5)]
    assert lines_of(free, "free(p);\nif (a) { p = 0; } else { return; }\ng(p);") == []
    assert lines_of(free, "while (a) {\ng(p);\nfree(p);\n}") == [(5, 4)]
    assert lines_of(free, "while (a) {\ng(p);\nfree(p);\nbreak;\n}") == []
    assert lines_of(free, "free(p);\ngoto out;\ng(p);\nout: return;") == []
    assert lines_of(free, "switch (a) {\ncase 1: free(p);\ncase 2: g(p);\n}") == [(4, 5)]
    assert lines_of(free, "switch (a) {\ncase 1: free(p); break;\ncase 2: g(p);\n}") == []
    unset = flow.uninitialised
    assert lines_of(unset, "int n;\nfor (n = 0; n < 3; n++) { g(n); }") == []
    assert lines_of(unset, "int n, m;\ndo { m = a; } while (m);\ng(n);") == [(3, 5)]
    assert lines_of(unset, "int n;\nread(&n);\ng(n);") == []


def test_suppression(spark):
    t = code(spark, "goto a; // @suppress P10_1b\ngoto b;\n")
    assert [r.from_lnr for r in registry.run(t, "P10_1b").df.collect()] == [2]


def test_taint_reaches_targets(spark):
    t = code(spark)
    assert ("leak", "x") in {(r.fct, r.name) for r in taint.tainted(t).collect()}
    assert {(r.target, r.name) for r in taint.findings(t).collect()} == {("strcpy", "x")}
    assert taint.parse_config("%sources\nread 2\n%targets\nstrcpy 1 0\n") == {"sources": [("read", "2", "")], "targets": [("strcpy", "1", "0")]}


def test_reports_and_import(spark, tmp_path):
    t = code(spark)
    f = sinks.findings(pattern.search(t, "goto @ident", "G", "a jump"), t, lexer.lines(spark.createDataFrame([(1, "t.c", CODE)], "fid long, fnm string, text string")))
    r = json.loads(sinks.to_json(f, plus=True).head().json)
    assert (r["type"], r["message"], r["line"]) == ("G", "a jump", "14") and "goto out" in r["source"]
    s = json.loads(sinks.sarif(f))
    assert s["runs"][0]["results"][0]["ruleIndex"] == 0
    assert 'failures="1"' in sinks.junit(f) and sinks.scrubbed(f).head().value == "t.c:14: a jump"
    back = readers.import_findings(t, f.select("type", "message", "file", "line", "place"))
    assert [(m.from_seq, m.upto_seq) for m in back.df.collect()] == found(spark, "goto @ident")
    sinks.write_text(sinks.token_listing(t), str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_text(sinks.token_listing(t), str(tmp_path / "x"))


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "a.c").write_text("int a;\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/b.h").write_text("int b;\n")
    (tmp_path / "list").write_text(f"# names\n-DX=1 {tmp_path}/a.c\n")
    assert readers.read_tree(spark, str(tmp_path), "*.[ch]").count() == 2
    assert readers.without_headers(readers.read_tree(spark, str(tmp_path), "*.[ch]")).count() == 1
    assert readers.read_list(spark, str(tmp_path / "list")).head().options == ["-DX=1"]
    a = readers.split_archive(spark.createDataFrame([(1, "all", "@>x\n1\n2\n@>y\n3")], "fid long, fnm string, text string"))
    assert {(r.fnm, r.text) for r in a.collect()} == {("x", "1\n2"), ("y", "3")}


def test_scripts_and_programs(spark):
    t = code(spark)
    s = Session(t).script("def sw(a, b)\nm a; n {; c top no b; ps create X\nend\nsw(switch, default)  # macro\n")
    assert s.sets.df.count() == 1
    s.run("r; pe A: goto @ident; pe B: @ident \\;; ps C = A < B; m malloc; >1; r; m getenv; >|1; <1; l")
    assert s.output.count() == 1 and s.sets.of("A").df.count() == 1 and s.frame.marks().count() == 2
    p = Program(t)
    assert {(r.txt, r.n) for r in p.filter("(.typ == key)").count_by("txt").where("n > 1").collect()} == {("return", 2), ("case", 2)}
    rows = p.run(lambda c: [{"fid": x["fid"], "n": i} for i, x in enumerate(c) if x["txt"] == "{" and c.jump(x)], "fid long, n long")
    assert rows.count() == 3


def test_metrics(spark):
    t = code(spark)
    assert {(r.key, r.n) for r in metrics.statement_kinds(t).collect()} >= {("if", 1), ("return", 2)}
    assert {(r.params, r.functions) for r in metrics.parameter_counts(t).collect()} == {(2, 1), (1, 2)}
    assert {r.fct: r.complexity for r in metrics.keyword_complexity(t).collect()}["twice"] == 6
    assert metrics.halstead(t).head().volume > 0 and metrics.source_lines(t).where("fid is null").head().comments == 2
    assert metrics.cases_per_switch(t).head().cases == 2
    assert {r.pattern for r in metrics.loop_patterns(t).collect()} == {"int V1 = C ; V1 < C ; V1 ++"}
    assert metrics.function_pairs(structure.calls(t), 1).count() == 4
    assert metrics.pairing(t, "malloc", "free").head().bad == 1


def test_duplicates(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, "a", " ".join(base)), (2, "b", "x " + " ".join(base[:30]) + " CHANGED " + " ".join(base[31:])), (3, "c", "other words")]
    t = lexer.text_tokens(spark.createDataFrame(rows, "fid long, fnm string, text string"))
    f = duplicates.fragments(t, 20)
    assert {(r.a_from, r.a_upto, r.b_from, r.b_upto) for r in f.collect()} == {(0, 29, 1, 30), (31, 59, 32, 60)}
    assert duplicates.patches(f).count() == 1 and duplicates.report(f, t).head().report.startswith("1 match of 30 tokens a:1-1 <-> b:1-1")


def test_markup(spark):
    h = spark.createDataFrame([(1, "p", "<ul><li>a<li>b</ul><table><tr><td colspan=2>x</td><td>y</td></tr></table><br><foo>")], "fid long, fnm string, text string")
    t = lexer.with_defaults(lexer.text_tokens(h))
    p = {(r.name, r.problem) for r in markup.tag_pairs(t).collect()}
    assert ("li", "not closed") in p and ("ul", None) in p and ("br", None) not in p
    assert [r.columns for r in markup.table_columns(h).collect()] == [3] and [r.name for r in markup.unknown_tags(t).collect()] == ["foo"]
    lines = lexer.lines(spark.createDataFrame([(1, "p", "if a:\n  b\n  if c:\n    d\ne\n")], "fid long, fnm string, text string"))
    assert {(r.lnr, r["last"]) for r in markup.python_blocks(lines).collect()} == {(1, 4), (3, 4)}


def test_functions_and_regexes(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).head().x
    assert get(scalar.strrstr(F.lit("abcabc"), "bc")) == 5 and get(scalar.strrstr(F.lit("abc"), "z")) == 0
    assert get(scalar.substr(F.lit("hello"), 1, 3)) == "ell" and get(scalar.split(F.lit("a,b,"))) == ["a", "b"]
    assert get(scalar.count_of(F.lit("aaaa"), "aa")) == 3 and get(scalar.toint(F.lit("2.6x"))) == 3 and get(scalar.atoi(F.lit("12ab"))) == 12
    assert get(scalar.tostr(F.lit(2.0))) == "2" and get(scalar.tostr(F.lit(2.345))) == "2.35" and get(scalar.disambiguate(F.lit("m_O1"))) == get(scalar.disambiguate(F.lit("rnol")))
    assert get(scalar.equal(F.lit("2"), F.lit(2.0))) and not get(scalar.equal(F.lit("x"), F.lit(2)))
    assert ere.to_java("[[:alpha:]_]+\\.") == "[a-zA-Z_]+\\." and ere.to_java("[\\d]") == "[\\\\d]"
    f = expr.function("(.len > 2 && .txt != /^a) || .lnr / 0 == 1")
    assert f({"len": 3, "txt": "bcd", "lnr": 1}) and not f({"len": 3, "txt": "abc", "lnr": 1})


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    spark.createDataFrame([("k", 1, "a { b"), ("k", 2, " } go"), ("j", 1, "goto x")], "key string, ord long, text string").coalesce(1).write.mode("append").json(str(src))
    s = spark.readStream.schema("key string, ord long, text string").json(str(src))
    q = stream.matches(s, {"B": "{ .* }"}).writeStream.format("memory").queryName("m1").outputMode("append").option("checkpointLocation", str(out)).start()
    q.processAllAvailable()
    spark.createDataFrame([("k", 3, "to { c }")], "key string, ord long, text string").coalesce(1).write.mode("append").json(str(src))
    q.processAllAvailable()
    q.stop()
    assert {(r.key, r.from_seq, r.upto_seq) for r in spark.table("m1").collect()} == {("k", 1, 3)} | {(r.key, r.from_seq, r.upto_seq) for r in spark.table("m1").where("from_seq > 3").collect()}
    assert spark.table("m1").count() == 2
    with pytest.raises(ValueError):
        stream.streamable("a @1 (.jmp == 2)")


def test_frame_lists_and_displays(spark):
    t = code(spark)
    f = TokenFrame(t).mark("return")
    assert [(r.nr, r.lnr) for r in f.list().orderBy("nr").collect()] == [(1, 3), (2, 12)]
    lines = lexer.lines(spark.createDataFrame([(1, "t.c", CODE)], "fid long, fnm string, text string"))
    assert f.display(lines, 1).where("marked").count() == 2 and f.display(lines, 1, 2).count() == 3
    assert "return a + b ;" in f.reprint().where("lnr = 3").head().line


def test_code_tokens_go_out_in_bounded_batches():
    import pyarrow as pa

    texts = ["int a; { b(); }\n" * 3000, "", None, "x = 1;", "{ }" * 9000]
    b = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(["f"] * 5), pa.array(texts)], names=["fid", "fnm", "text"])
    out = list(lexer._code("c", False, False, False, True, True)(iter([b, b])))
    assert max(x.num_rows for x in out) <= lexer.BATCH < sum(x.num_rows for x in out)
    got = [(r["fid"], r["seq"], r["txt"], r["jmp"]) for x in out for r in x.to_pylist()]
    want = []
    for fid, text in [*enumerate(texts)] * 2:
        txts = [t for _, t, _ in lexer.lex(text or "", eof=False)]
        want += [(fid, i, t, j) for i, (t, j) in enumerate(zip(txts, lexer.nest(txts)[1], strict=True))]
    assert got == want
