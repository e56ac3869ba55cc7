"""Windows against a list model, on random token streams; and every query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tokenloom import queries
from tokenloom.operators import lexer
from tokenloom.operators.frame import TokenFrame
from tokenloom.operators.match import MatchFrame
from tokenloom.plans import pattern

SF = "/root/testdata/sf0.001"


def stream(seed, n=60):
    r = random.Random(seed)
    return [r.choice(["{", "}", "(", ")", "[", "]", "a", "b", "c", "if"]) for _ in range(n)]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(f, f"f{f}", i, i // 7 + 1, t) for f in range(20) for i, t in enumerate(stream(f))]
    df = spark.createDataFrame(rows, "fid long, fnm string, seq long, lnr int, txt string").repartition(5)
    return lexer.with_defaults(lexer.nested(df)).cache()


def listed(tokens):
    out = {}
    for r in tokens.orderBy("fid", "seq").collect():
        out.setdefault(r.fid, []).append(r)
    return out


def marks(frame):
    return {(r.fid, r.seq) for r in frame.marks().select("fid", "seq").collect()}


def test_nesting_is_that_of_stacks(tokens):
    for rows in listed(tokens).values():
        depths, jmp = lexer.nest([r.txt for r in rows])
        assert [(r["curly"], r["round"], r["bracket"]) for r in rows] == depths
        assert [r.jmp for r in rows] == jmp


def test_moves(tokens):
    model = listed(tokens)
    f = TokenFrame(tokens).mark("a")
    nxt, bck, one, jumped = set(), set(), set(), set()
    for k, rows in model.items():
        txt = [r.txt for r in rows]
        for i, t in enumerate(txt):
            if t == "a":
                if (j := next((j for j in range(i, len(txt)) if txt[j] == "b"), None)) is not None:
                    nxt.add((k, j))
                if (j := next((j for j in range(i - 1, -1, -1) if txt[j] == "b"), None)) is not None:
                    bck.add((k, j))
                if i + 1 < len(txt):
                    one.add((k, i + 1))
            if t == "{" and rows[i].jmp is not None:
                jumped.add((k, rows[i].jmp))
    assert marks(f.next("b")) == nxt and marks(f.back("b")) == bck and marks(f.next()) == one
    assert marks(f.next().back()) == {(k, j - 1) for k, j in one}
    assert marks(TokenFrame(tokens).mark("{").jump()) == jumped


@pytest.mark.parametrize("how", ["any", "top", "up"])
def test_ranges(tokens, how):
    model = listed(tokens)
    level = {"{": "curly", "(": "round", "[": "bracket"}
    close = {"{": "}", "(": ")", "[": "]"}

    def fits(a, b):
        name = level.get(a.txt, "curly")
        if how == "top":
            return a[name] == b[name] - (a.txt in level and b.txt != close.get(a.txt))
        return how == "any" or a[name] == b[name] + 1

    for anchor in ("{", "(", "if"):
        hold, hit, to = set(), set(), set()
        for k, rows in model.items():
            for i, r in enumerate(rows):
                if r.txt == anchor:
                    if r.jmp is not None and r.jmp > i:
                        inner = [(k, x.seq) for x in rows[i + 1 : r.jmp] if x.txt == "a" and fits(r, x)]
                        hit |= {*inner}
                        if inner:
                            hold.add((k, i))
                    if (x := next((x for x in rows[i + 1 :] if x.txt == "b" and fits(r, x)), None)) is not None:
                        to.add((k, i, x.seq))
        q = {how: True} if how != "any" else {}
        f = TokenFrame(tokens).mark(anchor)
        assert marks(f.contains("a", **q)) == hold
        assert marks(f.contains("a", and_=True, **q)) == hit
        if anchor != "if":
            pairs = {(k, r.seq) for k, rows in model.items() for r in rows if r.txt == anchor and r.jmp is not None}
            assert marks(f.contains("a", no=True, **q)) == pairs - hold
        got = {(r.fid, r.seq, r.bound) for r in f.stretch("b", **q).marks().collect()}
        assert got == to


def test_inside_registers_and_expressions(tokens):
    model = listed(tokens)
    want = {(k, x.seq) for k, rows in model.items() for r in rows if r.txt == "{" and r.jmp is not None for x in rows[r.seq + 1 : r.jmp] if x.txt == "c"}
    f = TokenFrame(tokens)
    assert marks(f.mark("{").mark("c", ir=True)) == want
    a = f.mark("a").save(1).reset().mark("b")
    assert marks(a.restore(1, "|")) == {(k, r.seq) for k, rows in model.items() for r in rows if r.txt in "ab"}
    assert marks(a.restore(1, "&")) == set() and marks(a.restore(1)) == marks(f.mark("a"))
    assert marks(a.restore(1, "^")) == marks(f.mark("b")) and a.reset().undo().df.columns == a.df.columns
    got = marks(f.mark("a").where(".curly + .round * 2 > 1 && !(.lnr == 3) || .txt == b"))
    assert got == {(k, r.seq) for k, rows in model.items() for r in rows if r.txt == "a" and (r["curly"] + r["round"] * 2 > 1 and r.lnr != 3)}
    with pytest.raises(ValueError):
        f.mark("a", no=True, ir=True)


def test_lowered_patterns_are_the_automatons(tokens):
    for p in ("a b", "[a b] ^c", "a", "@ident", "/^[ab]$ ^if c", ". a", "x:@ident :x", "x:@ident ^:x :x", "x:@ident y:/^[ab]$ [:x if]", "x:@ident ^[:x b]", "/^[a-z]+$ b /^[a-z]+$"):
        key = lambda m: sorted((r.fid, r.from_seq, r.upto_seq, tuple((b["name"], b["text"], b["def_seq"], b["ref_seq"], tuple(b["all_refs"])) for b in r.bindings or [])) for r in m.df.collect())
        assert key(pattern.search(tokens, p, native=False)) == key(pattern.search(tokens, p)), p


def test_algebra_is_that_of_lists(spark):
    r = random.Random(4)
    sets = {n: [(n, k, a, a + r.randint(0, 6)) for k in range(4) for a in [r.randint(0, 30) for _ in range(12)]] for n in "AB"}
    a, b = (MatchFrame(spark.createDataFrame(sets[n], "set string, fid long, from_seq long, upto_seq long")) for n in "AB")
    rel = {
        "containing": lambda x, y: x[2] <= y[2] and y[3] <= x[3], "inside": lambda x, y: y[2] <= x[2] and x[3] <= y[3], "meets": lambda x, y: x[3] + 1 == y[2], "following": lambda x, y: y[3] + 1 == x[2],
        "precedes": lambda x, y: x[3] < y[2], "follows": lambda x, y: y[3] < x[2], "overlaps": lambda x, y: x[2] < y[2] <= x[3] <= y[3], "overlapped_by": lambda x, y: y[2] < x[2] <= y[3] <= x[3], "intersect": lambda x, y: x[2:] == y[2:],
    }
    for name, f in rel.items():
        got = sorted((m.set, m.fid, m.from_seq, m.upto_seq) for m in getattr(a, name)(b).df.collect())
        assert got == sorted(x for x in sets["A"] if any(x[1] == y[1] and f(x, y) for y in sets["B"])), name
    assert a.minus(a).df.count() == 0 and a.union(a).df.count() == 2 * len(sets["A"])
    assert a.add(9, 1, 2, "A").add(9, 1, 2, "A").df.count() == len(sets["A"]) + 1


_FAST = [n for n in queries.SQL if n not in ("set_union", "set_minus", "set_and", "set_follows", "set_overlapped", "save_and")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", _FAST)
def test_query_is_its_sql(spark, duck, name):
    df, q = queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(q.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(q.select(*[f'"{c}"' for c in cols]).fetchall(), key=repr)


def test_frames_do_not_depend_on_partitions(tokens):
    one = marks(TokenFrame(tokens.repartition(1)).mark("a").next("b"))
    assert one == marks(TokenFrame(tokens.repartition(9)).mark("a").next("b"))
    assert F is not None


def test_jump_and_contains_read_the_tokens_once(spark):
    rows = [(None, "f", i, 1, t) for i, t in enumerate("{ a { b } { } } { }".split())] + [(7, "g", i, 1, t) for i, t in enumerate("} { a".split())]
    df = lexer.with_defaults(lexer.nested(spark.createDataFrame(rows, "fid long, fnm string, seq long, lnr int, txt string")))
    f = TokenFrame(df).mark("{")
    far = TokenFrame(f.df.withColumn("bound", F.when(F.col("seq") == 0, 99).when(F.col("seq") == 2, 7).cast("long")))
    for frame in (f.jump(), f.contains("b"), f.contains("b", no=True)):
        plan = frame.marks()._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
    assert marks(f.jump()) == {(None, 4), (None, 6), (None, 7), (None, 9)}
    assert marks(far.jump()) == {(None, 6), (None, 7), (None, 9)}  # a bound that no token has is nobody's
    assert marks(f.contains("b")) == {(None, 0), (None, 2)} and marks(f.contains("b", no=True)) == {(None, 5), (None, 8)}
    assert f.jump().df.columns == f.df.columns and f.jump().df.count() == len(rows)


def test_patterns_and_programs_ask_only_for_what_they_read(spark):
    from tokenloom.plans.program import Program

    texts = ["{ a padding } x { b }", "} { ( } )", "", None, "{ { c } }"]
    t = lexer.with_defaults(lexer.nested(lexer.text_tokens(spark.createDataFrame([*enumerate(texts)], "fid long, text string").withColumn("fnm", F.lit("f")))))
    found = pattern.search(t, "{ ^padding* }").df
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Pandas" not in plan
    assert {(r.fid, r.from_seq, r.upto_seq) for r in found.collect()} == {(0, 5, 7), (4, 0, 4), (4, 1, 3)}
    assert [(r.fid, r.from_seq) for r in pattern.search(t, "{@1 .* }").df.collect()] == [(4, 1)]

    def body(c):
        for k in c:
            if k["txt"] == "{":
                k["own"] = 1
                assert (k | {"x": 2})["x"] == 2 and "curly" in k and k.get("none", 5) == 5 and dict(k)["own"] == k.copy()["own"] == 1
                yield {"fid": k["fid"], "seq": k["seq"], "jmp": k["jmp"], "n": len(c.tokens[k["seq"] :])}

    got = {tuple(r) for r in Program(t).run(body, "fid long, seq long, jmp long, n long").collect()}
    assert got == {(0, 0, 3, 8), (0, 5, 7, 3), (1, 1, 3, 4), (4, 0, 4, 5), (4, 1, 3, 4)}


def test_matches_having_a_token_need_no_join(spark):
    f = spark.createDataFrame([*enumerate(["of a the b", "of", "", None, "x the x the of"])], "fid long, text string").withColumn("fnm", F.lit("f"))
    t = lexer.text_tokens(f)
    m = MatchFrame(t.where("seq = 1").select("fid", F.col("seq").alias("from_seq"), F.lit(3).alias("upto_seq")))
    kept = m.having(t, F.col("txt") == "the").df
    assert [r.fid for r in kept.orderBy("fid").collect()] == [0, 4]
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert m.having(t, F.col("txt") == "nowhere").df.count() == 0


def test_global_numbers_need_no_sort_of_tokens(spark):
    rows = [(i, None if i == 5 else "a b" * (i % 3), "f") for i in (70_000, 1, 5, 3, 65_537)]
    t = lexer.text_tokens(spark.createDataFrame(rows, "fid long, text string, fnm string"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lexer.with_global_seq(t)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = [(r.fid, r.seq) for r in out.orderBy("gseq").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ShuffledHashJoin [fid" in plan
    assert got == sorted((r.fid, r.seq) for r in t.collect()) and [r.gseq for r in out.orderBy("gseq").collect()] == list(range(len(got)))
