"""Searches and windows over files of text as they are read: held against the token frames, and their plans."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom import queries
from tokenloom.operators import duplicates, lexer, packed
from tokenloom.operators.frame import TokenFrame
from tokenloom.operators.match import MATCHES, MatchFrame
from tokenloom.plans import pattern

SF = "/root/testdata/sf0.001"
ODD = ["of a the b\nof", "of", "", None, "x the x the of\r\n\n the é the é\x00. of é . a_1 9.\n.", "naïve of 日本 the 😀 the of\tof . of", "\n\n", "." * 5, " of the of the of "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 6 else None, "f", x) for k, x in enumerate(ODD)]
    return spark.createDataFrame(rows, "fid long, fnm string, text string")


def _rows(m):
    return sorted(((r.set, r.fid, r.from_seq, r.upto_seq, r.from_lnr, r.upto_lnr) for r in m.df.collect()), key=repr)


def test_text_is_searched_as_its_tokens_are(odd):
    t = lexer.with_defaults(lexer.text_tokens(odd))
    ps = [("A", "of /^[a-z]+$", "m"), ("B", "/^[a-z]+$ the /^[a-z]+$", None), ("C", "[the of] ^[x b]", None), ("D", "^the of", None), ("E", ". of", None), ("F", "/é", None), ("G", "@ident", None), ("H", "nowhere", None)]
    found = pattern.search_text(odd, ps)
    assert _rows(found) == _rows(pattern.search_all(t, ps)) and {r.msg for r in found.of("A").df.collect()} == {"m"}
    with pytest.raises(ValueError):
        pattern.search_text(odd, [("A", "x:@ident :x", None)])
    tok = [(r.fid, r.seq) for r in t.where("txt = '.'").orderBy("fid", "seq").collect()]
    want = sorted((a[0], a[1], b[1]) for a, b in zip(tok, tok[1:]) if a[0] == b[0])
    assert sorted((r.fid, r.from_seq, r.upto_seq) for r in pattern.search_text(odd, [], [("S", ".")]).df.collect()) == want and want


def test_sets_of_one_frame_have_the_algebra_of_lists(spark):
    r = random.Random(5)
    rows = [(n, k, a, a + r.choice((0, 1, 2, 9, 40))) for n in "ABC" for k in (None, 0, 1, 2, 3) for a in [r.randint(0, 30) for _ in range(12)]]
    found = MatchFrame(spark.createDataFrame(rows, "set string, fid long, from_seq long, upto_seq long"))
    rel = {
        "containing": lambda x, y: x[2] <= y[2] and y[3] <= x[3], "inside": lambda x, y: y[2] <= x[2] and x[3] <= y[3], "meets": lambda x, y: x[3] + 1 == y[2], "following": lambda x, y: y[3] + 1 == x[2],
        "precedes": lambda x, y: x[3] < y[2], "follows": lambda x, y: y[3] < x[2], "overlaps": lambda x, y: x[2] < y[2] <= x[3] <= y[3], "overlapped_by": lambda x, y: y[2] < x[2] <= y[3] <= x[3],
        "intersect": lambda x, y: x[2:] == y[2:] and x[1] is not None, "minus": lambda x, y: False,
    }
    for left, right in (("A", "B"), ("AB", "B"), ("AB", "BC")):
        x, y = (found.of(n[0]) if len(n) == 1 else found.of(n[0]).union(found.of(n[1])) for n in (left, right))
        for name, f in rel.items():
            got = sorted(((m.set, m.fid, m.from_seq, m.upto_seq) for m in getattr(x, name)(y).df.collect()), key=repr)
            of, other = ([m for m in rows if m[0] in n] for n in (left, right))
            if name == "minus":
                want = [a for a in of if a[1] is None or not any(a[1:] == b[1:] for b in other)]
            else:
                want = [a for a in of if any(a[1] == b[1] and f(a, b) for b in other)]
            assert got == sorted(want, key=repr), (name, left, right)
    a = found.of("A")
    assert a.union(a).df.count() == 2 * a.df.count() and a.of("B").df.count() == 0 and found.of("A").union(found.of("B")).of("B").df.count() == 60


def test_places_are_the_marks(spark, odd):
    t = lexer.with_defaults(lexer.text_tokens(odd.where("fid is not null")))
    m = pattern.search_text(odd.where("fid is not null"), [("E", ". the", None), ("O", "of .", None)])
    for bits in (False, True):
        marked = m.to_marks(TokenFrame(t), bits).df.where("mark > 0")
        assert sorted((r.fid, r.seq, r.mark) for r in marked.collect()) == sorted((r.fid, r.seq, r.mark) for r in m.places(bits).collect())


ONE_PASS = ["set_minus", "set_follows", "set_overlaps", "set_meets", "set_and", "set_summary", "set_during", "set_overlapped", "set_to_marks"]


@pytest.mark.parametrize("name", ONE_PASS)
def test_texts_are_read_once_and_tokens_not_shuffled(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Generate posexplode" not in plan


def test_text_is_searched_without_bindings(spark, odd):
    found = pattern.search_text(odd, [("A", "of /^[a-z]+$", "m"), ("B", "/^[a-z]+$ the /^[a-z]+$", None)], [("C", ".")])
    a, b = found.of("A"), found.of("B")
    assert found.df.schema == a.df.schema == a.overlaps(b).df.schema == MATCHES and {r.bindings for r in found.df.collect()} == {None}
    assert sorted(r.set for r in found.summary().collect()) == ["A", "B", "C"] and not found.of("D").df.count()
    for name in ("set_overlaps", "set_overlapped"):  # no column of nulls goes to the kernel
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 2 and "bindings" not in plan


def _texts(spark):
    r = random.Random(6)
    word = lambda: r.choice("a b c dd é . ( _x".split())
    base = [word() for _ in range(60)]
    texts = [" ".join(base), " ".join([*base[:30], "X", *base[31:]]), " ".join(base * 3), None, "", "a b\na", "a " * 90, " ".join(word() for _ in range(400)), "z " + " ".join(base[5:45]) + "\n a"]
    return spark.createDataFrame([(k, "f", x) for k, x in enumerate(texts)], "fid long, fnm string, text string")


@pytest.mark.parametrize("n", (1, 2, 3, 10, 20, 33))
def test_repeated_windows_of_text_are_those_of_its_tokens(spark, n):
    f = _texts(spark)
    t = lexer.text_tokens(f)
    key = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    got, want = duplicates.repeated(f, n), duplicates.repeated(t, n)
    assert key(got, "fid", "seq", "lnr", "copies") == key(want, "fid", "seq", "lnr", "copies")
    if n < 20:
        c = ("copies", "files", "first_fid", "first_seq")
        assert key(duplicates.multiclones(f, n, 3), *c) == key(duplicates.multiclones(t, n, 3), *c)
    else:
        c = ("a_fid", "a_from", "a_upto", "b_fid", "b_from", "b_upto", "n_tokens")
        assert key(duplicates.fragments(f, n), *c) == key(duplicates.fragments(t, n), *c) and got.count()


TWO_PASSES = ["dup_windows", "dup_fragments", "dup_patches", "multiclones"]


@pytest.mark.parametrize("name", TWO_PASSES)
def test_windows_are_hashed_where_texts_are_read(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2 and "Generate posexplode" not in plan
    assert not re.search(r"RangeFrame, \d+, unboundedfollowing", plan)  # the square of a window's copies


def test_rows_are_packed_by_bucket(monkeypatch):
    monkeypatch.setattr(packed, "ROWS", 100)
    rng = np.random.default_rng(7)
    key, nr, on = rng.integers(-(2**63), 2**63, 1000), np.arange(1000), rng.random(1000) < 0.5
    kinds = ("i8", "i4", "?")
    batches = list(packed.pack(iter([(key[:730], nr[:730], on[:730]), (key[:0], nr[:0], on[:0]), (key[730:], nr[730:], on[730:])]), kinds))
    assert len(batches) > 5
    t = pa.Table.from_batches(batches).sort_by("bucket")
    got = list(packed.unpack(iter(t.to_batches(max_chunksize=7)), kinds))
    assert all(len({*(k & (packed.BUCKETS - 1))}) == 1 for k, _, _ in got) and len(got) == len({*(key & (packed.BUCKETS - 1))})
    assert sorted((int(k), int(i), bool(o)) for cols in got for k, i, o in zip(*cols)) == sorted(zip(key.tolist(), nr.tolist(), on.tolist()))


def test_a_key_of_two_windows():
    at, size = duplicates._alike(np.array([5, 3, 5, 5, 3, 5, 9]), np.array([1, 0, 2, 1, 0, 2, 0]), 2)
    assert at[np.argsort(at)].tolist() == [0, 1, 2, 3, 4, 5] and size.tolist() == [2, 2, 2]
    groups = np.split(at, np.cumsum(size)[:-1])
    assert sorted(sorted(g.tolist()) for g in groups) == [[0, 3], [1, 4], [2, 5]]


@pytest.mark.parametrize("n", (2, 20))
def test_windows_of_files_without_a_number_and_of_one_number(spark, n):
    f = _texts(spark)
    f = f.union(f.where("fid = 0").withColumn("fid", F.lit(None).cast("long"))).union(f.where("fid = 2"))
    t = lexer.text_tokens(f.where("fid is null or fid <> 2")).cache()  # of one number, a row is a file of its own
    key = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=repr)
    one = f.where("fid is null or fid <> 2")
    assert key(duplicates.repeated(one, n, whole=False), "fid", "seq", "copies") == key(duplicates.repeated(t, n), "fid", "seq", "copies")
    c = ("copies", "files", "first_fid", "first_seq")
    assert key(duplicates.multiclones(one, n, 3), *c) == key(duplicates.multiclones(t, n, 3), *c)
    got = key(duplicates.multiclones(f, n, 2), *c)
    assert any(r[0] > r[1] + 1 for r in got) and any(r[2] is None for r in got)
    c = ("a_fid", "a_from", "a_upto", "b_fid", "b_from", "b_upto", "n_tokens")
    assert key(duplicates.fragments(one, n), *c) == key(duplicates.fragments(t, n), *c)


@pytest.mark.parametrize("name", TWO_PASSES)
def test_windows_are_shuffled_in_packs(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [bucket") == (2 if name in ("dup_windows", "multiclones") else 3)
    assert plan.count("Window [") == (name == "dup_patches") and "key2" not in plan
