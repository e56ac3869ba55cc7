"""Each operator against brute force, SQL or held-out labels, and on odd tables."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import decontam, embeddings, langid, licenses, minhash, mixing, pii, quality, sharding, suffixes
from tokenloom.llm.kernel import Chunk, ngrams, slide

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = ["".join(random.Random(i).choices("abcdefghijklmnop", k=4)) for i in range(3000)]


def words(n, seed):
    return random.Random(seed).choices(VOCAB, k=n)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCS)


ODD = [(None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "Ünï çödé — 中文"), (6, "x " * 30_000), (7, "y" * 200_000)]


def odd(spark, extra=True):
    d = docs(spark, ODD)
    return d.selectExpr("*", "doc_id as words", "text as votes", "1 as band", "'x' as h", "2 as pos") if extra else d


def words_of(t):
    return re.findall(r"(?:[0-9A-Za-z_]|[^\x00-\x7f])+", t)


# kernel


def test_words_and_hashes_are_those_of_a_regex():
    texts = ["The cat, the CAT.", "", "über-cool x_1", "a"]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    c = Chunk(np.frombuffer(data, np.uint8), bounds, np.arange(4))
    got = [[data[a:b].decode() for a, b in zip(c.ws[c.first[i] : c.first[i + 1]], c.we[c.first[i] : c.first[i + 1]])] for i in range(4)]
    assert got == [words_of(t) for t in texts]
    assert c.h[0] == c.h[2] and c.h[1] == c.h[3] and len({*c.h.tolist()}) == 6
    assert ngrams(c.h[:4], 2)[0] == ngrams(c.h[:4], 2)[2]
    x = np.random.default_rng(0).integers(0, 99, 50)
    assert slide(x, 7).tolist() == [x[i : i + 7].min() for i in range(44)]


# 1


def brute_repeats(rows):
    at = {}
    for d, t in rows:
        w = [x.lower() for x in words_of(t)]
        for i in range(len(w) - 49):
            at.setdefault(tuple(w[i : i + 50]), set()).add((d, i))
    hit = {}
    for places in at.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                hit.setdefault(d, set()).update(range(i, i + 50))
    out = set()
    for d, s in hit.items():
        s = sorted(s)
        start = s[0]
        for a, b in zip(s, [*s[1:], None]):
            if b != a + 1:
                out.add((d, start, a + 1, a + 1 - start))
                start = b
    return out


def test_repeats_are_those_of_brute_force(spark):
    r = random.Random(1)
    shared = [words(n, 900 + n) for n in (49, 50, 51, 75, 200, 30)]
    rows = []
    for i in range(60):
        w = words(r.randint(0, 150), i)
        for _ in range(r.randint(0, 2)):
            p = r.choice(shared)
            cut = r.randint(0, 5)
            at = r.randint(0, len(w))
            w[at:at] = p[cut:] if r.random() < 0.5 else p
        rows.append((i, " ".join(w)))
    rows += [(100, "same " * 120), (101, "same " * 80), (102, rows[3][1])]
    got = {tuple(x) for x in suffixes.passages(docs(spark, rows)).collect()}
    # touching spans are one
    assert got == brute_repeats(rows)


def test_loser_tree_orders_and_keeps_prefixes():
    r = random.Random(5)
    runs = []
    for k in range(7):
        keys = sorted(b"12345678" + bytes(r.choices(b"ab ", k=r.randint(0, 9))) for _ in range(r.randint(0, 40)))
        runs.append([(x, b"", k, i) for i, x in enumerate(keys)])
    got = list(suffixes.merge([suffixes.decode(suffixes.encode(x)) for x in runs]))
    keys = [x[1] for x in got]
    assert keys == sorted(k for run in runs for k, *_ in run)
    assert [x[0] for x in got[1:]] == [suffixes.common(a, b, 0) for a, b in zip(keys, keys[1:])]


# 2


def test_groups_find_copies_and_leave_others(spark):
    rows = [(i, " ".join(words(120, i))) for i in range(40)]
    for k, i in enumerate((3, 3, 7, 9)):
        w = rows[i][1].split()
        w[10 + k] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, rows[20][1]) for k in range(30)] + [(300, "short"), (301, "Short"), (302, "")]
    got = dict(minhash.groups(docs(spark, rows)).collect())
    want = {3: 3, 100: 3, 101: 3, 7: 7, 102: 7, 9: 9, 103: 9, 20: 20, **{200 + k: 20 for k in range(30)}, 300: 300, 301: 300}
    assert got == want


def test_signature_agreement_is_jaccard(spark):
    a, b = words(300, 1), words(300, 2)
    mixed = a[:200] + b[:100]
    sets = [{tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in (a, mixed)]
    j = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    texts = [" ".join(x) for x in (a, mixed)]
    data = "".join(texts).encode()
    c = Chunk(np.frombuffer(data, np.uint8), np.array([0, len(texts[0]), len(data)]), np.arange(2))
    sig = minhash.signatures(*minhash.shingles(c), 512)[1]
    assert abs((sig[0] == sig[1]).mean() - j) < 0.05


def test_recall_of_near_pairs(spark):
    r = random.Random(3)
    rows, pairs = [], []
    for i in range(60):
        w = words(100, 5000 + i)
        v = list(w)
        for _ in range(r.randint(0, 8)):
            v[r.randrange(100)] = r.choice(VOCAB)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        s = [{tuple(x[k : k + 3]) for k in range(98)} for x in (w, v)]
        if len(s[0] & s[1]) / len(s[0] | s[1]) >= 0.7:
            pairs.append((2 * i, 2 * i + 1))
    got = dict(minhash.groups(docs(spark, rows)).collect())
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs) >= 0.9 * len(pairs) and len(pairs) > 20


def boilerplate(n, pairs, own, change):
    """Documents that share 200 words and have ``own`` of their own; the first ``pairs`` have a copy with words changed."""
    r, common, rows = random.Random(9), words(200, 70), []
    for i in range(n):
        w = words(own, 8000 + i)
        rows.append(w)
        if i < pairs:
            v = list(w)
            for k in range(change):
                v[-1 - k] = r.choice(VOCAB)
            rows.append(v)
    ids = r.sample(range(10 * len(rows)), len(rows))
    return [(k, " ".join(common + w)) for k, w in zip(ids, rows)], [(ids[2 * i], ids[2 * i + 1]) for i in range(pairs)]


def true_jaccard(a, b):
    x, y = ({tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_documents_a_little_below_the_threshold_stay(spark):
    rows, _ = boilerplate(300, 0, 48, 0)
    assert 0.65 < true_jaccard(rows[0][1], rows[1][1]) < 0.69
    assert minhash.groups(docs(spark, rows)).collect() == []


@pytest.mark.parametrize("block", [512, 16])
def test_near_pairs_in_hot_buckets_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block * 2048)
    rows, pairs = boilerplate(400, 80, 48, 36)
    text = dict(rows)
    assert all(0.7 <= true_jaccard(text[a], text[b]) < 0.76 for a, b in pairs)
    got = dict(minhash.groups(docs(spark, rows)).collect())
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs) >= 0.98 * len(pairs)
    assert set(got) <= {x for p in pairs for x in p}


def brute_near(rows, least=0.7):
    """doc_id: (least id of its component, size, texts linked), by the true Jaccard similarity of all pairs."""
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in words_of(t or "")]
        if d is not None and w:
            sets.setdefault(frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))), set()).add(d)
    near = {a: {b for b in sets if a is not b and len(a & b) >= least * len(a | b)} for a in sets}
    out, seen = {}, set()
    for a in sets:
        if a not in seen:
            todo, part = [a], {a}
            while todo:
                for b in near[todo.pop()] - part:
                    part.add(b)
                    todo.append(b)
            seen |= part
            ids = set().union(*(sets[x] for x in part))
            if len(ids) > 1:
                out |= {d: (min(ids), len(ids), len(near[x])) for x in part for d in sets[x]}
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_links_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block * 2048)
    r = random.Random(12)
    rows = [(i, " ".join(words(80, 300 + i))) for i in range(60)]
    for k in range(120):  # few near 0.7, where signatures may miss
        w = rows[r.randrange(6)][1].split()
        for _ in range(r.choice([0, 1, 2, 12])):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        rows.append((100 + k, " ".join(w)))
    rows += [(500, "one"), (501, "One"), (502, ""), (None, rows[0][1]), (503, None), (100, rows[20][1])]
    rows = [x for x in rows if x[0] != 100] + [(504, rows[20][1])]
    got = {x.doc_id: (x.keeper, x.group_size, x.n_links) for x in minhash.linked(docs(spark, rows)).collect()}
    assert got == brute_near(rows)


def test_query_is_brute_force_on_the_whole_table(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {x.doc_id: (x.keeper, x.group_size, x.n_links) for x in minhash.query(spark, SF).collect()}
    assert got == brute_near(rows) and len(got) > 10


def test_forest_connects_the_same():
    a, b = minhash.forest(np.array([5, 9, 7, 9, 3]), np.array([3, 7, 9, 8, 5]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(5, 3), (8, 7), (9, 7)]


# 3


def test_shards_are_a_permutation(spark):
    rows = docs(spark, [(i * 7 % 1000, f"t{i}") for i in range(777)] + [(None, "a"), (None, "b"), (5, "again")])
    got = sharding.shard(rows, 10).collect()
    assert sorted(r.row_num for r in got) == list(range(780))
    assert sorted((r["shard"], r["slot"]) for r in got) == [(i // 78, i % 78) for i in range(780)]
    again = {(r.doc_id, r.text): (r["shard"], r["slot"]) for r in sharding.shard(rows.repartition(3), 10).collect()}
    assert again == {(r.doc_id, r.text): (r["shard"], r["slot"]) for r in got}


def test_a_hot_id_and_null_ids_are_several_ranges(spark):
    rows = docs(spark, [(7, f"t{i}") for i in range(400)] + [(None, f"n{i}") for i in range(300)] + [(i, "x") for i in range(300)]).withColumn("_part", F.lit("mine")).withColumn("range", F.lit("r")).withColumn("HASH", F.lit(1))
    out = sharding.shard(rows, 10)
    got = out.collect()
    assert out.columns == [*rows.columns, "row_num", "shard", "slot"] and {r._part for r in got} == {"mine"} and {r.range for r in got} == {"r"}
    assert sorted(r.row_num for r in got) == list(range(1000))
    order = [r.doc_id for r in sorted(got, key=lambda r: r.row_num)]
    assert order == [None] * 300 + sorted([7] * 400 + list(range(300)))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        again = {(r.doc_id, r.text): r.row_num for r in sharding.shard(rows, 10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == {(r.doc_id, r.text): r.row_num for r in got}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 700])
def test_ranges_are_those_of_a_binary_search(spark, n):
    bounds = sorted({random.Random(i).randint(-500, 500) for i in range(n)})
    got = spark.range(-600, 600).select("id", sharding._search(F.col("id"), bounds).alias("at")).collect()
    assert [r["at"] for r in got] == np.searchsorted(bounds, [r.id for r in got], "right").tolist()


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_feistel_inverts(n):
    y = sharding.feistel(np.arange(n), n, 3)
    assert sorted(y) == list(range(n)) and (sharding.unfeistel(y, n, 3) == np.arange(n)).all()


# 4


def test_gradients_match_differences():
    p = {k: v.astype(np.float64) for k, v in langid.init(3).items()}
    x = np.random.default_rng(0).integers(1, 256, (5, 2)).astype(np.uint8)
    keep = []
    out = langid.forward(p, x, "b", keep)
    g = langid.backward(p, x, "b", keep, np.ones_like(out))
    for name, at in (("ub", (2, 5)), ("ub", (1, 20)), ("cb", (3,)), ("xb", (int(x[0, 0]), 7))):
        q = {k: v.copy() for k, v in p.items()}
        q[name][at] += 1e-2
        up = langid.forward(q, x, "b").sum()
        q[name][at] -= 2e-2
        assert abs((up - langid.forward(q, x, "b").sum()) / 2e-2 - g[name][at]) < 2e-2


def test_languages_of_held_out_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    train, test = d.where("doc_id % 4 > 0"), d.where("doc_id % 4 = 0")
    names, p = langid.train(train, 400)
    out = test.select("doc_id", "text").mapInArrow(langid._label(names, p), langid.schema(doc_id=langid.LONG, language=langid.STR, probability=langid.DBL, bytes_labelled=langid.LONG, bytes=langid.LONG))
    got = out.join(d, "doc_id").selectExpr("avg(cast(language = lang as double)) a", "sum(bytes) = sum(octet_length(text)) b").head()
    assert got.a > 0.9 and got.b


def slow_labels(p, raw):
    """Both gated layers byte by byte, one text at a time, with the same run-up."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    hid, out = langid.HIDDEN, []

    def states(side, order):
        h, got = np.zeros(hid), {}
        for i in order:
            a = p[f"x{side}"][raw[i]] + p[f"c{side}"] if 0 <= i < len(raw) else p[f"x{side}"][langid.PAD] + p[f"c{side}"]
            b = h @ p[f"u{side}"]
            r, z = sig(a[:hid] + b[:hid]), sig(a[hid : 2 * hid] + b[hid : 2 * hid])
            n = np.tanh(a[2 * hid :] + r * b[2 * hid :])
            got[i] = h = n + z * (h - n)
        return got

    for low in range(0, len(raw), langid.SPAN):
        f = states("f", range(low - langid.RUN, low + langid.SPAN))
        b = states("b", range(low + langid.SPAN + langid.RUN - 1, low - 1, -1))
        for i in range(low, min(len(raw), low + langid.SPAN)):
            o = np.concatenate([f[i], b[i]]) @ p["v"] + p["d"]
            e = np.exp(o - o.max())
            out.append(e / e.sum())
    return np.array(out)


def test_labels_are_those_of_a_plain_loop(spark, monkeypatch):
    rows = [(1, "Das ist ein Haus."), (2, ""), (3, None), (4, "x"), (5, " ".join(words(160, 3))), (5, "Ünï — 中文"), (6, "The end of it. " * 40)]
    d = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 5, "de").otherwise("en"))
    names, p = langid.train(d)
    monkeypatch.setattr(langid, "train", lambda *_: (names, p))
    got = {(r.doc_id, r.bytes): (r.language, r.probability, r.bytes_labelled) for r in langid.identify(d).collect()}
    per = {}
    for r in langid.runs(d).collect():
        per.setdefault(r.doc_id, []).append((r.start, r.end, r.language))
    for k, t in rows:
        raw = (t or "").encode()
        if not raw:
            assert got[k, 0] == (None, 0.0, 0)
            continue
        e = slow_labels(p, raw)
        mean = e.sum(0) / e.sum()
        best = int(mean.argmax())
        assert got[k, len(raw)][0] == names[best] and abs(got[k, len(raw)][1] - mean[best]) < 1e-4 and abs(got[k, len(raw)][2] - (e.argmax(1) == best).sum()) <= 2
        if k != 5:
            flat = [x for a, b, x in sorted(per[k]) for _ in range(b - a)]
            assert len(flat) == len(raw) and sum(x != names[i] for x, i in zip(flat, e.argmax(1))) <= 2


# 5


def test_raking_meets_all_marginals():
    r = np.random.default_rng(1)
    codes = [np.repeat([0, 1, 2], 4), np.tile([0, 1], 6), np.tile([0, 0, 1, 1], 3)]
    shares = [np.array([0.3, 0.4, 0.3]), np.array([0.55, 0.45]), np.array([0.5, 0.5])]
    t = r.uniform(5, 9, 12)
    q, off = mixing.rake(t, codes, [x * 0.75 * t.sum() for x in shares])
    p = np.minimum(1, q)
    assert off < 1e-9 and (q > 1).any()  # some are capped, and the rest makes up for it
    for c, x in zip(codes, shares):
        assert np.allclose(np.bincount(c, p * t), x * 0.75 * t.sum())


def brute_mix(rows, keep, powers):
    """Probability of each (source, lang, topic), by bisection of one factor after the other."""
    cells = {}
    for s, g, k, n in rows:
        cells[s, g, k] = cells.get((s, g, k), 0) + n
    total = sum(cells.values())
    seen = [{k: sum(v for c, v in cells.items() if c[d] == k) for k in {c[d] for c in cells}} for d in range(3)]
    goal = []
    for d in range(3):
        x = {k: (v / total) ** powers[d] for k, v in seen[d].items() if v}
        goal.append({k: v / sum(x.values()) for k, v in x.items()})
    keep = min(keep, *(seen[d][k] / total / v for d in range(3) for k, v in goal[d].items()))
    while True:
        f = [dict.fromkeys(x, 1.0) for x in seen]
        for _ in range(400):
            for d in range(3):
                for k, share in goal[d].items():
                    mine = [(v, f[0][c[0]] * f[1][c[1]] * f[2][c[2]] / f[d][k]) for c, v in cells.items() if c[d] == k]
                    low, high = -40.0, 40.0
                    for _ in range(70):
                        mid = (low + high) / 2
                        low, high = (mid, high) if sum(v * min(1, q * np.exp(mid)) for v, q in mine) < share * keep * total else (low, mid)
                    f[d][k] = float(np.exp(high))
            p = {c: min(1.0, f[0][c[0]] * f[1][c[1]] * f[2][c[2]]) for c in cells}
            off = max(abs(sum(v * p[c] for c, v in cells.items() if c[d] == k) - s * keep * total) for d in range(3) for k, s in goal[d].items()) / total
            if off < 1e-10:
                return p
        if off < 1e-7:
            return p
        keep *= 0.95


def mixed_rows(n=900):
    r = random.Random(4)
    tail = {"prose": "", "legal": " License and Copyright.", "tabular": " a | b"}
    out = []
    for i in range(n):
        s = r.choice(["a", "a", "a", "b", "c", None])
        g = r.choice(["en", "en", "en", "en", "de", None])
        k = r.choice(["prose"] * 8 + ["legal", "tabular"])
        out.append((i, " ".join(words(r.randint(5, 60), i)) + tail[k], g, s, 0, k))
    return out


@pytest.mark.parametrize("keep", [0.5, 0.97])
def test_mixing_is_that_of_brute_force(spark, keep):
    """Every row's probability and decision; at 0.97 the budget has to give way."""
    rows = mixed_rows() + [(5000, None, "en", "a", 0, "prose"), (5001, "", "xx", "zz", 0, "prose")]
    d = spark.createDataFrame([r[:5] for r in rows], DOCS)
    count = lambda t: len(re.split("[ \n]", t)) if t else 0
    want = brute_mix([(s or "\0", g or "\0", k, count(t)) for _, t, g, s, _, k in rows], keep, (0.9, 0.7, 0.8))
    got = {r.doc_id: (r._topic, r._tokens, r._p) for r in mixing.mix(d, keep).collect()}
    u = {r.doc_id: r.u for r in d.select("doc_id", mixing.uniform(29).alias("u")).collect()}
    for i, t, g, s, _, k in rows:
        p = want[s or "\0", g or "\0", k] if i != 5001 else 0.0
        assert (i in got) == (u[i] < p) or abs(u[i] - p) < 1e-6
        if i in got:
            assert got[i][:2] == (k, count(t)) and abs(got[i][2] - p) < 1e-6


def test_sample_follows_the_targets(spark):
    rows = [(i, " ".join(words(20, i)), ["en", "en", "en", "de"][i % 4], ["a", "b"][i % 2], 0) for i in range(4000)]
    d = spark.createDataFrame(rows, DOCS)
    with pytest.warns(UserWarning, match="leave the targets"):
        out = mixing.mix(d, 0.4, {"lang": {"en": 0.6, "de": 0.4, "fr": 0.0, "es": 0.2}}).groupBy("lang").sum("_tokens").collect()
    got = {r.lang: r[1] for r in out}
    assert abs(got["de"] / sum(got.values()) - 0.4) < 0.05 and abs(sum(got.values()) / 80_000 - 0.4) < 0.05


def test_raking_by_spark_jobs_is_the_same(spark, monkeypatch):
    rows = [(i, " ".join(words(20 + i % 7, i)), ["en", "en", "de"][i % 3], ["a", "b"][i % 2], 0) for i in range(300)]
    d = spark.createDataFrame(rows, DOCS).withColumn("cell_source", F.lit("x")).withColumn("_p", F.lit(3))
    one = {r.doc_id: r._p1 for r in mixing.mix(d, 0.75).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    out = mixing.mix(d, 0.75)
    two = {r.doc_id: r._p1 for r in out.collect()}
    assert one.keys() == two.keys() and len(one) > 100 and max(abs(two[k] - v) for k, v in one.items()) < 1e-9
    assert out.columns == [*d.columns, "_tokens", "_topic", "_p1"]


# 6


def test_licenses_with_edits(spark):
    mit = licenses.TEMPLATES["MIT"].split()
    edited = mit[:40] + ["entirely", "new"] + mit[42:]
    rows = [(1, "code " + " ".join(mit)), (2, " ".join(edited) + " more"), (3, " ".join(words(300, 1))), (4, "Released under the MIT License."), (5, " ".join(mit[:20]))]
    got = {(r.doc_id, r.license) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (4, "MIT-notice")}


def test_licenses_with_words_put_in_and_taken_out(spark):
    mit = licenses.TEMPLATES["MIT"].split()
    few = words(40, 7)
    rows = [
        (1, " ".join(mit[:80] + few[:4] + mit[80:])), (2, " ".join(mit[:80] + mit[85:])), (3, " ".join(mit[:50] + few[:1] + mit[50:100] + mit[102:])),
        (4, " ".join(mit + mit)), (5, " ".join(mit[:60])), (6, " ".join(few + mit + few)), (6, " ".join(few + mit + few)), (7, None), (None, " ".join(mit)), (8, " ".join(few) + " " + " ".join(mit).upper()),
    ]
    got = sorted((r.doc_id, r.license, r.start_word, r.end_word - r.start_word, r.coverage > 0.95) for r in licenses.scan(docs(spark, rows)).collect())
    n = len(words_of(" ".join(mit)))
    want = [(1, 0, n + 4), (2, 0, n - 5), (3, 0, n - 1), (4, 0, n), (4, n, n), (6, 40, n), (8, 40, n)]
    assert got == [(d, "MIT", at, size, True) for d, at, size in want]


# 7


def brute_vectors(rows, least):
    """vec_id: (class, size, links) by all pairs of distinct vectors."""
    nodes = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            nodes.setdefault(tuple(v), set()).add(i)
    unit = [np.array(v) / np.linalg.norm(v) for v in nodes]
    ids, n = [*nodes.values()], len(nodes)
    near = [[j for j in range(n) if j != i and len(unit[i]) == len(unit[j]) and min(ids[i]) != min(ids[j]) and unit[i] @ unit[j] >= least - 1e-9] for i in range(n)]
    root = {d: d for s in ids for d in s}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in [(min(ids[i]), min(ids[j])) for i in range(n) for j in near[i]] + [(min(s), d) for s in ids for d in s]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    size = {}
    for d in root:
        size.setdefault(find(d), []).append(d)
    links = {d: sum(len(near[i]) for i in range(n) if d in ids[i]) for d in root}
    return {d: (c, len(m), links[d]) for c, m in size.items() if len(m) > 1 for d in m}


@pytest.mark.parametrize("block,leaf,least", [(8192, 1 << 16, 0.9), (32, 16, 0.9), (16, 64, 0.6)])
def test_near_vectors_are_all_found(spark, monkeypatch, block, leaf, least):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 48))
    x[200:260] = x[:60] + r.normal(size=(60, 48)) * r.uniform(0.05, 0.4, (60, 1))
    x[300:310] = x[0]
    x[310:380] = x[1] + r.normal(size=(70, 48)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 48), (903, [1.0, 2.0]), (904, [float("nan")] * 48), (5, x[5].tolist()), (6, x[7].tolist()), (905, [2.0, 4.1]), (None, x[3].tolist()), (906, (2 * x[8]).tolist()), (907, [1.0, None])]
    d = spark.createDataFrame([(*v, 0, "n") for v in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {p.vec_id: (p.class_id, p.class_size, p.n_links) for p in embeddings.linked(d, least).collect()}
    want = brute_vectors(rows, least)
    assert got == want and len(got) > 60 and want[310][2] >= 69


# 8


def test_quality_of_held_out_labels(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.score(d, lab.where("doc_id % 3 > 0")).join(lab.where("doc_id % 3 = 0"), "doc_id").selectExpr("quality", "p_quality >= 0.5 as keep").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in out]) > 0.93
    assert np.mean([r.keep for r in out if r.quality == 1]) > 0.97


def test_scores_are_those_of_a_plain_loop(spark):
    """Word vectors, pooling and network once more, word by word, with the trained weights."""
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(d, lab)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    index, sums = [quality.index_vectors(n, n) for n in (quality.WORDS, quality.SHAPES)], [np.zeros((n, quality.DIM)) for n in (quality.WORDS, quality.SHAPES)]
    at = {}
    for k, t in rows:
        raw = t.encode()
        at[k] = [x.tolist() for x in quality.terms(Chunk(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.zeros(1), True))]
        assert len(at[k][0]) == len(re.findall(r"[^ \t\n\v\f\r]+", t))
        for s, i, ts in zip(sums, index, at[k]):
            for j, x in enumerate(ts):
                for m in (j - 2, j - 1, j + 1, j + 2):
                    if 0 <= m < len(ts):
                        s[x] += i[ts[m]]
    for s, v in zip(sums, model.vectors):
        n = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-9)
        assert np.allclose(n - n[np.abs(n).sum(1) > 0].mean(0), v[:, : quality.DIM], atol=1e-5)
    got = {r.doc_id: r.p_quality for r in quality.score(d, lab).collect()}
    for k, t in rows:
        f = []
        for v, ts in zip(model.vectors, at[k]):
            x = [v[i] for i in ts]
            f += [np.mean(x, 0), np.std(x, 0)] if x else [np.zeros(v.shape[1])] * 2
            if v.shape[1] == quality.DIM:
                f.append(sum((a * b for a, b in zip(x, x[1:])), np.zeros(quality.DIM)) / max(1, len(x)))
        want = model.probability(np.concatenate(f)[None])[0] if t.split() else 0.0
        assert abs(got[k] - want) < 1e-3


def test_huge_ids_two_labels_and_clashing_columns(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    far = (1 << 62) + 5
    big = d.withColumn("doc_id", F.col("doc_id") + far).withColumn("p", F.lit("mine")).withColumn("y", F.lit(1)).withColumn("id", F.lit(2))
    more = lab.withColumn("doc_id", F.col("doc_id") + far)
    both = more.union(more.where("quality = 0").withColumn("quality", F.lit(1)))  # the lower one counts
    one, two = quality.score(big, more).collect(), quality.score(big, both.repartition(3)).collect()
    assert {(r.doc_id, round(r.p_quality, 9)) for r in one} == {(r.doc_id, round(r.p_quality, 9)) for r in two}
    kept = quality.keep_good(big, more)
    assert kept.columns == big.columns and {r.p for r in kept.collect()} == {"mine"} and kept.count() == sum(r.p_quality >= 0.5 for r in one)


# 9


def test_private_spans(spark):
    text = 'Mail me.2@host.example.org or +1 (212) 555-0199, host 10.20.30.40, card 4111111111111111, api_key = "0123456789abcdef0123456789abcdef01234567". Licensed under CC BY-NC 4.0. See version 3.'
    rows = [(i, text) for i in range(30)] + [(100 + i, " ".join(words(50, i)) + " in 1999 and version 2.0, page 7.") for i in range(60)]
    got = pii.find(docs(spark, rows)).collect()
    by = {(text[r.start : r.end], r.kind) for r in got if r.doc_id == 3}
    assert by == {("me.2@host.example.org", "email"), ("+1 (212) 555-0199", "phone"), ("10.20.30.40", "ip"), ("4111111111111111", "card"), ("0123456789abcdef0123456789abcdef01234567", "secret")}
    assert all(r.doc_id < 100 for r in got)


def test_keys_of_an_issuer_are_found_without_context(spark):
    r = random.Random(8)
    key = lambda: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    keys = {i: key() for i in range(200)}
    rows = [(i, " ".join([*words(5, i), k if i % 2 else f'token = "{r.getrandbits(160):040x}"', *words(5, 100 + i)])) for i, k in keys.items()]
    got = {x.doc_id for x in pii.find(docs(spark, rows)).where("kind = 'secret'").collect()}
    assert got == {i for i, k in keys.items() if i % 2 == 0 or re.search("[0-9]", k)}


def test_more_kinds_and_long_secrets(spark):
    secret = "Qw" * 45 + "7" + "zX" * 12 + "9021"
    lines = ["My ssn: 123-45-6789.", "from 2001:db8:85a3::8a2e:370:7334 port", "IBAN: DE89370400440532013000 ok", f'password = "{secret}"', "card 4111 1111 1111 1111", "at 12:30:45 on 01-02-2003"]
    rows = [(i, " ".join([*words(5, i), lines[i % 6], *words(5, 100 + i)])) for i in range(120)]
    got = {(r.doc_id % 6, r.kind, dict(rows)[r.doc_id][r.start : r.end]) for r in pii.find(docs(spark, rows)).collect()}
    assert got == {(0, "ssn", "123-45-6789"), (1, "ip", "2001:db8:85a3::8a2e:370:7334"), (2, "iban", "DE89370400440532013000"), (3, "secret", secret), (4, "card", "4111 1111 1111 1111")}


def test_spans_are_those_of_a_plain_loop(spark):
    """Votes counted, expectation and maximisation pattern by pattern, and the decision span by span."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    spans = {(r.doc_id, a, b, k): (v, f) for r in d.collect() for a, b, k, v, f in pii.propose(r.text)}
    count = {}
    for (_, _, _, k), (v, _) in spans.items():
        count[k, v] = count.get((k, v), 0) + 1
    p = {}
    for kind in {k for k, _ in count}:
        mine = {v: n for (k, v), n in count.items() if k == kind}
        q = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v in mine}
        for _ in range(200):
            w = [{v: (1 - q[v]) * n for v, n in mine.items()}, {v: q[v] * n for v, n in mine.items()}]
            total = [sum(x.values()) for x in w]
            prior = (total[1] + 1) / (sum(total) + 2)
            rel = lambda y, j, vote: (sum(x for v, x in w[y].items() if v[j] == vote) + (3 if vote == 2 * y - 1 else 1)) / (total[y] + 5)  # noqa: B023, E731
            for v in mine:
                odds = np.log(prior / (1 - prior)) + sum(np.log(rel(1, j, x) / rel(0, j, x)) for j, x in enumerate(v))
                q[v] = 1 / (1 + np.exp(-odds))
        p |= {(kind, v): x for v, x in q.items()}
    keys = sorted(spans)
    x, y = np.array([spans[k][1] for k in keys]), np.array([p[k[3], spans[k][0]] for k in keys])
    w = pii.fit(x, y, np.ones(len(keys)))  # the sample takes all: no pattern has more
    want = {k for k, v in zip(keys, x @ w[:-1] + w[-1]) if v >= 0}
    got = {(r.doc_id, r.start, r.end, r.kind) for r in pii.find(d, sample=10**6).collect()}
    assert len(got ^ want) <= 0.01 * len(want) and len(want) > 20


# 10


def brute_leaks(rows, items, share=0.5):
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    low = lambda t: [x.lower() for x in words_of(t)]
    iw = [(k, low(t), t) for k, t in items]
    df, n = {}, len(iw)
    for _, w, _ in iw:
        for g in {*grams(w, 2)}:
            df[g] = df.get(g, 0) + 1
    mean = max(1.0, sum(len(grams(w, 2)) for _, w, _ in iw) / n)
    s = max(64, max(len(w) for _, w, _ in iw))
    out = {}
    for d, t in rows:
        w = low(t)
        for a, b in decontam.passages(len(w), s):
            p = w[a:b]
            have = {*grams(p, 2)}
            for k, x, raw in iw:
                g = grams(x, 2)
                weight = {q: np.log(1 + (n - df[q] + 0.5) / (df[q] + 0.5)) * g.count(q) * 2.2 / (g.count(q) + 1.2 * (0.25 + 0.75 * len(g) / mean)) for q in {*g}}
                score = sum(v for q, v in weight.items() if q in have)
                if not weight or score < share * sum(weight.values()) - 1e-9:
                    continue
                q, ans = decontam.parts(raw)
                q3, a2 = {*grams(low(q), 3)}, {*grams(low(ans), 2)}
                if (not q3 or len(q3 & {*grams(p, 3)}) / len(q3) >= 0.5) and (not a2 or len(a2 & have) / len(a2) >= 0.5):
                    out[d, k] = max(out.get((d, k), 0), round(score, 6))
    return out


def test_leaks_are_those_of_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    first = items.orderBy("item_id").head()
    half = " ".join(first.text.split()[: len(first.text.split()) // 2])
    rows += [(5000, " ".join(words(90, 1)) + " " + first.text + " " + " ".join(words(90, 2))), (5001, half), (5002, " ".join(words(500, 4)))]
    want = brute_leaks(rows, [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): round(r.score, 6) for r in decontam.leaks(docs(spark, rows), items).collect()}
    assert got == want and (5000, first.item_id) in got and (5001, first.item_id) not in got


def test_short_answers_are_verified(spark):
    items = spark.createDataFrame([(1, " ".join(words(30, 41)) + ". Zanzibar."), (2, "Which? " + " ".join(words(30, 42)) + ".")], "item_id long, text string")
    q, a = " ".join(words(30, 41)), " ".join(words(30, 42))
    rows = [(1, q + ". Zanzibar."), (2, q + ". Timbuktu."), (3, "Which? " + a), (4, "Whose? " + a)]
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, rows), items).collect()} == {(1, 1), (3, 2)}


def test_one_long_item_does_not_widen_the_window_of_others(spark):
    short = words(40, 51)
    items = spark.createDataFrame([(1, " ".join(short[:30]) + ". " + " ".join(short[30:]) + "."), (2, " ".join(words(5000, 52)) + ". Last words here.")], "item_id long, text string")
    far = [x for i in range(0, 40, 5) for x in [*short[i : i + 5], *words(300, 600 + i)]]
    rows = [(1, " ".join(far)), (2, " ".join(words(300, 61) + short + words(300, 62))), (3, " ".join(words(5000, 52)) + ". Last words here.")]
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, rows), items).collect()} == {(2, 1), (3, 2)}


# odd tables


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_no_operator_minds_odd_tables(spark, rows):
    d = odd(spark) if rows else odd(spark).limit(0)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (None, "x y"), (2, ""), (3, "one"), (4, "x x x x")], "item_id long, text string")
    assert suffixes.passages(d).count() == 0
    assert {tuple(r) for r in minhash.groups(d).collect()} == set()
    assert minhash.keep_one(d).count() == len(rows)
    s = sharding.shard(d, 4)
    assert s.count() == len(rows) and s.columns == [*d.columns, "row_num", "shard", "slot"]
    assert langid.identify(d).count() == sum(i is not None for i, _ in rows)
    assert mixing.mix(d).select(*d.columns).count() <= len(rows)
    assert licenses.scan(d).count() == 0
    q = quality.score(d, labels).collect()
    assert len(q) == len(rows) and all(r.p_quality == 0 for r in q if not (r.text or "").strip())
    assert quality.score(d, labels.limit(0)).count() == len(rows)
    assert pii.find(d).count() == 0
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(d, items).collect()} == ({(6, 4)} if rows else set())
    assert decontam.clean(d, items).count() == len(rows) - (1 if rows else 0)
    assert embeddings.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert sharding.shard(d.withColumn("slot", d.doc_id)).columns == [*d.columns, "slot", "row_num", "shard", "slot1"]


# queries and the pipeline


@pytest.mark.parametrize("module", [suffixes, sharding, licenses, embeddings])
def test_queries_are_their_sql(spark, module):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q, df = c.sql(module.sql()), module.query(spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(q.columns)
    assert sorted(tuple(r[k] for k in cols) for r in df.collect()) == sorted(q.select(*cols).fetchall())


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline as p

    out = p.run(spark, SF)
    got = {r.doc_id: (r["shard"], r["slot"]) for r in out.collect()}
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == [*d.columns, "row_num", "shard", "slot"]
    rows = {r.doc_id: r for r in d.collect()}
    good = {r.doc_id for r in quality.score(d, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.p_quality >= 0.5}
    kept = d.where(d.doc_id.isin(sorted(good)))
    group = dict(minhash.groups(kept).collect())
    good -= {k for k, v in group.items() if k != v}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good -= {k for k, _ in brute_leaks([(k, rows[k].text) for k in good], items)}
    sample = sorted(r.doc_id for r in mixing.mix(d.where(d.doc_id.isin(sorted(good)))).collect())
    place = sharding.feistel(np.arange(len(sample)), len(sample), 17)
    per = max(1, -(-len(sample) // 64))
    assert got == {k: (int(x) // per, int(x) % per) for k, x in zip(sample, place)}


CLASHES = ["_gone", "_bad", "_part", "_cell_source", "gone", "held", "cell_lang", "p", "range", "rep", "key", "family"]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_stages_on_odd_tables(spark, rows):
    """Which rows each stage keeps of nulls, empty and long texts and repeated rows, beside columns of the names that it works with."""
    import corpus_pipeline as p

    d = docs(spark, rows or ODD).selectExpr("*", *[f"'mine' as {c}" for c in CLASHES])
    d = d if rows else d.limit(0)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    everything = sorted(d.collect(), key=key)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        got = sorted(out.collect(), key=key)
        if name == "quality":
            assert all(r in everything for r in got) and all((r.text or "").strip() for r in got)
        elif name == "mixing":
            assert all(r in everything for r in got)
        else:
            assert got == everything, name
    out = p.STAGES[-1][1](spark, d, SF)
    assert out.columns == [*d.columns, "row_num", "shard", "slot"]
    assert sorted(r.row_num for r in out.collect()) == list(range(len(rows)))
    assert sorted((tuple(r)[: len(d.columns)] for r in out.collect()), key=repr) == sorted(map(tuple, everything), key=repr)
