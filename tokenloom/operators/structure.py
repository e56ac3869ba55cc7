"""Functions, calls, reachability, control flow, links and declarations of C-like token streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import after, in_order, upto

_NOT_CALLS = ("if", "while", "for", "switch", "return", "sizeof", "catch")


def source(tokens: DataFrame) -> DataFrame:
    return tokens.where("typ is null or typ <> 'cmnt'")


def functions(tokens: DataFrame) -> DataFrame:
    """(fid, name, ns, name_seq, body_seq, end_seq, from_lnr, upto_lnr) of each definition ``name ( .. ) {`` outside of all braces
    (or inside of a class or namespace), also with words such as ``const`` between, or old-style parameter declarations.

    Three look-ups by equality on the bracket partners, no range join.
    """
    t = source(tokens).select("fid", "seq", "lnr", "txt", "typ", "curly", "round", "jmp")
    t = t.withColumn("_n1", F.lead("txt").over(in_order())).withColumn("_s1", F.lead("seq").over(in_order())).withColumn("_p1", F.lag("txt").over(in_order())).withColumn("_p2", F.lag("txt", 2).over(in_order())).withColumn("_p3", F.lag("txt", 3).over(in_order()))
    # the next { or ; or } decides what a bracket pair heads
    t = t.withColumn("_stop", F.last(F.when(F.col("txt").isin("{", ";", "}", "=") & (F.col("round") == 0), F.struct("txt", "seq", "jmp")), ignorenulls=True).over(after()))
    name = t.where((F.col("typ") == "ident") & (F.col("_n1") == "(") & (F.col("round") == 0) & ~F.col("txt").isin(*_NOT_CALLS) & (F.coalesce("_p1", F.lit("")) != ".") & (F.coalesce("_p1", F.lit("")) != "->"))
    name = name.select(F.col("fid").alias("_f"), F.col("txt").alias("name"), F.col("seq").alias("name_seq"), F.col("lnr").alias("from_lnr"), F.col("_s1").alias("_o"), F.when(F.col("_p1") == "::", F.col("_p2")).alias("ns"), F.col("curly").alias("_c"))
    pair = t.where("txt = ')' and jmp is not null").select(F.col("fid").alias("_f"), F.col("jmp").alias("_o"), F.col("_stop").alias("_b"), F.col("_n1").alias("_after"))
    head = name.join(pair, ["_f", "_o"]).where((F.col("_b.txt") == "{") & F.col("_b.jmp").isNotNull() & ~F.col("_after").isin(",", ")", "=", ".", "->", "+", "-", "*", "/", "?", "[", "]", "&&", "||", "==", "!="))
    end = t.where("txt = '}'").select(F.col("fid").alias("_f"), F.col("seq").alias("_e"), F.col("lnr").alias("upto_lnr"))
    out = head.select("_f", "name", "ns", "name_seq", "from_lnr", "_c", F.col("_b.seq").alias("body_seq"), F.col("_b.jmp").alias("_e")).join(end, ["_f", "_e"])
    # one body, one function: the first name before it; none inside of another's body
    w = Window.partitionBy("_f", "body_seq").orderBy("name_seq")
    out = out.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    outer = F.max("_e").over(Window.partitionBy("_f").orderBy("name_seq").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_in", outer).where(F.col("_in").isNull() | (F.col("_in") < F.col("name_seq")))
    return out.select(F.col("_f").alias("fid"), "name", "ns", "name_seq", "body_seq", F.col("_e").alias("end_seq"), "from_lnr", "upto_lnr")


def with_function(tokens: DataFrame) -> DataFrame:
    """fct: the function whose span holds the token, else ``global``. Functions don't nest, so the last one begun decides: an as-of look-up."""
    f = functions(tokens).select(F.col("fid").alias("_f"), F.col("name_seq").alias("_s"), F.struct("name", "end_seq").alias("_fn"))
    out = tokens.join(f, tokens.fid.eqNullSafe(F.col("_f")) & (F.col("seq") == F.col("_s")), "left").drop("_f", "_s")
    last = F.last("_fn", ignorenulls=True).over(upto())
    return out.withColumn("_l", last).withColumn("fct", F.when(F.col("_l.end_seq") >= F.col("seq"), F.col("_l.name")).otherwise("global")).drop("_fn", "_l")


def calls(tokens: DataFrame) -> DataFrame:
    """(fid, caller, callee, seq) of each ``name (`` inside of a body."""
    t = with_function(source(tokens)).withColumn("_n", F.lead("txt").over(in_order()))
    names = functions(tokens).select("fid", F.col("name_seq").alias("seq"))
    out = t.where((F.col("typ") == "ident") & (F.col("_n") == "(") & (F.col("fct") != "global") & ~F.col("txt").isin(*_NOT_CALLS))
    return out.join(names, ["fid", "seq"], "left_anti").select("fid", F.col("fct").alias("caller"), F.col("txt").alias("callee"), "seq")


def reach(edges: DataFrame, start: str | None = None, end: str | None = None, a: str = "caller", b: str = "callee") -> DataFrame:
    """Edges on paths from ``start``, to ``end``, or from one to the other, by recursive queries."""
    spark = edges.sparkSession
    view = f"edges_{uuid.uuid4().hex}"
    edges.select(F.col(a).alias("x"), F.col(b).alias("y")).distinct().createOrReplaceTempView(view)

    def closure(root: str, x: str, y: str) -> DataFrame:
        # UNION ALL by level, at most as deep as there are nodes; levels are distinct sets
        seen = spark.createDataFrame([(root,)], "node string")
        new = seen
        e = spark.table(view)
        while new.take(1):
            step = new.join(e, new.node == F.col(x)).select(F.col(y).alias("node")).distinct().join(seen, "node", "left_anti")
            new = step.checkpoint() if spark.sparkContext.getCheckpointDir() else step.persist()
            seen = seen.union(new)
        return seen

    out = spark.table(view)
    if start is not None:
        out = out.join(closure(start, "x", "y"), F.col("x") == F.col("node"), "left_semi")
    if end is not None:
        out = out.join(closure(end, "y", "x"), F.col("y") == F.col("node"), "left_semi")
    return out.toDF(a, b)


def reach_sql(edges_view: str, start: str, depth: int = 50) -> str:
    """The nodes reached from ``start``, as a recursive query."""
    return f"WITH RECURSIVE r(node, d) AS (SELECT '{start}', 0 UNION ALL SELECT e.y, d + 1 FROM r JOIN {edges_view} e ON e.x = r.node WHERE d < {depth}) SELECT DISTINCT node FROM r"


def context(edges: DataFrame, name: str) -> DataFrame:
    """Callers and callees of a function."""
    return edges.where(F.col("caller") == name).select(F.lit("calls").alias("relation"), F.col("callee").alias("name")).union(edges.where(F.col("callee") == name).select(F.lit("called by"), "caller")).distinct()


def find_name(tokens: DataFrame, name: str, function: str | None = None) -> DataFrame:
    """(fid, seq, lnr, fct) of each use of an identifier, within one function if it is given."""
    t = with_function(source(tokens)).where((F.col("typ") == "ident") & (F.col("txt") == name))
    return (t if function is None else t.where(F.col("fct") == function)).select("fid", "seq", "lnr", "fct")


def function_source(tokens: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    f = functions(tokens).where(F.col("name") == name).select("fid", F.explode(F.sequence("from_lnr", "upto_lnr")).alias("lnr"))
    return lines.join(f, ["fid", "lnr"]).select("fid", "lnr", "line")


# statements: per-file kernels


def _skip(txt: list[str], jmp: list, i: int) -> int:
    """The token after the statement that begins at i."""
    n = len(txt)
    if i >= n:
        return n
    t = txt[i]
    if t == "{":
        return (jmp[i] if jmp[i] is not None else n - 1) + 1
    if t in ("if", "for", "while", "switch"):
        j = i + 1
        j = (jmp[j] if j < n and txt[j] == "(" and jmp[j] is not None else j - 1) + 1
        j = _skip(txt, jmp, j)
        return _skip(txt, jmp, j + 1) if t == "if" and j < n and txt[j] == "else" else j
    if t == "else":
        return _skip(txt, jmp, i + 1)
    if t == "do":
        j = _skip(txt, jmp, i + 1)
        while j < n and txt[j] != ";":
            j += 1
        return j + 1
    j = i
    while j < n and txt[j] not in (";", "}"):
        j = jmp[j] + 1 if txt[j] in ("(", "[", "{") and jmp[j] is not None else j + 1
    return j + 1 if j < n and txt[j] == ";" else j


def _arrays(pdf: pd.DataFrame):
    pdf = pdf.sort_values("seq")
    seq = pdf["seq"].tolist()
    at = {s: i for i, s in enumerate(seq)}
    return pdf, seq, pdf["txt"].tolist(), [at.get(j) if j == j else None for j in pdf["jmp"].tolist()]


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, seq, txt, jmp = _arrays(pdf)
    n, out = len(txt), {}
    fct = pdf["fct"].tolist()
    labels = {(fct[i], txt[i]): i for i in range(n - 1) if txt[i + 1] == ":" and (i == 0 or txt[i - 1] in (";", "{", "}", ":")) and txt[i] not in ("default",)}
    for i, t in enumerate(txt):
        if t == "if" and i + 1 < n and txt[i + 1] == "(" and jmp[i + 1] is not None:
            j = _skip(txt, jmp, jmp[i + 1] + 1)
            if j < n:
                out[i] = j
                if txt[j] == "else" and (k := _skip(txt, jmp, j + 1)) < n:
                    out[j] = k
        elif t == "goto" and i + 1 < n and (fct[i], txt[i + 1]) in labels:
            out[i] = labels[fct[i], txt[i + 1]]
        elif t in ("switch", "for", "while") and i + 1 < n and txt[i + 1] == "(" and jmp[i + 1] is not None:
            b = jmp[i + 1] + 1
            end = _skip(txt, jmp, i)
            cases = []
            j = b
            while j < min(end, n):
                if txt[j] in ("for", "while", "do", "switch") and j != i:
                    if t == "switch" or txt[j] in ("for", "while", "do", "switch"):
                        j = max(j + 1, _skip(txt, jmp, j))
                        continue
                if t == "switch" and txt[j] in ("case", "default"):
                    cases.append(j)
                if txt[j] == "break" and end < n:
                    out[j] = end
                j += 1
            if t == "switch":
                for a, c in zip(cases, cases[1:]):
                    out[a] = c
                if not any(txt[c] == "default" for c in cases) and end < n:
                    out[i] = end
        elif t == "do" and i + 1 < n:
            end = _skip(txt, jmp, i)
            for j in range(i + 1, min(end, n)):
                if txt[j] == "break" and j not in out and end < n:
                    out[j] = end
    return pd.DataFrame([(pdf["fid"].iloc[0], seq[i], seq[j]) for i, j in sorted(out.items())], columns=["fid", "seq", "target"])


def links(tokens: DataFrame) -> DataFrame:
    """(fid, seq, target): goto to its label, if to its else branch or what follows, else to what follows, case to the next
    case, a switch without default and a break to what follows the statement."""
    t = with_function(source(tokens)).select("fid", "seq", "txt", "jmp", "fct")
    return t.groupBy("fid").applyInPandas(_links, "fid long, seq long, target long")


def with_links(tokens: DataFrame) -> DataFrame:
    x = links(tokens).select(F.col("fid").alias("_f"), F.col("seq").alias("_s"), "target")
    return tokens.join(x, tokens.fid.eqNullSafe(F.col("_f")) & (F.col("seq") == F.col("_s")), "left").withColumn("bound", F.coalesce("target", "bound")).drop("_f", "_s", "target")


def _flow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Control flow of one function: nodes are statements, by the number of their first token."""
    pdf, seq, txt, jmp = _arrays(pdf)
    edges: set[tuple[int, int]] = set()
    n = len(txt)
    exit_ = n
    labels = {txt[i]: i for i in range(n - 1) if txt[i + 1] == ":" and i and txt[i - 1] in (";", "{", "}", ":")}

    def run(i: int, follow: int, brk: int, cont: int) -> int:
        """Edges of the statement at i, after which control is at ``follow``; returns its entry."""
        if i >= n:
            return follow
        t = txt[i]
        if t == "{":
            end = jmp[i] if jmp[i] is not None else n
            starts, j = [], i + 1
            while j < end:
                starts.append(j)
                j = max(j + 1, _skip(txt, jmp, j))
            entry = follow
            for k, s in reversed(list(enumerate(starts))):
                entry = run(s, entry if k + 1 < len(starts) else follow, brk, cont)
            return entry
        if t in ("if", "while", "for", "switch") and i + 1 < n and jmp[i + 1] is not None:
            b = jmp[i + 1] + 1
            if t == "if":
                e = _skip(txt, jmp, b)
                edges.add((i, run(b, follow, brk, cont)))
                edges.add((i, run(e + 1, follow, brk, cont) if e < n and txt[e] == "else" else follow))
            elif t == "switch":
                inner = jmp[b] if b < n and txt[b] == "{" and jmp[b] is not None else n
                cases = [j for j in range(b, min(inner, n)) if txt[j] in ("case", "default")]
                body = run(b, follow, follow, cont)
                for c in cases:
                    edges.add((i, c))
                if not any(txt[c] == "default" for c in cases):
                    edges.add((i, follow))
                if not cases:
                    edges.add((i, body))
            else:
                edges.add((i, run(b, i, follow, i)))
                edges.add((i, follow))
            return i
        if t == "do":
            e = _skip(txt, jmp, i + 1)
            edges.add((e, i + 1))
            edges.add((e, follow))
            return run(i + 1, e, follow, e)
        if t in ("case", "default") or (i + 1 < n and txt[i + 1] == ":"):
            j = i
            while j < n and txt[j] != ":":
                j += 1
            edges.add((i, run(j + 1, follow, brk, cont) if j + 1 < n and txt[j + 1] != "}" else follow))
            return i
        edges.add((i, {"return": exit_, "break": brk, "continue": cont}.get(t, labels.get(txt[i + 1], follow) if t == "goto" and i + 1 < n else follow)))
        return i

    entry = run(0, exit_, exit_, exit_) if n and txt[0] == "{" else exit_
    edges.add((-1, entry))
    name, fid = pdf["fct"].iloc[0], pdf["fid"].iloc[0]
    at = lambda i: -1 if i < 0 else seq[i] if i < n else -2
    return pd.DataFrame([(fid, name, at(a), at(b)) for a, b in sorted(edges)], columns=["fid", "fct", "src", "dst"])


def control_flow(tokens: DataFrame, name: str | None = None) -> DataFrame:
    """(fid, fct, src, dst) between statements, numbered by their first tokens; -1 is the entry, -2 the exit."""
    f = functions(tokens).where(F.lit(True) if name is None else F.col("name") == name)
    t = with_function(source(tokens)).join(f.select(F.col("fid").alias("_f"), F.col("name").alias("_n"), "body_seq", "end_seq"), F.col("fid").eqNullSafe(F.col("_f")) & (F.col("fct") == F.col("_n")) & (F.col("seq") >= F.col("body_seq")) & (F.col("seq") <= F.col("end_seq")))
    return t.select("fid", "fct", "seq", "txt", "jmp").groupBy("fid", "fct").applyInPandas(_flow, "fid long, fct string, src long, dst long")


def cyclomatic(flow: DataFrame) -> DataFrame:
    """Edges - nodes + 2 of each function."""
    nodes = flow.select("fid", "fct", F.explode(F.array("src", "dst")).alias("n")).groupBy("fid", "fct").agg(F.countDistinct("n").alias("nodes"))
    return flow.groupBy("fid", "fct").agg(F.count("*").alias("edges")).join(nodes, ["fid", "fct"]).withColumn("cyclomatic", F.col("edges") - F.col("nodes") + 2)


def _declared(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, seq, txt, _ = _arrays(pdf)
    typ, rows, i = pdf["typ"].tolist(), [], 0
    while i < len(txt):
        is_type = typ[i] in ("type", "modifier") or (txt[i] in ("struct", "union", "enum") and i + 2 < len(txt) and typ[i + 1] == "ident")
        if not is_type:
            i += 1
            continue
        words = [txt[i]]
        if txt[i] in ("struct", "union", "enum"):
            i += 1
            words.append(txt[i])
        i += 1
        while i < len(txt) and (typ[i] in ("type", "modifier", "qualifier")):
            words.append(txt[i])
            i += 1
        while i < len(txt):
            stars = 0
            while i < len(txt) and txt[i] in ("*", "const"):
                stars += txt[i] == "*"
                i += 1
            if i >= len(txt) or typ[i] != "ident" or (i + 1 < len(txt) and txt[i + 1] == "("):
                break
            rows.append((seq[i], txt[i], " ".join(words) + " *" * stars))
            i += 1
            depth = 0
            while i < len(txt) and (depth or txt[i] not in (",", ";", ")")):
                depth += (txt[i] in "([{") - (txt[i] in ")]}") if len(txt[i]) == 1 else 0
                if depth < 0:
                    break
                i += 1
            if i + 1 < len(txt) and txt[i] == "," and (typ[i + 1] == "ident" or txt[i + 1] == "*"):
                i += 1
                continue
            break
    fid = pdf["fid"].iloc[0]
    return pd.DataFrame([(fid, *r) for r in rows], columns=["fid", "seq", "name", "type"])


def declarations(tokens: DataFrame) -> DataFrame:
    """(fid, seq, name, type) of each declared variable, lists with commas included."""
    return source(tokens).select("fid", "seq", "txt", "typ", "jmp").groupBy("fid").applyInPandas(_declared, "fid long, seq long, name string, type string")


def symbols(tokens: DataFrame) -> DataFrame:
    """(fid, seq, name, decl_seq, class): each identifier with its likely declaration (param, local, global or none).

    The latest declaration of the name that stands in a scope still open: scopes are intervals, so it is the greatest
    declaration among those whose scope's end is at or after the use; a window by (file, name) finds it.
    """
    t = with_function(source(tokens))
    d = declarations(tokens).select(F.col("fid").alias("_f"), F.col("seq").alias("_s"), "type")
    t = t.join(d, t.fid.eqNullSafe(F.col("_f")) & (F.col("seq") == F.col("_s")), "left").drop("_f", "_s")
    f = functions(tokens).select(F.col("fid").alias("_f"), F.col("name").alias("_n"), F.col("body_seq"), F.col("end_seq"))
    t = t.join(f, t.fid.eqNullSafe(F.col("_f")) & (F.col("fct") == F.col("_n")) & (F.col("seq") <= F.col("end_seq")), "left").drop("_f", "_n")
    last = F.max("seq").over(Window.partitionBy("fid"))
    # the end of the enclosing block: the next closer one level up
    up = Window.partitionBy("fid", "_lv").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_lv", F.when(F.col("txt") == "}", F.col("curly") + 1).otherwise(F.col("curly")))
    t = t.withColumn("_close", F.min(F.when(F.col("txt") == "}", F.col("seq"))).over(up)).withColumn("_end", F.when(F.col("round") > 0, F.coalesce("end_seq", last)).when(F.col("curly") == 0, last).otherwise(F.coalesce("_close", last)))
    ids = t.where(F.col("typ") == "ident")
    w = Window.partitionBy("fid", "txt").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    decl = F.struct("seq", F.col("_end").alias("end"), F.when((F.col("round") > 0) & (F.col("curly") == 0), "param").when(F.col("curly") > 0, "local").otherwise("global").alias("class"))
    seen = F.collect_list(F.when(F.col("type").isNotNull(), decl)).over(w)
    open_ = F.filter(seen, lambda x: x["end"] >= F.col("seq"))
    out = ids.withColumn("_d", F.try_element_at(open_, F.lit(-1)))
    return out.select("fid", "seq", F.col("txt").alias("name"), F.col("_d.seq").alias("decl_seq"), F.coalesce("_d.class", F.lit("none")).alias("class"))
