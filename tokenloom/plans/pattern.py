"""Token patterns: parser, native lowering and the automaton.

    pattern  := sequence ( '\\|' sequence )*
    sequence := item+
    item     := atom [ '*' | '\\+' | '\\?' ]      (attached; a lone * is a token)
    atom     := '.' | ['^'] operand | ['^'] '[' operand+ ']' | '\\(' pattern '\\)'
              | name ':' operand | ['^'] ':' name | brace '@' depth | '<' n '>'
    operand  := word | '@' type | '/' regex | '\\' literal
    then       '@' n '(' expression ')'          constraints

The shortest match from each start token is kept; matches from different starts
may overlap. Brackets matched explicitly pair with explicit ones, implicit ones
(by '.' or a negation) with implicit ones. A match stays in its file.

Patterns of fixed length without brackets' depths or constraints are lowered to
``lead`` expressions over one window, bound names to comparisons of texts; others
run in an automaton over each file. ``search_text`` searches files of text as they
are read, without a shuffle of their tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.ere import to_java
from ..operators import packed
from ..operators.match import MATCHES, MatchFrame
from . import expr

OPENERS, CLOSERS = {"{": "}", "(": ")", "[": "]"}, {"}": "{", ")": "(", "]": "["}


@dataclass(frozen=True)
class Atom:
    """One token's test. kind: any, text, type, regex, set, bind, ref."""

    kind: str
    value: object = None
    negated: bool = False
    name: str | None = None
    depth: int | None = None
    position: int | None = None


@dataclass
class Node:
    op: str  # atom, cat, alt, star, plus, opt, empty
    items: list = field(default_factory=list)
    atom: Atom | None = None


@dataclass
class Pattern:
    tree: Node
    constraints: dict[int, str]
    text: str


def _operand(w: str, regular: bool) -> Atom:
    if w.startswith("\\") and len(w) > 1:
        return Atom("text", w[1:])
    if w.startswith("@") and len(w) > 1:
        return Atom("type", w[1:])
    if w.startswith("/") and len(w) > 1 and w not in ("/=",):
        return Atom("regex", to_java(w[1:]))
    m = re.fullmatch(r"([{(\[}\])])@(\d+)", w)
    if m:
        return Atom("text", m[1], depth=int(m[2]))
    return Atom("text", w)


def _split_constraints(text: str) -> tuple[str, dict[int, str]]:
    out: dict[int, str] = {}
    while m := re.search(r"\s@(\d+)\s*\(", text):
        level, j = 0, m.end() - 1
        while j < len(text):
            level += (text[j] == "(") - (text[j] == ")")
            if level == 0:
                break
            j += 1
        if j >= len(text):
            raise ValueError(f"a constraint of {text!r} is not closed")
        out[int(m[1])] = text[m.end() : j]
        text = text[: m.start()] + text[j + 1 :]
    return text, out


def parse(text: str, regular: bool = False) -> Pattern:
    """regular: ``|``, ``(`` and ``)`` are operators without a backslash (the ``re`` form)."""
    body, constraints = _split_constraints(text.strip())
    words = body.split()
    if not words:
        raise ValueError("the pattern is empty")
    if regular:  # operators may touch their operands
        words = [x for w in words for x in ([w] if w.startswith("/") else re.sub(r"(?<!\\)([(|]|\)[*+?]?)", r" \1 ", w).split())]
    bar, left, right = ("|", "(", ")") if regular else ("\\|", "\\(", "\\)")
    at = 0

    def suffix(w: str) -> tuple[str, str]:
        if len(w) > 1:
            if w.endswith("*") and w not in ("**", "/*") and not (w.startswith("\\") and len(w) == 2):
                return w[:-1], "star"
            for end, op in (("\\+", "plus"), ("\\?", "opt")):
                if w.endswith(end) and len(w) > 2:
                    return w[:-2], op
            if regular and len(w) > 1 and w[-1] in "+?" and w[:-1] not in ("+", "?", "\\"):
                return w[:-1], "plus" if w[-1] == "+" else "opt"
        return w, ""

    def alternatives(stop: bool) -> Node:
        nonlocal at
        options = [[]]
        while at < len(words):
            w = words[at]
            core, op = suffix(w)
            if core == right and stop:
                break
            at += 1
            if w == bar:
                options.append([])
                continue
            if core == left and not op:
                n = alternatives(True)
                if at >= len(words):
                    raise ValueError(f"a group of {text!r} is not closed")
                _, op = suffix(words[at])
                at += 1
            elif m := re.fullmatch(r"<(\d+)>", core):
                options[-1].append(Node("position", atom=Atom("position", position=int(m[1]))))
                continue
            else:
                n = atom_node(core, op, w)
                core, op = (n[1], n[2])
                n = n[0]
            options[-1].append(Node(op, [n]) if op else n)
        nodes = [Node("cat", o) if len(o) != 1 else o[0] for o in options]
        return nodes[0] if len(nodes) == 1 else Node("alt", nodes)

    def atom_node(core: str, op: str, w: str) -> tuple[Node, str, str]:
        nonlocal at
        neg = core.startswith("^") and core not in ("^", "^=")
        base = core[1:] if neg else core
        if base.startswith("[") and (len(base) > 1) and not base.startswith("[@") or base == "[" and neg:
            # a set: elements up to the one that ends in ]
            items = [base[1:]] if len(base) > 1 else []
            last_op = op
            if items and items[-1].endswith("]") and len(items[-1]) > 1:
                items[-1] = items[-1][:-1]
            else:
                if items:
                    items[-1] = w[len(core) - len(base) + 1 :] if op else items[-1]
                while True:
                    if at >= len(words):
                        raise ValueError(f"a set of {text!r} is not closed")
                    e = words[at]
                    at += 1
                    c, last_op = suffix(e)
                    if c.endswith("]") and len(c) > 1:
                        items.append(c[:-1])
                        break
                    items.append(e)
            elements = tuple(_element(x) for x in items if x)
            return Node("atom", atom=Atom("set", elements, neg)), core, last_op
        if base == "." and not neg:
            return Node("atom", atom=Atom("any")), core, op
        if m := re.fullmatch(r":(\w+)", base):
            return Node("atom", atom=Atom("ref", m[1], neg)), core, op
        if not neg and (m := re.fullmatch(r"(\w+):(\S+)", base)):
            return Node("atom", atom=Atom("bind", _operand(m[2], regular), name=m[1])), core, op
        a = _operand(base, regular)
        return Node("atom", atom=Atom(a.kind, a.value, neg, depth=a.depth)), core, op

    def _element(x: str) -> Atom:
        return Atom("ref", x[1:]) if re.fullmatch(r":\w+", x) else _operand(x, regular)

    tree = alternatives(False)
    if at < len(words):
        raise ValueError(f"a group of {text!r} closes too often")
    return Pattern(tree, constraints, text)


# native lowering


def fixed(p: Pattern) -> list[Atom] | None:
    """The pattern's atoms if it is a plain row of them that needs no state; bracket pairs and names bound twice need it."""
    items = p.tree.items if p.tree.op == "cat" else [p.tree]
    if p.constraints or any(i.op != "atom" for i in items):
        return None
    atoms = [i.atom for i in items]
    names = [a.name for a in atoms if a.kind == "bind"]
    if any(a.depth is not None for a in atoms) or len({*names}) < len(names):
        return None
    return atoms if _harmless(atoms) else None


def _may(a: Atom, brackets: dict[str, str], bound: dict[str, Atom]) -> bool:
    """Whether the atom can match one of these brackets."""
    if a.kind == "any" or a.negated:
        return True
    if a.kind == "text":
        return a.value in brackets
    if a.kind == "type":
        return False
    if a.kind == "regex":
        return any(_search(a.value)(x) for x in brackets)
    if a.kind == "set":
        return any(_may(e, brackets, bound) for e in a.value)
    if a.kind == "bind":
        return _may(a.value, brackets, bound)
    return a.value in bound and _may(bound[a.value], brackets, bound)


def _harmless(atoms: list[Atom]) -> bool:
    """No opener may come before a closer inside the row."""
    seen, bound = False, {a.name: a.value for a in atoms if a.kind == "bind"}
    for a in atoms:
        if seen and _may(a, CLOSERS, bound):
            return False
        seen |= _may(a, OPENERS, bound)
    return True


def condition(a: Atom) -> Column:
    if a.kind == "any":
        c = F.lit(True)
    elif a.kind == "text":
        c = F.col("txt") == a.value
    elif a.kind == "type":
        t = F.coalesce("typ", F.lit(""))
        c = t.startswith("const") if a.value == "const" else t == a.value
    elif a.kind == "regex":
        c = F.col("txt").rlike(a.value)
    else:
        texts = [e.value for e in a.value if e.kind == "text"]
        c = F.col("txt").isin(texts) if texts else F.lit(False)
        for e in a.value:
            if e.kind != "text":
                c = c | condition(e)
    return ~c if a.negated else c


def _refers(a: Atom, at: int, bound: dict[str, int], w) -> Column:
    """The condition on the token ``at`` places ahead, where an atom refers to what names before it are bound to."""
    if a.kind == "ref":
        k = bound.get(a.value)
        same = F.lit(False) if k is None or k >= at else F.lead("txt", at).over(w) == F.lead("txt", k).over(w)
        return ~same if a.negated else same
    if a.kind == "set" and any(e.kind == "ref" for e in a.value):
        plain = tuple(e for e in a.value if e.kind != "ref")
        c = F.lead(condition(Atom("set", plain)), at).over(w)
        for e in a.value:
            if e.kind == "ref":
                c = c | _refers(e, at, bound, w)
        return ~c if a.negated else c
    return F.lead(condition(a.value if a.kind == "bind" else a), at).over(w)


def lowered(tokens: DataFrame, patterns: list[tuple[str, str | None, list[Atom]]]) -> DataFrame:
    """All matches of rows of atoms (set, caption, atoms), in one pass: a ``lead`` for each atom over one window."""
    w = Window.partitionBy("fid").orderBy("seq")
    ahead = lambda k: F.col("seq") + k
    found = []
    for name, msg, atoms in patterns:
        bound = {a.name: k for k, a in enumerate(atoms) if a.kind == "bind"}
        hit = F.lit(True)
        for k, a in enumerate(atoms):
            hit = hit & F.coalesce(_refers(a, k, bound, w), F.lit(False))
        last = len(atoms) - 1
        binds = []
        for n, k in sorted(bound.items(), key=lambda x: x[1]):
            refs = [ahead(j) for j, a in enumerate(atoms) if a.kind == "ref" and not a.negated and a.value == n and j > k]
            binds.append(F.struct(F.lit(n).alias("name"), F.lead("txt", k).over(w).alias("text"), ahead(k).alias("def_seq"), (refs[0] if refs else F.lit(None).cast("long")).alias("ref_seq"), F.array(*refs).cast("array<bigint>").alias("all_refs")))
        kind = MATCHES["bindings"].dataType.simpleString()
        bindings = F.array(*binds).cast(kind) if binds else F.lit(None).cast(kind)
        found.append(F.when(hit, F.struct(F.lit(name).alias("set"), ahead(last).alias("upto_seq"), F.lead("lnr", last).over(w).alias("upto_lnr"), F.lit(msg).cast("string").alias("msg"), bindings.alias("bindings"))))
    out = tokens.select("fid", "seq", "lnr", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("_hits")).where(F.size("_hits") > 0)
    return out.select("fid", F.col("seq").alias("from_seq"), F.col("lnr").alias("from_lnr"), F.explode("_hits").alias("_h")).select("fid", "from_seq", "from_lnr", "_h.*")


# automaton


class Machine:
    """Thompson construction, run by sets of states that carry bindings and bracket flags."""

    def __init__(self, p: Pattern):
        self.edges: list[list[tuple[Atom | None, int]]] = []
        self.positions: dict[int, int] = {}
        start, self.accept = self._build(p.tree)
        self.start = start
        self.closures = [self._closure(s) for s in range(len(self.edges))]
        self.constraints = {n: expr.function(c) for n, c in p.constraints.items()}
        self.by_state = bool(p.constraints) and not self.positions
        self.order = self._numbers()

    def _new(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _build(self, n: Node) -> tuple[int, int]:
        if n.op in ("atom", "position"):
            a, b = self._new(), self._new()
            if n.op == "position":
                self.positions[b] = n.atom.position
            self.edges[a].append((n.atom if n.op == "atom" else None, b))
            return a, b
        if n.op == "cat":
            if not n.items:
                s = self._new()
                return s, s
            first = last = None
            for i in n.items:
                a, b = self._build(i)
                if first is None:
                    first = a
                else:
                    self.edges[last].append((None, a))
                last = b
            return first, last
        if n.op == "alt":
            a, b = self._new(), self._new()
            for i in n.items:
                x, y = self._build(i)
                self.edges[a].append((None, x))
                self.edges[y].append((None, b))
            return a, b
        x, y = self._build(n.items[0])
        a, b = self._new(), self._new()
        self.edges[a].append((None, x))
        self.edges[y].append((None, b))
        if n.op in ("star", "plus"):
            self.edges[y].append((None, x))
        if n.op in ("star", "opt"):
            self.edges[a].append((None, b))
        return a, b

    def _closure(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for a, t in self.edges[todo.pop()]:
                if a is None and t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _numbers(self) -> dict[int, int]:
        """States in the order in which atoms reach them, for constraints by state number."""
        out = {s: 0 for s in self.closures[self.start]}
        k, todo = 0, [self.start]
        seen = {self.start}
        while todo:
            s = todo.pop(0)
            for q in sorted(self.closures[s]):
                for a, t in self.edges[q]:
                    if a is not None and t not in seen:
                        k += 1
                        seen.add(t)
                        for z in self.closures[t]:
                            out.setdefault(z, k)
                        todo.append(t)
        return out

    def first(self) -> list[Atom] | None:
        """What a start token must satisfy, if it can be told from it alone."""
        atoms = [a for s in self.closures[self.start] for a, _ in self.edges[s] if a is not None]
        return None if self.accept in self.closures[self.start] or any(a.kind == "ref" for a in atoms) else atoms

    def find(self, toks: list[dict], starts: Iterator[int], jmp: list[int | None], texts: list[str] | None = None, typs: list[str] | None = None) -> Iterator[tuple[int, int, list]]:
        """texts, typs: what the tokens hold, if it is at hand; without constraints and depths the tokens aren't read then."""
        texts, typs = texts or [t["txt"] for t in toks], typs or [t["typ"] or "" for t in toks]
        first = self.first()
        if first is not None and not any(_deep(a) for a in first):
            # tokens alike in text and type are tested once
            can = {k for k in {*zip(texts, typs, strict=True)} if any(_test(a, *k, None) for a in first)}
            starts, first = (s for s in starts if (texts[s], typs[s]) in can) if can else (), None
        for s in starts:
            if first is not None and not any(_test(a, texts[s], typs[s], toks[s]) for a in first):
                continue
            if hit := self._run(toks, texts, typs, jmp, s):
                yield hit

    def _allowed(self, state: int, tok: dict, binds: tuple, toks: list[dict]) -> bool:
        if not self.constraints:
            return True
        look = lambda name: [toks[i] for n, i in binds if n == name]
        if self.by_state:
            c = self.constraints.get(self.order.get(state, -1))
            return c is None or bool(c(tok, look))
        for q in self.closures[state]:
            if q in self.positions and (c := self.constraints.get(self.positions[q])) is not None and not c(tok, look):
                return False
        return True

    def _run(self, toks, texts, typs, jmp, s):
        # thread: (state, bindings, references, stack of (explicit?) marks for openers since the start)
        threads = {(self.start, (), (), ())}
        for q in range(s, len(toks)):
            txt, typ, tok = texts[q], typs[q], toks[q]
            opens, closes = txt in OPENERS, txt in CLOSERS
            new = set()
            for state, binds, refs, stack in threads:
                for c in self.closures[state]:
                    for a, t in self.edges[c]:
                        if a is None:
                            continue
                        ok, b, r = self._step(a, txt, typ, tok, q, binds, refs, texts)
                        if not ok:
                            continue
                        st = stack
                        implicit = a.kind == "any" or a.negated
                        if opens:
                            st = (*stack, not implicit)
                        elif closes:
                            if stack:
                                if stack[-1] == implicit:
                                    continue
                                st = stack[:-1]
                        if self.constraints and not self._allowed(t if not self.by_state else state, tok, b, toks):
                            continue
                        if self.accept in self.closures[t]:
                            return s, q, [(n, i, tuple(x for m, x in r if m == n)) for n, i in b]
                        new.add((t, b, r, st))
            if not new:
                return None
            threads = self._thin(new)
        return None

    @staticmethod
    def _thin(threads: set) -> set:
        """Of threads alike in state, bindings and brackets the one with most references goes on, then the one whose references come first."""
        if len(threads) < 2:
            return threads
        best: dict = {}
        for s, b, r, st in threads:
            k = (s, b, st)
            if k not in best or (-len(r), r) < (-len(best[k]), best[k]):
                best[k] = r
        return {(s, b, r, st) for (s, b, st), r in best.items()}

    def _step(self, a: Atom, txt, typ, tok, q, binds, refs, texts):
        if a.kind == "ref":
            same = [i for n, i in binds if n == a.value and texts[i] == txt]
            if not a.negated:
                return bool(same), binds, (*refs, (a.value, q)) if same else refs
            return not same, binds, refs
        if a.kind == "bind":
            ok = _test(a.value, txt, typ, tok)
            return ok, (*(b for b in binds if b[0] != a.name), (a.name, q)) if ok else binds, refs
        if a.kind == "set" and any(e.kind == "ref" for e in a.value):
            hit = any((any(n == e.value and texts[i] == txt for n, i in binds)) if e.kind == "ref" else _test(e, txt, typ, tok) for e in a.value)
            return hit != a.negated, binds, refs
        return _test(a, txt, typ, tok), binds, refs


@lru_cache(4096)
def _search(pattern: str) -> Callable:
    return re.compile(pattern).search


def _test(a: Atom, txt: str, typ: str, tok: dict) -> bool:
    if a.kind == "any":
        return True
    if a.kind == "bind":
        return _test(a.value, txt, typ, tok)
    if a.kind == "text":
        hit = txt == a.value
        if hit and a.depth is not None:
            hit = tok[{"{": "curly", "}": "curly", "(": "round", ")": "round", "[": "bracket", "]": "bracket"}[txt]] == a.depth
    elif a.kind == "type":
        hit = typ.startswith("const") if a.value == "const" else typ == a.value
    elif a.kind == "regex":
        hit = _search(a.value)(txt) is not None
    elif a.kind == "set":
        hit = any(_test(e, txt, typ, tok) for e in a.value)
    else:
        return True
    return hit != a.negated


def _deep(a: Atom) -> bool:
    """Whether the atom asks for a token's depth."""
    inner = a.value if a.kind == "set" else (a.value,) if a.kind == "bind" else ()
    return a.depth is not None or any(_deep(x) for x in inner)


def _kernel(patterns: list[tuple[str, str, str | None]], top: bool, regular: bool):
    machines = [(name, msg, Machine(parse(p, regular))) for name, p, msg in patterns]
    rich = _rich(machines)

    def run(t: pa.Table) -> pa.Table:
        seqs = t.column("seq").to_numpy()
        if (seqs[1:] < seqs[:-1]).any():
            t = t.sort_by("seq")
        seqs, lnrs, texts, typs = (t.column(n).to_pylist() for n in ("seq", "lnr", "txt", "typ"))
        typs, fid = [x or "" for x in typs], t.column("fid")[0].as_py()
        toks, jmp = [None] * len(seqs), []
        if rich:
            toks, at = t.to_pylist(), {x: i for i, x in enumerate(seqs)}
            jmp = [at.get(x["jmp"]) for x in toks]
            for x, j in zip(toks, jmp, strict=True):
                x["range"] = lnrs[j] - x["lnr"] if j is not None else 0
        starts = [i for i, m in enumerate(t.column("mark").to_pylist()) if (m or 0) > 0] if top else range(len(seqs))
        rows = []
        for name, msg, m in machines:
            for a, b, binds in m.find(toks, iter(starts), jmp, texts, typs):
                found = [{"name": n, "text": texts[i], "def_seq": seqs[i], "ref_seq": seqs[r[0]] if r else None, "all_refs": [seqs[x] for x in r]} for n, i, r in binds]
                rows.append((name, fid, seqs[a], seqs[b], lnrs[a], lnrs[b], msg, found))
        cols = zip(*rows, strict=True) if rows else [()] * len(_FOUND)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)

    return run


def _rich(machines: list[tuple[str, str | None, Machine]]) -> bool:
    """Whether a machine asks for more of a token than its text and type."""
    return any(m.constraints or any(_deep(a) for e in m.edges for a, _ in e if a is not None) for _, _, m in machines)


_FOUND = to_arrow_schema(MATCHES)
#: Where the bindings stand, which rows of atoms without names don't have.
_UNBOUND = MATCHES.names.index("bindings")
_NEEDED_FEW = ("fid", "seq", "lnr", "txt", "typ", "mark")
_NEEDED = ("fid", "fnm", "seq", "lnr", "txt", "typ", "len", "curly", "round", "bracket", "jmp", "mark", "fct")


def search(tokens: DataFrame, pattern: str, name: str = "SN1", msg: str | None = None, top: bool = False, regular: bool = False, native: bool | None = None, comments: bool = False) -> MatchFrame:
    """All matches of one pattern. native: force (or forbid) the lowering."""
    return search_all(tokens, [(name, pattern, msg)], top, regular, native, comments)


def search_all(tokens: DataFrame, patterns: list[tuple[str, str, str | None]], top: bool = False, regular: bool = False, native: bool | None = None, comments: bool = False) -> MatchFrame:
    """All matches of a pack of (name, pattern, caption): those that need the automaton in one pass over each file."""
    if not comments:
        tokens = tokens.where("typ is null or typ <> 'cmnt'")
    out, rest, rows = None, [], []
    for name, p, msg in patterns:
        atoms = fixed(parse(p, regular)) if native is not False and not top else None
        if atoms is None:
            if native:
                raise ValueError(f"not a fixed row of tokens: {p}")
            rest.append((name, p, msg))
        else:
            rows.append((name, msg, atoms))
    if rows:
        out = MatchFrame(lowered(tokens, rows))
    if rest:
        rich = _rich([(n, None, Machine(parse(p, regular))) for n, p, _ in rest])
        df = MatchFrame(tokens.select(*(_NEEDED if rich else _NEEDED_FEW)).groupBy("fid").applyInArrow(_kernel(rest, top, regular), MATCHES))
        out = df if out is None else out.union(df)
    return out


# files of text: rows of atoms over the tokens of a chunk


def _places(c: packed.Chunk, atoms: list[Atom]) -> np.ndarray:
    """Numbers of the tokens at which the row of atoms matches. Plain texts go first; texts alike among the places left are tested once."""
    order, last = sorted(enumerate(atoms), key=lambda x: (x[1].kind != "text", x[1].negated)), len(atoms) - 1
    k, a = order[0]
    at = np.flatnonzero(c.codes == c.code(a.value)) - k if a.kind == "text" and not a.negated else np.arange(len(c.codes))
    at = at[(at >= 0) & (at + last < len(c.codes))]
    at = at[c.row[at] == c.row[at + last]]
    for k, a in order:
        if a.kind == "text" and not a.negated:
            at = at[c.codes[at + k] == c.code(a.value)]
        elif a.kind != "any":
            here = c.codes[at + k]
            ok = np.zeros(len(c.words), bool)
            ok[here] = True
            some = np.flatnonzero(ok)
            ok[some] = [_test(a, w, "", None) for w in c.words.take(pa.array(some)).to_pylist()]
            at = at[ok[here]]
    return at


def _text_kernel(rows: list[tuple[str, str | None, list[Atom]]], stretches: list[tuple[str, str]]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, c in packed.chunks(b):
                found = [(name, msg, at, at + len(atoms) - 1) for name, msg, atoms in rows for at in (_places(c, atoms),)]
                for name, text in stretches:
                    at = _places(c, [Atom("text", text)])
                    on = c.row[at[:-1]] == c.row[at[1:]]
                    found.append((name, None, at[:-1][on], at[1:][on]))
                fids = b.column(0)[part]
                for name, msg, at, upto in found:
                    if n := len(at):
                        cols = [pa.array([name] * n), fids.take(pa.array(c.row[at])), pa.array(c.seq[at]), pa.array(c.seq[upto]), pa.array(c.lines(at)), pa.array(c.lines(upto)), pa.array([msg] * n, pa.string())]
                        yield pa.RecordBatch.from_arrays(cols, schema=_FOUND.remove(_UNBOUND))

    return run


def search_text(files: DataFrame, patterns: list[tuple[str, str, str | None]], stretches: list[tuple[str, str]] = ()) -> MatchFrame:
    """All matches of (name, pattern, caption) in files (fid, fnm, text) by the text lexer, in one pass over their texts.

    ``stretches``: (name, text), from each token of the text to the next one of it. The patterns are rows of tokens that
    bind no names; others want ``search_all``. A row is a file: rows of one fid are searched apart. A null
    text has no tokens.
    """
    rows = []
    for name, p, msg in patterns:
        atoms = fixed(parse(p))
        if atoms is None or any(e.kind in ("bind", "ref") for a in atoms for e in (a, *(a.value if a.kind == "set" else ()))):
            raise ValueError(f"not a fixed row of tokens without names: {p}")
        rows.append((name, msg, atoms))
    found = files.select(F.col("fid").cast("long").alias("fid"), F.col("text").cast("string").alias("text")).mapInArrow(_text_kernel(rows, list(stretches)), StructType(MATCHES[:_UNBOUND]))
    return MatchFrame(found, found, frozenset(x[0] for x in (*patterns, *stretches)))


def suppressed(matches: MatchFrame, tokens: DataFrame) -> MatchFrame:
    """Without matches on whose first line a comment says ``@suppress tag``, the tag being part of their set's name or message."""
    tags = tokens.where(F.col("typ") == "cmnt").select(F.col("fid").alias("_f"), F.col("lnr").alias("_l"), F.explode(F.regexp_extract_all("txt", F.lit(r"@suppress\s+(\S+)"), F.lit(1))).alias("_tag"))
    on = F.col("fid").eqNullSafe(F.col("_f")) & (F.col("from_lnr") == F.col("_l")) & (F.col("set").contains(F.col("_tag")) | F.coalesce("msg", F.lit("")).contains(F.col("_tag")))
    return MatchFrame(matches.df.join(tags, on, "left_anti"))
