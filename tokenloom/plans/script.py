r"""Command lines: ``m switch; n {; c top no default; ps create X``, run on a session.

Commands may be shortened to any prefix that the table below lists first.
``def name(a, b) .. end`` defines text macros of at most eight arguments; ``#``
begins a comment; ``;`` ends a command (``\;`` is a token). The whole line is
one lazy plan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..operators.frame import TokenFrame
from ..operators.match import MatchFrame
from . import pattern

COMMANDS = ("mark", "next", "back", "contains", "stretch", "extend", "jump", "unmark", "reset", "undo", "save", "restore", "with", "list", "display", "pre", "pe", "re", "ps", "dp", "fcts", "ft", "inspect", "def", "default", "terse", "quit")
_OPS = {"|": "|", "+": "|", "&": "&", "*": "&", "^": "^", "-": "^", "=": "=", "": "="}


class Session:
    def __init__(self, tokens: DataFrame, lines: DataFrame | None = None, variables: dict[str, str] | None = None):
        self.frame, self.lines = TokenFrame(tokens), lines
        self.sets: MatchFrame | None = None
        self.macros: dict[str, tuple[list[str], str]] = {}
        self.variables = variables or {}
        self.output: DataFrame | None = None
        self._auto = 0

    def script(self, text: str) -> Session:
        """A script file: macro definitions and command lines."""
        kept, name, args, body = [], None, [], []
        for line in text.splitlines():
            line = re.sub(r"(^|\s)#(\s.*|$)", "", line).strip()
            if m := re.match(r"def\s+(\w+)\s*(?:\(([^)]*)\))?\s*$", line):
                name, args, body = m[1], [a.strip() for a in (m[2] or "").split(",") if a.strip()], []
                if len(args) > 8:
                    raise ValueError(f"macro {name} has more than 8 arguments")
            elif line == "end" and name:
                self.macros[name] = (args, "\n".join(body))
                name = None
            elif name:
                body.append(line)
            elif line:
                kept.append(line)
        for line in kept:
            self.run(line)
        return self

    def run(self, line: str) -> Session:
        for command in split(line):
            for k, v in self.variables.items():
                command = re.sub(rf"\b{re.escape(k)}\b", lambda _, v=v: v, command)
            self._one(command)
        return self

    def _one(self, c: str) -> None:
        if m := re.match(r"(\w+)\s*(?:\((.*)\))?$", c):
            if m[1] in self.macros:
                args, body = self.macros[m[1]]
                given = [a.strip() for a in (m[2] or "").split(",")] if m[2] else []
                if len(given) != len(args):
                    raise ValueError(f"macro {m[1]} takes {len(args)} arguments")
                for a, g in zip(args, given, strict=True):
                    body = re.sub(rf"\b{re.escape(a)}\b", lambda _, g=g: g, body)
                for line in body.splitlines():
                    self.run(line)
                return
        if m := re.match(r"([<>])\s*([|+&*^=-]?)\s*([123])$", c):
            f = self.frame
            self.frame = f.save(int(m[3]), _OPS[m[2]]) if m[1] == ">" else f.restore(int(m[3]), _OPS[m[2]])
            return
        word, _, rest = c.partition(" ")
        name = next((x for x in COMMANDS if x.startswith(word)), None)
        if name is None:
            raise ValueError(f"no such command: {word}")
        getattr(self, f"_{name}", self._nothing)(rest.strip())

    @staticmethod
    def _words(rest: str) -> tuple[list[str], dict[str, bool]]:
        """Predicates, and the qualifiers before them."""
        q: dict[str, bool] = {}
        words = re.findall(r"\([^()]*(?:\([^()]*\)[^()]*)*\)|\S+", rest)
        while words and words[0] in ("no", "ir", "and", "&", "top", "up"):
            q[{"and": "and_", "&": "and_"}.get(words[0], words[0])] = True
            words.pop(0)
        return words, q

    def _step(self, method: str, rest: str) -> None:
        words, q = self._words(rest)
        self.frame = getattr(self.frame, method)(*words, **q)

    def _nothing(self, rest: str) -> None:
        pass

    def _mark(self, rest: str) -> None:
        self._step("mark", rest)

    def _unmark(self, rest: str) -> None:
        self._step("unmark", rest)

    def _next(self, rest: str) -> None:
        self._step("next", rest)

    def _back(self, rest: str) -> None:
        self._step("back", rest)

    def _contains(self, rest: str) -> None:
        self._step("contains", rest)

    def _stretch(self, rest: str) -> None:
        self._step("stretch", rest)

    def _extend(self, rest: str) -> None:
        self._step("extend", rest)

    def _jump(self, rest: str) -> None:
        self.frame = self.frame.jump()

    def _reset(self, rest: str) -> None:
        self.frame = self.frame.reset(rest == "all")

    def _undo(self, rest: str) -> None:
        self.frame = self.frame.undo()

    def _save(self, rest: str) -> None:
        self.frame = self.frame.save(int(rest))

    def _restore(self, rest: str) -> None:
        self.frame = self.frame.restore(int(rest))

    def _with(self, rest: str) -> None:
        self.frame = self.frame.where(rest.strip()[1:-1])

    def _ft(self, rest: str) -> None:
        self.frame = self.frame.struct_body(rest)

    def _fcts(self, rest: str) -> None:
        from pyspark.sql import functions as F

        from ..operators.structure import functions

        df = self.frame.df
        f = functions(df).select(F.col("fid").alias("_f"), F.col("name_seq").alias("_s"))
        out = df.join(f, df.fid.eqNullSafe(F.col("_f")) & (F.col("seq") == F.col("_s")), "left")
        self.frame = TokenFrame(out.withColumn("mark", F.when(F.col("_s").isNotNull(), 1).otherwise(F.col("mark"))).drop("_f", "_s"), self.frame)

    def _list(self, rest: str) -> None:
        self.output = self.frame.list(int(rest) if rest else None)

    def _display(self, rest: str) -> None:
        n = [int(x) for x in rest.split()]
        self.output = self.frame.display(self.lines, n[1] if len(n) > 1 else 0, n[0] if n else None)

    def _pre(self, rest: str) -> None:
        self.output = self.frame.reprint()

    def _inspect(self, rest: str) -> None:
        f, n = rest.split()
        self.output = self.frame.inspect(f, int(n))

    def _pe(self, rest: str, regular: bool = False) -> None:
        within = rest.startswith("& ")
        rest = rest[2:].strip() if within else rest
        if m := re.match(r"(\w+):\s+(.*)$", rest, re.S):
            name, rest = m[1], m[2]
        else:
            self._auto += 1
            name = f"SN{self._auto}"
        found = pattern.search(self.frame.df, rest, name, regular=regular)
        found = found.within_marks(self.frame) if within else found
        self.sets = found if self.sets is None else self.sets.delete(name).union(found)

    def _re(self, rest: str) -> None:
        self._pe(rest, True)

    def _need(self) -> MatchFrame:
        if self.sets is None:
            raise ValueError("there are no pattern sets yet")
        return self.sets

    def _ps(self, rest: str) -> None:
        word, _, more = rest.partition(" ")
        if word == "create":
            found = MatchFrame.from_marks(self.frame, more.strip())
            self.sets = found if self.sets is None else self.sets.delete(more.strip()).union(found)
        elif word == "convert":
            self.frame = self._need().of(more.strip()).to_marks(self.frame, bits=True)
        elif word == "delete":
            self.sets = self._need().delete(more.strip())
        elif word == "rename":
            self.sets = self._need().rename(*more.split())
        elif word == "caption":
            name, _, text = more.strip().partition(" ")
            self.sets = self._need().delete(name).union(self._need().of(name).named(name, text))
        elif word == "list":
            self.output = self._need().summary() if not more else self._need().of(more.strip()).summary()
        elif m := re.match(r"(\w+)\s*=\s*(\w+)\s*(with\b.*|\S+)\s*(\w+)?$", rest):
            s = self._need()
            a = s.of(m[2])
            if m[3].startswith("with"):
                from ..operators.frame import predicate

                p = m[3][4:].strip()
                out = a.having(self.frame.df, predicate(p.strip('"') if not p.startswith("(") else p))
            else:
                b = s.of(m[4])
                out = {
                    "+": a.union, "|": a.union, "-": a.minus, "^": a.minus, "\\": a.minus, "&": a.intersect, "*": a.containing, "d": a.containing,
                    "m": a.meets, "<": a.precedes, ">": a.follows, "(": a.overlaps, ")": a.overlapped_by,
                }[m[3]](b)
            self.sets = s.delete(m[1]).union(out.named(m[1]))
        else:
            raise ValueError(f"no such ps command: {rest}")

    def _dp(self, rest: str) -> None:
        s = self._need()
        words = rest.split()
        s = s if not words or words[0] == "*" else s.of(words[0])
        n = [int(x) for x in words[1:]]
        self.output = s.display(nth=n[0]) if len(n) == 1 else s.display(least=n[0], most=n[1]) if len(n) == 2 else s.display()


def split(line: str) -> list[str]:
    r"""Commands between semicolons; not at ``\;`` and not in a word of brackets."""
    parts = re.split(r"(?<!\\);", line)
    return [p.strip() for p in parts if p.strip()]
