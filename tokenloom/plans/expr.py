"""The expression language of ``with`` and of pattern constraints.

``.field``, ``:name``, ``:name.field``, integers, words, ``/regex``, ``size(n)``,
``! && || == != < <= > >= + - * / %`` and brackets. One grammar, two back ends:
a Column over a token table, and a function of a token (for the pattern kernel).
Arithmetic is on integers; division by 0 gives 0. A comparison with a word or
regex is one of texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ere import to_java

NUMBERS = ("lnr", "seq", "mark", "curly", "round", "bracket", "len", "range")
TEXTS = ("txt", "typ", "fnm", "fct")
_TOKEN = re.compile(r"\s*(?:(\d+)|(&&|\|\||[=!<>]=|[<>!+*%()-])|/((?:\\.|[^\s/)]|\)(?=\$))+)|(/)|(\.[A-Za-z_]\w*)|(:[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(\w+)|\"([^\"]*)\"|(@\w+))")


def parse(text: str) -> tuple:
    """A tree of ('op', ...) tuples."""
    items, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read the expression from: {text[at:]!r}")
        num, op, regex, slash, field, bound, word, quoted, typ = m.groups()
        if regex is not None and not (items and items[-1][0] == "op" and items[-1][1] in ("==", "!=")):
            slash, regex = "/", None  # a division
            m = re.compile(r"\s*/").match(text, at)
        items.append(("num", int(num)) if num else ("op", op) if op else ("regex", regex) if regex is not None else ("op", "/") if slash else ("field", field[1:]) if field else ("bound", bound[1:]) if bound else ("word", word) if word else ("word", quoted) if quoted is not None else ("word", typ))
        at = m.end()
    tree, rest = _binary(items, 0)
    if rest:
        raise ValueError(f"not understood in {text!r}: {rest}")
    return tree


_LEVELS = [("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%")]


def _binary(items: list, level: int) -> tuple[tuple, list]:
    if level == len(_LEVELS):
        return _unary(items)
    left, items = _binary(items, level + 1)
    while items and items[0][0] == "op" and items[0][1] in _LEVELS[level]:
        op = items[0][1]
        right, items = _binary(items[1:], level + 1)
        left = (op, left, right)
    return left, items


def _unary(items: list) -> tuple[tuple, list]:
    if not items:
        raise ValueError("the expression ends too soon")
    (kind, value), rest = items[0], items[1:]
    if (kind, value) == ("op", "("):
        tree, rest = _binary(rest, 0)
        if not rest or rest[0] != ("op", ")"):
            raise ValueError("a bracket is not closed")
        return tree, rest[1:]
    if kind == "op" and value in "!-":
        tree, rest = _unary(rest)
        return ("not" if value == "!" else "neg", tree), rest
    if kind == "op":
        raise ValueError(f"{value!r} needs a left side")
    if kind == "word" and value == "size" and rest[:1] == [("op", "(")] and len(rest) >= 3:
        return ("size", rest[1][1]), rest[3:]
    return (kind, value), rest


def _textual(t: tuple) -> bool:
    return t[0] in ("word", "regex") or (t[0] == "field" and t[1] in TEXTS) or (t[0] == "bound" and t[1].rpartition(".")[2] not in NUMBERS)


def fields(t: tuple) -> set[str]:
    return {t[1]} if t[0] == "field" else set().union(*(fields(x) for x in t[1:] if isinstance(x, tuple)))


def column(text: str, sizes: dict[int, Column] | None = None) -> Column:
    """The expression as a condition or value over a token table's row."""
    return _col(parse(text), sizes or {})


def _bool(t: tuple, sizes) -> Column:
    c = _col(t, sizes)
    return c if t[0] in ("==", "!=", "<", "<=", ">", ">=", "&&", "||", "not") else c != 0


def _col(t: tuple, sizes) -> Column:
    op = t[0]
    if op == "num":
        return F.lit(t[1])
    if op == "word":
        return F.lit(t[1])
    if op == "size":
        return sizes[t[1]]
    if op == "field":
        if t[1] not in NUMBERS + TEXTS:
            raise ValueError(f"no such field: {t[1]}")
        return F.col(t[1])
    if op == "bound":
        raise ValueError("names are bound in patterns only")
    if op == "not":
        return ~_bool(t[1], sizes)
    if op == "neg":
        return -_col(t[1], sizes)
    a, b = t[1], t[2]
    if op in ("&&", "||"):
        return _bool(a, sizes) & _bool(b, sizes) if op == "&&" else _bool(a, sizes) | _bool(b, sizes)
    if b[0] == "regex":
        hit = F.coalesce(_col(a, sizes).rlike(to_java(b[1])), F.lit(False))
        return hit if op == "==" else ~hit
    x, y = _col(a, sizes), _col(b, sizes)
    if op in ("==", "!=", "<", "<=", ">", ">=") and (_textual(a) or _textual(b)):
        x, y = x.cast("string"), y.cast("string")
    if op in ("/", "%"):
        return F.when(y == 0, 0).otherwise((x / y).cast("long") if op == "/" else x % y)
    return {"==": x.eqNullSafe(y), "!=": ~x.eqNullSafe(y), "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "+": x + y, "-": x - y, "*": x * y}[op]


def function(text: str) -> Callable[[dict, Callable[[str], list[dict]]], object]:
    """The expression as a function of a token (a dict of fields) and of a look-up of bound tokens by name."""
    tree = parse(text)
    return lambda token, names=lambda n: []: _value(tree, token, names)


def _value(t: tuple, token: dict, names):
    op = t[0]
    if op in ("num", "word", "regex"):
        return t[1]
    if op == "field":
        v = token.get(t[1])
        return ("" if t[1] in TEXTS else 0) if v is None else v
    if op == "bound":
        name, _, field = t[1].partition(".")
        found = names(name)
        return found[0].get(field or "txt", 0) if found else ""
    if op == "size":
        return 0
    if op == "not":
        return int(not _value(t[1], token, names))
    if op == "neg":
        return -_value(t[1], token, names)
    a = _value(t[1], token, names)
    if op == "&&":
        return int(bool(a) and bool(_value(t[2], token, names)))
    if op == "||":
        return int(bool(a) or bool(_value(t[2], token, names)))
    b = _value(t[2], token, names)
    if t[2][0] == "regex":
        hit = re.search(to_java(b), str(a)) is not None
        return int(hit if op == "==" else not hit)
    if _textual(t[1]) or _textual(t[2]):
        a, b = str(a), str(b)
    if op in ("/", "%"):
        return 0 if b == 0 else int(a / b) if op == "/" else a - b * int(a / b)
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "+": a + b if op == "+" else 0, "-": a - b if op == "-" else 0, "*": a * b if op == "*" else 0}[op]
