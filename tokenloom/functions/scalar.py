"""The string and number functions of inline programs, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ere import to_java


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def strlen(s) -> Column:
    """Bytes of the text."""
    return F.octet_length(_c(s))


def substr(s, at, n) -> Column:
    """n characters from the 0-based place ``at``; empty beyond the end."""
    return F.when(_c(at) >= F.length(_c(s)), "").otherwise(F.substring(_c(s), _c(at) + 1, _c(n)))


def strstr(s, t) -> Column:
    """1-based first place of t, 0 if there is none."""
    return F.instr(_c(s), t)


def strrstr(s, t: str) -> Column:
    """1-based last place of t, 0 if there is none."""
    back = F.locate(t[::-1], F.reverse(_c(s)))
    return F.when(back == 0, 0).otherwise(F.length(_c(s)) - back - len(t) + 2)


def strcmp(a, b) -> Column:
    return F.when(_c(a) < _c(b), -1).when(_c(a) > _c(b), 1).otherwise(0)


def gsub(old, new, s) -> Column:
    return F.replace(_c(s), _c(old), _c(new))


def split(s, sep: str = ",") -> Column:
    """Fields between a one-character separator; an empty last one is dropped."""
    parts = F.split(_c(s), r"\Q" + sep[:1] + r"\E")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def atoi(s) -> Column:
    """The leading integer, 0 if there is none."""
    return F.coalesce(F.regexp_extract(_c(s), r"^\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0))


def toint(s) -> Column:
    return F.coalesce(F.round(F.regexp_extract(_c(s), r"^\s*([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double")).cast("long"), F.lit(0))


def tofloat(s) -> Column:
    return F.format_string("%f", F.coalesce(_c(s).try_cast("double"), F.lit(0.0)))


def tostr(x) -> Column:
    """Integers bare, other numbers with two decimals."""
    v = _c(x).cast("double")
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string("%.2f", v))


def count_of(s, t: str) -> Column:
    """How often t occurs in s, overlaps included."""
    n = len(t)
    return F.when(F.length(_c(s)) < n, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(_c(s)) - n + 1)), lambda i: F.substring(_c(s), i, F.lit(n)) == t)))


def match(s, p: str, typ=None) -> Column:
    """``/re``: search; ``@type``: type equality; else text equality."""
    if p.startswith("/"):
        return _c(s).rlike(to_java(p[1:]))
    if p.startswith("@"):
        return type_is(typ, p[1:])
    return _c(s) == p


def type_is(typ, name: str) -> Column:
    return _c(typ).startswith("const") if name == "const" else _c(typ) == name


def hashed(s) -> Column:
    return F.xxhash64(_c(s))


def hash_array(a, upto) -> Column:
    """Hash of the first ``upto`` + 1 elements together."""
    return F.xxhash64(F.array_join(F.slice(_c(a), 1, _c(upto) + 1), " "))


def disambiguate(s) -> Column:
    """Texts that are easily taken for one another become equal."""
    return F.lower(F.translate(F.regexp_replace(_c(s), "rn", "m"), "OoIlSZB_", "0011528"))


def safe_div(a, b) -> Column:
    """Integer quotient; 0 if b is."""
    return F.when(_c(b) == 0, 0).otherwise((_c(a) / _c(b)).cast("long"))


def safe_mod(a, b) -> Column:
    return F.when(_c(b) == 0, 0).otherwise(_c(a) % _c(b))


def power(a, b) -> Column:
    return F.pow(_c(a), _c(b))


def add(a, b, text: bool = False) -> Column:
    """A sum, or of texts their concatenation: the left operand decides."""
    return F.concat(_c(a).cast("string"), _c(b).cast("string")) if text else _c(a).cast("double") + _c(b).cast("double")


def equal(a, b) -> Column:
    """Equality across kinds: a numeric text equals its number."""
    x, y = _c(a).cast("string"), _c(b).cast("string")
    return F.coalesce(F.when(x.try_cast("double").isNotNull() & y.try_cast("double").isNotNull(), x.try_cast("double") == y.try_cast("double")).otherwise(x == y), F.lit(False))


def bits(a, op: str, b=None) -> Column:
    """``|``, ``&``, ``^``, ``<<``, ``>>`` of two whole numbers, ``~`` of one; other numbers lose their fraction first."""
    x = _c(a).cast("long")
    if op == "~":
        return F.bitwise_not(x)
    y = _c(b).cast("long")
    if op in ("<<", ">>"):
        return F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int"))
    return {"|": x.bitwiseOR, "&": x.bitwiseAND, "^": x.bitwiseXOR}[op](y)
