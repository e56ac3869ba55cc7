"""Operator 9: personal data and secrets by weak supervision.

A wide pattern proposes spans (anything like an address, a dotted or grouped
number, or a long token with a digit, wherever that stands). Six labelers, regular
expressions, gazetteers, checksums and context rules, vote on each: yes, no or no
opinion; context is the 40 characters before a span and the 10 behind it.
Expectation-maximisation (Dawid and Skene) over the counts of all vote patterns
of the corpus estimates how reliable each labeler is, apart for each kind of
span, and how likely each pattern is to be right. These probabilities train a
logistic span classifier on features of the span and its surroundings, which
decides. The classifier is fit on at most ``sample`` spans of each vote pattern;
the votes are counted over all documents.

Nulls: rows without an id or text take no part. Empty texts have no spans; very
long ones are read whole. Repeated rows each give their spans, which are then
the same rows and returned once. Ties: overlapping proposals go to the leftmost,
then the first kind in ``KINDS``. Empty tables, and tables without any proposal,
give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DBL, INT, LONG, STR, materialize, schema, texts

KINDS = ("email", "secret", "iban", "ip", "ssn", "phone", "card")
_PROPOSE = re.compile(
    r"""(?P<email>[^\s@"'<>(),;:]+@[^\s@"'<>(),;:]+)
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<secret>(?<![A-Za-z0-9])[A-Za-z0-9_+/-]{20,}(?![A-Za-z0-9]))
    |(?P<ip>(?<![\d.])\d{1,4}(?:\.\d{1,4})+(?![\d.]*\d)|(?<![\w:.])(?=:{0,2}[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))
    |(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    |(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d[\d .-]{4,13}\d(?!\d)|\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}|(?<!\d)\d{3}[.-]\d{3}[.-]\d{4}(?!\d))
    |(?P<card>(?<!\d)\d{4}(?:[ -]?\d{2,6}){2,4}(?!\.?\d)|(?<![\d.])\d{1,12}(?![\d.]))""",
    re.X,
)
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    "secret": re.compile(r"[0-9a-fA-F]{32,}|(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abpr]-|sk-|glpat-|npm_)[\w-]{12,}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f:]*::[0-9A-Fa-f:]*"),
    "ssn": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}[A-Z0-9 ]{11,36}"),
    "phone": re.compile(r"\+?\d{0,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"),
    "card": re.compile(r"\d{13,19}|(?:\d{4}[ -]){3}\d{1,7}"),
}
#: Top-level domains of general use and of the larger countries.
_TLDS = {*"com org net edu gov mil int info biz io ai app dev co me tv cloud tech online site xyz eu uk de fr es it nl be lu ch at pl cz sk hu ro bg gr pt ie dk se no fi is ee lv lt ru ua tr il sa ae ir in pk bd lk cn hk tw jp kr sg my th vn id ph au nz za ng ke eg ma dz us ca mx br ar cl pe ve uy".split()}
#: Country codes of telephone numbers, and of bank accounts with their length.
_DIAL = {*"1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 358 370 371 372 375 380 381 385 386 420 421 852 880 886 961 962 965 966 971 972 974".split()}
_IBAN = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "GB": 22, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25, "IE": 22, "LU": 20, "PL": 28, "CZ": 24, "SK": 24, "HU": 28, "RO": 24, "BG": 22, "GR": 27, "DK": 18, "SE": 24, "NO": 15, "FI": 18, "EE": 20, "LV": 21, "LT": 20, "SI": 19, "HR": 21, "TR": 26, "SA": 24, "AE": 23, "IL": 23}
#: How keys of well-known issuers begin.
_ISSUED = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abpr]-|sk-|glpat-|npm_)[\w-]{12,}")
_KEYS = re.compile(r"(?:token|secret|api[_-]?key|password|passwd|pwd|bearer|credential)s?\s*[=:]\s*[\"']?$", re.I)
_CUES = {
    "email": re.compile(r"(?:e-?mail|contact|write|mailto)\W*$", re.I),
    "ip": re.compile(r"(?:\bip|address|host|server|from)\W*$", re.I),
    "ssn": re.compile(r"(?:\bssn|social security(?: number)?)\W*$", re.I),
    "iban": re.compile(r"(?:\biban|account)\W*$", re.I),
    "phone": re.compile(r"(?:phone|tel|call|mobile|fax)\W*$", re.I),
    "card": re.compile(r"(?:card|visa|account|number)\W*$", re.I),
}
_AGAINST = re.compile(r"(?:version|release|licen[sc]ed?|section|chapter|figure|table|page|\bv)\W*$", re.I)
LABELERS = 6


def _luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _mod97(span: str) -> bool:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _address(span: str) -> bool:
    try:
        return bool(ipaddress.ip_address(span))
    except ValueError:
        return False


def _bare(s: str, kind: str) -> str:
    return s.rstrip("*#$%&!|.,") if kind == "email" else s


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """1 yes, -1 no, 0 no opinion: strict form, gazetteer, context, length, plausibility, checksum."""
    digits = sum(c.isdigit() for c in span)
    strict = 1 if _STRICT[kind].fullmatch(span) else -1
    check = 0
    if kind == "email":
        gazetteer = 1 if span.rpartition(".")[2].lower() in _TLDS else -1
        plausible = 1 if "." in span.partition("@")[2] else -1
    elif kind == "ip":
        gazetteer = -1 if span.count(".") + span.count(":") < 2 else 0
        plausible = 1 if _address(span) else -1
    elif kind == "ssn":
        gazetteer, plausible = 0, 1 if len({*span}) > 3 else -1
    elif kind == "iban":
        bare = span.replace(" ", "")
        gazetteer = 1 if bare[:2] in _IBAN else -1
        plausible = 1 if len(bare) == _IBAN.get(bare[:2], len(bare)) else -1
        check = 1 if _mod97(span) else -1
    elif kind == "phone":
        code = re.match(r"\+(\d{1,3})", span)
        gazetteer = 0 if not code else 1 if code[1] in _DIAL or code[1][:2] in _DIAL or code[1][:1] in _DIAL else -1
        plausible = 1 if 7 <= digits <= 15 else -1
    elif kind == "card":
        gazetteer = 0 if digits < 13 else 1 if span[0] in "23456" else 0
        plausible = 1 if 13 <= digits <= 19 else -1
        check = 0 if digits < 13 else 1 if _luhn("".join(c for c in span if c.isdigit())) else -1
    else:
        letters = sum(c.isalpha() for c in span)
        gazetteer = 1 if _ISSUED.fullmatch(span) or _KEYS.search(before) else 0
        plausible = 1 if digits >= 4 and letters >= 2 and len({*span.lower()}) >= 8 else -1
    cue = _CUES.get(kind)
    context = -1 if _AGAINST.search(before) else 1 if (kind == "secret" and _KEYS.search(before)) or (cue and cue.search(before)) else 0
    least = {"email": 8, "secret": 20, "ip": 7, "phone": 10, "card": 13, "ssn": 11, "iban": 15}[kind]
    return strict, gazetteer, context, 1 if len(span) >= least else -1, plausible, check


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    n = len(span)
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    return [
        *(1.0 if kind == k else 0.0 for k in KINDS),
        min(n, 60) / 60, digits / n, letters / n, min(digits, 20) / 20, len({*span.lower()}) / n,
        min(span.count("."), 4) / 4, float("@" in span), min(span.count("-"), 3) / 3, float(span[0] == "+"), float("(" in span),
        *(1.0 if low <= n < high else 0.0 for low, high in ((0, 4), (4, 8), (8, 13), (13, 20), (20, 1 << 30))),
        float(votes(kind, span, before, after)[5] == 1), float(after[:1] in ('"', "'")), float(before[-1:] in ('"', "'")), float(bool(_AGAINST.search(before))), float(bool(_KEYS.search(before))),
    ]


def propose(text: str) -> Iterator[tuple[int, int, str, tuple[int, ...], list[float]]]:
    for m in _PROPOSE.finditer(text):
        kind = m.lastgroup
        span = _bare(m[0], kind)
        if not span or (kind == "email" and not span.partition("@")[2]) or (kind == "secret" and not any(c.isdigit() for c in span)):
            continue
        before, after = text[max(0, m.start() - 40) : m.start()], text[m.start() + len(span) : m.start() + len(span) + 10]
        yield m.start(), m.start() + len(span), kind, votes(kind, span, before, after), features(kind, span, before, after)


def _spans(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "end", "kind", "votes", "features"]
    for b in it:
        rows = [(d, a, e, k, ",".join(map(str, v)), f) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for a, e, k, v, f in propose(t)]
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def expectation(patterns: np.ndarray, counts: np.ndarray, groups: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dawid-Skene for yes/no/abstain votes: P(true) of each pattern, prior and reliability by group.

    Reliabilities are [group, class, labeler, vote + 1], with one pseudo-count a cell.
    """
    g = groups.max(initial=-1) + 1
    p = np.clip(0.5 + 0.2 * patterns.sum(1), 0.05, 0.95)  # majority to begin with
    prior, rel = np.zeros(g), np.zeros((g, 2, LABELERS, 3))
    for _ in range(rounds):
        old = p
        prior, rel = np.zeros(g), np.zeros((g, 2, LABELERS, 3))
        for k in range(g):
            on = groups == k
            w = np.stack([(1 - p[on]) * counts[on], p[on] * counts[on]])
            prior[k] = (w[1].sum() + 1) / (w.sum() + 2)
            for y in (0, 1):
                for j in range(LABELERS):
                    # better than chance beforehand, so that classes can't swap
                    start = np.array([1.0, 1.0, 3.0]) if y else np.array([3.0, 1.0, 1.0])
                    rel[k, y, j] = (np.bincount(patterns[on, j] + 1, w[y], 3) + start) / (w[y].sum() + 5)
        odds = np.log(prior[groups]) - np.log(1 - prior[groups])
        for j in range(LABELERS):
            odds += np.log(rel[groups, 1, j, patterns[:, j] + 1]) - np.log(rel[groups, 0, j, patterns[:, j] + 1])
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if len(p) == 0 or np.abs(p - old).max() < 1e-9:
            break
    return p, prior, rel


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600) -> np.ndarray:
    """Logistic regression on soft labels, by Adam; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    weight = weight / weight.sum()
    for s in range(1, steps + 1):
        g = x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - y) * weight) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.999**s)) + 1e-9)
    return w


def find(docs: DataFrame, sample: int = 50, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, kind, probability) of the spans that are personal or secret, in characters."""
    spark = docs.sparkSession
    kind = schema(doc_id=LONG, start=INT, end=INT, kind=STR, votes=STR, features=T.ArrayType(DBL))
    rows = texts(docs).where(F.col("text").rlike("[0-9@]"))  # every proposal has one
    spans = materialize(rows.mapInArrow(_spans, kind).distinct(), "spans")
    counts = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most 7 x 3**6 rows
    out = schema(doc_id=LONG, start=INT, end=INT, kind=STR, probability=DBL)
    if not counts:
        return spark.createDataFrame([], out)
    counts.sort(key=lambda r: (r.kind, r.votes))
    patterns = np.array([[int(v) for v in r.votes.split(",")] for r in counts])
    groups = np.array([KINDS.index(r.kind) for r in counts])
    groups = np.unique(groups, return_inverse=True)[1]
    p, _, _ = expectation(patterns, np.array([r.n for r in counts], float), groups)
    soft = {(r.kind, r.votes): (float(q), r.n) for r, q in zip(counts, p, strict=True)}
    order = F.xxhash64("doc_id", "start", "end")
    few = _least(spans, sample, order)
    x, y, w = [], [], []
    for r in few:
        q, n = soft[r.kind, r.votes]
        x.append(r.features)
        y.append(q)
        w.append(n / min(n, sample))
    weights = [float(v) for v in fit(np.array(x), np.array(y), np.array(w))]
    logit = F.aggregate(F.zip_with("features", F.array(*[F.lit(v) for v in weights[:-1]]), lambda a, b: a * b), F.lit(weights[-1]), lambda s, v: s + v)
    return spans.withColumn("probability", 1 / (1 + F.exp(-logit))).where(F.col("probability") >= least).select(*out.names)


def _least(spans: DataFrame, sample: int, order) -> list:
    """The spans of the least hashes of each vote pattern, at most ``sample``."""
    w = Window.partitionBy("kind", "votes").orderBy("h", "doc_id", "start")
    got = spans.withColumn("h", order).withColumn("k", F.row_number().over(w)).where(F.col("k") <= sample)
    return sorted(got.select("kind", "votes", "h", "features").collect(), key=lambda r: (r.kind, r.votes, r.h))


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("probability", F.round("probability", 4))
