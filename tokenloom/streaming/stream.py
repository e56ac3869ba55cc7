"""Streams: the text lexer and patterns over Structured Streaming.

A stream has rows (key, text) of successive pieces of text. State by key carries
the line and token numbers, the nesting depths and a margin of the last tokens,
so that a match may cross from one piece into the next. Stateless lexing of
whole rows is the batch lexer itself. Matches are appended as they are found.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.pattern import Machine, parse

MATCH = "key string, set string, from_seq long, upto_seq long, from_lnr int, upto_lnr int, text string"
TOKEN = "key string, seq long, lnr int, txt string, curly int, round int, bracket int"
_STATE = "state string"
_WORD = re.compile(r"[A-Za-z0-9_]+|[^ \t\r\n\f\x0bA-Za-z0-9_]|\n")


def streamable(pattern: str) -> None:
    """Refuse what a window of tokens can't decide: references back beyond the margin."""
    if re.search(r"\.(jmp|prv)\b", pattern):
        raise ValueError("a stream can't follow .jmp or .prv")


def _advance(state: dict, text: str, last: bool) -> list[dict]:
    """Tokens of the next piece. A word that ends a piece may go on in the next: it waits."""
    text = state["rest"] + text
    state["rest"] = ""
    if not last and (m := re.search(r"[A-Za-z0-9_]+\Z", text)):
        state["rest"], text = m[0], text[: m.start()]
    out, d = [], state["depth"]
    for m in _WORD.finditer(text):
        t = m[0]
        if t == "\n":
            state["lnr"] += 1
            continue
        k = {"}": 0, ")": 1, "]": 2}.get(t)
        if k is not None:
            d[k] = max(0, d[k] - 1)
        out.append({"seq": state["seq"], "lnr": state["lnr"], "txt": t, "typ": "", "curly": d[0], "round": d[1], "bracket": d[2], "mark": 0, "len": len(t), "fct": "", "fnm": "", "range": 0})
        k = {"{": 0, "(": 1, "[": 2}.get(t)
        if k is not None:
            d[k] += 1
        state["seq"] += 1
    return out


def _fresh() -> dict:
    return {"seq": 0, "lnr": 1, "depth": [0, 0, 0], "rest": "", "margin": [], "from": 0}


def _load(state: GroupState) -> dict:
    return json.loads(state.get[0]) if state.exists else _fresh()


def tokens(stream: DataFrame) -> DataFrame:
    """Tokens with numbers, lines and depths that go on from piece to piece of a key. Columns in: key, ord, text."""

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = _load(state)
        rows = []
        for p in pd.concat(list(pieces)).sort_values("ord").itertuples():
            rows += [(key[0], t["seq"], t["lnr"], t["txt"], t["curly"], t["round"], t["bracket"]) for t in _advance(s, p.text or "", False)]
        state.update((json.dumps(s),))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOKEN.split(", ")])

    return stream.groupBy("key").applyInPandasWithState(step, TOKEN, _STATE, "append", GroupStateTimeout.NoTimeout)


def matches(stream: DataFrame, patterns: dict[str, str], margin: int = 100) -> DataFrame:
    """Matches of text patterns, each reported once; one may span at most ``margin`` tokens.

    A start token is decided when ``margin`` tokens after it have come; tokens before that are dropped.
    """
    for p in patterns.values():
        streamable(p)
    machines = {n: Machine(parse(p)) for n, p in patterns.items()}

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = _load(state)
        rows = []
        for p in pd.concat(list(pieces)).sort_values("ord").itertuples():
            s["margin"] += _advance(s, p.text or "", False)
        held = s["margin"]
        for name, m in machines.items():
            done = {*s.setdefault("done", {}).get(name, [])}
            for a, b, _ in m.find(held, iter(range(len(held))), [None] * len(held)):
                if held[a]["seq"] not in done:
                    rows.append((key[0], name, held[a]["seq"], held[b]["seq"], held[a]["lnr"], held[b]["lnr"], " ".join(t["txt"] for t in held[a : b + 1])))
                    done.add(held[a]["seq"])
            least = held[-margin]["seq"] if len(held) > margin else 0
            s["done"][name] = sorted(x for x in done if x >= least)
        s["margin"] = held[-margin:]
        state.update((json.dumps(s),))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in MATCH.split(", ")])

    return stream.groupBy("key").applyInPandasWithState(step, MATCH, _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None, key: str = "event_type") -> DataFrame:
    """Counts by key and event-time window, with a watermark; the same on a batch."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Event counts by user and session window."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
