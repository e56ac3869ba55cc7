"""POSIX extended regular expressions, as Java and Python read them.

In a bracket expression a backslash is an ordinary character and ``[:alpha:]``
a class; Java would read the latter as a nested class.
"""

from __future__ import annotations

import re

_CLASSES = {
    "alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r" \t\n\r\f\x0b", "blank": r" \t",
    "punct": r"!-/:-@\[-`{-~", "print": " -~", "graph": "!-~", "cntrl": r"\x00-\x1f\x7f", "xdigit": "0-9A-Fa-f",
}


def to_java(ere: str) -> str:
    """The same expression for Java's (and Python's) engine."""
    out, i = [], 0
    while i < len(ere):
        c = ere[i]
        if c == "\\" and i + 1 < len(ere):
            out.append(re.escape(ere[i + 1]) if not ere[i + 1].isalnum() else ere[i + 1])
            i += 2
            continue
        if c != "[":
            out.append(c)
            i += 1
            continue
        j = i + 1
        out.append("[")
        if j < len(ere) and ere[j] == "^":
            out.append("^")
            j += 1
        first = True
        while j < len(ere) and (first or ere[j] != "]"):
            if m := re.match(r"\[:(\w+):\]", ere[j:]):
                out.append(_CLASSES[m[1]])
                j += len(m[0])
            else:
                out.append("\\" + ere[j] if ere[j] in "\\[]&^~" and not (ere[j] == "-") else ere[j])
                j += 1
            first = False
        out.append("]")
        i = j + 1
    return "".join(out)
