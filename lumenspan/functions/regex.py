"""Patterns: lens patterns are written for a linear-time engine with ASCII classes; here they are put into Java's dialect."""

from __future__ import annotations

import re

_WORD = "0-9A-Za-z_"
_OUTSIDE = {"b": f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))", "B": f"(?:(?<![{_WORD}])(?![{_WORD}])|(?<=[{_WORD}])(?=[{_WORD}]))", "s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]"}
_INSIDE = {"s": r"\t\n\f\r "}
# What * stands for in a sink glob, and what is escaped.
GLOB_RUN = "[A-Za-z0-9_.$]*"
GLOB_ESCAPED = "+()[]{}^$|?\\"


def to_java(pattern: str) -> str:
    r"""ASCII \b and \s, $ as the end of the text alone, \n as the only line end; case folding of non-ASCII letters too."""
    out, i, in_class = [], 0, False
    flags = "d"
    if m := re.match(r"\(\?([a-z]+)\)", pattern):
        flags += m[1] + ("u" if "i" in m[1] else "")
        i = m.end()
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            out.append((_INSIDE if in_class else _OUTSIDE).get(n, c + n))
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            if pattern[i + 1 : i + 2] == "^":
                out.append("[^")
                i += 2
                if pattern[i : i + 1] == "]":
                    out.append("\\]")
                    i += 1
                continue
            if pattern[i + 1 : i + 2] == "]":
                out.append("[\\]")
                i += 2
                continue
        elif c == "]" and in_class:
            in_class = False
        elif in_class and c in "[&":  # Java gives them a meaning inside a class
            c = "\\" + c
        elif c == "$" and not in_class and "m" not in flags:
            c = r"\z"
        out.append(c)
        i += 1
    return f"(?{flags})" + "".join(out)


def glob_to_regex(glob: str) -> str:
    """A sink glob such as *kafka*.send as a pattern: * is a run of identifier characters and dots, the rest stands for itself."""
    return "".join(GLOB_RUN if c == "*" else "\\." if c == "." else "\\" + c if c in GLOB_ESCAPED else c for c in glob)


def word(name: str) -> str:
    return r"\b" + re.escape(name) + r"\b"


def bounded(word: str) -> str:
    """A word between characters that are no word characters, in a form that engines without look-around share."""
    return f"(^|[^{_WORD}]){word}([^{_WORD}]|$)"
