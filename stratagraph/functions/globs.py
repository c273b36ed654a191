"""Patterns of dotted names and of files, as regular expressions."""

from __future__ import annotations

import re


def dotted_glob(pattern: str) -> str:
    """`*` is one segment, `**` any number, a trailing `.**` includes the package, a leading `**.` floats."""
    if not pattern or any(not s for s in pattern.split(".")):
        raise ValueError(f"not a pattern of dotted names: {pattern!r}")
    parts, out = pattern.split("."), ""
    for k, p in enumerate(parts):
        last, first = k == len(parts) - 1, k == 0
        if p == "**":
            out += r"(?:[^.]+\.)*" if first and not last else r"(?:\.[^.]+)*" if not first else r"[^.]+(?:\.[^.]+)*"
            continue
        sep = "" if first or (k == 1 and parts[0] == "**") else r"\."
        out += sep + r"[^.]*".join(re.escape(x) for x in p.split("*")) if p != "*" else sep + r"[^.]+"
    return f"^{out}$"


def file_glob(pattern: str) -> str:
    """`**` as a whole segment is any number of directories; `*` stays within one, and so does a `**` beside other characters;
    `?` is one character, all else literal."""
    out, segments = "", pattern.split("/")
    for k, part in enumerate(segments):
        last = k == len(segments) - 1
        if part == "**":
            out += ".*" if last else "(?:.*/)?"
            continue
        for c in re.sub(r"\*+", "*", part):
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        out += "" if last else "/"
    return f"^{out}$"


def covers(wider: str, narrower: str) -> bool:
    """Whether each name that narrower matches wider matches too, by segments."""
    a, b = wider.split("."), narrower.split(".")

    def fit(i: int, j: int) -> bool:
        if i == len(a):
            return j == len(b)
        if a[i] == "**":
            return fit(i + 1, j) or (j < len(b) and fit(i, j + 1))
        if j == len(b) or b[j] == "**":
            return False
        return (a[i] == "*" or a[i] == b[j]) and fit(i + 1, j + 1)

    return fit(0, 0)


def roots(patterns: list[str]) -> set[str] | None:
    """First segments of the patterns; None if one floats, which bounds nothing."""
    first = {p.split(".")[0] for p in patterns}
    return None if any("*" in f for f in first) else first
