"""Glob patterns compiled to one regular expression each, on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, optional_prefix: bool = True) -> str:
    """`**` is anything, `*` anything but a slash, `?` one character but a slash. With optional_prefix a leading `**/` may be empty."""
    out, rest = "", pattern
    if optional_prefix and rest.startswith("**/"):
        out, rest = "(?:.*/)?", rest[3:]
    for part in re.split(r"(\*\*|\*|\?)", rest):
        out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str], optional_prefix: bool = True) -> Column:
    if not patterns:
        return F.lit(False)
    return path.rlike("|".join(glob_regex(p, optional_prefix) for p in patterns))


def contains_text(text: Column, part: str) -> Column:
    """Whether text holds part, A-Z like a-z and all else as it is: a LIKE '%part%' whose part has no wild cards."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low(text).contains(low(F.lit(part)))


def like_text(text: Column, pattern: str) -> Column:
    """LIKE with % and _ and a backslash before either for itself, A-Z like a-z."""
    out, rest = "", iter(pattern)
    for ch in rest:
        out += {"%": "(?s:.*)", "_": "(?s:.)"}.get(ch) or re.escape(next(rest, "\\") if ch == "\\" else ch)
    return text.rlike(f"(?i)^{out}$")


def gitignore_patterns(text: str) -> list[str]:
    """Glob patterns of a .gitignore: comments and negations are left out, `dir/` means all below, a bare name is matched anywhere."""
    lines = (line.strip() for line in text.splitlines())
    kept = [line for line in lines if line and line[0] not in "#!"]
    return [f"{p}**" if p.endswith("/") else p if "/" in p else f"**/{p}" for p in kept]
