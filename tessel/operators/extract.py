"""Symbols, imports and routes of source files, line by line.

Scopes depend on the lines before, so a file is read in Python, many files at a time; everything after that is columns. Each language is a
table of line patterns; one loop serves all of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EXTRACTED

_STRINGS = re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`")
_CONTROL = frozenset(["if", "for", "while", "switch"])


def brace_end(lines: list[str], start: int) -> int:
    """Last line (from 1) of the block that opens at or after a line (from 0): where its braces balance, or a line with `=>` or a final `;` before any
    brace; the line itself if neither comes."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        bare = _STRINGS.sub("", lines[i])
        for m in re.finditer(r"[{}]", bare):
            depth += 1 if m[0] == "{" else -1
            opened = opened or m[0] == "{"
            if opened and depth <= 0 and m[0] == "}":
                return i + 1
        if not opened and re.search(r"=>|;\s*$", bare):
            return i + 1
    return start + 1


def indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def indent_end(lines: list[str], start: int) -> int:
    """Last line (from 1) before one that is indented no deeper than the line at start; blank lines don't count."""
    deep = indent(lines[start])
    return next((i for i in range(start + 1, len(lines)) if lines[i].strip() and indent(lines[i]) <= deep), len(lines))


@dataclass(frozen=True)
class Rule:
    """A line pattern for a kind of symbol: its first group that matched is the name; params and returns name groups."""

    kind: str | Callable[[str], str]
    pattern: re.Pattern
    names: int = 1
    params: int = 0
    returns: int = 0
    scope: str = ""  # "opens": begins a class; "member": a method inside one; "needs": only inside one
    one_line: bool = False


@dataclass(frozen=True)
class Language:
    kind: str
    end: Callable[[list[str], int], int]
    rules: tuple[Rule, ...]
    imports: re.Pattern
    routes: Callable[[list[str], int], dict | None] = field(default=lambda lines, i: None)
    by_indent: bool = False


def _const_kind(name: str) -> str:
    return "component" if name[0].isupper() else "hook" if name.startswith("use") else "function"


def _go_route(lines: list[str], i: int) -> dict | None:
    if "GoRoute(" not in lines[i]:
        return None
    near = "\n".join(lines[i : i + 10])

    def value(key: str) -> str | None:
        m = re.search(rf"{key}:\s*['\"]([^'\"]+)['\"]", near) or re.search(rf"{key}:\s*([A-Za-z0-9_.]+)", near)
        return m and m[1]

    name, path = value("name"), value("path")
    return {"framework": "flutter_go_router", "method": None, "path": path or name, "name": name} if name or path else None


def _decorator_route(lines: list[str], i: int) -> dict | None:
    m = re.match(r"\s*@(?:router|app)\.(get|post|put|patch|delete)\(\s*[\"']([^\"']+)[\"']", lines[i])
    if not m:
        return None
    handler = re.search(r"(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "\n".join(lines[i + 1 : i + 6]))
    return {"framework": "fastapi", "method": m[1].upper(), "path": m[2], "name": handler and handler[1]}


# The line patterns of each language.
_DART = Language(
    "dart", brace_end,
    (
        Rule("class", re.compile(r"\s*(?:abstract\s+|base\s+|final\s+|sealed\s+)?(?:class|mixin|enum|extension)\s+([A-Za-z_][A-Za-z0-9_]*)"), scope="opens"),
        Rule("function", re.compile(r"\s*(?:[A-Za-z_<>,.?]+\s+)+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^;]*)\)\s*(?:async\s*)?[{=>]"), params=2, scope="member"),
        Rule("provider", re.compile(r".*?\b(?:final|var)\s+([A-Za-z_][A-Za-z0-9_]*Provider)\s*="), one_line=True),
    ),
    re.compile(r"\s*import\s+['\"]([^'\"]+)['\"]"), _go_route,
)
_PYTHON = Language(
    "python", indent_end,
    (
        Rule("class", re.compile(r"\s*class\s+([A-Za-z_][A-Za-z0-9_]*)"), scope="opens"),
        Rule("function", re.compile(r"\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?"), params=2, returns=3, scope="member"),
    ),
    re.compile(r"\s*(?:from\s+([A-Za-z0-9_.]+)\s+import|import\s+([A-Za-z0-9_.]+))"), _decorator_route, True,
)
_SCRIPT = Language(
    "typescript", brace_end,
    (
        Rule("class", re.compile(r"\s*export\s+class\s+([A-Za-z_][A-Za-z0-9_]*)|\s*class\s+([A-Za-z_][A-Za-z0-9_]*)"), names=2, scope="opens"),
        Rule("function", re.compile(r"\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)"), params=2),
        Rule(_const_kind, re.compile(r"\s*(?:export\s+)?const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?\(([^)]*)\)"), params=2),
        Rule("function", re.compile(r"\s*(?:public\s+|private\s+|protected\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)\s*[:{]"), params=2, scope="needs"),
    ),
    re.compile(r"\s*import(?:.+from\s+)?[\"']([^\"']+)[\"']"),
)
LANGUAGES = {"dart": _DART, "python": _PYTHON, "typescript": _SCRIPT, "javascript": _SCRIPT}


def parameters(text: str | None) -> list[str]:
    """Names of a parameter list: what comes before a colon, equals sign or space."""
    found = (re.split(r"[:=\s]", p.strip(), maxsplit=1)[0] for p in (text or "").split(","))
    return [p for p in found if p]


def extract(path: str, language: str, text: str | None) -> dict:
    """symbols, imports and routes of one file; nothing for other languages and null texts."""
    lang = LANGUAGES.get(language)
    symbols, imports, routes = [], [], []
    if not lang or not text:
        return {"symbols": symbols, "imports": imports, "routes": routes}
    lines = re.split(r"\r?\n", text)
    scope: tuple[str, int, int] | None = None  # name, last line, indent
    for i, line in enumerate(lines):
        if scope and (i + 1 > scope[1] or lang.by_indent and line.strip() and indent(line) <= scope[2]):
            scope = None
        for rule in lang.rules:
            m = rule.pattern.match(line)
            name = m and next(g for g in m.groups()[: rule.names] if g)
            if not name or (rule.params and name in _CONTROL) or (rule.scope == "needs" and not scope):
                continue
            end = i + 1 if rule.one_line else lang.end(lines, i)
            if rule.scope == "opens":
                scope = (name, end, indent(line))
            inside = scope[0] if scope and rule.scope in ("member", "needs") else None
            kind = "method" if inside else rule.kind if isinstance(rule.kind, str) else rule.kind(name)
            returns = (m[rule.returns] or "").strip() or None if rule.returns else None
            symbols.append({
                "path": path, "name": name, "kind": kind, "signature": line.strip(), "qualified_name": f"{inside}.{name}" if inside else name, "container_name": inside,
                "parameters": parameters(m[rule.params]) if rule.params else [], "return_type": returns, "visibility": "private" if name[0] == "_" else "public",
                "language_kind": lang.kind, "start_line": i + 1, "end_line": end,
            })
        if m := lang.imports.match(line):
            imports.append(next(g for g in m.groups() if g))
        if route := lang.routes(lines, i):
            route |= {"file_path": path, "symbol_name": route["name"]}
            if route not in routes or lang.by_indent:
                routes.append(route)
    return {"symbols": symbols, "imports": imports, "routes": routes}


def _extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [extract(*row) for row in part[["path", "language", "text"]].itertuples(index=False)]
        yield pd.DataFrame({"path": part["path"], "language": part["language"], "text": part["text"], **{k: [f[k] for f in found] for k in ("symbols", "imports", "routes")}})


def extract_files(files: DataFrame) -> DataFrame:
    """files (path, language, text) with symbols, imports and routes; one pass, no shuffle."""
    return files.select("path", "language", "text").mapInPandas(_extract, f"path string, language string, text string, {EXTRACTED}")


def symbols(extracted: DataFrame, *more: Column | str) -> DataFrame:
    """A row for each symbol; more: columns of its file."""
    return extracted.select(F.explode("symbols").alias("s"), *more).select("s.*", *extracted.select(*more).columns).withColumn("symbol_key", F.concat_ws("::", "path", "qualified_name", "kind", F.col("start_line").cast("string")))


def imports(extracted: DataFrame) -> DataFrame:
    return extracted.select("path", F.explode("imports").alias("import_text"))


def routes(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.explode("routes").alias("r")).select("r.*")
