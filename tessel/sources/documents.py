"""Planning documents in Markdown, guard logs, suites, configuration and manifests."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOCUMENT_STEP, DOCUMENT_TARGET

# Folders that begin a path in prose, and words that decide what a line is.
PATH = r"((?:\./)?(?:frontend|backend|scripts|src|docs|develop|tests|test|shared|database|\.github)/[^\s:`'\")]+)"
COMMAND_START = r"^(make|npm|pnpm|yarn|python|python3|pytest|bash|sh|flutter|dart|cd)\b"
MOST_BYTES = 600_000
SIGNS = r"(?i)sync_targets|depends_on|validation|owner_domain|authority|must update|target"
_LISTS = ("depends_on", "sync_targets", "validation")
_KINDS = (("sync_target", r"sync|同步|must update|必须同步|目标文件|target", 0.62, "heading_action_item"), ("validation_target", r"validation|validate|验收|guard|校验|命令", 0.55, "body_path_mention"), ("depends_on", r"depends|依赖|相关", 0.5, "body_path_mention"))
_SUPPRESSED = re.compile(r"(^|/)(screenshots?|golden|snapshots?)(/|$)|\.(png|jpe?g|lock)$")


@dataclass
class Front:
    """Keys of a frontmatter block."""

    scalars: dict[str, str] = field(default_factory=dict)
    lists: dict[str, list[str]] = field(default_factory=lambda: {k: [] for k in _LISTS})


def _scalar(text: str) -> str:
    return text.strip().strip("\"'")


def frontmatter(text: str) -> tuple[Front, str]:
    """The block between `---` lines at the start, and the rest. Scalars, inline lists, and block lists of the three list keys are read."""
    m = re.match(r"\A---\r?\n(.*?)\r?\n---\r?\n?", text, re.S)
    front = Front()
    if not m:
        return front, text
    key = ""
    for line in m[1].splitlines():
        if item := re.match(r"\s*-\s+(.+)$", line):
            if key in front.lists:
                front.lists[key].append(_scalar(item[1]))
        elif pair := re.match(r"([A-Za-z_][A-Za-z0-9_-]*):\s*(.*)$", line):
            key, value = pair[1], pair[2].strip()
            if value.startswith("[") and value.endswith("]"):
                values = [_scalar(v) for v in value[1:-1].split(",") if v.strip()]
                front.lists[key] = values
            elif value and key in front.lists:
                front.lists[key] = [_scalar(value)]
            elif value:
                front.scalars[key] = _scalar(value)
    return front, text[m.end() :]


def find_path(text: str) -> str | None:
    m = re.search(PATH, text)
    return posixpath.normpath(re.sub(r"^(\./)+", "", m[1])) if m else None


def _resolve(doc: str, value: str) -> str:
    """A target as a path from the root: such already if it begins with a known folder, else beside the document."""
    return find_path(value) if re.match(PATH, value) else posixpath.normpath(posixpath.join(posixpath.dirname(doc), value))


def _is_command(text: str) -> bool:
    return re.match(COMMAND_START, text) is not None


def _command_kind(command: str) -> str:
    return "guard" if re.search("guard|lint|check|analyze", command) else "test" if re.search("test|vitest|pytest", command) else "step"


def _targets(doc: str, front: Front, body: str) -> list[dict]:
    row = lambda kind, path, c, raw, tier: {"path": doc, "kind": kind, "target_path": path, "confidence": c, "raw_value": raw, "evidence_tier": tier}
    out = [row("sync_target", _resolve(doc, v), 0.95, v, "frontmatter_sync") for v in front.lists["sync_targets"]]
    out += [row("depends_on", _resolve(doc, v), 0.75, v, "frontmatter_depends") for v in front.lists["depends_on"]]
    out += [row("validation_target", find_path(v) or v, 0.85, v, "frontmatter_validation") for v in front.lists["validation"] if find_path(v)]
    heading = ""
    for line in map(str.strip, body.splitlines()):
        if m := re.match(r"#{2,4}\s+(.+)$", line):
            heading = m[1]
            continue
        path = find_path(line)
        context = f"{heading} {line}".lower()
        hit = path and next(((k, c, t) for k, words, c, t in _KINDS if re.search(words, context)), None)
        if hit:
            kind, c, tier = hit
            where = path if kind == "validation_target" else _resolve(doc, path)
            out.append(row(kind, where, 0.25 if kind == "validation_target" and _SUPPRESSED.search(path) else c, line, tier))
    seen: dict[tuple, dict] = {}
    for t in out:
        seen.setdefault((t["kind"], t["target_path"]), t)
    return list(seen.values())


def _steps(doc: str, front: Front, body: str) -> list[dict]:
    out: list[dict] = []

    def add(phase: str | None, raw: str, command: str | None, c: float = 0.7) -> None:
        out.append({"path": doc, "phase": phase, "ordinal": len(out) + 1, "title": None if command else raw[:120], "command": command, "target_path": find_path(command or raw), "category": _command_kind(command) if command else "step", "raw_text": raw, "confidence": c})

    phase, fence = None, None
    for line in map(str.strip, body.splitlines()):
        if m := re.match(r"#{2,4}\s+(.+)$", line):
            phase = m[1]
        elif m := re.match(r"```([A-Za-z0-9_-]*)", line):
            fence = m[1] if fence is None else None
        elif fence is not None:
            command = re.sub(r"^\$\s*", "", line)
            if command and (fence in ("bash", "sh") or _is_command(line)):
                add(phase, command, command)
        elif (m := re.match(r"[-*]\s+(.+)$", line)) and (phase or _is_command(m[1]) or "`" in m[1]):
            text = m[1].strip()
            inline = next((x.strip() for x in re.findall(r"`([^`]+)`", text) if _is_command(x.strip()) or x.strip().startswith("scripts/")), None)
            add(phase, text, inline or (text if _is_command(text) else None))
    for command in front.lists["validation"]:
        add("frontmatter validation", command, command, 0.95)
    return out


def analyze(path: str, text: str) -> dict:
    """Title, owner, mode, confidence, summary, targets and steps of one document."""
    front, body = frontmatter(text)
    targets = _targets(path, front, body)
    from_front = any(front.lists[k] for k in _LISTS)
    from_body = any(t["evidence_tier"] in ("heading_action_item", "body_path_mention") for t in targets)
    mode = "mixed" if from_front and from_body else "frontmatter" if from_front else "inferred"
    title = re.search(r"(?m)^#\s+(.+)$", body)
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", body) if p.strip() and not p.lstrip().startswith(("#", "```", "-", "*"))]
    return {"path": path, "title": title and title[1].strip(), "owner_domain": front.scalars.get("owner_domain"), "authority": front.scalars.get("authority"), "parse_mode": mode, "confidence": {"frontmatter": 1.0, "mixed": 0.85, "inferred": 0.55}[mode], "summary": paragraphs[0][:500] if paragraphs else None, "targets": targets, "steps": _steps(path, front, body)}


def _analyze(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([analyze(*r) for r in part[["path", "text"]].itertuples(index=False)], columns=["path", "title", "owner_domain", "authority", "parse_mode", "confidence", "summary", "targets", "steps"])


def _struct(ddl: str) -> str:
    return re.sub(r"(\w+) ([a-z<>]+)", r"\1:\2", ddl).lower()


def source_documents(files: DataFrame) -> DataFrame:
    """Markdown files with signs of a plan that have targets or steps, analysed; lines of a document are read in order, in Python, in one pass."""
    chosen = files.filter((F.col("language") == "markdown") & (F.col("size") <= MOST_BYTES) & (F.col("text").startswith("---") | F.col("text").rlike(SIGNS)))
    ddl = f"path string, title string, owner_domain string, authority string, parse_mode string, confidence double, summary string, targets array<struct<{_struct(DOCUMENT_TARGET)}>>, steps array<struct<{_struct(DOCUMENT_STEP)}>>"
    return chosen.select("path", "text").mapInPandas(_analyze, ddl).filter("size(targets) + size(steps) > 0")


def guard_findings(lines: Column, rule: Column | str | None = None) -> Column:
    """A struct of file, line, column, rule, message and confidence for a log line; null where it names no path."""
    at = PATH + r":([0-9]+)(?::([0-9]+))?"
    number = lambda i: F.nullif(F.regexp_extract(lines, at, i), F.lit("")).cast("int")
    direct, loose = F.regexp_extract(lines, at, 1), F.regexp_extract(lines, PATH, 1)
    file = F.regexp_replace(F.when(direct != "", direct).otherwise(loose), r"^(\./)+", "")
    name = rule if isinstance(rule, Column) else F.lit(rule).cast("string")
    message = F.substring(F.trim(F.regexp_replace(lines, r"\s+", " ")), 1, 500)
    return F.when(loose != "", F.struct(file.alias("file"), number(2).alias("line"), number(3).alias("column"), name.alias("rule"), message.alias("message"), F.when(direct != "", 0.95).otherwise(0.75).alias("confidence")))


def guard_rule_name(output: str, command: str = "") -> str | None:
    if m := re.search(r"\[([A-Za-z0-9_-]+)\]", output):
        return m[1]
    m = re.search(r"(?:check|run)_([A-Za-z0-9_ -]+?)(?:\.py|\.sh|\s|$)", f"{command}\n{output}")
    return m[1].replace("-", "_") if m else None


def parse_guard_output(spark: SparkSession, output: str, command: str = "") -> DataFrame:
    raw = spark.createDataFrame([(i, x) for i, x in enumerate(output.splitlines())], "i int, text string")
    found = raw.select(guard_findings(F.col("text"), guard_rule_name(output, command)).alias("f")).filter("f IS NOT NULL")
    return found.select("f.*").dropDuplicates(["file", "line", "column", "message"])


def suite(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation suite or mutation suite: a JSON file with `cases` or `mutations`."""
    raw = spark.read.text(path, wholetext=True).first()[0]
    data = json.loads(raw)
    rows = data.get("cases") or data.get("mutations") or []
    return spark.createDataFrame([(str(r.get("id")), json.dumps(r)) for r in rows], "id string, body string")


#: What a mutation may do.
MUTATIONS = ("add", "change", "delete", "rename")


def mutation_rows(spark: SparkSession, suites: list[dict]) -> DataFrame:
    """suite, place, kind, path, text and to of mutation suites ({id, mutations: [{kind, path, text or to}]}); another kind is an error."""
    rows = [(str(s["id"]), i, m["kind"], m["path"], m.get("text"), m.get("to")) for s in suites for i, m in enumerate(s["mutations"])]
    if wrong := sorted({r[2] for r in rows} - set(MUTATIONS)):
        raise ValueError(f"no such mutation: {', '.join(wrong)}")
    return spark.createDataFrame(rows, "suite string, place int, kind string, path string, text string, to string")


def mutation_suite(spark: SparkSession, path: str) -> DataFrame:
    """mutation_rows() of a JSON file with a list of suites under `mutations`."""
    return mutation_rows(spark, [json.loads(r["body"]) for r in suite(spark, path).collect()])  # as long as the file


@dataclass
class Config:
    """Settings of a repository; unknown keys are ignored, snake case is understood."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    respect_gitignore: bool = False
    domains: list[dict] = field(default_factory=list)
    domain_gates: list[dict] = field(default_factory=list)
    source_path_boosts: list[dict] = field(default_factory=list)
    most_must_read: int = 5

    @classmethod
    def of(cls, data: dict) -> Config:
        snake = {re.sub(r"(?<=[a-z])([A-Z])", r"_\1", k).lower(): v for k, v in data.items()}
        return cls(**{k: v for k, v in snake.items() if k in cls.__dataclass_fields__})


def manifest_pages(text: str) -> list[dict]:
    """Pages of a visual manifest: a list under `pages:` of `- key: value` blocks; nested keys are joined with a dot, nested lists are lists."""
    pages: list[dict] = []
    path: list[tuple[int, str]] = []
    inside = False
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip():
            continue
        deep = len(line) - len(line.lstrip())
        if re.match(r"pages:\s*$", line):
            inside = True
            continue
        if not inside:
            continue
        if deep == 0 and not line.startswith("-"):
            break
        body = line.strip()
        if body.startswith("- ") and ":" in body and (not path or deep <= path[0][0] - 2 or not pages):
            pages.append({})
            path = []
            body, deep = body[2:], deep + 2
        if not pages:
            continue
        while path and path[-1][0] >= deep and not body.startswith("- "):
            path.pop()
        if body.startswith("- "):
            pages[-1].setdefault(".".join(k for _, k in path), []).append(_scalar(body[2:]))
            continue
        key, _, value = body.partition(":")
        if value.strip().startswith("["):
            pages[-1][".".join([*(k for _, k in path), key])] = [_scalar(v) for v in value.strip()[1:-1].split(",") if v.strip()]
        elif value.strip():
            pages[-1][".".join([*(k for _, k in path), key])] = _scalar(value)
        else:
            path.append((deep, key))
    return pages
