"""Source trees, commands, rules and git history as DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.globs import gitignore_patterns, matches_any
from ..functions.rules import base_name, command_category, extension, first_of, is_indexable, language_of, rule_category

# Folders and names that are not read, and the largest file that is.
IGNORED_DIRS = (".git", "node_modules", "build", "dist", ".dart_tool", ".venv", "venv", "env", "coverage", ".tessel", ".mypy_cache", ".tmp", ".cache", ".ruff_cache", "__pycache__", ".pytest_cache")
MOST_BYTES, MOST_RULES = 1_500_000, 300
RULE_FILES = ("AGENTS.md", "CLAUDE.md", "README.md", "docs/README.md", "docs/CONVENTIONS.md", "frontend/README.md", "backend/README.md")
MODAL = r"(?i)(^|[^A-Za-z0-9_])(must|should|never|do not|prefer)($|[^A-Za-z0-9_])|不要|必须|禁止|优先|建议"


def scan_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, gitignore: str | None = None) -> DataFrame:
    """path, language, size, hash and text of a tree's text files; any store that Spark reads. gitignore is the text of that file."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    where = F.element_at(F.split("path", root.replace("file://", "").replace("\\", "\\\\") + "/", 2), -1)
    files = files.withColumn("path", where).filter((F.col("length") <= MOST_BYTES) & is_indexable(F.col("path")) & (base_name(F.col("path")) != ".DS_Store"))
    files = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED_DIRS))))
    if include:
        files = files.filter(matches_any(F.col("path"), include))
    if unwanted := [*(exclude or []), *gitignore_patterns(gitignore or "")]:
        files = files.filter(~matches_any(F.col("path"), unwanted))
    return files.select("path", language_of(F.col("path")).alias("language"), F.col("length").alias("size"), F.sha1("content").alias("hash"), F.decode("content", "UTF-8").alias("text"))


def read_text(spark: SparkSession, root: str, path: str, most: int = MOST_BYTES) -> str | None:
    """The text of one file of a tree; None if it is missing, no file or larger than most."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}").filter(F.col("length") <= most).select(F.decode("content", "UTF-8")).head()
    except AnalysisException:
        return None
    return found and found[0]


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1) and line."""
    each = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    return each.withColumn("line_no", F.col("line_no") + 1)


def commands(files: DataFrame) -> DataFrame:
    """name, command, source_file and category of make targets, npm scripts and the usual commands of Dart and Python projects."""
    make = lines(files.filter(base_name(F.col("path")) == "Makefile")).select("path", F.regexp_extract("line", r"^([A-Za-z0-9_-][A-Za-z0-9_.-]*):", 1).alias("name")).filter("name <> ''")
    make = make.select("name", F.concat(F.lit("make "), F.col("name")).alias("command"), "path", F.col("name").alias("_about"))
    scripts = files.filter(base_name(F.col("path")) == "package.json").select("path", F.explode(F.from_json("text", "scripts map<string,string>")["scripts"]).alias("name", "_script"))
    npm = scripts.select("name", F.concat(F.lit("npm run "), F.col("name")).alias("command"), "path", F.concat_ws(" ", "name", "_script").alias("_about"))
    folder = F.when(F.col("path").contains("/"), F.concat(F.lit("cd "), F.regexp_replace("path", "/[^/]*$", ""), F.lit(" && "))).otherwise("")
    usual = files.select("path", F.explode(first_of([(base_name(F.col("path")) == "pubspec.yaml", F.array(F.lit("flutter test"), F.lit("flutter analyze"))), (base_name(F.col("path")) == "pyproject.toml", F.array(F.lit("pytest")))], F.array().cast("array<string>"))).alias("name"))
    usual = usual.select("name", F.concat(folder, F.col("name")).alias("command"), "path", F.col("name").alias("_about"))
    out = make.unionByName(npm).unionByName(usual)
    return out.select("name", "command", F.col("path").alias("source_file"), command_category(F.col("_about")).alias("category")).distinct()


def rules(files: DataFrame, candidates: tuple[str, ...] = RULE_FILES, most: int | None = MOST_RULES) -> DataFrame:
    """source_file, title, body and category of bullets and modal sentences in rule files, in order; the title is the nearest heading above."""
    each = lines(files.filter(F.col("path").isin(*candidates))).withColumn("line", F.trim("line")).filter("line <> ''")
    heading = F.nullif(F.regexp_extract("line", r"^#{1,4}\s+(.+)$", 1), F.lit(""))
    above = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("_h", heading).withColumn("title", F.last("_h", ignorenulls=True).over(above))
    found = each.filter("_h IS NULL").filter(F.col("line").rlike(r"^[-*]\s+") | F.col("line").rlike(MODAL))
    place = first_of([(F.col("path") == c, i) for i, c in enumerate(candidates)])
    out = found.select(F.col("path").alias("source_file"), "title", F.regexp_replace("line", r"^[-*]\s+", "").alias("body"), rule_category(F.col("line")).alias("category"), place.alias("_p"), "line_no").orderBy("_p", "line_no")
    return (out.limit(most) if most else out).drop("_p", "line_no")


def _git(root: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=30, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


def git_head(root: str) -> str | None:
    return _git(root, "rev-parse", "--short", "HEAD").strip() or None


def git_log(spark: SparkSession, root: str, most: int = 200) -> DataFrame:
    """commit_no (0 is the newest) and path of the last commits."""
    rows, n = [], -1
    for line in _git(root, "log", "-n", str(most), "--name-only", "--pretty=format:\x01").splitlines():
        if line.startswith("\x01"):
            n += 1
        elif line.strip():
            rows.append((n, line.strip()))
    return spark.createDataFrame(rows, "commit_no int, path string")


def worktree_status(spark: SparkSession, porcelain: str) -> DataFrame:
    """path and state (modified, staged, untracked) from `git status --porcelain`; a rename counts under its new name."""
    raw = spark.createDataFrame([(x,) for x in porcelain.splitlines() if x], "line string")
    path = F.element_at(F.split(F.substring("line", 4, 4096), " -> "), -1)
    code = F.substring("line", 1, 2)
    state = F.when(code == "??", "untracked").when(F.substring(code, 2, 1) != " ", "modified").otherwise("staged")
    return raw.select(F.regexp_replace(path, '^"|"$', "").alias("path"), state.alias("state"))


__all__ = ["commands", "extension", "git_head", "git_log", "lines", "rules", "scan_files", "worktree_status"]
