"""Where answers come from and how far they can be trusted: freshness, file hashes, worktree fingerprints, coverage, and answers of outside indexes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_of

#: Kinds of evidence that are not fresh by nature, and states in which evidence still counts as strong.
FRESHNESS_BY_KIND = ((r"(?i)co_?change|git", "stale_until_full_scan"), (r"(?i)weak", "weak"), (r"(?i)metadata_only", "metadata_only"))
STRONG_STATES = ("fresh", "partial")
#: Files that a provenance record names by hash.
MOST_HASHED = 256
#: States of a path in an outside index that are no gap, and the one in which its metadata is current.
NO_GAP, CURRENT = ("no_recorded_issue", "indexed_no_recorded_gap"), "metadata_match"
PATH_KEY = re.compile(r"(?:file|path|file_path|route_file|changed_files)", re.I)
PATH_LIKE = re.compile(r".*/.*|.*\.[A-Za-z0-9]{1,12}", re.S)


def evidence_freshness(kind: Column) -> Column:
    """What a kind of evidence is without further knowledge; null counts as fresh."""
    return first_of([(kind.rlike(p), state) for p, state in FRESHNESS_BY_KIND], "fresh")


def is_strong(state: Column) -> Column:
    return state.isNull() | state.isin(*STRONG_STATES)


def stale_critical(evidence: DataFrame) -> DataFrame:
    """One row: whether any critical evidence (kind, state or null, critical) is no longer strong."""
    state = F.coalesce("state", evidence_freshness(F.col("kind")))
    return evidence.agg(F.coalesce(F.max(F.col("critical") & ~is_strong(state)), F.lit(False)).alias("stale"))


def file_hashes(files: DataFrame, paths: DataFrame, most: int = MOST_HASHED) -> tuple[DataFrame, DataFrame]:
    """path and sha256 of the first `most` of the paths that are files, and one row with how many paths there are, how many were hashed and whether some were left out.

    files: path and text (or content). A limit is part of the record: it names a few files, not a tree.
    """
    asked = paths.select(F.regexp_replace("path", r"^(\./)+", "").alias("path")).filter("path <> ''").distinct()
    first = asked.orderBy("path").limit(most)
    body = F.col("content") if "content" in files.columns else F.col("text")
    found = files.join(first, "path", "left_semi").select("path", F.sha2(body.cast("binary"), 256).alias("sha256"))
    total = asked.agg(F.count("*").alias("candidates")).crossJoin(found.agg(F.count("*").alias("hashed")))  # one row each
    return found, total.select("candidates", "hashed", (F.col("candidates") > most).alias("truncated"))


def worktree_fingerprint(entries: DataFrame) -> DataFrame:
    """path and fingerprint of worktree entries (path, state, mode, size, modified, sha256; nulls for what is missing)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("state", "mode", "size", "modified", "sha256", "source") if c in entries.columns]
    return entries.groupBy("path").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("\0", *parts))), "\1"), 256).alias("fingerprint"))


def worktree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and status (new, changed, deleted) of what differs between two worktree_fingerprint() tables."""
    from .incremental import hash_diff

    return hash_diff(before, after, "path", "fingerprint")


def overall_fingerprint(fingerprints: DataFrame) -> DataFrame:
    """One row: the root of a hash tree over paths. Paths are dealt by the first four hex digits of a hash, those buckets by the first two, and these (256 at
    most) make the root, so no task holds more than its bucket's paths. No rows give the hash of nothing."""
    digest = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: F.concat_ws("\0", r["path"], r["fingerprint"])), "\1"), 256).alias("fingerprint")
    level = fingerprints.select("path", "fingerprint", F.sha1("path").alias("_h"))
    for digits in (4, 2):
        own = F.substring("_h", 1, digits)
        level = level.groupBy(own.alias("_b")).agg(digest(F.struct("path", "fingerprint"))).select(F.col("_b").alias("path"), "fingerprint", F.col("_b").alias("_h"))
    return level.agg(digest(F.struct("path", "fingerprint")))


def coverage_freshness(status: Column, freshness: Column) -> Column:
    """An aggregate over the paths of a coverage report: stale if any path's metadata is not current, partial or weak by their states, else metadata_only."""
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    return first_of([(F.count("*") == 0, "unknown"), (has(~freshness.eqNullSafe(CURRENT)), "stale"), (has(status == "partial"), "partial"), (has(status.isin("skipped", "excluded", "coverage_unavailable")), "weak")], "metadata_only")


def coverage_summary(paths: DataFrame) -> DataFrame:
    """One row of a coverage report (path, status, freshness): its freshness, paths with gaps, paths with outdated metadata, and warnings."""
    status, state = F.col("status"), F.col("freshness")
    some = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    row = paths.agg(coverage_freshness(status, state).alias("state"), some(~F.coalesce(status.isin(*NO_GAP), F.lit(False))).alias("gaps"), some(~state.eqNullSafe(CURRENT)).alias("outdated"))
    says = F.array(F.when(F.col("gaps") > 0, F.concat(F.col("gaps").cast("string"), F.lit(" paths have gaps or no coverage"))), F.when(F.col("outdated") > 0, F.concat(F.col("outdated").cast("string"), F.lit(" paths have outdated metadata: read their source"))))
    return row.select(F.col("state").alias("freshness"), "gaps", "outdated", F.filter(says, lambda w: w.isNotNull()).alias("warnings"))


def symbol_rows(answer: str) -> list[dict]:
    """name, qualified_name, kind, path, start_line, end_line and score from one outside answer: a table of cols and rows, or groups of rows with a common prefix and file. ValueError for other shapes."""
    data = json.loads(answer)
    cols = data.get("cols") if isinstance(data, dict) else None
    groups = [{"rows": data["rows"]}] if cols and isinstance(data.get("rows"), list) else data.get("groups") if cols else None
    if not isinstance(cols, list) or not isinstance(groups, list):
        raise ValueError("an answer needs cols and rows or groups")
    out = []
    for group in groups:
        if not isinstance(group.get("rows"), list) or not all(isinstance(r, list) for r in group["rows"]):
            raise ValueError("a group needs rows that are arrays")
        for cells in group["rows"]:
            row = dict(zip(cols, cells, strict=False))
            qualified = row.get("qn") or row.get("qualified_name") or ""
            name = row.get("name") or qualified.rpartition(".")[2]
            if not name:
                raise ValueError("a row has no symbol name")
            if prefix := group.get("qn_prefix"):
                qualified = f"{prefix}.{name}"
            lines = re.fullmatch(r"(\d+)(?:-(\d+))?", str(row.get("lines") or ""))
            first = int(lines[1]) if lines else None
            out.append({"name": name, "qualified_name": qualified or name, "kind": row.get("label") or "Unknown", "path": row.get("file") or group.get("file"), "start_line": first, "end_line": int(lines[2]) if lines and lines[2] else first, "score": row.get("score", row.get("rank"))})
    return out


def symbol_table(answers: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """What symbol_rows() says of a table of answers, and what it can't read.

    The first has key, part (number of the group, 0 for a plain table), place (of the row in it) and the columns of symbol_rows(), cells as strings and
    score as a double; the second has key, part and place (null where the whole answer or group is meant) and a reason. A bad row doesn't spoil its answer. Null and
    empty answers are bad; empty lists have no rows. Of columns with one name the last counts, as in an object.
    """
    got = lambda v, path, kind: F.try_variant_get(v, path, kind)
    many = "array<variant>"
    read = answers.select(F.col(key), F.try_parse_json(F.col(text)).alias("_v")).select("*", got(F.col("_v"), "$.cols", "array<string>").alias("_cols"), got(F.col("_v"), "$.rows", many).isNotNull().alias("_plain"))
    read = read.withColumn("_groups", F.when(F.size("_cols") > 0, F.when(F.col("_plain"), F.array("_v")).otherwise(got(F.col("_v"), "$.groups", many))))
    parts = read.select(key, "_cols", "_plain", "_groups", F.posexplode_outer("_groups").alias("part", "_g")).filter("_groups IS NULL OR part IS NOT NULL")
    parts = parts.withColumn("_rows", got(F.col("_g"), "$.rows", many))
    rows = parts.select("*", F.posexplode_outer("_rows").alias("place", "_r")).filter("_rows IS NULL OR place IS NOT NULL").withColumn("_cells", got(F.col("_r"), "$", many))
    rows = rows.withColumn("_names", F.slice("_cols", 1, F.size("_cells")))

    def has(name: str) -> Column:
        return F.array_contains("_names", name)

    def cell(name: str, kind: str = "string") -> Column:
        at = F.size("_names") - F.array_position(F.reverse("_names"), name).cast("int")
        return F.when(has(name), got(F.get("_cells", at), "$", kind))

    filled = lambda c: F.when(c != "", c)
    whole = F.coalesce(filled(cell("qn")), filled(cell("qualified_name")))
    rows = rows.withColumn("_whole", whole).withColumn("name", F.coalesce(filled(cell("name")), filled(F.substring_index("_whole", ".", -1))))
    outer = lambda path: filled(F.when(~F.col("_plain"), got(F.col("_g"), path, "string")))
    lines = cell("lines")
    line = lambda i: F.when(lines.rlike(r"^\d+(-\d+)?$"), F.try_element_at(F.split(lines, "-"), F.lit(i)).try_cast("int"))
    why = first_of([(F.col("_groups").isNull(), "an answer needs cols and rows or groups"), (F.col("_rows").isNull(), "a group needs rows"), (F.col("_cells").isNull(), "a row is not an array"), (F.col("name").isNull(), "a row has no symbol name")], None)
    rows = rows.withColumn("reason", why)
    good = rows.filter("reason IS NULL").select(
        key, "part", "place", "name", F.coalesce(F.concat(outer("$.qn_prefix"), F.lit("."), "name"), "_whole", "name").alias("qualified_name"), F.coalesce(filled(cell("label")), F.lit("Unknown")).alias("kind"),
        F.coalesce(filled(cell("file")), outer("$.file")).alias("path"), line(1).alias("start_line"), F.coalesce(line(2), line(1)).alias("end_line"), F.when(has("score"), cell("score", "double")).otherwise(cell("rank", "double")).alias("score"),
    )
    return good, rows.filter("reason IS NOT NULL").select(key, "part", "place", "reason")


def returned_paths(answer: str | None) -> list[str]:
    """Every string under a path-like key or in a path-like column of an answer, sorted; bad JSON has none."""
    try:
        todo: list[tuple] = [(None, json.loads(answer or "null"))]
    except ValueError:
        return []
    found = set()
    while todo:
        key, value = todo.pop()
        if isinstance(value, str):
            if key and PATH_KEY.fullmatch(key) and PATH_LIKE.fullmatch(value) and "\0" not in value:
                found.add(value.replace("\\", "/"))
        elif isinstance(value, list):
            todo += [(key, v) for v in value]
        elif isinstance(value, dict):
            if isinstance(value.get("cols"), list) and isinstance(value.get("rows"), list):
                todo += [(str(c), v) for r in value["rows"] if isinstance(r, list) for c, v in zip(value["cols"], r, strict=False)]
            todo += list(value.items())
    return sorted(found)


def harvest_paths(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key and the sorted paths of each JSON answer, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def harvest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(returned_paths)

    return answers.select(key, harvest(F.col(text)).alias("paths"))
