"""The context of a task: what to read, edit, run and leave alone, within a budget; one call over the tables of a code graph."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import first_of
from ..operators import discovery, planning, search
from ..sources import documents
from . import code_graph


@dataclass(frozen=True)
class Budget:
    """How much a context shows, and which parts it makes at all."""

    primary: int
    supporting: int
    commands: int
    warnings: int
    chars: int
    parts: frozenset = field(default_factory=frozenset)


_ALL = frozenset(("memory", "rules", "debug", "discovery", "routes", "symbols"))
#: Paths of each tier that a context shows; its tiers have all.
SHOWN_PATHS = 1000
#: The budget of each profile.
PROFILES = {"brief": Budget(3, 2, 3, 3, 2500), "standard": Budget(20, 20, 20, 20, 12_000, _ALL), "debug": Budget(100, 100, 100, 100, 50_000, _ALL)}
#: What a source of the reading list counts, at least (must read, chain) or at most (related, generic Markdown).
FROM_MUST_READ, FROM_CHAIN, FROM_FINDING, FROM_CHANGED, MOST_RELATED, MOST_MARKDOWN = 0.98, 0.94, 1.0, 0.9, 0.6, 0.1
TARGETS = {"sync_target": 0.95, "validation_target": 0.85, "depends_on": 0.75}


@dataclass
class Task:
    """What is asked, and what is known beforehand."""

    text: str
    changed: list[str] = field(default_factory=list)
    guard_output: str | None = None
    guard_command: str = ""
    source_doc: str | None = None
    domain: str | None = None
    mode: str = "auto"
    profile: str = "standard"
    guard_rules: list[dict] = field(default_factory=list)
    gates: list[dict] = field(default_factory=list)
    recipes: list[dict] = field(default_factory=list)
    status: DataFrame | None = None
    most_files: int | None = None


def task_mode(task: Task) -> str:
    """repair if a guard's output, a document or changed files are given, else discovery; unless the task says which."""
    if task.mode != "auto":
        return task.mode
    return "repair" if task.guard_output or task.source_doc or task.changed else "discovery"


def source_document(tables: dict[str, DataFrame], files: DataFrame | None, path: str | None) -> tuple[DataFrame, list[str]]:
    """The rows of one document (as documents.source_documents() gives), from the graph, else read anew from files (path, text), and a warning if there is neither."""
    known = tables["documents"]
    if path is None:
        return known.limit(0), []
    own = known.filter(F.col("path") == path)
    if not own.isEmpty():
        return own, []
    if files is not None:
        read = documents.source_documents(files.filter(F.col("path") == path))
        if not read.isEmpty():
            return read, [f"{path} isn't in the graph; it was read directly"]
    return known.limit(0), [f"{path} was not found"]


def reading_list(task: Task, found: dict[str, DataFrame], related: DataFrame, symbols: DataFrame, findings: DataFrame, targets: DataFrame) -> DataFrame:
    """path, score and source, one row for a path: the strongest of what must be read, entry chains, symbols, findings, changed files, document targets and related files."""
    spark = related.sparkSession
    changed = spark.createDataFrame([(p,) for p in task.changed], "path string")
    kind = first_of([(F.col("kind") == k, v) for k, v in TARGETS.items()], TARGETS["depends_on"])
    sources = [(findings.select(F.col("file").alias("path")), "guard failure", FROM_FINDING), (changed, "changed file", FROM_CHANGED), (targets.select(F.col("target_path").alias("path"), F.least(kind, F.col("confidence")).alias("score")), "document target", None)]
    generic = F.col("path").rlike(r"(?i)\.(md|markdown)$") & ~F.col("path").eqNullSafe(F.lit(task.source_doc))
    sources.append((related.select("path", F.when(generic, F.least("score", F.lit(MOST_MARKDOWN))).otherwise(F.least("score", F.lit(MOST_RELATED))).alias("score")), "related file", None))
    sources.append((symbols.select("path", F.least("score", F.lit(0.9)).alias("score")), "symbol match", None))
    if "must_read" in found:
        sources.append((found["must_read"].filter("selected").select("path", F.greatest("score", F.lit(FROM_MUST_READ)).alias("score")), "must read", None))
    if "entrypoints" in found:
        sources.append((found["entrypoints"].select("path", F.least(F.col("score"), F.lit(FROM_CHAIN)).alias("score")), "entry point", None))
    return planning.fuse_reads(*sources).filter("path IS NOT NULL AND path <> ''")


def with_tiers(reads: DataFrame, tiers: DataFrame) -> DataFrame:
    """reads with edit_tier and context_tier: core for what is or may be edited, inspect for what may be inspected or is strong itself, reference for the rest, suppressed below 0.05."""
    joined = reads.join(tiers.select("path", F.col("tier").alias("edit_tier")), "path", "left")
    tier = F.col("edit_tier")
    context = first_of([(tier.isin("must_edit", "may_edit"), "core"), (F.col("score") < 0.05, "suppressed"), (tier == "reference_only", "reference"), ((tier == "may_inspect") | (F.col("score") >= 0.5), "inspect")], "reference")
    return joined.withColumn("context_tier", context)


def prepare(tables: dict[str, DataFrame], task: Task, files: DataFrame | None = None, memory: DataFrame | None = None) -> dict:
    """The context as a dict: small tables stay lazy DataFrames, settings and warnings are plain values.

    tables: of code_graph.build(). Tiers, boundaries and the reading list are joins of narrow tables; nothing is collected but single settings.
    """
    budget, mode, warnings = PROFILES[task.profile], task_mode(task), []
    spark: SparkSession = tables["files"].sparkSession
    doc, said = source_document(tables, files, task.source_doc)
    warnings += said
    targets = doc.select(F.explode("targets").alias("t")).select("t.*") if "targets" in doc.columns else spark.createDataFrame([], "path string, kind string, target_path string, confidence double, raw_value string, evidence_tier string")
    steps = doc.select(F.explode("steps").alias("s")).select("s.*") if "steps" in doc.columns else spark.createDataFrame([], "phase string, ordinal int, title string, command string, confidence double")
    findings = documents.parse_guard_output(spark, task.guard_output or "", task.guard_command)
    matches = planning.rule_scores(findings, task.guard_rules, task.guard_command, task.guard_output or "") if task.guard_rules else spark.createDataFrame([], "file string, rule_id string, domain string, score double")
    reported = [r["file"] for r in findings.select("file").distinct().orderBy("file").limit(budget.primary).collect()]
    explicit = sorted({*task.changed, *reported})
    repair = mode == "repair" and bool(explicit)
    most = task.most_files or (budget.primary + budget.supporting if task.profile == "brief" else 20)
    found = code_graph.discover(tables, task.text, min(most, 15), changed=task.changed) if mode == "discovery" and "discovery" in budget.parts else {}
    nothing = spark.createDataFrame([], "path string, language string, score double, reason string")
    related = nothing if repair else discovery.related_files(tables["files"], tables["symbols"], task.text, k=5 if task.profile == "brief" else 40)
    no_symbols = spark.createDataFrame([], "symbol_key string, path string, name string, kind string, start_line int, score double, method string")
    symbols = code_graph.find_symbol(tables, task.text, 12) if "symbols" in budget.parts and not repair else no_symbols
    domain = planning.infer_domain(task.gates, task.text, task.changed, reported, task.domain)
    gate = next((g for g in task.gates if domain and g["name"] == domain["name"]), {})
    recipe = planning.recipe_by_alias(task.recipes, domain["name"]) if domain else None
    reads = planning.apply_domain_gate(reading_list(task, found, related, symbols, findings, targets), gate, explicit)
    recipes = spark.createDataFrame([(p,) for p in (recipe or {}).get("files", [])], "path string")
    tiers = planning.file_tiers(findings.select("file"), spark.createDataFrame([(p,) for p in task.changed], "path string"), recipes, targets)
    order = with_tiers(reads.orderBy(F.desc("score"), "path").limit(most), tiers)
    tests, commands = discovery.related_tests(tables["tests"], tables["commands"], related, explicit, task.text)
    commands = commands.limit(budget.commands)
    text = F.coalesce("command", "title")
    plan = steps.select((F.col("ordinal") * 2).alias("ordinal"), "phase", "command", text.alias("text"), F.col("confidence").alias("score")).unionByName(commands.select(F.lit(100_000).alias("ordinal"), F.lit("test").alias("phase"), "command", F.col("command").alias("text"), "score"))
    plan = planning.rerank_steps(planning.dedupe_steps(plan), 8)
    boundary = planning.edit_boundary(tiers, SHOWN_PATHS)
    edited = [r["path"] for r in tiers.filter("tier IN ('must_edit', 'may_edit')").orderBy("path").limit(budget.primary).collect()]
    planned = [r["command"] for r in commands.select("command").collect()]
    outside = None
    if task.status is not None:
        outside, many = planning.worktree_boundary(task.status, tiers.filter("tier IN ('must_edit', 'may_edit')"))
        warnings += ["the worktree has many changes"] if many else []
    out = {
        "task": task.text, "mode": mode, "profile": task.profile, "domain": domain, "document": doc, "findings": findings, "rule_matches": matches, "reading_list": order, "core": order.filter("context_tier IN ('core', 'inspect')"), "reference": order.filter("context_tier = 'reference'"),
        "tiers": tiers, "boundary": boundary, "plan": plan, "repair_path": planning.repair_path(edited, task.guard_command or None, planned), "tests": tests, "commands": commands, "outside": outside, "discovery": found, "symbols": symbols,
        "task_id": hashlib.sha1("\0".join([task.text, *explicit]).encode()).hexdigest()[:12], "warnings": warnings[: budget.warnings],
    }
    if "routes" in budget.parts and not repair:
        out["routes"] = discovery.trace_route(tables["routes"], task.text, 12)
    if "rules" in budget.parts:
        out["rules"] = planning.rule_relevance(task.text, tables["rules"]).filter("score > 0.2").orderBy(F.desc("score"), "title", "body").limit(12)
    if "memory" in budget.parts and memory is not None:
        out["memory"] = stored_memory(memory, task.text, 5)
    return out


def stored_memory(memory: DataFrame, query: str, k: int = 5) -> DataFrame:
    """The k remembered rows (schemas.MEMORY) that a query finds, with score and method."""
    keyed = memory.withColumn("memory_key", F.sha1(F.concat_ws("\0", "topic", "summary")))
    hits = search.search(keyed, "memory_key", F.concat_ws(" ", "topic", "summary"), query, [(F.col("topic"), 1.0), (F.col("summary"), 0.8)], k)
    return hits.join(keyed.dropDuplicates(["memory_key"]), "memory_key").orderBy(F.desc("score"), "memory_key").drop("memory_key")


def render(context: dict) -> str:
    """The context as Markdown of at most its profile's characters. Collects only what is shown."""
    budget = PROFILES[context["profile"]]
    out = [f"# {context['task']}", f"mode: {context['mode']}"]
    if context["domain"]:
        out.append(f"domain: {context['domain']['name']} ({context['domain']['confidence']:.2f})")

    def section(title: str, rows: list[str]) -> None:
        if rows:
            out.extend(["", f"## {title}", *rows])

    order = [r.asDict() for r in context["reading_list"].orderBy(F.desc("score"), "path").limit(budget.primary + budget.supporting).collect()]
    section("Read", [f"- {r['path']} ({r['context_tier']}): {r['source']}" for r in order if r["context_tier"] != "suppressed"])
    lists = context["boundary"].first()
    section("Edit", [f"- {p} ({tier})" for tier in ("must_edit", "may_edit") for p in (lists[tier] or [])[: budget.primary]])
    section("Run", [f"- {r['command']}" for r in context["commands"].orderBy(F.desc("score"), "command").limit(budget.commands).collect()])
    section("Steps", [f"{r['ordinal']}. {r['text']}" for r in context["plan"].orderBy("ordinal").collect()])
    section("Repair", [f"{i}. {s}" for i, s in enumerate(context["repair_path"], 1)])
    if "rules" in context:
        section("Rules", [f"- {r['body']}" for r in context["rules"].collect()])
    section("Warnings", [f"- {w}" for w in context["warnings"]])
    text, shown = "", 0
    for line in out:
        if len(text) + len(line) + 1 > budget.chars - 30:
            return text + f"... {len(out) - shown} lines more\n"
        text, shown = text + line + "\n", shown + 1
    return text


def render_map(tables: dict[str, DataFrame], most: int = 30) -> str:
    """Languages, counts, modules and commands of a graph as Markdown."""
    languages, counts = discovery.repo_map(tables["files"], {k: tables[k] for k in ("files", "symbols", "edges", "routes", "tests", "commands", "modules")})
    out = ["# Map", "", "## Languages", *[f"- {r['language']}: {r['files']}" for r in languages.limit(most).collect()], "", "## Tables", *[f"- {r['table']}: {r['rows']}" for r in counts.orderBy("table").collect()]]
    out += ["", "## Modules", *[f"- {r['root']} ({r['type']}): {r['files']}" for r in tables["modules"].orderBy(F.desc("files"), "root").limit(most).collect()]]
    out += ["", "## Commands", *[f"- {r['command']} ({r['category']})" for r in tables["commands"].orderBy("category", "command").limit(most).collect()]]
    return "\n".join(out) + "\n"
