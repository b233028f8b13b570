"""Ordered rules: the first that fits decides. Rules are data, so callers can replace them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds, categories and path patterns that decide results.
LANGUAGES = {".dart": "dart", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".sql": "sql", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".sh": "shell", ".ps1": "powershell"}
TEXT_NAMES = ("Makefile", "Dockerfile", "README", "AGENTS.md", "CLAUDE.md", "package.json", "pubspec.yaml", "pyproject.toml")
NOT_TEXT = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".heic", ".pdf", ".otf", ".ttf", ".zip", ".gz", ".tar", ".dump", ".sqlite", ".db", ".lock")
COMMAND_CATEGORIES = (("test", ("test", "pytest", "vitest")), ("lint", ("lint", "analyze", "ruff", "mypy")), ("build", ("build",)), ("guard", ("guard", "quality")))
RULE_CATEGORIES = (("test", ("test", "测试")), ("frontend", ("frontend", "flutter", "ui")), ("backend", ("backend", "api", "schema")), ("constraint", ("do not", "never", "禁止", "不要")))
FRONTEND, API = r"页面|界面|组件|卡片|widget|flutter|frontend|dashboard|card|ui|视觉", r"api|接口|endpoint|schema|字段|backend|fastapi|database"
DESIGN = r"design system|design-system|design_system|设计系统|视觉|token|guard|breakpoint|ds-"
END_TO_END = r"e2e|maestro|patrol|截图|screenshot"
TEST_DIR = r"(^|/)(test|tests)/"
SUBDOMAINS = ("lookup", "level", "management", "platform", "plan", "admin", "pr")
#: reason, path pattern, where it goes, confidence, condition on the task
SUPPRESSIONS = (
    ("e2e_artifact", r"(^|/)(e2e|maestro|patrol)(/|$)|\.maestro/", "ignoreForNow", 0.9, ""),
    ("screenshot_artifact", r"(screenshots?|golden|ocr|snapshot)", "ignoreForNow", 0.9, ""),
    ("qa_manifest_artifact", r"(^|/)qa(/|_)|qa_manifest|manifest\.json$", "ignoreForNow", 0.9, ""),
    ("backend_noise_for_frontend_task", r"^(backend|database|infra)/", "ignoreForNow", 0.9, "frontend only"),
    ("generated_api_model", r"\.g\.dart$|generated|openapi|api_client|packages/api_client", "supportingContext", 0.9, ""),
    ("import_only_l10n_wrapper", r"(^|/)(l10n|locale|localizations?)(/|\.|_)", "supportingContext", 0.9, ""),
    ("logger_utility", r"(logger|logging)", "supportingContext", 0.9, ""),
    ("api_error_wrapper", r"(api_error|/errors?/)", "supportingContext", 0.9, ""),
    ("auth_cache_dependency", r"(auth_user_cache|auth.*cache|cache_provider)", "supportingContext", 0.9, ""),
    ("below_must_read_threshold", r"modules/design_system/theme|theme|tokens|experience_theme|breakpoint", "shouldInspect", 0.72, "design"),
    ("theme_token_support", r"(modules/design_system/theme|theme|tokens)", "supportingContext", 0.9, ""),
    ("design_system_base_component_support", r"modules/design_system/(components|foundation)/", "supportingContext", 0.9, ""),
    ("generic_helper", r"(utils?|helpers?|constants|shared|common)", "supportingContext", 0.9, ""),
)
PLANES = (
    ("workflowProfiles", r"^(\.agents/tessel|\.tessel)/workflow-profiles\.json$"),
    ("evalSuites", r"^(\.agents/tessel|\.tessel)/.*(eval|suite|discovery-suite).*\.json$|^agents-results/"),
    ("commandSources", r"(^|/)(Makefile|package\.json|package-lock\.json|pubspec\.ya?ml|pyproject\.toml)$"),
    ("docs", r"(^|/)(AGENTS|CLAUDE|README)\.md$|^docs/|^\.agents/skills/.*\.md$"),
)
PLANE_KINDS = {"workflowProfiles": "workflow_profiles_only", "evalSuites": "eval_only", "commandSources": "commands_only", "docs": "docs_only", "codeGraph": "code_graph"}
#: folder before a module's name, most parts of its name, type
MODULES = (("frontend/lib/modules/", 2, "flutter_module"), ("backend/app/", 2, "backend_area"), ("src/", 1, "source_module"), ("packages/", 1, "package"), ("apps/", 1, "app"))
#: plane, and its state after a metadata-only, a partial, and any other scan of changed code
FRESHNESS = (("fileCatalog", "fresh", "fresh", "fresh"), ("symbolGraph", "stale", "fresh", "fresh"), ("importGraph", "stale", "fresh", "fresh"), ("routeGraph", "stale", "fresh", "fresh"), ("testGraph", "stale", "fresh", "fresh"), ("duplicateClusters", "stale", "partial", "partial"), ("coChangeGraph", "stale_until_full_scan", "stale_until_full_scan", "stale_until_full_scan"))


def first_of(cases: list[tuple[Column, Column | str | None]], otherwise=None) -> Column:
    """The value of the first case whose condition holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = lit(otherwise)
    for condition, value in reversed(cases):
        out = F.when(condition, lit(value)).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """Of the file name, lower-cased, with its dot; empty without one and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column) -> Column:
    ext = extension(path)
    known = first_of([(ext == k, v) for k, v in LANGUAGES.items()], "text")
    return F.when(base_name(path) == "Makefile", "makefile").otherwise(known)


def is_indexable(path: Column) -> Column:
    ext = extension(path)
    return base_name(path).isin(*TEXT_NAMES) | (ext.isin(*LANGUAGES) & ~ext.isin(*NOT_TEXT))


def by_substring(text: Column, categories, otherwise: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_of([(low.rlike("|".join(map(re.escape, words))), name) for name, words in categories], otherwise)


def command_category(text: Column) -> Column:
    return by_substring(text, COMMAND_CATEGORIES, "command")


def rule_category(text: Column) -> Column:
    return by_substring(text, RULE_CATEGORIES, "general")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(test|tests)/|(_test|\.test|\.spec)\.(dart|ts|tsx|js|py)$")


def test_command(path: Column) -> Column:
    return first_of([
        (path.startswith("frontend/") & path.endswith(".dart"), F.concat(F.lit("cd frontend && flutter test "), F.regexp_replace(path, "^frontend/", ""))),
        (path.endswith(".py"), F.concat(F.lit("pytest "), path)),
        (path.rlike(r"\.[tj]s$"), F.concat(F.lit("npx vitest run "), path)),
    ], "")


def module_of(path: Column) -> Column:
    """A struct of name, root and type of the module that a path is in, null for none: see MODULES. Of longer names only folders count."""
    cases = []
    for prefix, most, kind in MODULES:
        rest = F.split(F.substring(path, len(prefix) + 1, 1 << 20), "/")
        count = F.lit(1) if most == 1 else F.greatest(F.lit(0), F.least(F.size(rest) - 1, F.lit(most)))
        name = F.array_join(F.slice(rest, 1, count), "/")
        cases.append((path.startswith(prefix) & (name != ""), F.struct(name.alias("name"), F.concat(F.lit(prefix), name).alias("root"), F.lit(kind).alias("type"))))
    return first_of(cases)


def change_plane(path: Column) -> Column:
    """Which part of the index a changed file belongs to; codeGraph unless a rule says otherwise."""
    return first_of([(path.rlike(p), name) for name, p in PLANES], "codeGraph")


def change_kind(planes: Column) -> Column:
    """From the distinct planes of all changes: none, what the one plane is called, or mixed."""
    one = F.element_at(planes, 1)
    return F.when(F.size(planes) == 0, "none").when(F.size(planes) > 1, "mixed").otherwise(first_of([(one == k, v) for k, v in PLANE_KINDS.items()]))


#: Topics that weigh paths and symbols, and what else in a task's words decides rules.
TOPICS = ("dashboard", "athlete")
WORDS = {"frontend": FRONTEND, "api": API, "api_wide": API + "|route handler|数据库", "design": DESIGN, "test": r"\btest\b|测试|spec", "e2e": END_TO_END}
NOT_TOKEN = r"[^a-z0-9_一-鿿]+"


def _on(flag: bool | Column) -> Column:
    return flag if isinstance(flag, Column) else F.lit(flag)


@dataclass(frozen=True)
class Intent:
    """What a task is about, from its words: values that decide rules when a plan is made, or columns of a table of tasks."""

    task: str | Column
    frontend: bool | Column = False
    api: bool | Column = False
    api_wide: bool | Column = False
    design: bool | Column = False
    test: bool | Column = False
    e2e: bool | Column = False
    tokens: tuple[str, ...] | Column = ()
    topics: tuple[str, ...] | dict[str, Column] = field(default=())

    @classmethod
    def of(cls, task: str, topics: tuple[str, ...] = TOPICS) -> Intent:
        low = task.lower()
        tokens = tuple(t for t in re.split(NOT_TOKEN, low) if len(t) > 1)
        has = lambda p: re.search(p, low) is not None
        return cls(task, **{k: has(p) for k, p in WORDS.items()}, tokens=tokens, topics=tuple(t for t in topics if has(rf"\b{t}\b")))

    @staticmethod
    def column(task: Column, topics: tuple[str, ...] = TOPICS) -> Column:
        """of() as a struct column, for read()."""
        low = F.lower(task)
        has = lambda p: low.rlike(f"(?U){p}")
        tokens = F.filter(F.split(low, NOT_TOKEN), lambda t: F.length(t) > 1)
        return F.struct(task.alias("task"), *[has(p).alias(k) for k, p in WORDS.items()], tokens.alias("tokens"), F.struct(*[has(rf"\b{t}\b").alias(t) for t in topics]).alias("topics"))

    @classmethod
    def read(cls, intent: Column, topics: tuple[str, ...] = TOPICS) -> Intent:
        return cls(intent["task"], **{k: intent[k] for k in (*WORDS, "tokens")}, topics={t: intent["topics"][t] for t in topics})

    def about(self) -> dict[str, Column]:
        """Topics with whether the task has them."""
        return self.topics if isinstance(self.topics, dict) else {t: F.lit(True) for t in self.topics}

    def words(self) -> Column:
        return F.array_join(self.tokens, " ") if isinstance(self.tokens, Column) else F.lit(" ".join(self.tokens))

    def names(self, low: Column) -> Column:
        """Whether lower-case text has any of the task's tokens of three characters or more."""
        if isinstance(self.tokens, Column):
            return F.exists(self.tokens, lambda t: (F.length(t) > 2) & low.contains(t))
        long = [t for t in self.tokens if len(t) > 2]
        return low.rlike("|".join(map(re.escape, long))) if long else F.lit(False)


def noise_penalty(intent: Intent, path: Column) -> Column:
    low = F.lower(path)
    add = lambda on, weight: F.when(on, weight).otherwise(0.0)
    out = add(_on(intent.frontend) & ~_on(intent.api_wide) & low.rlike(r"^(backend|database|infra)/"), 0.45)
    out += add(_on(intent.frontend) & ~_on(intent.e2e) & low.rlike(r"(maestro|patrol|screenshot|golden|ocr|qa)"), 0.25)
    return out + add(_on(intent.api_wide) & low.startswith("frontend/lib/modules/design_system/"), 0.35)


def subdomain_penalty(intent: Intent, path: Column, symbol: Column) -> Column:
    both, words = F.lower(F.concat_ws(" ", path, symbol)), intent.words()
    out = F.lit(0.0)
    for t in SUBDOMAINS:
        out += F.when(~words.contains(t) & both.contains(t), 0.09).otherwise(0.0)
    page = both.contains("dashboard_page") & ~both.rlike("lookup|management|platform|plan|admin|pr")
    out -= F.when(intent.about().get("dashboard", F.lit(False)) & page, 0.06).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.24), out))


def type_weight(kind: Column, symbol: Column, path: Column) -> Column:
    page = path.rlike("page|screen|view")
    return first_of([(kind.isin("flutter_route", "fastapi_route"), 1.0), (symbol.rlike(r"Page|Screen|View$"), 0.92), ((kind == "flutter_page_widget") & page, 0.86), (kind == "flutter_page_widget", 0.62), (kind == "react_component", 0.7), (kind == "test_entry", 0.35), (kind == "cli_command", 0.28)], 0.48)


#: How much each topic adds to paths and symbols that name it.
TOPIC_WEIGHTS = {"dashboard": (0.28, 0.34), "athlete": (0.22, 0.32)}


def module_proximity(intent: Intent, path: Column) -> Column:
    low, about = F.lower(path), intent.about()
    add = lambda on, weight: F.when(on, weight).otherwise(0.0)
    out = add(_on(intent.frontend) & low.startswith("frontend/lib/"), 0.35)
    for topic, on in about.items():
        out += add(on & low.contains(topic), TOPIC_WEIGHTS.get(topic, (0.2, 0.3))[0])
    if set(TOPICS) <= set(about):
        out += add(about["dashboard"] & about["athlete"] & low.contains("user_core/dashboard"), 0.25)
    out += add(_on(intent.api_wide) & low.startswith("backend/"), 0.45)
    return F.least(F.lit(1.0), out + add(_on(intent.test) & low.rlike(TEST_DIR), 0.25))


def symbol_exactness(intent: Intent, symbol: Column) -> Column:
    low, out = F.lower(F.coalesce(symbol, F.lit(""))), F.lit(0.0)
    for topic, on in intent.about().items():
        out += F.when(on & low.contains(topic), TOPIC_WEIGHTS.get(topic, (0.2, 0.3))[1]).otherwise(0.0)
    out += F.when(intent.names(low), 0.24).otherwise(0.0)
    return F.least(F.lit(1.0), out + F.when(low.rlike("page|screen|view"), 0.1).otherwise(0.0))


def entrypoint_score(intent: Intent, kind: Column, symbol: Column, path: Column, text_score: Column) -> Column:
    symbol = F.coalesce(symbol, F.lit(""))
    plus = text_score * 0.28 + type_weight(kind, symbol, path) * 0.26 + module_proximity(intent, path) * 0.24 + symbol_exactness(intent, symbol) * 0.16 + F.when(kind.contains("route"), 0.12).otherwise(0.0)
    minus = noise_penalty(intent, path) + subdomain_penalty(intent, path, symbol) + F.when(symbol.startswith("_"), 0.12).otherwise(0.0)
    minus += F.when(symbol.rlike(r"(?i)(^|[^a-z0-9_])_card($|[^a-z0-9_])|(^|[A-Z])card$|_card") & ~symbol.rlike("(?i)page|screen|view"), 0.06).otherwise(0.0)
    minus += F.when(~_on(intent.test) & path.rlike(TEST_DIR), 0.28).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), plus - minus))


def dependency_tier(intent: Intent, path: Column, evidence: Column | None = None) -> Column:
    low = F.lower(path)
    theme = low.contains("/modules/design_system/theme/")
    strong = F.exists(evidence, lambda e: e.rlike("route_match|route_builds_page|page_composes_widget|widget_composes_widget")) if evidence is not None else F.lit(False)
    return first_of([
        (_on(intent.design) & (theme | low.contains("/tokens/") | low.contains("experience_theme") | low.contains("breakpoint")), "core_implementation"),
        (~_on(intent.design) & (theme | low.contains("/modules/design_system/components/") | low.contains("/modules/design_system/foundation/")), "supporting_dependency"),
        (strong, "core_implementation"),
        (low.rlike(r"flutter|riverpod|provider|go_router|material|fastapi|dio|node_modules|package:"), "framework_dependency"),
        (low.rlike(r"(l10n|locale|api_error|logger|logging|auth_user_cache|theme|tokens|utils?|helpers?|constants)"), "supporting_dependency"),
        (intent.names(low), "core_implementation"),
    ], "irrelevant_import")


def is_noisy_path(intent: Intent, path: Column) -> Column:
    low, front = F.lower(path), _on(intent.frontend)
    backend = front & ~_on(intent.api) & low.rlike(r"^(backend|database|infra)/")
    return backend | (front & ~_on(intent.e2e) & low.rlike(r"(maestro|patrol|screenshot|golden|ocr|qa)"))


def suppression(intent: Intent, path: Column, tier: Column | None = None, test_noise: Column | None = None, noisy: Column | None = None, enough: Column | None = None) -> Column:
    """A struct of reason, goes_to and confidence for a path that isn't among those to read first."""
    low = F.lower(path)
    row = lambda reason, to, c: F.struct(F.lit(reason).alias("reason"), F.lit(to).alias("goes_to"), F.lit(float(c)).alias("confidence"))
    holds = {"": F.lit(True), "frontend only": _on(intent.frontend) & ~_on(intent.api), "design": _on(intent.design)}
    cases = [(holds[on] & low.rlike(p), row(reason, to, c)) for reason, p, to, c, on in SUPPRESSIONS]
    no = F.lit(False)
    tier = tier if tier is not None else F.lit("")
    cases += [(test_noise if test_noise is not None else no, row("test_noise", "ignoreForNow", 0.9)), (tier == "framework_dependency", row("framework_dependency_only", "supportingContext", 0.9)), (tier == "supporting_dependency", row("supporting_dependency_only", "supportingContext", 0.9)), (noisy if noisy is not None else no, row("domain_noise", "ignoreForNow", 0.9)), (~enough if enough is not None else no, row("insufficient_strong_evidence", "shouldInspect", 0.82))]
    return first_of(cases, row("below_must_read_threshold", "shouldInspect", 0.78))


def reuse_verdict(similarity: Column, proximity: Column) -> Column:
    return first_of([((similarity >= 0.85) & (proximity >= 0.45), "reuse_as_is"), ((similarity >= 0.65) & (proximity >= 0.4), "extend_existing"), (similarity >= 0.72, "extract_shared")], "create_new_allowed")


def freshness(mode: Column) -> Column:
    """Planes and their states as a map, by mode: metadata_only, partial, full, none or incremental."""
    rows = lambda i: F.create_map(*[F.lit(x) for r in FRESHNESS for x in (r[0], r[i])])
    all_fresh = F.create_map(*[F.lit(x) for r in FRESHNESS for x in (r[0], "fresh")])
    return F.when(mode == "metadata_only", rows(1)).when(mode == "partial", rows(2)).when(mode == "incremental", rows(3)).otherwise(all_fresh)
