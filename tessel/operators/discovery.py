"""Ranked questions about a code graph: related files, tests, routes, entry points, reuse, reasons, modules, gates and chains.

Tables: files (path, language), symbols (path, name, qualified_name, kind, start_line, symbol_key), routes (framework, method, path, name, file_path),
commands (name, command, source_file, category), blocks (symbol_key, path, name, qualified_name, tokens, normalized_hash), edges (schemas.EDGE).
A task is a string that is known when the plan is made, so all scores are column expressions with literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import matches_any
from ..functions.rules import TEST_DIR, Intent, dependency_tier, entrypoint_score, first_of, is_noisy_path, module_proximity, noise_penalty, reuse_verdict, suppression
from ..functions.text import clamp, jaccard, query_tokens, score_text, tokenize_code
from .combinators import best_per_key, budgeted_tiers, smallest, top_k, top_k_per_group
from .graph import traverse


def related_files(files: DataFrame, symbols: DataFrame, task: str, domains: list[dict] = (), boosts: list[dict] = (), k: int = 20) -> DataFrame:
    """path, language, score and reason: the best of path, symbol and token matches for each file."""
    low = task.lower()
    domain, path = F.lit(0.0), F.col("path")
    for d in domains:
        if any(w.lower() in low for w in d["keywords"]):
            named = F.lower(path).rlike("|".join(map(_quote, d["keywords"])))
            domain += F.when(matches_any(path, list(d.get("paths", []))) | named, 0.35).otherwise(0.0)
    boost = F.lit(0.0)
    for b in boosts:
        boost += F.when(matches_any(path, [b["pattern"]]), float(b["boost"])).otherwise(0.0)
    own = score_text(task, path)
    by_path = files.select("path", "language", clamp(own * 0.65 + domain + boost).alias("score"), F.when((domain > 0) & (own > 0), "path and domain").when(domain > 0, "domain").otherwise("path").alias("reason")).filter("score > 0")
    by_symbol = symbols.select("path", (clamp(score_text(task, F.col("name")) * 0.75)).alias("score"), F.concat(F.lit("symbol "), F.col("name")).alias("reason")).filter("score > 0").join(files.select("path", "language"), "path").select("path", "language", "score", "reason")
    out = by_path.unionByName(by_symbol)
    if tokens := query_tokens(task):
        hit = F.lower(path).rlike("|".join(map(_quote, tokens)))
        out = out.unionByName(files.filter(hit).select("path", "language", F.lit(0.35).alias("score"), F.lit("path token").alias("reason")))
    best = best_per_key(out, "path", -F.col("score"), F.col("reason"))
    return top_k(best, k, F.desc("score"), F.col("path"))


def _quote(word: str) -> str:
    import re

    return re.escape(word.lower())


def related_tests(test_edges: DataFrame, commands: DataFrame, related: DataFrame, changed: list[str], task: str, k: int = 30) -> tuple[DataFrame, DataFrame]:
    """Test files (path, score, reason) that cover changed files or look related, and commands that a task asks for."""
    direct = test_edges.filter(F.col("target_path").isin(*changed)) if changed else test_edges.limit(0)
    files = direct.select(F.col("test_path").alias("path"), F.col("confidence").alias("score"), F.lit("covers a changed file").alias("reason"))
    loose = related.filter(F.col("path").rlike("test|tests|guard")).select("path", "score", F.lit("related path").alias("reason"))
    tests = top_k(best_per_key(files.unionByName(loose), "path", -F.col("score"), F.col("reason")), k, F.desc("score"), F.col("path"))
    text = F.concat_ws(" ", "name", "command", "source_file")
    score = score_text(task, text) + F.when(F.col("category") == "guard", 0.2).otherwise(0.0)
    wanted = top_k(commands.select("name", "command", "category", clamp(score).alias("score")).filter("score > 0.15"), 20, F.desc("score"), F.col("command"))
    return tests, wanted


def trace_route(routes: DataFrame, query: str, k: int = 20) -> DataFrame:
    score = F.greatest(*[score_text(query, F.col(c)) for c in ("path", "name", "file_path")])
    return top_k(routes.select("framework", "method", "path", "name", "file_path", score.alias("score")).filter("score > 0"), k, F.desc("score"), F.col("path"), F.col("file_path"))


def entrypoints(routes: DataFrame, symbols: DataFrame, commands: DataFrame, task: str, k: int = 10, least: float = 0.16) -> DataFrame:
    """type, symbol, path, route_path, method and score of routes, page-like symbols and commands."""
    every = entry_rows(routes, symbols, commands).withColumn("own", score_text(task, F.col("raw")))
    return ranked_entries(Intent.of(task), every, k, least)


def entry_rows(routes: DataFrame, symbols: DataFrame, commands: DataFrame) -> DataFrame:
    """type, symbol, path, route_path, method and raw (the text that a task is held against) of all that may be an entry point, and whether it is a command."""
    null = F.lit(None).cast("string")
    a = routes.select(F.when(F.col("framework") == "fastapi", "fastapi_route").otherwise("flutter_route").alias("type"), F.col("name").alias("symbol"), F.coalesce("file_path", F.lit("")).alias("path_"), F.col("path").alias("route_path"), "method", F.concat_ws(" ", "path", "name", "file_path").alias("raw"))
    kind = first_of([(F.col("path").rlike(TEST_DIR), "test_entry"), ((F.col("kind") == "component") | F.col("path").endswith(".tsx"), "react_component"), (F.col("path").endswith(".dart") & F.col("name").rlike("Page|Screen|View|Card|Widget"), "flutter_page_widget")], "class")
    pages = symbols.filter(F.col("kind").isin("class", "component") | F.col("name").rlike("(Page|Screen|View|Card)$"))
    b = pages.select(kind.alias("type"), F.coalesce("qualified_name", "name").alias("symbol"), F.col("path").alias("path_"), null.alias("route_path"), null.alias("method"), F.concat_ws(" ", "name", "qualified_name", "path").alias("raw"))
    is_test = F.col("category") == "test"
    raw = F.concat_ws(" ", "name", "command", "source_file")
    c = commands.select(F.when(is_test, "test_entry").otherwise("cli_command").alias("type"), F.col("name").alias("symbol"), F.col("source_file").alias("path_"), null.alias("route_path"), null.alias("method"), raw.alias("raw"))
    tag = lambda df, on: df.withColumn("command", F.lit(on))
    return tag(a.unionByName(b), False).unionByName(tag(c, True)).withColumnRenamed("path_", "path")


def ranked_entries(intent: Intent, entries: DataFrame, k: int, least: float = 0.16, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best of entry_rows() with own, the score of their text; of each group if by names columns."""
    entries = entries.filter(~F.col("command") | (F.col("own") > 0.15) | ((F.col("type") == "test_entry") & (F.col("own") > 0)))
    key, order = ["type", "path", "symbol", "route_path"], (F.desc("score"), F.col("path"), F.col("symbol"), F.col("type"), F.col("route_path"))
    scored = entries.select(*by, *key, "method", entrypoint_score(intent, F.col("type"), F.col("symbol"), F.col("path"), F.col("own")).alias("score")).filter(F.col("score") > least)
    best = best_per_key(scored, [*by, *key], -F.col("score"), F.col("method")).select(*by, "type", "symbol", "path", "route_path", "method", "score")
    return top_k_per_group(best, list(by), k, *order) if by else top_k(best, k, *order)


def reuse_type(path: Column, name: Column) -> Column:
    both = F.concat_ws(" ", path, name)
    return first_of([(both.rlike("(?i)Widget|Card|Page|Screen|View|component"), "component"), (both.rlike("(?i)service|repository|client|provider"), "service"), (name.rlike("^use[A-Z]"), "hook")], "code_block")


def reuse(blocks: DataFrame, task: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Reusable candidates, and what a new piece of code would duplicate: symbol_key, path, similarity, reuse_type and verdict."""
    label, words = block_text()
    asked = F.array_distinct(tokenize_code(F.lit(task)))
    similarity = F.least(F.lit(1.0), F.greatest(jaccard(words, asked), F.when(score_text(task, label) > 0.15, score_text(task, label)).otherwise(0.0)))
    hits = blocks.filter(F.size("tokens") > 4).select("symbol_key", "path", "name", "qualified_name", similarity.alias("similarity")).filter("similarity > 0")
    hits = reuse_hits(Intent.of(task), hits)
    order = (F.desc("similarity"), F.col("path"), F.col("symbol_key"))
    return top_k(hits.filter(SHOWN), k, *order), top_k(hits.filter("similarity >= 0.58"), k, *order)


#: Which reusable candidates are shown.
SHOWN = "concat_ws(' ', reuse_type, name, path) RLIKE '(?i)component|widget|card|service|hook|provider'"


def block_text() -> tuple[Column, Column]:
    """A code block's label and its distinct words."""
    label = F.concat_ws(" ", "path", "name", "qualified_name")
    return label, F.array_distinct(F.concat("tokens", tokenize_code(label)))


def reuse_hits(intent: Intent, hits: DataFrame) -> DataFrame:
    typed = hits.withColumn("reuse_type", reuse_type(F.col("path"), F.coalesce("name", "qualified_name")))
    return typed.withColumn("verdict", reuse_verdict(F.col("similarity"), module_proximity(intent, F.col("path"))))


def constructor_fit(params: Column) -> Column:
    """A struct of required parameters and risk, from a constructor's parameter text."""
    needed = F.size(F.filter(F.split(F.coalesce(params, F.lit("")), ","), lambda p: p.contains("required ")))
    return F.struct(needed.alias("required"), F.when(needed > 2, "medium").otherwise("low").alias("risk"))


def explain_reuse(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters that a candidate is in, by path or qualified name."""
    by_path = members.join(candidates.select("path").distinct(), "path", "left_semi")
    by_name = members.join(candidates.select("qualified_name").distinct(), "qualified_name", "left_semi")
    return by_path.unionByName(by_name).select("cluster_hash", "representative").distinct()


def why_related(targets: DataFrame, task: str, symbols: DataFrame, routes: DataFrame, edges: DataFrame) -> DataFrame:
    """target, score and evidence (type, detail, score): paths, up to ten symbols, a route and importers, for all targets (column target) at once."""
    ev = lambda kind, detail, score: F.struct(F.lit(kind).alias("type"), detail.alias("detail"), score.alias("score"))
    own = targets.select("target", ev("path_token", F.col("target"), score_text(task, F.col("target"))).alias("e")).filter("e.score > 0")
    first = symbols.join(targets, F.col("path") == F.col("target")).withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("start_line", "name"))).filter("_n <= 10")
    named = first.select("target", ev("symbol_token", F.coalesce("qualified_name", "name"), score_text(task, F.concat_ws(" ", "name", "qualified_name"))).alias("e")).filter("e.score > 0")
    routed = routes.join(targets, F.col("file_path") == F.col("target")).groupBy("target").agg(F.min(F.coalesce("name", "path")).alias("d")).select("target", ev("entrypoint", F.col("d"), F.lit(0.8)).alias("e"))
    used = edges.filter("kind = 'imports'").join(targets, F.col("to_key") == F.col("target")).groupBy("target").agg(F.count("*").alias("n")).select("target", ev("graph_proximity", F.col("n").cast("string"), F.lit(0.5)).alias("e"))
    every = own.unionByName(named).unionByName(routed).unionByName(used).groupBy("target").agg(F.array_sort(F.collect_list("e")).alias("evidence"), F.sum("e.score").alias("s"))
    return targets.join(every, "target", "left").select("target", F.round(F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) / 2), 2).alias("score"), "evidence")


def folders(path: Column) -> Column:
    """All folders above a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def module_map(modules: DataFrame, files: DataFrame, edges: DataFrame, tests: DataFrame, k: int = 30, entries: DataFrame | None = None, risks: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Modules (name, root) with their core files, what they depend on, what depends on them, their tests and, where given, entry points (entries: path,
    symbol) and files with duplicates (risks: path). scope is a part of a root or name. Files meet modules by their folders, an equi-join."""
    if scope:
        modules = modules.filter(F.lower("root").contains(scope.lower()) | F.lower("name").contains(scope.lower()))
    roots = modules.select("root").distinct()
    inside = files.select("path", F.explode(folders(F.col("path"))).alias("root")).filter(F.col("path") != F.col("root")).join(roots, "root", "left_semi").select("root", "path")
    top = lambda df, col, n: smallest(df, "root", col, n)
    core = top(inside.withColumnRenamed("path", "core_files"), "core_files", 12)
    links = edges.filter("kind = 'imports'").select("from_key", "to_key")
    here = inside.select(F.col("root"), F.col("path"))
    out = links.join(here, F.col("from_key") == F.col("path")).join(here.select(F.col("root").alias("_r"), F.col("path").alias("_p")), F.col("to_key") == F.col("_p"), "left").filter("_r IS NULL OR _r <> root")
    back = links.join(here, F.col("to_key") == F.col("path")).join(here.select(F.col("root").alias("_r"), F.col("path").alias("_p")), F.col("from_key") == F.col("_p"), "left").filter("_r IS NULL OR _r <> root")
    deps = top(out.withColumnRenamed("to_key", "depends_on"), "depends_on", 20)
    users = top(back.withColumnRenamed("from_key", "used_by"), "used_by", 20)
    own = top(tests.join(here, F.col("target_path") == F.col("path")).withColumnRenamed("test_path", "tests"), "tests", 12)
    joined, parts = modules.select("name", "root", "type"), [core, deps, users, own]
    if entries is not None:
        parts.append(top(entries.join(here, "path").select("root", F.col("symbol").alias("entrypoints")), "entrypoints", 12))
    if risks is not None:
        parts.append(top(risks.select("path").distinct().join(here, "path").select("root", F.col("path").alias("duplicate_risks")), "duplicate_risks", 12))
    for part in parts:
        joined = joined.join(part, "root", "left")
    return joined.orderBy("name", "root").limit(k)


def read_order(task: str, hits: DataFrame, k: int = 15) -> DataFrame:
    """path, score and tier (mustRead up to five, shouldInspect and ignoreForNow up to k)."""
    intent, path = Intent.of(task), F.col("path")
    test = path.rlike(TEST_DIR)
    penalty = F.when(test, 0.0 if intent.test else 0.15).otherwise(0.0)
    scored = hits.withColumn("score", clamp(F.col("score") * 0.55 + module_proximity(intent, path) * 0.4 - noise_penalty(intent, path) - penalty, 0.99))
    noise = noise_penalty(intent, path) >= 0.35
    core = (F.col("score") >= 0.72) & ~noise & ~test & ((module_proximity(intent, path) >= 0.55) | F.lower(path).rlike("route"))
    return budgeted_tiers(scored, "path", core, ~noise, 5, k, F.desc("score"), path).filter("tier IS NOT NULL")


STRONG = "route_match|route_builds_page|page_composes_widget|widget_composes_widget|direct_target|reuse_verdict"


def must_read(task: str, candidates: DataFrame, budget: int = 5) -> DataFrame:
    """path, score, evidence, dependency_tier, selected, reason, goes_to: which candidates (path, score, evidence) must be read, and why others need not.

    Candidates are merged by path. Eligibility depends on the row alone; only the budget depends on rank.
    """
    return gated(Intent.of(task), merged_candidates(candidates), budget)


def merged_candidates(candidates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return candidates.groupBy(*by, "path").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def gated(intent: Intent, merged: DataFrame, budget: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """must_read() of merged candidates; budget rows of each group if by names columns."""
    has = lambda w: F.array_contains("evidence", w)
    direct, forced = has("workflow_profile") & has("direct_target"), has("workflow_force_must_read") | has("force_must_read")
    strong = F.exists("evidence", lambda e: e.rlike(STRONG))
    enough = (F.size("evidence") >= 2) | strong
    tier = F.when(direct | has("reuse_verdict"), "core_implementation").otherwise(dependency_tier(intent, F.col("path"), F.col("evidence")))
    test = intent.test if isinstance(intent.test, Column) else F.lit(intent.test)
    test_noise = ~test & F.col("path").rlike(TEST_DIR) & ~forced
    noisy = ~forced & ((is_noisy_path(intent, F.col("path")) & ~direct) | test_noise)
    rows = merged.select("*", tier.alias("dependency_tier"), enough.alias("_enough"), test_noise.alias("_test"), noisy.alias("_noisy"))
    fits = ~F.col("_noisy") & (F.col("dependency_tier") == "core_implementation") & ((F.col("score") >= 0.72) | strong | forced) & F.col("_enough")
    order = (F.desc("score"), F.col("path"))
    if by:
        chosen = top_k_per_group(rows.filter(fits), list(by), budget, *order).select(*by, "path", F.lit(True).alias("_chosen"))
    else:
        chosen = F.broadcast(rows.filter(fits).orderBy(*order).limit(budget).select("path", F.lit(True).alias("_chosen")))  # budget rows
    rows = rows.join(chosen, [*by, "path"], "left").withColumn("selected", F.col("_chosen").isNotNull())
    why = suppression(intent, F.col("path"), F.col("dependency_tier"), F.col("_test"), F.col("_noisy"), F.col("_enough"))
    return rows.withColumn("_w", F.when(~F.col("selected"), why)).select(*by, "path", "score", "evidence", "dependency_tier", "selected", F.col("_w.reason").alias("reason"), F.col("_w.goes_to").alias("goes_to"))


def impact(edges: DataFrame, path: str, depth: int = 2) -> DataFrame:
    """Files that a change of path may reach: path, distance, score and chain."""
    spark = edges.sparkSession
    seeds = spark.createDataFrame([(path,)], "node string")
    return traverse(edges, seeds, "upstream", depth, depth * 30).select(F.col("node").alias("path"), "distance", "score", "confidence", "chain")


def trace_feature(entries: DataFrame, bindings: DataFrame, tests: DataFrame, k: int = 3) -> DataFrame:
    """For each entry point its file, up to k imports and a test, verified if it has an import or a test."""
    ranked = bindings.filter("resolved_path IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("confidence"), "resolved_path"))).filter(F.col("_n") <= k)
    uses = ranked.groupBy("path").agg(F.array_sort(F.collect_list("resolved_path")).alias("imports"))
    covered = tests.groupBy(F.col("target_path").alias("path")).agg(F.min("test_path").alias("test_path"))
    out = entries.select("type", "symbol", "path", "score").join(uses, "path", "left").join(covered, "path", "left")
    verified = F.col("imports").isNotNull() | F.col("test_path").isNotNull()
    return out.withColumn("chain_type", F.when(verified, "verified_chain").otherwise("candidate_chain"))


def acceptance_matrix(pages: DataFrame, most: int = 1000) -> DataFrame:
    """family with its number of variants and its first `most` roles, routes, modes and states in order. pages: family, role, route, mode, states (array)."""
    out = pages.groupBy("family").agg(F.count("*").alias("variants"))
    each = {"roles": pages.select("family", F.col("role").alias("roles")), "routes": pages.select("family", F.col("route").alias("routes")), "modes": pages.select("family", F.col("mode").alias("modes")), "states": pages.select("family", F.explode("states").alias("states"))}
    for name, values in each.items():
        out = out.join(smallest(values, "family", name, most), "family", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def workflow_profiles(profiles: list[dict], task: str) -> list[dict]:
    """Profiles whose any/all/regex/keywords match a task, by confidence."""
    import re

    low = task.lower()

    def fits(m: dict) -> bool:
        words = lambda k: [w.lower() for w in m.get(k, [])]
        if words("all") and not all(w in low for w in words("all")):
            return False
        some = [any(w in low for w in words("any") + words("keywords"))] if words("any") + words("keywords") else []
        some += [re.search(p, low) is not None for p in m.get("regex", [])]
        return any(some) if some else bool(words("all"))

    return sorted((p for p in profiles if fits(p.get("match", {}))), key=lambda p: (-p.get("confidence", 0.95), p["name"]))


def profile_seeds(spark, profiles: list[dict], files: DataFrame) -> DataFrame:
    """profile, path, role and confidence of seeds that exist and that no profile of strictly higher confidence suppresses."""
    rows = [(p["name"], s, role, float(p.get("confidence", 0.95))) for p in profiles for role, key in (("must_read", "mustRead"), ("supporting", "supporting")) for s in p.get(key, [])]
    seeds = spark.createDataFrame(rows, "profile string, path string, role string, confidence double").join(files.select("path"), "path", "left_semi")
    for p in profiles:
        if p.get("suppressPaths"):
            seeds = seeds.filter(~(matches_any(F.col("path"), p["suppressPaths"], False) & (F.col("confidence") < float(p.get("confidence", 0.95)))))
    return seeds


def repo_map(files: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Files by language, and the rows of each table."""
    languages = files.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return languages, counts
