"""The code graph of a source tree: built in full, updated in part, compared, and asked."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Intent, language_of, module_of
from ..functions.text import call_tokens, extract_lines, fingerprint, structural_shape
from ..operators import discovery, duplicates, evaluation, extract, graph, impact, incremental, planning, resolve, search
from ..operators.combinators import best_per_key, dealt, kept, top_k, top_k_per_group
from ..sources import changes, documents, repo

#: Keys by which sections of two graphs are compared.
SECTIONS = {
    "files": ["path", "hash"], "symbols": ["path", "qualified_name", "kind"], "code_blocks": ["symbol_key", "normalized_hash"], "symbol_edges": ["from_symbol", "to_symbol", "kind"],
    "bindings": ["path", "source_text", "resolved_path"], "routes": ["framework", "method", "path", "name", "file_path"], "tests": ["test_path", "target_path"],
}


#: Files of which a task extracts the symbols and fingerprints the code, some seconds of work.
FILES_A_TASK = 2000


def bodies(extracted: DataFrame) -> DataFrame:
    """Symbols with the text of their lines (body) and their file's language (_l). A file's symbols stay in the task that has its text."""
    return extract.symbols(extracted, "text", F.col("language").alias("_l")).withColumn("body", extract_lines(F.col("text"), F.col("start_line"), F.col("end_line")))


def code_blocks(extracted: DataFrame) -> DataFrame:
    """Symbols with the text of their lines and its fingerprints."""
    rows = bodies(extracted).withColumn("f", fingerprint("body")).withColumn("shape", structural_shape(F.col("_l"), F.col("body")))
    return rows.select("symbol_key", "path", "name", "qualified_name", "kind", "start_line", "end_line", "body", "f.body_hash", "f.normalized_hash", F.col("f.simhash").alias("fingerprint"), "f.tokens", F.col("shape.hash").alias("shape_hash"), F.col("shape.kind").alias("shape_kind"))


def calls_of(blocks: DataFrame) -> DataFrame:
    """from_key, path and name of every name that a symbol's body calls."""
    return blocks.filter("kind <> 'class'").select(F.col("symbol_key").alias("from_key"), "path", F.explode(call_tokens("body")).alias("name"))


def known_names(symbols: DataFrame) -> DataFrame:
    """key, file and name of the symbols that calls may mean."""
    return symbols.filter("kind <> 'provider'").select(F.col("symbol_key").alias("key"), F.col("path").alias("file"), "name")


def symbol_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls between symbols, by name."""
    found = graph.resolved_calls(calls.withColumnRenamed("path", "file"), known_names(symbols))
    kind = F.when(F.col("name").rlike("^[A-Z]"), "constructs").otherwise("calls")
    return found.select(F.col("from_key").alias("from_symbol"), F.col("to_key").alias("to_symbol"), "from_path", "to_path", kind.alias("kind"), "confidence", F.array("how").alias("evidence"))


def edges(symbols: DataFrame, bindings: DataFrame, tests: DataFrame, co_changes: DataFrame | None = None) -> DataFrame:
    row = lambda df, ft, fk, tt, tk, kind, w, c: df.select(F.lit(ft).alias("from_type"), F.col(fk).alias("from_key"), F.lit(tt).alias("to_type"), F.col(tk).alias("to_key"), F.lit(kind).alias("kind"), F.lit(w).alias("weight"), c.alias("confidence"))
    out = row(symbols, "file", "path", "symbol", "symbol_key", "contains", 1.0, F.lit(1.0))
    out = out.unionByName(row(bindings.filter("resolved_path IS NOT NULL"), "file", "path", "file", "resolved_path", "imports", 0.8, F.when(F.col("source_text").startswith("."), 0.9).otherwise(0.62)))
    out = out.unionByName(row(tests, "file", "target_path", "file", "test_path", "covered_by", 0.9, F.col("confidence")))
    return out.unionByName(graph.co_change_edges(co_changes)) if co_changes is not None else out


def build(files: DataFrame, git_log: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables from files (path, language, size, hash, text). Extraction runs at once, the rest is lazy; write them with VersionedStore.publish()."""
    extracted = kept(extract.extract_files(dealt(files, FILES_A_TASK)))
    symbols = extract.symbols(extracted)
    blocks = kept(code_blocks(dealt(extracted, FILES_A_TASK)))
    bindings = resolve.import_bindings(extract.imports(extracted), files)
    tests = resolve.test_targets(files)
    routes = extract.routes(extracted)
    pairs = top_k(graph.co_changes(git_log, "commit_no", "path"), graph.MOST_PAIRS, F.desc("weight"), F.col("a"), F.col("b")) if git_log is not None else None
    calls = calls_of(blocks)
    found = clusters(blocks)
    out = {
        "files": files.select("path", "language", "size", "hash"), "symbols": symbols, "code_blocks": blocks, "calls": calls, "symbol_edges": symbol_edges(calls, symbols), "bindings": bindings, "tests": tests, "routes": routes,
        "edges": edges(symbols, bindings, tests, pairs), "clusters": found, "members": members(blocks, found), "modules": modules(files),
        "commands": repo.commands(files), "rules": repo.rules(files), "documents": documents.source_documents(files), "postings": postings(symbols), "lengths": lengths(symbols),
    }
    return out | ({"co_changes": pairs} if pairs is not None else {})


def clusters(blocks: DataFrame) -> DataFrame:
    return duplicates.clusters(blocks, "symbol_key", F.col("normalized_hash"), F.size("tokens") > 8)


def members(blocks: DataFrame, found: DataFrame) -> DataFrame:
    return duplicates.members(blocks, "symbol_key", F.col("normalized_hash"), found)


def modules(files: DataFrame) -> DataFrame:
    return files.select(module_of(F.col("path")).alias("m")).filter("m IS NOT NULL").groupBy("m.name", "m.root", "m.type").agg(F.count("*").alias("files"))


#: The text of a symbol that searches read.
SYMBOL_TEXT = ("name", "kind")


def postings(symbols: DataFrame) -> DataFrame:
    """term, symbol_key, path, times and words of every word of a symbol's text."""
    return search.postings(symbols, "symbol_key", F.concat_ws(" ", *SYMBOL_TEXT), "path")


def lengths(symbols: DataFrame) -> DataFrame:
    """path, docs and words of a file's symbols."""
    return search.lengths(symbols, F.concat_ws(" ", *SYMBOL_TEXT), "path")


def affected_callers(changed: DataFrame, graph_tables: dict[str, DataFrame], most: int = 100) -> DataFrame:
    """Paths that import or call into changed paths, at most so many, in order."""
    by_import = graph_tables["bindings"].join(changed.select(F.col("path").alias("resolved_path")), "resolved_path", "left_semi").select("path")
    by_call = graph_tables["symbol_edges"].join(changed.select(F.col("path").alias("to_path")), "to_path", "left_semi").select(F.col("from_path").alias("path"))
    return by_import.unionByName(by_call).distinct().join(changed.select("path"), "path", "left_anti").orderBy("path").limit(most)


#: Changed files up to which names are looked up, names looked up, callers of a name, neighbours of a module, and files in all.
TOKEN_FILES, TOKEN_NAMES, A_TOKEN, A_MODULE, IN_ALL = 3, 25, 50, 30, 100


def expanded_callers(changed: DataFrame, tables: dict[str, DataFrame], names: int = TOKEN_NAMES, a_token: int = A_TOKEN, a_module: int = A_MODULE, most: int = IN_ALL) -> tuple[DataFrame, DataFrame]:
    """Who a change of files (path) may touch: path and reasons of at most `most` files in order, and one row of how many candidates there are and are left out.

    Importers and callers all count. Of at most TOKEN_FILES changed files the first `names` names of three characters or more that they define are looked up in
    the table of calls, which is inverted by name, at most a_token files each; and each changed file's module gives at most a_module neighbours. The caps are group
    limits in order of path, so they are the same on every run, and a name that everyone calls reaches no task whole.
    """
    paths = changed.select("path").distinct()
    row = lambda df, path, why: df.select(F.col(path).alias("path"), F.lit(why).alias("reason"))
    to = lambda c: paths.withColumnRenamed("path", c)
    out = row(tables["bindings"].join(to("resolved_path"), "resolved_path", "left_semi"), "path", "import").unionByName(row(tables["symbol_edges"].join(to("to_path"), "to_path", "left_semi"), "from_path", "call"))
    if len(paths.take(TOKEN_FILES + 1)) <= TOKEN_FILES:
        defined = top_k(tables["symbols"].join(paths, "path", "left_semi").filter("length(name) >= 3").select("name").distinct(), names, F.col("name"))
        users = tables["calls"].join(F.broadcast(defined), "name", "left_semi").select("name", "path").distinct().join(paths, "path", "left_anti")  # `names` rows
        out = out.unionByName(row(top_k_per_group(users, "name", a_token, F.col("path")), "path", "token"))
    root = lambda c: module_of(F.col(c))["root"]
    own = paths.select(root("path").alias("root")).filter("root IS NOT NULL").distinct()
    near = tables["files"].select("path", root("path").alias("root")).join(own, "root", "left_semi").join(paths, "path", "left_anti")
    out = out.unionByName(row(top_k_per_group(near, "root", a_module, F.col("path")), "path", "module")).join(paths, "path", "left_anti")
    merged = kept(out.distinct().groupBy("path").agg(F.array_sort(F.collect_list("reason")).alias("reasons")))  # four reasons at most
    counts = merged.agg(F.count("*").alias("candidates"), F.greatest(F.count("*") - most, F.lit(0)).alias("left_out"))
    return top_k(merged, most, F.col("path")), counts


def update(old: dict[str, DataFrame], files: DataFrame) -> tuple[dict[str, DataFrame], str]:
    """The tables after files changed, and the plan that was used; delta.changes() says what differs."""
    from . import delta

    found, plan = delta.changes(old, files)
    if plan == "full":
        return build(files), plan
    return (delta.with_edges(found.apply(old)) if found else old), plan


def differences(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    return incremental.verify(lambda: left, lambda: right, SECTIONS)


def find_symbol(tables: dict[str, DataFrame], query: str, k: int = 20) -> DataFrame:
    symbols = tables["symbols"]
    fallback = [(F.col("name"), 1.0), (F.col("path"), 0.8)]
    if search.is_index(tables.get("postings")):
        index = search.Index(tables["postings"], tables["lengths"], "symbol_key")
        hits = search.search(symbols, "symbol_key", None, query, fallback, k, index)
    else:
        hits = search.search(symbols, "symbol_key", F.concat_ws(" ", *SYMBOL_TEXT), query, fallback, k)
    found = symbols.join(F.broadcast(hits), "symbol_key")  # k rows
    return found.select("symbol_key", "path", "name", "kind", "start_line", "score", "method").orderBy(F.desc("score"), "symbol_key")


#: Parts of a discovery that each mode asks for.
MODES = {"full": ("entrypoints", "related", "symbols", "reuse", "tests", "callees"), "locate": ("related", "symbols"), "reuse": ("reuse", "symbols"), "impact": ("related", "tests", "callees"), "entry": ("entrypoints", "related", "tests")}


#: Words of a task that ask for a mode, in order.
QUERY_MODES = (("reuse", "reuse|duplicate|复用|重复"), ("impact", "impact|affect|影响"), ("entry", "entry|route|入口"), ("locate", "where|locate|find|哪里"))


def query_mode(task: str) -> str:
    import re

    return next((mode for mode, words in QUERY_MODES if re.search(words, task.lower())), "full")


def discover(tables: dict[str, DataFrame], task: str, k: int = 15, mode: str | None = None, changed: list[str] = ()) -> dict[str, DataFrame]:
    """Lazy answers of each part that the mode asks for, their fused candidates, what must be read, and the order to read in.

    Files that a task names as changed count as evidence, and tests that cover them come first.
    """
    parts, out = MODES[mode or query_mode(task)], {}
    rows = []
    ev = lambda df, name, score="score": df.select("path", F.col(score).alias("score"), F.array(F.lit(name)).alias("evidence"))
    if "entrypoints" in parts:
        out["entrypoints"] = discovery.entrypoints(tables["routes"], tables["symbols"], tables["commands"], task)
        rows.append(ev(out["entrypoints"], "entrypoint"))
    if "related" in parts:
        out["related"] = discovery.related_files(tables["files"], tables["symbols"], task)
        rows.append(ev(out["related"], "related_file"))
    if "symbols" in parts:
        out["symbols"] = find_symbol(tables, task)
        rows.append(ev(out["symbols"], "symbol_match"))
    if "reuse" in parts:
        out["reuse"], out["duplicate_risks"] = discovery.reuse(tables["code_blocks"], task)
        rows.append(ev(out["reuse"].filter("verdict <> 'create_new_allowed'"), "reuse_verdict", "similarity"))
        out["reuse_clusters"] = discovery.explain_reuse(out["reuse"], cluster_members(tables))
    if "tests" in parts and "related" in out:
        out["tests"], out["test_commands"] = discovery.related_tests(tables["tests"], tables["commands"], out["related"], list(changed), task)
    if "callees" in parts:
        starts = find_symbol(tables, task, 5).select(F.col("symbol_key").alias("node"))
        reached = impact.trace(tables["symbol_edges"], starts, "callees", 1, 40)
        at = tables["symbols"].select(F.col("symbol_key").alias("node"), "path", "qualified_name")
        out["callees"] = reached.join(at, "node").select("node", "path", "qualified_name", "via")
        rows.append(out["callees"].select("path", F.lit(0.5).alias("score"), F.array(F.lit("callee")).alias("evidence")))
    if changed:
        rows.append(tables["files"].filter(F.col("path").isin(*changed)).select("path", F.lit(0.9).alias("score"), F.array(F.lit("changed_file"), F.lit("direct_target")).alias("evidence")))
    fused = rows[0]
    for r in rows[1:]:
        fused = fused.unionByName(r)
    out["must_read"] = discovery.must_read(task, fused)
    out["read_order"] = discovery.read_order(task, fused.groupBy("path").agg(F.max("score").alias("score")), k)
    return out


def cluster_members(tables: dict[str, DataFrame], scope: str | None = None, k: int | None = None) -> DataFrame:
    """cluster_hash, representative, symbol_key, path and qualified_name of the members of duplicate clusters whose path or name holds scope; clusters of
    fewer than two such members are left out, then the k largest are taken."""
    at = tables["symbols"].select("symbol_key", "path", "qualified_name")
    rows = tables["members"].select("cluster_hash", "representative", "symbol_key").join(at, "symbol_key")
    if scope:
        rows = rows.filter(F.col("path").contains(scope) | F.col("qualified_name").contains(scope))
    sizes = rows.groupBy("cluster_hash").agg(F.count("*").alias("n")).filter("n >= 2")
    sizes = top_k(sizes, k, F.desc("n"), F.col("cluster_hash")) if k else sizes
    return rows.join(sizes.select("cluster_hash"), "cluster_hash", "left_semi")


def report_impact(tables: dict[str, DataFrame], path: str, task: str) -> tuple[DataFrame, DataFrame]:
    """The parts of what a change of one file may touch, and their report by role and risk."""
    related = discovery.related_files(tables["files"], tables["symbols"], task)
    entries = discovery.entrypoints(tables["routes"], tables["symbols"], tables["commands"], task)
    parts = kept(impact.impact_parts(path, tables, related, entries, discovery.reuse(tables["code_blocks"], task)[0]))
    return parts, impact.impact_report(parts)


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """section and row (JSON of its natural keys) of every compared section: a graph as one table that can be written, read and compared."""
    out = None
    for section, columns in SECTIONS.items():
        one = tables[section].select(F.lit(section).alias("section"), F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}).alias("row")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def export_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """The snapshot as JSON lines, a folder for each section."""
    snapshot(tables).write.mode("overwrite").partitionBy("section").text(path)


def query_answers(tables: dict[str, DataFrame], cases: list[dict]) -> DataFrame:
    """case and key of the answers to questions: {id, kind, of}, with a kind of discover, impact, callers, callees or trace."""
    spark = tables["files"].sparkSession
    calls = tables["symbol_edges"].withColumnsRenamed({"from_symbol": "from_key", "to_symbol": "to_key"})
    one = lambda name: tables["symbols"].filter(F.col("name") == name).select(F.col("symbol_key").alias("node"))
    ask = {
        "discover": lambda q: discover(tables, q, 12)["must_read"].filter("selected").select(F.concat(F.lit("must read "), "path").alias("key")),
        "impact": lambda q: impact.change_impact(spark.createDataFrame([(q,)], "path string"), tables["bindings"], tables["symbol_edges"], tables["tests"]).select(F.concat_ws(" ", "kind", "path").alias("key")),
        "callers": lambda q: graph.neighbours(calls, one(q), "callers").select(F.col("neighbour").alias("key")),
        "callees": lambda q: graph.neighbours(calls, one(q), "callees").select(F.col("neighbour").alias("key")),
        "trace": lambda q: impact.trace(tables["symbol_edges"], one(q), "callees", 3).select(F.concat_ws(" ", F.col("hop").cast("string"), "node").alias("key")),
    }
    out = None
    for c in cases:
        rows = ask[c["kind"]](c["of"]).select(F.lit(c["id"]).alias("case"), "key").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def query_differences(left: dict[str, DataFrame], right: dict[str, DataFrame], cases: list[dict]) -> DataFrame:
    """Answers that only one of two graphs gives: section `queries`, side, case and key."""
    return graph.equivalence(query_answers(left, cases), query_answers(right, cases), ["case", "key"], "queries")


def mutate(files: DataFrame, mutations: list[dict]) -> DataFrame:
    """files after mutations: {kind: add, change, delete or rename; path; text or to}. Hash, size and language follow."""
    out = files
    for m in mutations:
        path, is_it = m["path"], F.col("path") == m["path"]
        if m["kind"] == "delete":
            out = out.filter(~is_it)
        elif m["kind"] == "rename":
            out = out.withColumn("path", F.when(is_it, m["to"]).otherwise(F.col("path")))
        elif m["kind"] == "change":
            out = out.withColumn("text", F.when(is_it, m["text"]).otherwise(F.col("text")))
        else:
            new = files.sparkSession.createDataFrame([(path, "", 0, "", m["text"])], "path string, language string, size long, hash string, text string")
            out = out.unionByName(new.select(*[F.col(c).cast(files.schema[c].dataType) for c in files.columns]))
    return out.withColumn("language", language_of(F.col("path"))).withColumn("size", F.octet_length("text").cast("long")).withColumn("hash", F.sha1("text"))


def mutated(files: DataFrame, mutations: DataFrame) -> DataFrame:
    """suite and the files (path, language, size, hash, text) after each suite of documents.mutation_rows(), all suites at once.

    A mutation names a path of the tree before its suite. Of several on one path a deletion wins, else the last text and the last new path count. What
    is added or renamed onto a path replaces the file there, the last one added or renamed. Mutations of paths that aren't there change nothing; a suite
    without mutations has no rows. The tree is joined once with the suites and once with what they do to a path.
    """
    last = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.col("place")))
    done = mutations.filter("kind <> 'add'").groupBy("suite", "path").agg(F.max(F.col("kind") == "delete").alias("_gone"), last("change", "text").alias("_text"), last("rename", "to").alias("_to"), F.max(F.when(F.col("kind") == "rename", F.col("place"))).alias("_place"))
    every = files.select("path", "text").crossJoin(mutations.select("suite").distinct())  # each suite is a tree of its own
    left = every.join(done, ["suite", "path"], "left").filter("_gone IS NULL OR NOT _gone")
    rows = left.select("suite", F.coalesce("_to", "path").alias("path"), F.coalesce("_text", "text").alias("text"), F.coalesce("_place", F.lit(-1)).alias("_place"))
    added = mutations.filter("kind = 'add'").select("suite", "path", "text", F.col("place").alias("_place"))
    out = best_per_key(rows.unionByName(added), ["suite", "path"], -F.col("_place"))
    return out.select("suite", "path", language_of(F.col("path")).alias("language"), F.octet_length("text").cast("long").alias("size"), F.sha1("text").alias("hash"), "text")


def check_mutations(files: DataFrame, suites: list[dict], cases: list[dict] = ()) -> DataFrame:
    """mutation, plan, side, section and key of differences between a partial update and a full build after each suite ({id, mutations}); no rows if they agree.

    The trees of all suites are made at once (mutated()); each is then updated and built, which is what is checked.
    """
    spark, out = files.sparkSession, None
    before, trees = build(files), kept(mutated(files, documents.mutation_rows(spark, suites)))
    for s in suites:
        after = trees.filter(F.col("suite") == str(s["id"])).drop("suite")
        (part, plan), full = update(before, after), build(after)
        rows = differences(full, part).select("section", "side", "key")
        if cases:
            rows = rows.unionByName(query_differences(full, part, list(cases)).select("section", "side", F.concat_ws(" ", "case", "key").alias("key")))
        rows = rows.select(F.lit(s["id"]).alias("mutation"), F.lit(plan).alias("plan"), "section", "side", "key")
        out = rows if out is None else out.unionByName(rows)
    return out


def stale_edges(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """Edges of the old graph whose target symbol the new one no longer has."""
    return incremental.rewire(old["symbol_edges"], new["symbols"])[1]


#: Lists of an evaluation's case.
CASE_LISTS = ("expected", "forbidden", "chain", "reuse", "tests", "reasons")


def evaluate(tables: dict[str, DataFrame], cases: list[dict] | DataFrame, most: int = 50) -> DataFrame:
    """evaluation.score_cases() of a suite: id, task, mode, limit and expected, forbidden, chain, reuse, tests and reasons, as dicts or rows.

    All cases are answered at once (suite.discover); a case's latency is its share of the time that took. Ids must be unique. What a case doesn't have is null
    or empty.
    """
    from . import suite

    spark = tables["files"].sparkSession
    form = "id string, task string, mode string, limit int, " + ", ".join(f"{c} array<string>" for c in CASE_LISTS)
    if not isinstance(cases, DataFrame):
        cases = spark.createDataFrame([(str(c["id"]), c.get("task"), c.get("mode"), c.get("limit"), *[c.get(x) for x in CASE_LISTS]) for c in cases], form)
    none = F.array().cast("array<string>")
    cases = kept(cases.select(F.col("id").cast("string").alias("case"), "task", "mode", "limit", *[F.coalesce(c, none).alias(c if c in ("expected", "forbidden") else f"wanted_{c}") for c in CASE_LISTS]))
    n, began = cases.count(), time.perf_counter()
    answered = kept(suite.answers(suite.discover(tables, cases.select("case", "task", "mode")), cases, most))
    each = int(1000 * (time.perf_counter() - began) / max(n, 1))
    return evaluation.score_cases(cases.join(answered.withColumn("chain", F.col("found")), "case").withColumnRenamed("case", "id").withColumn("latency_ms", F.lit(each)))


class Project:
    """A source tree and its graph: scan, update and questions, with results as small lists of dicts in one envelope."""

    def __init__(self, spark: SparkSession, root: str, store: str):
        from .delta import GraphStore

        self.spark, self.root, self.store = spark, root, GraphStore(spark, store)

    def scan(self, incremental_scan: bool = False) -> dict:
        from . import delta

        files = repo.scan_files(self.spark, self.root)
        old = self.store.tables()
        found, plan = delta.changes(old, files) if incremental_scan and old else (None, "full")
        if plan == "none":
            return self.response({"plan": plan})
        if plan != "full":
            self.store.advance(found)
            return self.response({"plan": plan, "stale_edges": stale_edges(old, self.store.tables()).count()})
        self.store.publish(build(files, repo.git_log(self.spark, self.root.replace("file://", ""))))
        return self.response({"plan": plan})

    def response(self, data, warnings: list[str] = ()) -> dict:
        at = datetime.now(UTC).isoformat(timespec="seconds")
        return {"repo": self.root, "generated_at": at, "index_status": "ready" if self.store.tables() else "missing", "data": data, "warnings": list(warnings)}

    def tools(self) -> dict[str, Callable[..., DataFrame]]:
        """What can be asked, by name; each gives a lazy table in its own order."""
        t, spark = self.store.tables(), self.spark
        one = lambda key: spark.createDataFrame([(key,)], "node string")
        named = lambda name: resolve.resolve_symbol(t["symbols"], name).select(F.col("symbol_key").alias("node"))
        calls = t["symbol_edges"].withColumnsRenamed({"from_symbol": "from_key", "to_symbol": "to_key"})
        strongest = lambda df: df.orderBy("node", F.desc("confidence"), "neighbour")
        paths = lambda *names: spark.createDataFrame([(p,) for p in names], "path string")
        return {
            "status": lambda: discovery.repo_map(t["files"], t)[1], "repo_map": lambda: discovery.repo_map(t["files"], t)[0], "architecture": lambda scope=None: discovery.module_map(t["modules"], t["files"], t["edges"], t["tests"], entries=t["routes"].select(F.col("file_path").alias("path"), F.col("name").alias("symbol")), risks=cluster_members(t).select("path"), scope=scope),
            "modules": lambda: discovery.module_map(t["modules"], t["files"], t["edges"], t["tests"]), "find_symbol": lambda q: find_symbol(t, q), "resolve_symbol": lambda name: resolve.resolve_symbol(t["symbols"], name), "related": lambda q: discovery.related_files(t["files"], t["symbols"], q),
            "callers": lambda s: strongest(graph.neighbours(calls, one(s), "callers")), "callees": lambda s: strongest(graph.neighbours(calls, one(s), "callees")), "trace": lambda name, direction="callees", depth=2, limit=100: impact.trace(t["symbol_edges"], named(name), direction, depth, limit),
            "impact": lambda p, depth=2: discovery.impact(t["edges"], p, depth), "impact_parts": lambda p, task="": report_impact(t, p, task)[0].orderBy("part", F.desc("score"), "path"), "impact_report": lambda p, task="": report_impact(t, p, task)[1].orderBy("role"),
            "detect_changes": lambda *names: impact.change_impact(paths(*names), t["bindings"], t["symbol_edges"], t["tests"]).orderBy(F.desc("confidence"), "path"), "affected_callers": lambda *names: affected_callers(paths(*names), t),
            "duplicates": lambda scope=None, k=200: cluster_members(t, scope, k).orderBy("cluster_hash", "symbol_key"), "similar": lambda key: duplicates.similar_to(t["code_blocks"], "symbol_key", "tokens", "normalized_hash", t["code_blocks"].filter(F.col("symbol_key") == key)).orderBy(F.desc("similarity"), "symbol_key"),
            "reuse": lambda q: discovery.reuse(t["code_blocks"], q)[0], "explain_reuse": lambda q: discovery.explain_reuse(discovery.reuse(t["code_blocks"], q)[0], cluster_members(t)).orderBy("cluster_hash"), "entrypoints": lambda q: discovery.entrypoints(t["routes"], t["symbols"], t["commands"], q),
            "trace_route": lambda q: discovery.trace_route(t["routes"], q), "trace_feature": lambda q: discovery.trace_feature(discovery.entrypoints(t["routes"], t["symbols"], t["commands"], q), t["bindings"], t["tests"]).orderBy(F.desc("score"), "path"),
            "why": lambda q, *names: discovery.why_related(spark.createDataFrame([(p,) for p in names], "target string"), q, t["symbols"], t["routes"], t["edges"]).orderBy("target"), "tests": lambda q, *names: discovery.related_tests(t["tests"], t["commands"], discovery.related_files(t["files"], t["symbols"], q), list(names), q)[0],
            "commands": lambda q: discovery.related_tests(t["tests"], t["commands"], discovery.related_files(t["files"], t["symbols"], q), [], q)[1], "must_read": lambda q: discover(t, q)["must_read"].orderBy(F.desc("selected"), F.desc("score"), "path"), "read_order": lambda q: discover(t, q)["read_order"].orderBy(F.desc("score"), "path"),
            "rules": lambda q: planning.rule_relevance(q, t["rules"]).orderBy(F.desc("score"), "title", "body"), "documents": lambda: t["documents"].select("path", "title", "parse_mode", "confidence").orderBy("path"), "snapshot": lambda: snapshot(t).orderBy("section", "row"),
        }

    def ask(self, name: str, *args, most: int = 200, **kw) -> dict:
        """The answer of one of tools() in an envelope: at most so many rows, with a warning if there are more."""
        rows = self.tools()[name](*args, **kw).limit(most + 1).collect()
        return self.response([r.asDict(recursive=True) for r in rows[:most]], [f"only the first {most} rows are shown"] if len(rows) > most else [])

    def context(self, task, files: DataFrame | None = None) -> dict:
        """The context of a task (plans.context.Task), rendered, in an envelope; the session is remembered in the log `sessions`."""
        from . import context as contexts

        made = contexts.prepare(self.store.tables(), task, files)
        reads = [r["path"] for r in made["core"].select("path").orderBy("path").collect()]
        local = self.root.replace("file://", "")
        status = [p for p, *_ in changes.parse_status(changes.run_git(local, "status", "--porcelain=v1", "-z") or "")]
        boundary = made["boundary"].first().asDict()
        row = planning.session_row(self.spark, made["task_id"], task.text, reads, task.source_doc, made["domain"] and made["domain"]["name"], repo.git_head(local), status, boundary)
        self.store.append("sessions", row)
        return self.response(contexts.render(made), made["warnings"])

    def load_session(self, task_id: str) -> dict | None:
        """The session of a task as it was remembered last, with its boundary; None if there is none."""
        try:
            row = self.store.latest("sessions", "task_id").filter(F.col("task_id") == task_id).first()
        except ValueError:  # no session at all
            return None
        return row and row.asDict() | {"boundary": json.loads(row["boundary"])}

    def record_result(self, title: str, task_id: str = "", result: str | None = None, summary: str | None = None, validations: list[str] = (), guard_output: str = "", guard_command: str = "", guard_rules: list[dict] = (), base: str = "main") -> dict:
        """Remembers what became of a task: changed files, rules that a guard's output names, commands that were run, and a summary, in the logs `results` and `memory`."""
        findings = documents.parse_guard_output(self.spark, guard_output, guard_command)
        rules = [r["rule_id"] for r in planning.rule_scores(findings, list(guard_rules), guard_command, guard_output).select("rule_id").distinct().orderBy("rule_id").collect()] if guard_rules else []
        changed = [r["path"] for r in changes.git_changes(self.spark, self.root.replace("file://", ""), base).paths.filter("state <> 'committed'").select("path").distinct().orderBy("path").collect()]
        validation = list(dict.fromkeys([*validations, *([guard_command] if guard_command else [])]))
        text = summary or planning.result_summary(title, changed, rules, validation, result)
        self.store.append("results", planning.result_row(self.spark, task_id or title, title, changed, rules, validation, result, text))
        self.store.append("memory", planning.remember(self.spark, title, text, changed, validation, rules, "task_result"))
        return self.response({"stored": True, "changed": changed, "rules": rules, "validation": validation, "summary": text})


__all__ = ["Intent", "Project", "build", "differences", "discover", "find_symbol", "update"]
