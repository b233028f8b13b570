"""What a change of files does to a graph's tables, as rows that go and rows that come; and the store that writes only the buckets they are in.

Per-file tables lose and get the rows of touched files. What depends on other files is found by equi-joins on the few keys that changed:
calls of names that now resolve differently, imports whose candidates appeared or vanished, clusters of hashes that touched files have or had, and
words of touched symbols. Files that are not among these keep their rows, and buckets without such keys keep their files.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract, graph, incremental, resolve
from ..operators.combinators import kept
from ..operators.incremental import Delta, without
from ..sources import documents, repo
from . import code_graph

#: The column whose hash says in which bucket a row of each table is. Other tables are small and written whole.
KEYS = {
    "files": "path", "symbols": "path", "code_blocks": "path", "calls": "path", "bindings": "path", "symbol_edges": "from_path", "routes": "file_path", "commands": "source_file", "documents": "path",
    "clusters": "cluster_hash", "members": "cluster_hash", "postings": "term", "lengths": "path",
}


def with_edges(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables with their typed edges, which are a view of other tables."""
    return tables | {"edges": code_graph.edges(tables["symbols"], tables["bindings"], tables["tests"], tables.get("co_changes"))}


def _distinct(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def changes(old: dict[str, DataFrame], files: DataFrame) -> tuple[Delta | None, str]:
    """The delta between a graph and files (path, language, size, hash, text), and the plan: none, metadata_only, lightweight, partial, batch_partial or full.

    No delta for none and full. Metadata rows are advanced by every plan, so a scan after it finds nothing new.
    """
    diff = kept(incremental.planes(incremental.hash_diff(old["files"], files.select("path", "hash"), "path", "hash"), "path"))
    plan = incremental.choose_plan(diff, old["files"].isEmpty())
    if plan in ("none", "full"):
        return None, plan
    touched = diff.select("path")
    part = kept(files.join(F.broadcast(touched) if plan != "lightweight" else touched, "path", "left_semi"))  # BATCH code files at most, and what else changed
    seen = diff.agg(F.max(F.col("status") != "changed").alias("paths"), F.max(F.col("path").isin(*repo.RULE_FILES)).alias("rules")).first()
    rows = part.select("path", "language", "size", "hash")
    all_files = without(old["files"], touched).unionByName(rows)
    out = Delta()
    out.put("files", touched, rows)
    out.put("commands", touched.withColumnRenamed("path", "source_file"), repo.commands(part))
    out.put("documents", touched, documents.source_documents(part))
    if seen["rules"]:
        out.whole["rules"] = repo.rules(files.filter(F.col("path").isin(*repo.RULE_FILES)))
    if seen["paths"]:
        out.whole |= {"tests": resolve.test_targets(all_files), "modules": code_graph.modules(all_files)}
    if plan != "metadata_only":
        extracted = kept(extract.extract_files(part))
        with ThreadPoolExecutor(3) as pool:  # three short chains of jobs that don't need each other
            for done in [pool.submit(_symbols_and_calls, out, old, touched, extracted), pool.submit(_imports, out, old, diff, extracted, all_files), pool.submit(_clusters, out, old, touched, extracted)]:
                done.result()
    return out, plan


def _symbols_and_calls(out: Delta, old: dict[str, DataFrame], touched: DataFrame, extracted: DataFrame) -> None:
    """Names that touched files define or defined, then those that resolve differently, then who calls them. And the words of touched symbols."""
    symbols, was = extract.symbols(extracted), old["symbols"].join(touched, "path", "left_semi")
    all_symbols = without(old["symbols"], touched).unionByName(symbols)
    names = kept(_distinct(was.select("name"), symbols.select("name")))
    few = lambda df: code_graph.known_names(df.join(names, "name", "left_semi"))
    others = without(old["calls"], touched)
    moved = graph.moved_names(few(old["symbols"]), few(all_symbols))
    again = kept(_distinct(touched, others.join(moved, "name", "left_semi").select("path")))
    calls = code_graph.calls_of(code_graph.bodies(extracted))
    asked = kept(others.join(again, "path", "left_semi").unionByName(calls))
    meant = all_symbols.join(asked.select("name").distinct(), "name", "left_semi")
    out.put("symbols", touched, symbols)
    out.put("calls", touched, calls)
    out.put("symbol_edges", again.withColumnRenamed("path", "from_path"), code_graph.symbol_edges(asked, meant))
    words, gone = code_graph.postings(symbols), code_graph.postings(was)
    out.put("postings", kept(_distinct(words.select("term", "path"), gone.select("term", "path"))), words)
    out.put("lengths", touched, code_graph.lengths(symbols))


def _imports(out: Delta, old: dict[str, DataFrame], diff: DataFrame, extracted: DataFrame, all_files: DataFrame) -> None:
    """Routes and imports of touched files, and imports of files with a candidate that appeared or vanished."""
    touched = diff.select("path")
    place = diff.filter("status <> 'changed'").select(F.col("path").alias("candidate"))
    known = without(old["bindings"], touched).select("path", F.col("source_text").alias("import_text"))
    tried = known.select("path", F.explode(resolve.import_candidates(F.col("path"), F.col("import_text"))).alias("candidate"))
    importers = kept(_distinct(touched, tried.join(place, "candidate", "left_semi").select("path")))
    texts = known.join(importers, "path", "left_semi").unionByName(extract.imports(extracted))
    out.put("bindings", importers, resolve.import_bindings(texts, all_files))
    out.put("routes", touched.withColumnRenamed("path", "file_path"), extract.routes(extracted))


def _clusters(out: Delta, old: dict[str, DataFrame], touched: DataFrame, extracted: DataFrame) -> None:
    """Blocks of touched files, and clusters of hashes that they have or had."""
    blocks = kept(code_graph.code_blocks(extracted))
    hashes = lambda df: df.select(F.col("normalized_hash").alias("cluster_hash"))
    mixed = kept(_distinct(hashes(old["code_blocks"].join(touched, "path", "left_semi")), hashes(blocks)))
    narrow = ["symbol_key", "normalized_hash", "tokens"]
    alike = without(old["code_blocks"], touched).select(narrow).unionByName(blocks.select(narrow)).join(mixed.withColumnRenamed("cluster_hash", "normalized_hash"), "normalized_hash", "left_semi")
    found = kept(code_graph.clusters(alike))
    out.put("code_blocks", touched, blocks)
    out.put("clusters", mixed, found)
    out.put("members", mixed, code_graph.members(alike, found))


class GraphStore(incremental.BucketStore):
    """The store of a code graph. Edges are a view and are not written."""

    KEYS = KEYS
    #: Files that a bucket is made for, and the least and most buckets of a table.
    FILES, LEAST, MOST = 256, 4, 4096

    def publish(self, tables: dict[str, DataFrame]) -> str:
        self.buckets = min(max(tables["files"].count() // self.FILES, self.LEAST), self.MOST)
        return super().publish({name: df for name, df in tables.items() if name != "edges"})

    def tables(self) -> dict[str, DataFrame]:
        found = super().tables()
        return with_edges(found) if "symbols" in found else found


__all__ = ["Delta", "GraphStore", "changes", "with_edges"]
