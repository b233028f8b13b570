"""What a change reaches: changed files and who points at them, traces over calls, and impact reports by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import TEST_DIR, first_of
from .combinators import best_per_key, kept, smallest, top_k, top_k_per_group
from .graph import Adjacency, neighbours

#: Changed files from which an impact is of high and of medium risk, and how many hits of each kind a report shows.
HIGH, MEDIUM = 8, 3
SHOWN = 20
#: What a path's name says about its role, in order.
ROLES = (("view_model", "view_?model|provider|controller|notifier"), ("widget", "widget|card|page|screen|view"), ("role", "role|permission|auth"))


def changed_paths(*sources: DataFrame) -> DataFrame:
    """path and states of files that a merge-base difference, the worktree, the index or untracked files name. Sources: path, state."""
    every = sources[0].select("path", "state")
    for s in sources[1:]:
        every = every.unionByName(s.select("path", "state"))
    return every.filter("path IS NOT NULL AND path <> ''").groupBy("path").agg(F.array_sort(F.collect_set("state")).alias("states"))


def change_impact(changed: DataFrame, bindings: DataFrame, symbol_edges: DataFrame, tests: DataFrame) -> DataFrame:
    """path, confidence, kind and via of the files one step from changed ones: who imports them, calls into them or tests them; the best link of each.

    changed: path. Changed files themselves are left out. Three joins on the changed paths, one aggregation; hot targets combine before the shuffle.
    """
    names = changed.select(F.col("path").alias("via")).distinct()
    row = lambda df, path, to, kind: df.select(F.col(path).alias("path"), F.col(to).alias("via"), "confidence", F.lit(kind).alias("kind"))
    links = row(bindings.filter("resolved_path IS NOT NULL"), "path", "resolved_path", "imports").unionByName(row(symbol_edges, "from_path", "to_path", "calls")).unionByName(row(tests, "test_path", "target_path", "covered_by"))
    near = links.join(names, "via", "left_semi").join(names.withColumnRenamed("via", "path"), "path", "left_anti")
    return best_per_key(near.select("path", "confidence", "kind", "via"), "path", -F.col("confidence"), F.col("kind"), F.col("via"))


def trace(symbol_edges: DataFrame, seeds: DataFrame, direction: str = "callees", depth: int = 2, limit: int | None = None) -> DataFrame:
    """node, hop and via of the symbols that calls reach from seeds (column node), each at its smallest hop; via is the smallest symbol before it.

    A step is one join and one aggregation; steps are few and known, and those of a hub are dealt into parts. Beyond limit the nearest stay.
    """
    here, there = ("from_symbol", "to_symbol") if direction == "callees" else ("to_symbol", "from_symbol")
    ways = Adjacency(symbol_edges.select(F.col(here).alias("u"), F.col(there).alias("v")).distinct())
    seen = seeds.select("node", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via")).dropDuplicates(["node"])
    front = seen
    for hop in range(1, depth + 1):
        reached = ways.out_of(front).groupBy(F.col("v").alias("_n")).agg(F.min("u").alias("_via"))
        front = reached.join(seen.select(F.col("node").alias("_n")), "_n", "left_anti").select(F.col("_n").alias("node"), F.lit(hop).alias("hop"), F.col("_via").alias("via"))
        front = kept(front)
        seen = seen.unionByName(front)
    out = seen.filter("hop > 0")
    return top_k(out, limit, F.col("hop"), F.col("node")) if limit else out


def risk_of(files: Column) -> Column:
    return F.when(files >= HIGH, "high").when(files >= MEDIUM, "medium").otherwise("low")


def impact_parts(path: str, tables: dict[str, DataFrame], related: DataFrame, entrypoints: DataFrame, reuse: DataFrame) -> DataFrame:
    """part, path, detail and score of all that a change of one file may touch: related files, callers, callees, entry points, tests, reuse and
    files that change with it; the strongest SHOWN of each part."""
    own = tables["symbols"].filter(F.col("path") == path).select(F.col("symbol_key").alias("node"))
    calls = tables["symbol_edges"].select(F.col("from_symbol").alias("from_key"), F.col("to_symbol").alias("to_key"), "kind", "confidence")
    at = tables["symbols"].select(F.col("symbol_key").alias("neighbour"), "path")
    side = lambda way: neighbours(calls, own, way).join(at, "neighbour").select(F.lit(way).alias("part"), "path", F.col("neighbour").alias("detail"), F.col("confidence").alias("score"))
    row = lambda df, part, detail, score: df.select(F.lit(part).alias("part"), "path", detail.cast("string").alias("detail"), score.alias("score"))
    out = row(related, "related", F.col("reason"), F.col("score")).unionByName(side("callers")).unionByName(side("callees"))
    out = out.unionByName(row(entrypoints, "entrypoints", F.col("symbol"), F.col("score"))).unionByName(row(reuse, "reuse", F.col("symbol_key"), F.col("similarity")))
    tests = tables["tests"].filter(F.col("target_path") == path).select(F.col("test_path").alias("path"), "confidence")
    out = out.unionByName(row(tests, "tests", F.lit(path), F.col("confidence")))
    together = tables["edges"].filter((F.col("kind") == "co_changes") & (F.col("from_key") == path)).select(F.col("to_key").alias("path"), "confidence", "weight")
    out = out.unionByName(row(together, "co_changes", F.col("weight"), F.col("confidence")))
    best = best_per_key(out.filter(F.col("path") != path), ["part", "path"], -F.col("score"), F.col("detail"))
    return top_k_per_group(best, "part", SHOWN, F.desc("score"), F.col("path"))


def impact_report(parts: DataFrame, most: int = 1000) -> DataFrame:
    """role, files, the first `most` paths and risk of impact_parts(): tests apart, other files by what their name says; the row `all` is of every file."""
    name = F.lower("path")
    role = first_of([(F.col("part").isin("tests") | F.col("path").rlike(TEST_DIR), "test"), *[(name.rlike(p), r) for r, p in ROLES]], "other")
    files = parts.select("path", role.alias("role")).distinct()
    whole = files.select("path", F.lit("all").alias("role")).distinct()
    every = files.unionByName(whole)
    counts = every.groupBy("role").agg(F.count("*").alias("files"))
    return counts.join(smallest(every, "role", "path", most, "paths"), "role").select("role", "files", "paths").withColumn("risk", risk_of(F.col("files")))
