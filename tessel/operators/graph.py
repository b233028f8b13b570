"""Edges, neighbours, bounded traversal, co-change pairs, snapshots and their comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .combinators import ROWS_A_TASK, dealt, kept

#: How much of a score passes along an edge of each kind; 0.5 for others.
KIND_WEIGHTS = {"covered_by": 1.0, "imports": 0.86, "contains": 0.72, "co_changes": 0.62}
MOST_FILES_PER_COMMIT, MOST_COMMITS, MOST_PAIRS = 30, 200, 1000
#: Edges of a node from which it is a hub, and the most hubs there may be (beyond that, hubs are nodes with more edges).
HUB, MOST_HUBS = 10_000, 100_000


def kind_weight(kind: Column) -> Column:
    return reduce(lambda out, kv: F.when(kind == kv[0], kv[1]).otherwise(out), KIND_WEIGHTS.items(), F.lit(0.5))


def oriented(edges: DataFrame, direction: str = "downstream") -> DataFrame:
    """u, v, kind, weight and confidence of edges as they are walked: downstream from -> to, upstream to -> from, or both."""
    forward = edges.select(F.col("from_key").alias("u"), F.col("to_key").alias("v"), "kind", "weight", "confidence")
    back = edges.select(F.col("to_key").alias("u"), F.col("from_key").alias("v"), "kind", "weight", "confidence")
    return {"downstream": forward, "upstream": back, "both": forward.unionByName(back)}[direction]


class Adjacency:
    """Steps (column u and others) whose hubs are dealt into parts of about `hub` steps, so that no task holds all steps of one node.

    Degrees are counted with partial sums; of hubs there are MOST_HUBS at most, which bounds what is broadcast. Without hubs nothing is dealt.
    """

    def __init__(self, steps: DataFrame, hub: int | None = None):
        hub = hub or HUB
        degrees = kept(steps.groupBy("u").agg(F.count("*").alias("_d")).filter(F.col("_d") > hub))
        total = degrees.agg(F.sum("_d").alias("n")).first()["n"]
        self.hubs, self.steps = None, steps
        if total:
            least = max(hub, -(-total // MOST_HUBS))
            self.hubs = degrees.filter(F.col("_d") > least).select(F.col("u").alias("_hub"), F.ceil(F.col("_d") / least).alias("_parts"))
            self.steps = self._with_parts(steps, "u").withColumn("_part", F.pmod(F.xxhash64(*steps.columns), F.col("_parts"))).drop("_parts")

    def _with_parts(self, df: DataFrame, node: str) -> DataFrame:
        return df.join(F.broadcast(self.hubs), F.col(node) == F.col("_hub"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long"))).drop("_hub")

    def out_of(self, front: DataFrame) -> DataFrame:
        """front (column node) joined with the steps of its nodes; a hub's row meets each of its parts."""
        if self.hubs is None:
            return front.join(self.steps, F.col("node") == F.col("u"))
        dealt = self._with_parts(front, "node").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
        return dealt.join(self.steps, (F.col("node") == F.col("u")) & (F.col("_at") == F.col("_part"))).drop("_at", "_part")


def traverse(edges: DataFrame, seeds: DataFrame, direction: str = "downstream", depth: int = 2, limit: int | None = None) -> DataFrame:
    """node, distance, score, confidence and chain of what is reached from seeds (one column, node) in at most depth steps.

    A node counts where it is first reached; of several ways of that length the best score wins, then confidence, then the smallest parent. Along an
    edge score is multiplied by its kind's weight and min(2, weight), confidence by its confidence. Each step is one join and one aggregation,
    checkpointed in the shared folder (cached where there is none); depth is small and known, so the number of jobs is too. Steps out of a hub are dealt
    into parts (Adjacency); steps into one combine before the shuffle.
    """
    steps = oriented(edges, direction).withColumn("_w", kind_weight(F.col("kind")) * F.least(F.lit(2.0), F.col("weight")))
    seen = seeds.select("node", F.lit(0).alias("distance"), F.lit(1.0).alias("score"), F.lit(1.0).alias("confidence"), F.array("node").alias("chain")).dropDuplicates(["node"])
    front, ways = seen, Adjacency(steps.select("u", "v", "_w", F.col("confidence").alias("_c")))
    for d in range(1, depth + 1):
        reached = ways.out_of(front).select(
            F.col("v").alias("node"), F.lit(d).alias("distance"), (F.col("score") * F.col("_w")).alias("score"), (F.col("confidence") * F.col("_c")).alias("confidence"), F.concat("chain", F.array("v")).alias("chain"), F.col("u").alias("_parent"),
        )
        new = reached.join(seen.select("node"), "node", "left_anti")
        rest = F.struct("distance", "score", "confidence", "chain")
        best = new.groupBy("node").agg(F.min_by(rest, F.struct(-F.col("score"), -F.col("confidence"), F.col("_parent"))).alias("r"))
        front = best.select("node", "r.distance", "r.score", "r.confidence", "r.chain")
        front = kept(front)
        seen = seen.unionByName(front)
    out = seen.filter("distance > 0")
    return out.orderBy(F.desc("score"), "distance", "node").limit(limit) if limit else out


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str, k: int | None = None) -> DataFrame:
    """One step from nodes (column node): node, neighbour, kind and confidence, strongest first; at most k for each node."""
    here, there = ("to_key", "from_key") if direction == "callers" else ("from_key", "to_key")
    found = kept(edges.join(nodes, edges[here] == nodes["node"]).select("node", F.col(there).alias("neighbour"), "kind", "confidence"))
    found = dealt(found, ROWS_A_TASK, "node", "neighbour").distinct()
    if k:
        w = Window.partitionBy("node").orderBy(F.desc("confidence"), "neighbour", "kind")
        found = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
    return found


def co_changes(changes: DataFrame, commit: str, item: str, most_items: int = MOST_FILES_PER_COMMIT, least: int = 1) -> DataFrame:
    """a, b and weight: unordered pairs of items that change in the same commit, and in how many.

    Commits with more than most_items are left out (a rule of the operator: they say little), which also bounds pairs per commit; they go before items are
    listed. Rows without a commit or an item say nothing. Changes are dealt by commit into tasks of a fixed number of rows, which bounds the pairs that a task counts before
    they are shuffled.
    """
    rows = changes.select(F.col(commit).alias("c"), F.col(item).alias("i")).filter("c IS NOT NULL AND i IS NOT NULL")
    items = dealt(rows, ROWS_A_TASK, "c").distinct().withColumn("_n", F.count("*").over(Window.partitionBy("c"))).filter(F.col("_n").between(2, most_items))
    sets = items.groupBy("c").agg(F.array_sort(F.collect_list("i")).alias("s"))
    one = sets.select("s", F.posexplode("s").alias("p", "a"))
    pairs = one.select("a", F.explode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def co_change_edges(pairs: DataFrame) -> DataFrame:
    """Both directions, as typed edges of confidence 0.65."""
    way = lambda x, y: pairs.select(F.lit("file").alias("from_type"), F.col(x).alias("from_key"), F.lit("file").alias("to_type"), F.col(y).alias("to_key"), F.lit("co_changes").alias("kind"), F.col("weight").cast("double").alias("weight"), F.lit(0.65).alias("confidence"))
    return way("a", "b").unionByName(way("b", "a"))


def equivalence(left: DataFrame, right: DataFrame, keys: list[str], section: str) -> DataFrame:
    """section, side (missing from right, extra in right), and the keys of rows that only one side has."""
    missing, extra = left.select(*keys).distinct(), right.select(*keys).distinct()
    null_safe = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    out = [a.join(b, null_safe(a, b), "left_anti").select(F.lit(section).alias("section"), F.lit(side).alias("side"), *keys) for side, a, b in (("missing", missing, extra), ("extra", extra, missing))]
    return out[0].unionByName(out[1])


def resolved_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """from_key, from_path, name, to_key, to_path, confidence and how each called name resolves.

    calls: from_key, file, name; symbols: key, file, name. A symbol of the same file wins (0.95), else the only one of that name (0.75), else the first
    of several (0.45). Symbols are reduced to one for each (name, file) and one for each name before any join, so common names don't multiply rows.
    """
    local = symbols.groupBy("name", "file").agg(F.min("key").alias("local_key"))
    whole = symbols.groupBy("name").agg(F.min(F.struct("file", "key")).alias("any"), F.count("*").alias("n"))
    distinct = calls.select("from_key", "file", "name").distinct()
    found = distinct.join(local, ["name", "file"], "left").join(whole, "name", "left")
    own = F.col("local_key").isNotNull()
    to, path = F.coalesce("local_key", "any.key"), F.when(own, F.col("file")).otherwise(F.col("any.file"))
    confidence = F.when(own, 0.95).when(F.col("n") == 1, 0.75).otherwise(0.45)
    how = F.when(own, "same_file").when(F.col("n") == 1, "unique_name").otherwise("ambiguous_name")
    return found.select("from_key", F.col("file").alias("from_path"), "name", to.alias("to_key"), path.alias("to_path"), confidence.alias("confidence"), how.alias("how")).filter("to_key IS NOT NULL AND to_key <> from_key")


def name_resolution(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """resolved_calls() without paths."""
    return resolved_calls(calls, symbols).drop("from_path", "to_path")


def moved_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """name of all names whose calls from other files resolve differently: another first symbol, or no longer one symbol only. Both: key, file, name."""
    rows = before.select("name", F.struct("file", "key").alias("_b"), F.lit(None).alias("_a")).unionByName(after.select("name", F.lit(None).alias("_b"), F.struct("file", "key").alias("_a")))
    both = rows.groupBy("name").agg(*[f(c).alias(f"{n}{c}") for c in ("_b", "_a") for n, f in (("min", F.min), ("n", F.count))])
    same = F.col("min_b").eqNullSafe(F.col("min_a")) & ((F.col("n_b") == 1) == (F.col("n_a") == 1))
    return both.filter(~same).select("name")
