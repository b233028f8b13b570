"""Traversal past hubs, and answers of outside indexes as a table."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessel.operators import graph, impact, provenance


def test_star_and_chain(spark):
    star = spark.range(200_000).select(F.lit("hub").alias("from_key"), F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("to_key"))
    back = spark.range(0, 200_000, 4).select(F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("from_key"), F.lit("sink").alias("to_key"))
    chain = spark.createDataFrame([("start", "c1"), ("c1", "hub"), ("sink", "c2"), ("c2", "start")], "from_key string, to_key string")
    edges = star.unionByName(back).unionByName(chain).select("*", F.lit("imports").alias("kind"), F.lit(1.0).alias("weight"), F.lit(0.5).alias("confidence"))
    seed = spark.createDataFrame([("start",)], "node string")
    out = graph.traverse(edges, seed, "downstream", 5)
    assert {tuple(r) for r in out.groupBy("distance").count().collect()} == {(1, 1), (2, 1), (3, 200_000), (4, 1), (5, 1)}
    sink = out.filter("node = 'sink'").first()
    assert sink["chain"] == ["start", "c1", "hub", "leaf0", "sink"] and sink["score"] == pytest.approx(0.86**4) and sink["confidence"] == 0.5**4
    calls = edges.select(F.col("from_key").alias("from_symbol"), F.col("to_key").alias("to_symbol"))
    hops = impact.trace(calls, seed, "callees", 4)
    assert {tuple(r) for r in hops.groupBy("hop").count().collect()} == {(1, 1), (2, 1), (3, 200_000), (4, 1)} and hops.filter("node = 'sink'").first()["via"] == "leaf0"
    assert impact.trace(calls, spark.createDataFrame([("c2",)], "node string"), "callers", 2).count() == 1 + 50_000


def test_hubs_are_dealt_into_parts(spark):
    steps = spark.range(40_000).select(F.when(F.col("id") < 30_000, "hub").otherwise(F.concat(F.lit("n"), (F.col("id") % 5_000).cast("string"))).alias("u"), F.col("id").cast("string").alias("v"))
    ways = graph.Adjacency(steps, 500)
    assert [tuple(r) for r in ways.hubs.collect()] == [("hub", 60)]
    sizes = [r["count"] for r in ways.steps.repartition(8, "u", "_part").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 40_000 / 8
    front = spark.createDataFrame([("hub", 1), ("n3", 2), ("lost", 3)], "node string, x int")
    want = steps.filter("u IN ('hub', 'n3')")
    got = ways.out_of(front)
    assert got.count() == want.count() == got.select("u", "v").intersect(want).count() and set(got.columns) == {"node", "x", "u", "v"}
    assert graph.Adjacency(steps, 30_000).hubs is None and graph.Adjacency(steps.limit(0)).out_of(front).count() == 0


def test_traversal_is_the_same_with_and_without_hubs(spark, monkeypatch):
    rnd = random.Random(5)
    pairs = {(f"n{rnd.choice([0, 1, rnd.randrange(60)])}", f"n{rnd.choice([0, 1, rnd.randrange(60)])}") for _ in range(260)}
    edges = spark.createDataFrame([(a, b, rnd.choice(["imports", "contains", "x"]), 1.0, 0.9) for a, b in sorted(pairs)], "from_key string, to_key string, kind string, weight double, confidence double")
    seed = spark.createDataFrame([("n7",), ("n7",)], "node string")
    rows = lambda: sorted((r["node"], r["distance"], round(r["score"], 9), tuple(r["chain"])) for r in graph.traverse(edges, seed, "both", 3).collect())
    plain = rows()
    monkeypatch.setattr(graph, "HUB", 5)
    assert rows() == plain
    near, front, seen = defaultdict(set), {"n7"}, {"n7": 0}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for d in (1, 2, 3):
        front = {w for v in front for w in near[v]} - seen.keys()
        seen |= dict.fromkeys(front, d)
    assert {(n, d) for n, d, *_ in plain} == {(n, d) for n, d in seen.items() if d}
    degrees = Counter(v for a, b in pairs for v in (a, b))
    assert sum(n > 5 for n in degrees.values()) >= 2


ANSWERS = [
    {"cols": ["name", "qn", "label", "file", "lines", "score"], "rows": [["f", "m.f", "Function", "m.py", "3-9", 1.5], [None, "m.g", None, "", "7", 2], ["h"], ["i", "", "", "x.py", "a-b", None]]},
    {"cols": ["lines", "name", "rank", "file"], "groups": [{"qn_prefix": "p.q", "file": "f.py", "rows": [["1-2", "x", 3, None], [None, "y", 0.5, "own.py"]]}, {"rows": [["5", "z"]]}, {"qn_prefix": "", "rows": []}]},
    {"cols": ["qualified_name", "name", "name"], "rows": [["a.b", "first", "last"], ["a.c", "only"]], "file": "not this", "groups": 3},
    {"cols": ["name"], "rows": []},
    {"cols": ["name", "score", "rank"], "rows": [["s", None, 4], ["t", 1]]},
    {"cols": ["name"], "groups": []},
]


def test_symbol_table_against_one_answer_at_a_time(spark):
    rows = [(i, json.dumps(a)) for i, a in enumerate(ANSWERS)]
    good, bad = provenance.symbol_table(spark.createDataFrame(rows, "id int, answer string"), "id", "answer")
    columns = ("name", "qualified_name", "kind", "path", "start_line", "end_line", "score")
    got = [(r["id"], *(r[c] for c in columns)) for r in good.orderBy("id", "part", "place").collect()]
    assert got == [(i, *(r[c] or None if c == "path" else r[c] for c in columns)) for i, a in rows for r in provenance.symbol_rows(a)] and bad.count() == 0


def test_symbol_table_keeps_what_it_cannot_read(spark):
    texts = [None, "", "nope", "[1]", "3", '{"cols": [], "rows": []}', '{"cols": "x", "rows": [[1]]}', '{"cols": ["name"], "rows": 3}', '{"cols": ["name"], "groups": [{"rows": 3}, 4, {"rows": [["ok"], 5, [""], [], [null]]}]}']
    good, bad = provenance.symbol_table(spark.createDataFrame(list(enumerate(texts)), "id int, answer string"), "id", "answer")
    assert [(r["id"], r["part"], r["place"], r["name"]) for r in good.collect()] == [(8, 2, 0, "ok")]
    shape = "an answer needs cols and rows or groups"
    want = [(i, None, None, shape) for i in range(8)] + [(8, 0, None, "a group needs rows"), (8, 1, None, "a group needs rows"), (8, 2, 1, "a row is not an array"), *[(8, 2, i, "a row has no symbol name") for i in (2, 3, 4)]]
    assert sorted(map(tuple, bad.collect()), key=str) == sorted(want, key=str)
    for text in texts[2:]:
        with pytest.raises((ValueError, AttributeError)):
            provenance.symbol_rows(text)
    none = provenance.symbol_table(spark.createDataFrame([], "id int, answer string"), "id", "answer")
    assert [df.count() for df in none] == [0, 0]
