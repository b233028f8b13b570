import random

import pytest
from pyspark.sql import functions as F

from tessel.operators import combinators, duplicates, graph, incremental


def edges(spark, rows):
    return spark.createDataFrame([("file", a, "file", b, kind, 1.0, 0.9) for a, b, kind in rows], "from_type string, from_key string, to_type string, to_key string, kind string, weight double, confidence double")


def test_chain_of_imports(spark):
    e = edges(spark, [("b", "a", "imports"), ("c", "b", "imports")])
    seed = spark.createDataFrame([("a",)], "node string")
    near = graph.traverse(e, seed, "upstream", 1).collect()
    far = {r["node"]: r for r in graph.traverse(e, seed, "upstream", 2).collect()}
    assert [r["node"] for r in near] == ["b"]
    assert far["c"]["distance"] == 2 and far["c"]["chain"] == ["a", "b", "c"] and far["c"]["score"] == pytest.approx(0.86**2)


@pytest.mark.parametrize("seed", range(3))
def test_traverse_against_plain_search(spark, seed):
    rnd = random.Random(seed)
    rows = sorted({(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}", "imports") for _ in range(20)})
    e = edges(spark, rows)
    got = {r["node"]: r["distance"] for r in graph.traverse(e, spark.createDataFrame([("n0",)], "node string"), "both", 3).collect()}
    want, front, seen = {}, {"n0"}, {"n0"}
    for d in range(1, 4):
        front = {b for a, b, _ in rows if a in front} | {a for a, b, _ in rows if b in front}
        front -= seen
        seen |= front
        want |= dict.fromkeys(front, d)
    assert got == want


def test_name_resolution(spark):
    calls = spark.createDataFrame([("k1", "f1", "own"), ("k1", "f1", "only"), ("k1", "f1", "many"), ("k1", "f1", "none")], "from_key string, file string, name string")
    known = spark.createDataFrame([("o1", "f1", "own"), ("o2", "f2", "own"), ("u", "f3", "only"), ("m2", "f5", "many"), ("m1", "f4", "many")], "key string, file string, name string")
    got = {r["name"]: (r["to_key"], r["confidence"]) for r in graph.name_resolution(calls, known).collect()}
    assert got == {"own": ("o1", 0.95), "only": ("u", 0.75), "many": ("m1", 0.45)}


def test_co_changes(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), *[(4, f"x{i}") for i in range(31)]], "c int, i string")
    got = {(r["a"], r["b"]): r["weight"] for r in graph.co_changes(rows, "c", "i").collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


def test_equivalence_with_nulls(spark):
    a, b = spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), spark.createDataFrame([(1, None), (3, "x")], "k int, v string")
    assert {(r["side"], r["k"]) for r in graph.equivalence(a, b, ["k", "v"], "s").collect()} == {("missing", 2), ("extra", 3)}


@pytest.mark.parametrize("seed", range(2))
def test_token_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.sample("abcdefghij", rnd.randrange(1, 9))) for i in range(40)]
    got = {(r["a"], r["b"]): r["similarity"] for r in duplicates.token_pairs(spark.createDataFrame(rows, "k int, t array<string>"), "k", "t", 0.6).collect()}
    sim = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = {(i, j): sim(x, y) for i, x in rows for j, y in rows if i < j and sim(x, y) >= 0.6}
    assert got == pytest.approx(want)


def test_combinators(spark):
    df = spark.createDataFrame([("a", 1.0, 1, ["x"], 2), ("a", 3.0, 2, ["y", "x"], 1), ("b", 3.0, 3, ["z"], 3)], "k string, score double, o int, evidence array<string>, tier_rank int")
    assert {(r["k"], r["o"]) for r in combinators.best_per_key(df, "k", -F.col("score"), F.col("o")).collect()} == {("a", 2), ("b", 3)}
    assert {(r["k"], r["o"]) for r in combinators.first_per_key(df, "k", "o").collect()} == {("a", 1), ("b", 3)}
    assert {(r["k"], r["o"]) for r in combinators.last_per_key(df, "k", "o").collect()} == {("a", 2), ("b", 3)}
    m = {r["k"]: r for r in combinators.merge_per_key(df, "k").collect()}
    assert (m["a"]["score"], m["a"]["evidence"], m["a"]["tier_rank"]) == (3.0, ["x", "y"], 1)
    t = {r["k"]: r["t"] for r in combinators.merge_text(df.withColumn("t", F.concat("k", F.col("o").cast("string"))), "k", "t", "o").collect()}
    assert t["a"] == "a1 Also: a2"


def test_plans(spark):
    diff = lambda n, path: incremental.planes(spark.createDataFrame([(f"{path}{i}", "new") for i in range(n)], "path string, status string"), "path")
    assert incremental.choose_plan(diff(0, "src/")) == "none"
    assert incremental.choose_plan(diff(3, "docs/")) == "lightweight"
    assert incremental.choose_plan(diff(20, "src/")) == "partial" and incremental.choose_plan(diff(21, "src/")) == "batch_partial" and incremental.choose_plan(diff(101, "src/")) == "full"
    assert incremental.choose_plan(diff(1, "src/"), True) == "full"


def test_versions(spark, tmp_path):
    store = incremental.VersionedStore(spark, f"file://{tmp_path}/g")
    assert store.tables() == {}
    store.publish({"t": spark.createDataFrame([(1,)], "a int")})
    bad = spark.createDataFrame([("x",)], "a string").select(F.raise_error(F.lit("broken")).alias("a"))
    with pytest.raises(Exception, match="broken"):
        store.publish({"t": bad})
    assert store.tables()["t"].collect()[0]["a"] == 1
    store.publish({"t": spark.createDataFrame([(2,)], "a int")})
    assert store.tables()["t"].collect()[0]["a"] == 2


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(incremental.upsert(old, new.distinct(), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(incremental.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    cat = spark.createDataFrame([("a", None), ("b", None)], "path string, deleted_at string")
    gone = spark.createDataFrame([("a",)], "path string")
    assert rows(incremental.soft_delete(cat, gone, "path", "now")) == [("a", "now"), ("b", None)]
