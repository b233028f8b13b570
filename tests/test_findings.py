"""What reviews found to grow too fast or to be cut."""

import random

import pytest
from pyspark.sql import functions as F

from tessel.operators import duplicates, graph, planning
from tessel.plans import code_graph


def shuffled(spark, run) -> float:
    """MB that the stages of run() write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total() -> int:
        none = spark._jvm.java.util.ArrayList
        stages = store.stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return (total() - before) / 1e6


def test_pairs_of_near_copies_carry_no_sets(spark):
    rng = random.Random(5)
    base = [f"{rng.getrandbits(60):x}" for _ in range(600)]
    rows = [(i, [*base[:i], *base[i + 1 :], f"own{i}"]) for i in range(150)]
    df, got = spark.createDataFrame(rows, "k int, t array<string>"), []
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for limit in limits:
        spark.conf.set(limit, "-1")  # as for tables too large to be broadcast
    mb = shuffled(spark, lambda: got.extend(duplicates.token_pairs(df, "k", "t", 0.8, 5).collect()))
    for limit in limits:
        spark.conf.unset(limit)
    assert len(got) == 150 * 149 // 2 and {round(r["similarity"], 12) for r in got} == {round(598 / 602, 12)}
    assert mb < 10  # 11,175 pairs of 600 tokens; with a set for each pair it is more than 50


@pytest.mark.parametrize("least", [0.4, 0.8])
def test_pairs_of_sets_of_many_sizes(spark, least):
    rng = random.Random(7)
    sets = [sorted(rng.sample([f"w{i}" for i in range(300)], rng.choice((3, 20, 60, 64, 65, 130, 250)))) for _ in range(40)]
    for t in list(sets):
        sets += [sorted(set(t) - set(rng.sample(t, len(t) // rng.choice((3, 5, 10, 20)))) | {f"x{rng.randrange(50)}"}) for _ in range(2)]
    got = {(r["a"], r["b"]): round(r["similarity"], 12) for r in duplicates.token_pairs(spark.createDataFrame(list(enumerate(sets)), "k int, t array<string>"), "k", "t", least).collect()}
    alike = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(i, j): alike(x, y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j}
    assert got == {k: round(v, 12) for k, v in want.items() if v >= least}


def test_sets_that_share_a_rare_token_but_are_not_alike_make_no_pairs_to_shuffle(spark):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, [*rng.sample(common, 39), f"group{i % 2}", f"own{i}"]) for i in range(3000)]
    df, got = spark.createDataFrame(rows, "k int, t array<string>"), []
    mb = shuffled(spark, lambda: got.extend(duplicates.token_links(df, "k", "t", 0.95, 5).collect()))
    sets = [frozenset(t) for _, t in rows]
    assert len(got) == 3000 and all(r["links"] == 0 for r in got if not any(len(sets[r["k"]] ^ x) <= 4 for x in sets if x is not sets[r["k"]]))
    assert mb < 8  # 2.2 million pairs share a rare token; 13.7 MB when those that sizes and places allow were shuffled


def test_pairs_in_rounds_and_blocks(spark, monkeypatch):
    """Many rounds and blocks, few known tokens, text keys, copies, and near copies in more than one home."""
    for name, value in (("ROUND", 1), ("ROUNDS", 3), ("BLOCK", 4), ("KNOWN", 16)):
        monkeypatch.setattr(duplicates, name, value)
    rng = random.Random(13)
    base = [[f"w{rng.randrange(90)}" for _ in range(n)] for n in (12, 40, 70)]
    sets = [sorted(set(t[:j] + t[j + 1 + rng.randrange(3) :]) | {f"x{rng.randrange(30)}"}) for t in base for j in range(0, len(t), 2)] * 2 + [["a"], []]
    rows = [(f"k{i:03}", t) for i, t in enumerate(sets)]
    df = spark.createDataFrame([*rows, ("null", None)], "k string, t array<string>")
    alike = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(i, j): v for i, x in rows for j, y in rows if i < j and min(len(x), len(y)) >= 2 and (v := alike(x, y)) >= 0.8}
    got = {(r["a"], r["b"]): r["similarity"] for r in duplicates.token_pairs(df, "k", "t", 0.8, 2).collect()}
    assert got == want and len(want) > 500
    links = {r["k"]: r["links"] for r in duplicates.token_links(df, "k", "t", 0.8, 2).collect()}
    assert links == {k: sum(k in p for p in want) for k in [k for k, _ in rows] + ["null"]}


def test_pairs_of_copies_are_written_out_from_lists(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "LISTED", 10)
    rows = [(1000 * i + j, [*(f"w{n}" for n in range(20)), f"own{i}"]) for i in range(4) for j in range(200)]
    df, got = spark.createDataFrame(rows, "k int, t array<string>"), []
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for limit in limits:
        spark.conf.set(limit, "-1")
    pairs = duplicates.token_pairs(df, "k", "t", 0.8, 5)
    mb = shuffled(spark, lambda: got.extend(tuple(r) for r in pairs.collect()))
    for limit in limits:
        spark.conf.unset(limit)
    assert sorted(got) == [(a, b, 1.0 if a // 1000 == b // 1000 else 20 / 22) for a, _ in rows for b, _ in rows if a < b]
    assert mb < 0.1


def test_edit_boundary_has_all_paths(spark):
    tiers = spark.range(2500).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") < 1200, "must_edit").otherwise("may_inspect").alias("tier"))
    row = planning.edit_boundary(tiers).first()
    assert list(row["must_edit"]) == sorted(f"f{i}" for i in range(1200)) and list(row["may_inspect"]) == sorted(f"f{i}" for i in range(1200, 2500))
    assert len(planning.edit_boundary(tiers, 10).first()["must_edit"]) == 10


def test_a_tree_in_one_partition_is_read_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(code_graph, "FILES_A_TASK", 40)
    text = F.concat(F.lit("def helper_"), "id", F.lit("(x):\n    return run(x)"))
    files = spark.range(0, 400, 1, 1).select(F.concat(F.lit("src/f"), "id", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.length(text).cast("long").alias("size"), F.sha1(text).alias("hash"), text.alias("text"))
    made = code_graph.build(files)
    assert made["code_blocks"].count() == made["symbols"].count() == 400
    assert len(made["code_blocks"].inputFiles()) == len(made["symbols"].inputFiles()) == 10


def test_neighbours_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS_A_TASK", 100)
    edges = spark.range(2000).select((F.col("id") % 50).alias("from_key"), F.col("id").alias("to_key"), F.lit("calls").alias("kind"), F.lit(0.5).alias("confidence"))
    found = graph.neighbours(edges, spark.range(50).withColumnRenamed("id", "node"), "callees")
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString() and found.rdd.getNumPartitions() == 20
    assert found.count() == 2000


def test_co_changes_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks of a fixed number of rows; neither a large commit nor rows without a commit or an item make pairs."""
    monkeypatch.setattr(graph, "ROWS_A_TASK", 100)
    rows = [(c, i) for c in range(400) for i in (c % 7, c % 5 + 10, c % 5 + 10, c + 100)] + [(999, i) for i in range(50)] + [(None, 1), (None, 2), (5, None)]
    changes = spark.createDataFrame(rows, "c long, i long")
    found = graph.co_changes(changes, "c", "i")
    plan = found._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(c#" in plan and ", 17)" in plan
    want: dict[tuple, int] = {}
    for c in range(400):
        own = sorted({c % 7, c % 5 + 10, c + 100})
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["weight"] for r in found.collect()} == want
