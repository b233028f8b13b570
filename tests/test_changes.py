"""Readers of a real worktree, fingerprints of its contents, logs with state, and what bounded lists and classes of copies keep."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tessel.operators import combinators, duplicates, incremental, provenance
from tessel.plans import code_graph, context
from tessel.sources import changes


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    git(root, "init", "-q", "-b", "main")
    for name in ("a.py", "b b.py", "c.py", "d.py", "e.py"):
        (root / name).write_text(f"def f_{name[0]}():\n    return '{name} long enough to be found again'\n")
    os.symlink("a.py", root / "link")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    git(root, "checkout", "-qb", "work")
    (root / "a.py").write_text("def f_a():\n    return 2\n")
    git(root, "commit", "-qam", "two")
    git(root, "mv", "b b.py", "new name.py")
    (root / "c.py").write_text("def f_c():\n    return 3\n")
    (root / "d.py").unlink()
    (root / "é\n.py").write_text("x = 1\n")
    return root


def test_git_changes(spark, tree, tmp_path):
    found = changes.git_changes(spark, str(tree))
    assert found.merge_base and found.warning is None
    assert {tuple(r) for r in found.paths.collect()} == {("a.py", "committed"), ("new name.py", "staged"), ("c.py", "modified"), ("d.py", "modified"), ("é\n.py", "untracked")}
    other = changes.git_changes(spark, str(tree), "nowhere")
    assert other.merge_base is None and "nowhere" in other.warning and "committed" not in {r["state"] for r in other.paths.collect()}
    unborn = tmp_path / "unborn"
    unborn.mkdir()
    git(unborn, "init", "-q", "-b", "main")
    (unborn / "x.py").write_text("x = 1\n")
    git(unborn, "add", "x.py")
    (unborn / "y.py").write_text("y = 1\n")
    new = changes.git_changes(spark, str(unborn))
    assert {tuple(r) for r in new.paths.collect()} == {("x.py", "staged"), ("y.py", "untracked")} and "merge base" in new.warning
    none = changes.git_changes(spark, str(tmp_path / "missing"))
    assert none.paths.count() == 0 and "could not read" in none.warning and changes.worktree_entries(spark, str(tmp_path / "missing")) is None


def test_worktree_entries(spark, tree):
    rows = {r["path"]: r for r in changes.worktree_entries(spark, str(tree)).collect()}
    assert rows["new name.py"]["source"] == "b b.py" and rows["b b.py"]["sha256"] is None and rows["d.py"]["sha256"] is None and rows["é\n.py"]["state"] == "??"
    look = lambda: provenance.worktree_fingerprint(changes.worktree_entries(spark, str(tree)).drop("modified").withColumn("modified", F.lit(0)))
    whole = lambda: provenance.overall_fingerprint(look()).first()["fingerprint"]
    before, seen = {r["path"]: r["fingerprint"] for r in look().collect()}, [whole()]
    assert whole() == seen[0]

    def changed(*paths):
        after = {r["path"]: r["fingerprint"] for r in look().collect()}
        different = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
        assert different == set(paths)
        seen.append(whole())
        before.clear()
        before.update(after)

    (tree / "c.py").write_text("def f_c():\n    return 4\n")  # of the same size and state
    changed("c.py")
    (tree / "link").unlink()
    os.symlink("c.py", tree / "link")
    changed("link")
    (tree / "c.py").unlink()
    changed("c.py")
    git(tree, "mv", "e.py", "f.py")
    changed("e.py", "f.py")
    assert len(set(seen)) == len(seen)


def test_parse_status():
    assert changes.parse_status("R  new\0old\0 M a -> b\0?? c\0") == [("new", "R ", "old"), ("a -> b", " M", None), ("c", "??", None)] and changes.parse_status("") == []


def test_log(spark, tmp_path):
    store = incremental.VersionedStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError, match="nothing was logged"):
        store.log("x")
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v int")
    for k, v in (("a", 1), ("b", 2), ("a", 3)):
        store.append("x", row(k, v))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.log("x")) == [("a", 1), ("a", 3), ("b", 2)] and rows(store.latest("x", "k")) == [("a", 3), ("b", 2)]
    assert store.compact("x") == 3 and rows(store.log("x")) == [("a", 1), ("a", 3), ("b", 2)] and rows(store.latest("x", "k")) == [("a", 3), ("b", 2)]
    store.append("x", row("b", 5))
    assert store.compact("x", "k") == 2 and rows(store.log("x")) == rows(store.latest("x", "k")) == [("a", 3), ("b", 5)] and store.compact("x") == 0
    # a compaction that broke off before its list was written is not seen
    store.log("x").withColumn("_logged", F.lit(1)).write.parquet(f"file://{tmp_path}/s/logs/x/b-broken")
    assert rows(store.log("x")) == [("a", 3), ("b", 5)]


def test_sessions_and_results(spark, tree, tmp_path):
    p = code_graph.Project(spark, f"file://{tree}", f"file://{tmp_path}/store")
    assert p.load_session("x") is None
    p.scan()
    p.context(context.Task("change f_c", profile="brief", changed=["c.py"]))
    task = p.store.log("sessions").first()["task_id"]
    p.context(context.Task("change f_c", profile="brief", changed=["c.py"]))
    session = p.load_session(task)
    assert session["task"] == "change f_c" and session["boundary"]["must_edit"] == ["c.py"] and "c.py" in session["status"] and p.store.latest("sessions", "task_id").count() == 1
    for result in ("tried", "passed"):
        out = p.record_result("change f_c", task, result, validations=["pytest"], guard_output="c.py:1:2 bad", guard_command="check_all.py")["data"]
    assert "c.py" in out["changed"] and "a.py" not in out["changed"] and out["validation"] == ["pytest", "check_all.py"] and "Result: passed" in out["summary"]
    last = p.store.latest("results", "task_id").collect()
    assert [r["result"] for r in last] == ["passed"] and p.store.log("memory").count() == 2
    assert context.stored_memory(p.store.log("memory"), "change passed").first()["memory_type"] == "task_result"


def test_smallest_of_a_hot_group(spark):
    rows = spark.range(300_000).select(F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("g"), (F.col("id") * 7919 % 50_000).cast("string").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("none", None), ("hot", None)], rows.schema))
    got = {r["g"]: r["v"] for r in combinators.smallest(rows, "g", "v", 4).collect()}
    want = lambda keep: sorted({str(i * 7919 % 50_000) for i in range(300_000) if (i % 100 == 0) == keep})[:4]
    assert got == {"hot": want(False), "cold": want(True)}


@pytest.mark.parametrize("run", [3, 4096])
def test_token_links(spark, run, monkeypatch):
    import random

    monkeypatch.setattr(duplicates, "RUN", run)
    monkeypatch.setattr(duplicates.class_pairs, "__defaults__", (run,))
    rnd = random.Random(3)
    rows = [(i, ["all", *rnd.sample("abcdefgh", rnd.randrange(8))]) for i in range(60)] + [(100 + i, ["x", "all", "x"]) for i in range(5)] + [(200, []), (201, None)]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    sim = lambda x, y: len(x & y) / len(x | y)
    sets = {k: frozenset(t or []) for k, t in rows}
    got = {r["k"]: tuple(r)[1:] for r in duplicates.token_links(df, "k", "t", 0.6, 2).collect()}
    able = {k: s for k, s in sets.items() if len(s) >= 2}
    want = {k: (min(j for j in able if able[j] == s), sum(able[j] == s for j in able), sum(sim(s, able[j]) >= 0.6 for j in able) - 1) if k in able else (k, 1, 0) for k, s in sets.items()}
    assert got == want
    pairs = {(r["a"], r["b"]): r["similarity"] for r in duplicates.token_pairs(df, "k", "t", 0.6, 2).collect()}
    assert pairs == pytest.approx({(i, j): sim(able[i], able[j]) for i in able for j in able if i < j and sim(able[i], able[j]) >= 0.6})


def test_many_copies_and_a_token_of_all(spark):
    rows = spark.range(20_000).select("id", F.split(F.lit("all of one text with seven words"), " ").alias("t"))
    rows = rows.unionByName(spark.range(20_000, 21_000).select("id", F.array(F.lit("all"), *[F.concat(F.lit(f"{i}-"), F.col("id").cast("string")) for i in range(5)]).alias("t")))
    got = duplicates.token_links(rows, "id", "t", 0.8, 5).groupBy("class_size", "links").count().collect()
    assert {tuple(r) for r in got} == {(20_000, 19_999, 20_000), (1, 0, 1_000)}
