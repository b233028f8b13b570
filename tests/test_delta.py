"""Updates by delta: what is written, what is not, and that answers equal a full build's."""

import pytest
from pyspark.sql import functions as F

from tessel.operators import graph, incremental, search
from tessel.plans import code_graph, delta

FILES = {f"src/m{i % 3}/f{i}.py": f"from src.m{(i + 1) % 3}.f{i + 1} import go\n\ndef go_{i}(n):\n    return go_{i + 1}(n)\n\ndef same(n):\n    return helper(n)\n" for i in range(40)}
FILES |= {"src/m0/util.py": "def helper(n):\n    return n\n", "src/m9/other.py": "def lonely():\n    return 1\n", "tests/test_f3.py": "def test_it():\n    go_3(1)\n", "README.md": "# App\n- You must test\n", ".tessel/eval/basic.json": '{"cases": []}'}


def frame(spark, texts):
    df = spark.createDataFrame(sorted(texts.items()), "path string, text string")
    return df.select("path", code_graph.language_of(F.col("path")).alias("language"), F.octet_length("text").cast("long").alias("size"), F.sha1("text").alias("hash"), "text")


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    store = delta.GraphStore(spark, f"file://{tmp_path_factory.mktemp('graph')}")
    store.FILES, store.LEAST = 2, 16
    store.publish(code_graph.build(frame(spark, FILES)))
    return store


def folders(store):
    return {(r["name"], r["bucket"]): r["folder"] for r in store._folders()}


def test_advance_writes_touched_buckets_only(spark, published):
    before = folders(published)
    texts = FILES | {"src/m9/other.py": "def lonely():\n    return 2\n\ndef more():\n    return lonely()\n"}
    found, plan = delta.changes(published.tables(), frame(spark, texts))
    assert plan == "partial" and "tests" not in found.whole and "modules" not in found.whole
    published.advance(found)
    after = folders(published)
    moved = {k for k in after if before.get(k) != after[k]}
    assert {n for n, _ in moved} <= set(found.rows) and len([k for k in moved if k[0] == "symbols"]) == 1 and len([k for k in moved if k[0] == "symbol_edges"]) == 1
    assert code_graph.differences(code_graph.build(frame(spark, texts)), published.tables()).collect() == []
    assert delta.changes(published.tables(), frame(spark, texts))[1] == "none"


def test_removed_renamed_and_shadowed(spark, published):
    """A helper that all call moves, a file that others import goes, and a second symbol of a name appears."""
    texts = {k: v for k, v in FILES.items() if k not in ("src/m0/util.py", "src/m1/f7.py", "tests/test_f3.py")} | {"src/a/util.py": FILES["src/m0/util.py"], "src/a/z.py": "def lonely():\n    go_5(1)\n", "tests/test_other.py": "def test_x():\n    lonely()\n"}
    found, plan = delta.changes(published.tables(), frame(spark, texts))
    assert plan == "partial"
    published.advance(found)
    now, want = published.tables(), code_graph.build(frame(spark, texts))
    assert code_graph.differences(want, now).collect() == []
    for name in ("calls", "clusters", "members", "commands", "modules", "lengths"):
        columns = want[name].columns
        assert graph.equivalence(want[name], now[name], columns, name).collect() == [], name
    plain = ["term", "symbol_key", "path", "words", "times"]
    assert graph.equivalence(want["postings"].select(plain), now["postings"].select(plain), plain, "postings").collect() == []
    assert published.vacuum() > 0 and code_graph.differences(want, published.tables()).collect() == []


def test_metadata_advances_once(spark, tmp_path):
    store = delta.GraphStore(spark, f"file://{tmp_path}/g")
    store.publish(code_graph.build(frame(spark, FILES)))
    texts = FILES | {".tessel/eval/basic.json": '{"cases": [1]}'}
    found, plan = delta.changes(store.tables(), frame(spark, texts))
    if plan == "metadata_only":
        assert set(found.rows) == {"files", "commands", "documents"}
    assert plan in ("metadata_only", "lightweight")
    store.advance(found)
    assert delta.changes(store.tables(), frame(spark, texts))[1] == "none"
    gone = {k: v for k, v in texts.items() if not k.startswith(".tessel")}
    store.advance(delta.changes(store.tables(), frame(spark, gone))[0])
    assert delta.changes(store.tables(), frame(spark, gone))[1] == "none"


def test_index_reads_its_terms_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} " + "filler " * (i % 5)) for i in range(60)] + [(99, None), (100, "")], "k long, text string")
    store = incremental.BucketStore(spark, f"file://{tmp_path}/i", 16)
    store.KEYS = {"postings": "term", "lengths": "k"}
    store.publish({"postings": search.postings(docs, "k", F.col("text"), "k"), "lengths": search.lengths(docs, F.col("text"), "k")})
    t = store.tables()
    index = search.Index(t["postings"], t["lengths"], "k")
    for query in ("word3 other1", "filler", "nothing here", "word1 word1 WORD2"):
        got, want = ([(r["k"], round(r["score"], 9)) for r in df.collect()] for df in (index.bm25(query, 15), search.bm25(docs, "k", F.col("text"), query, 15)))
        assert got == want
    plan = index.bm25("word3", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert search.is_index(t["postings"]) and not search.is_index(search.postings(docs, "k", F.col("text"), "k"))


def test_moved_names(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "key string, file string, name string")
    before = rows(("k1", "a", "kept"), ("k2", "b", "alone"), ("k3", "c", "gone"), ("k4", "d", "two"), ("k5", "e", "two"))
    after = rows(("k1", "a", "kept"), ("k2", "b", "alone"), ("k9", "z", "alone"), ("k4", "d", "two"), ("k5", "e", "two"), ("k6", "f", "two"), ("k7", "g", "new"))
    assert {r[0] for r in graph.moved_names(before, after).collect()} == {"alone", "gone", "new"}


def test_an_update_of_the_index_costs_what_changes(spark, tmp_path):
    """Documents that go and come are a layer: no file of the layers below is written anew, until there are too many layers."""
    text = F.col("text")
    frame_of = lambda d: spark.createDataFrame(sorted(d.items()), "k long, text string")
    texts = {i: f"word{i % 7} other{i % 3} " + "filler " * (i % 5) for i in range(60)}
    store = incremental.BucketStore(spark, f"file://{tmp_path}/i", 4)
    store.KEYS, store.MOST_LAYERS = {"postings": "term", "lengths": "k"}, 3
    store.publish({"postings": search.postings(frame_of(texts), "k", text, "k"), "lengths": search.lengths(frame_of(texts), text, "k")})
    folders = lambda: {r["folder"] for r in store._folders() if r["name"] == "postings" and r["folder"]}
    before = folders()
    for step in range(5):
        gone = [i for i in texts if i % 5 == step]
        new = {i: f"word{i % 4} fresh{step}" for i in gone if i % 2} | {1000 + step: "word3 filler", **({1000: "other1 filler filler"} if step == 1 else {})}
        texts = {i: t for i, t in texts.items() if i not in gone} | new
        keys = spark.createDataFrame([(i,) for i in {*gone, *new}], "k long")
        store.advance(incremental.Delta(gone={"postings": keys, "lengths": keys}, rows={"postings": search.postings(frame_of(new), "k", text, "k"), "lengths": search.lengths(frame_of(new), text, "k")}))
        assert (before <= folders()) == (step < 3)
        if step == 2:  # by the buckets' key, on top of layers
            word = spark.createDataFrame([("fresh1", 1)], "term string, k long")
            store.advance(incremental.Delta(gone={"postings": word}, rows={"postings": spark.sql("SELECT 'fresh1' AS term, 1L AS k, 2 AS words, 1L AS times")}))
            before = {f for f in before if f in folders()}
        store.vacuum()
        t = store.tables()
        index = search.Index(t["postings"], t["lengths"], "k")
        for query in ("word3 other1", "filler fresh1"):
            got, want = ([(r["k"], round(r["score"], 9)) for r in df.collect()] for df in (index.bm25(query, 100), search.bm25(frame_of(texts), "k", text, query, 100)))
            assert got == want
    plan = index.bm25("word3", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") + plan.count("PartitionFilters: [(bucket") >= len({r["layer"] for r in store._folders() if r["name"] == "postings"})


def test_postings_are_counted_where_texts_are_read(spark):
    texts = ["One one  ONE-two", None, "", "été 1st\u2003x\x1cy\x00z", "same word", "same word", "Kelvin \u212a K"] + [" ".join(f"w{i}" for i in range(n)) for n in (5, 40)]
    docs = spark.createDataFrame([(i, f"g{i % 2}", t) for i, t in enumerate(texts)] + [(4, "g0", "same word")], "k long, g string, text string")
    got = search.postings(docs, "k", F.col("text"), "g")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    each = docs.select("k", "g", F.size(search.words_of(F.col("text"))).alias("words"), F.posexplode(search.words_of(F.col("text"))).alias("_", "term"))
    want = each.groupBy("term", "k", "g", "words").agg(F.count("*").alias("times"))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.groupBy("term", "k", "g", "words").agg(F.sum("times")).collect())) == sorted(map(tuple, want.collect()))
    sizes = docs.groupBy("g").agg(F.count("*"), F.sum(F.size(search.words_of(F.col("text")))))
    assert sorted(map(tuple, search.lengths(docs, F.col("text"), "g").collect())) == sorted(map(tuple, sizes.collect()))


def test_the_rows_of_one_term_are_written_in_parts(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("often").alias("term"), F.col("id").alias("k"), F.lit(1).alias("words"), F.lit(1).cast("long").alias("times"))
    store = incremental.BucketStore(spark, f"file://{tmp_path}/i", 2)
    store.KEYS = {"postings": "term"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.publish({"postings": rows})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = store.tables()["postings"]
    assert len(found.inputFiles()) == 4 and found.select("k").distinct().count() == 4000  # all four tasks have some
