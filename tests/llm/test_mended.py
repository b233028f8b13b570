"""What earlier rounds got wrong: whole articles lost to class names, clashing columns, a language whose rows share an id."""

import pytest
from pyspark.sql import functions as F

from tessel.llm import common, decontamination, html_extraction, jaccard_join, language_id


@pytest.mark.parametrize(
    "html",
    [
        "<div class='no-sidebar'><article><p>Body text</p></article></div>",
        "<div class='content has-sidebar'><article><p>Body text</p></article></div>",
        "<form id='aspnetForm'><div><article><p>Body text</p></article></div></form>",
        "<main><div data-id='share-7'><p>Body text</p></div></main>",
        "<main><div title='class=nav'><p>Body text</p></div></main>",
        "<article><p class='form-of-address'>Body text</p></article>",
        "<article><section id='related-work'>Body text</section></article>",
        "<article><section class='search-algorithms'>Body text</section></article>",
        "<article><p>Body text</p><div class='related-posts'>x</div><div class='cookie-banner'>x</div><aside><article>x</article></aside><form><p>x</p></form><div id='article-comments'>x</div></article>",
        "<nav><article>x</article></nav><div class='related'><article>x</article></div><article>Body text</article>",
    ],
)
def test_articles_stay(spark, html):
    assert " ".join(b.text for b in html_extraction.slots(html_extraction.parse(html)[0])) == "Body text"
    rows = spark.createDataFrame([(1, "http://h/a", html)], "page_id long, url string, html string")
    assert html_extraction.extract(rows).first()["text"] == "Body text"


CLASH = ("_hash", "_length", "_l", "_drop", "_s", "_p", "_row", "_w", "_d", "_h")


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in CLASH:
        df = df.withColumn(c, F.concat(F.lit("own "), F.col("doc_id").cast("string")))
    return df


def test_clashing_columns_survive(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words), "en"), (2, " ".join([*words[:39], "x"]), "en"), (3, "the cat sat on the mat and so on", "en"), (4, "one two three four five six seven eight nine ten", "en")]
    docs = clashing(spark, rows)
    own = lambda df: {r["doc_id"]: {r[c] for c in CLASH} for r in df.collect()}
    bench = spark.createDataFrame([(7, "One two three four five six seven eight nine ten!")], "item_id long, text string")
    clean, cut = decontamination.clean_documents(docs, bench), decontamination.without_spans(docs, bench)
    single = jaccard_join.without_near_copies(docs)
    known = language_id.accepted(docs, 0.0)
    assert own(clean) == {i: {f"own {i}"} for i in (1, 2, 3)} and own(single) == {i: {f"own {i}"} for i in (1, 3, 4)}
    assert own(cut) == own(known) == {i: {f"own {i}"} for i in (1, 2, 3, 4)} and {r["doc_id"]: r["text"] for r in cut.collect()}[4] == ""
    assert all(df.columns == docs.columns for df in (clean, cut, single, known))


def test_a_language_of_one_id_is_learned(spark):
    rows = [(7, f"zug zwo zaan zeer zicht {i % 50}", "xx") for i in range(2500)] + [(i, "the cat and the dog and the house", "en") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(~language_id.is_held_out("doc_id"))
    docs = docs.unionByName(spark.createDataFrame([(7, rows[0][1], "xx")] * 5, docs.schema)) if docs.filter("lang = 'xx'").isEmpty() else docs
    model = language_id.fit(docs)
    assert model["langs"] == ["en", "xx"]
    got = spark.createDataFrame([("zug zeer zicht",), ("the dog",)], "t string").select(language_id.language(F.col("t"), model, spark)["lang"]).collect()
    assert [r[0] for r in got] == ["xx", "en"]


def test_equal_rows_of_a_language_are_learned(spark):
    docs = spark.createDataFrame([(8, "zug zwo zaan", "xx")] * 3000 + [(9, "the cat", "en")] * 10, "doc_id long, text string, lang string")
    assert language_id.language(F.lit("zug zaan"), language_id.fit(docs), spark) is not None
    model = language_id.fit(docs)
    assert all(len(rows) for rows in model["rows"][:1]) and "zug" in model["index"][0]


def test_clearing_is_of_its_own_thread(spark):
    import threading

    seen = []
    with common.clearing(spark):
        other = threading.Thread(target=lambda: seen.append(list(common._MADE.open)))
        other.start()
        other.join()
        assert len(common._MADE.open) == 1
    assert seen == [[]]
