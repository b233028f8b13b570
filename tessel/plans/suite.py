"""Discovery for a table of tasks at once: the answers of code_graph.discover() for every task of a suite, in a number of jobs that doesn't grow with it.

Tasks are rows. A task's words meet the texts of files, symbols, commands and blocks by equi-joins on runs of characters, on terms and on code words, and the
best rows of a task are group limits. Entry points alone are scored for all tasks, since a route counts without a word in common: a stated set of questions
against all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Intent, first_of
from ..functions.text import clamp, tokenize, tokenize_code
from ..operators import discovery, search
from ..operators.combinators import best_per_key, kept, rank_position_score_by, top_k_per_group
from ..operators.graph import Adjacency
from ..operators.incremental import bucket_of
from .code_graph import MODES, QUERY_MODES, SYMBOL_TEXT

#: Characters of a word by which texts that may hold it are found.
GRAM = 3
C = F.col


def with_intents(cases: DataFrame) -> DataFrame:
    """case, task, mode and intent of tasks (case, task, mode or null); a null task has no words."""
    task, low = F.coalesce("task", F.lit("")), F.lower(F.coalesce("task", F.lit("")))
    guess = first_of([(low.rlike(words), mode) for mode, words in QUERY_MODES], "full")
    return cases.select("case", task.alias("task"), F.coalesce("mode", guess).alias("mode"), Intent.column(task).alias("intent"))


def asking(cases: DataFrame, part: str) -> DataFrame:
    return cases.filter(C("mode").isin(*[m for m, parts in MODES.items() if part in parts]))


def words_inside(words: DataFrame, texts: DataFrame) -> DataFrame:
    """kind, text, token and value of the words (token) that a text (kind, text) holds: 1 for one of its own, else 0.8 for a Chinese, 0.5 for a long one and 0.

    A word and a text meet by the word's first characters, an equi-join; then the text is searched. Texts and words are taken once; null texts have no words.
    """
    low = F.lower("text")
    places = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    grams = F.array_distinct(F.concat(places(GRAM - 1), places(GRAM)))
    spread = texts.filter("text IS NOT NULL").distinct().select("kind", "text", F.explode(grams).alias("gram"))
    met = spread.join(words.select("token").distinct().withColumn("gram", F.substring("token", 1, GRAM)), "gram").filter(low.contains(C("token")))
    inside = F.when(C("token").rlike("[一-鿿]"), 0.8).when(F.length("token") >= 5, 0.5).otherwise(0.0)
    return met.select("kind", "text", "token", F.when(F.array_contains(tokenize("text"), C("token")), 1.0).otherwise(inside).alias("value"))


def task_words(cases: DataFrame) -> DataFrame:
    """case, place, token and n (words of the task) of every word of a task, repeats too."""
    tokens = cases.select("case", tokenize("task").alias("t"))
    return tokens.select("case", F.size("t").alias("n"), F.posexplode("t").alias("place", "token"))


def in_order(place: str, value: Column) -> Column:
    """The sum of a group's values in order of place, as a chain of additions gives it; a group has a row for each word of a task."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(C(place), value.alias("v")))), F.lit(0.0), lambda a, r: a + r["v"])


def text_scores(words: DataFrame, inside: DataFrame) -> DataFrame:
    """case, kind, text and score of score_text() where it isn't 0. words: task_words(); inside: words_inside()."""
    met = inside.filter("value > 0").join(words, "token")
    return met.groupBy("case", "kind", "text").agg((in_order("place", C("value")) / F.first("n")).alias("score"))


def find_symbols(cases: DataFrame, tables: dict[str, DataFrame], scores: DataFrame, k: int = 20) -> DataFrame:
    """case, symbol_key, path, score and method as find_symbol() gives them for each task: BM25 by postings, or lexical scores where no symbol has a term."""
    terms = F.slice(F.filter(F.array_distinct(F.split(F.lower("task"), "[^a-z0-9]+")), lambda t: F.length(t) > 1), 1, search.MOST_TERMS)
    asked = cases.select("case", F.posexplode(terms).alias("place", "term"))
    on = ["term"]
    if search.is_index(tables["postings"]):
        asked, on = asked.withColumn("bucket", bucket_of(C("term"), tables["postings"].schema["bucket"].metadata["buckets"])), ["bucket", "term"]
    hits = tables["postings"].join(asked.select(*on).distinct(), on, "left_semi").select("term", "symbol_key", "times", C("words").alias("_len"))
    whole = tables["lengths"].agg(F.sum("docs").alias("_n"), (F.sum("words") / F.sum("docs")).alias("_avg"))
    weighed = hits.join(hits.groupBy("term").agg(F.count("*").alias("_df")), "term").crossJoin(F.broadcast(whole)).select("term", "symbol_key", search.term_weight(C("_df"), C("times")).alias("w"))  # one row
    summed = weighed.join(asked, "term").groupBy("case", "symbol_key").agg(in_order("place", C("w")).alias("score"))
    best = kept(top_k_per_group(summed, "case", k, F.desc("score"), C("symbol_key")))
    ranked = rank_position_score_by(best, "case", F.desc("score"), C("symbol_key")).withColumn("method", F.lit("bm25"))
    left = scores.join(cases.select("case"), "case", "left_semi").join(best.select("case").distinct(), "case", "left_anti")
    keyed = tables["symbols"].select("symbol_key", "path", "name")
    part = lambda kind, weight: left.filter(C("kind") == kind).select("case", C("text").alias(kind), (C("score") * weight).alias("score")).join(keyed, kind).select("case", "symbol_key", "score")
    loose = part("name", 1.0).unionByName(part("path", 0.8)).groupBy("case", "symbol_key").agg(F.max("score").alias("score"))
    loose = top_k_per_group(loose, "case", k, F.desc("score"), C("symbol_key")).withColumn("method", F.lit("lexical"))
    return ranked.unionByName(loose).join(keyed.select("symbol_key", "path"), "symbol_key").select("case", "symbol_key", "path", "score", "method")


def related_files(cases: DataFrame, tables: dict[str, DataFrame], scores: DataFrame, words: DataFrame, inside: DataFrame, k: int = 20) -> DataFrame:
    """case, path, score and reason as discovery.related_files() gives them for each task."""
    own = scores.join(cases.select("case"), "case", "left_semi")
    score = lambda kind, weight: own.filter(C("kind") == kind).select("case", C("text").alias(kind), clamp(C("score") * weight).alias("score"))
    by_path = score("path", 0.65).withColumn("reason", F.lit("path"))
    names = tables["symbols"].select("path", "name").distinct().join(tables["files"].select("path"), "path", "left_semi")
    by_symbol = score("name", 0.75).join(names, "name").select("case", "path", "score", F.concat(F.lit("symbol "), C("name")).alias("reason"))
    token = inside.filter("kind = 'path'").join(words.join(cases.select("case"), "case", "left_semi"), "token").select("case", C("text").alias("path"), F.lit(0.35).alias("score"), F.lit("path token").alias("reason")).distinct()
    best = best_per_key(by_path.unionByName(by_symbol).unionByName(token), ["case", "path"], -C("score"), C("reason"))
    files = tables["files"].select("path")  # symbols' paths have scores too
    return top_k_per_group(best.join(files, "path", "left_semi"), "case", k, F.desc("score"), C("path"))


def entrypoints(cases: DataFrame, entries: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """case and the rows of discovery.entrypoints() for each task."""
    every = cases.select("case", "intent").crossJoin(entries)
    own = scores.filter("kind = 'entry'").select("case", C("text").alias("raw"), C("score").alias("own"))
    every = every.join(own, ["case", "raw"], "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    return discovery.ranked_entries(Intent.read(C("intent")), every, k, by=("case",))


def block_rows(blocks: DataFrame) -> DataFrame:
    label, words = discovery.block_text()
    return blocks.filter(F.size("tokens") > 4).select("symbol_key", "path", "name", "qualified_name", label.alias("label"), words.alias("words"))


def reuse(cases: DataFrame, blocks: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """case and the candidates of discovery.reuse() for each task. blocks: block_rows(). Common words are counted by an equi-join, not set by set."""
    asked = cases.select("case", F.array_distinct(tokenize_code("task")).alias("a")).select("case", F.size("a").alias("m"), F.explode("a").alias("word"))
    spread = blocks.select("symbol_key", F.size("words").alias("n"), F.explode("words").alias("word"))
    common = spread.join(asked, "word").groupBy("case", "symbol_key").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("m").alias("m"))
    by_words = common.select("case", "symbol_key", (C("both") / (C("n") + C("m") - C("both"))).alias("s"))
    named = scores.filter("kind = 'block' AND score > 0.15").join(cases.select("case"), "case", "left_semi").select("case", C("text").alias("label"), "score")
    by_text = named.join(blocks.select("symbol_key", "label"), "label").select("case", "symbol_key", C("score").alias("s"))
    best = by_words.unionByName(by_text).groupBy("case", "symbol_key").agg(F.least(F.lit(1.0), F.max("s")).alias("similarity"))
    hits = best.join(blocks.drop("label", "words"), "symbol_key").join(cases.select("case", "intent"), "case")
    judged = discovery.reuse_hits(Intent.read(C("intent")), hits).drop("intent")
    return top_k_per_group(judged.filter(discovery.SHOWN), "case", k, F.desc("similarity"), C("path"), C("symbol_key"))


def callees(starts: DataFrame, tables: dict[str, DataFrame], limit: int = 40) -> DataFrame:
    """case, node and path of what each task's starts (case, symbol_key) call, without the starts; at most limit for each."""
    ways = Adjacency(tables["symbol_edges"].select(C("from_symbol").alias("u"), C("to_symbol").alias("v")).distinct())
    front = starts.select("case", C("symbol_key").alias("node")).distinct()
    reached = ways.out_of(front).select("case", C("v").alias("node")).distinct().join(front, ["case", "node"], "left_anti")
    at = tables["symbols"].select(C("symbol_key").alias("node"), "path")
    return top_k_per_group(reached, "case", limit, C("node")).join(at, "node")


def discover(tables: dict[str, DataFrame], cases: DataFrame) -> dict[str, DataFrame]:
    """The parts of code_graph.discover() with a column case, for a table of tasks (case, task, mode or null). case is unique.

    Parts that a task's mode doesn't ask for have no rows of it. Empty tables, empty and null tasks give no rows.
    """
    cases = kept(with_intents(cases))
    words = kept(task_words(cases))
    entries, blocks = kept(discovery.entry_rows(tables["routes"], tables["symbols"], tables["commands"])), kept(block_rows(tables["code_blocks"]))
    text = lambda df, kind, column: df.select(F.lit(kind).alias("kind"), C(column).alias("text"))
    texts = text(tables["files"], "path", "path").unionByName(text(tables["symbols"], "path", "path")).unionByName(text(tables["symbols"], "name", "name")).unionByName(text(entries, "entry", "raw")).unionByName(text(blocks, "block", "label"))
    inside = kept(words_inside(words, texts))
    scores = kept(text_scores(words, inside))
    out = {
        "entrypoints": kept(entrypoints(asking(cases, "entrypoints"), entries, scores)),
        "related": kept(related_files(asking(cases, "related"), tables, scores, words, inside)),
        "symbols": kept(find_symbols(asking(cases, "symbols"), tables, scores)),
        "reuse": kept(reuse(asking(cases, "reuse"), blocks, scores)),
        "callees": callees(find_symbols(asking(cases, "callees"), tables, scores, 5), tables),
    }
    test = F.col("path").rlike("test|tests|guard")
    out["tests"] = out["related"].filter(test).join(asking(cases, "tests").select("case"), "case", "left_semi").select("case", "path", "score")
    ev = lambda df, name, score=C("score"): df.select("case", "path", score.alias("score"), F.array(F.lit(name)).alias("evidence"))
    rows = ev(out["entrypoints"], "entrypoint").unionByName(ev(out["related"], "related_file")).unionByName(ev(out["symbols"], "symbol_match"))
    rows = rows.unionByName(ev(out["reuse"].filter("verdict <> 'create_new_allowed'"), "reuse_verdict", C("similarity"))).unionByName(ev(out["callees"], "callee", F.lit(0.5)))
    merged = kept(discovery.merged_candidates(rows, ("case",)).join(cases.select("case", "intent"), "case"))
    out["must_read"] = discovery.gated(Intent.read(C("intent")), merged, by=("case",))
    return out


def answers(found: dict[str, DataFrame], cases: DataFrame, most: int) -> DataFrame:
    """case, found (paths to read, best first), reasons, tests and reuse of every case, empty where there is nothing; lists are of a task's best rows."""
    listed = lambda df, name, score="score": top_k_per_group(df, "case", most, F.desc(score), C("path")).groupBy("case").agg(F.transform(F.array_sort(F.collect_list(F.struct((-C(score)).alias("s"), "path"))), lambda r: r["path"]).alias(name))
    read, none = found["must_read"], F.array().cast("array<string>")
    why = read.filter("reason IS NOT NULL").select("case", "reason").distinct().groupBy("case").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))  # a dozen
    out = cases.select("case")
    for part in (listed(read.filter("selected"), "found"), why, listed(found["tests"], "tests"), listed(found["reuse"], "reuse", "similarity")):
        out = out.join(part, "case", "left")
    return out.select("case", *[F.coalesce(c, none).alias(c) for c in ("found", "reasons", "tests", "reuse")])
