"""Benchmark decontamination with a broadcast set of normalised test n-grams, in DataFrame operations only.

1. A benchmark item's windows are its runs of ten words (all its words, if fewer). The set is stored.
2. One pass over the texts counts the benchmark's words in them. Every window is anchored at its rarest word; a window with a word that no text
   has is dropped, since it occurs nowhere.
3. A second pass goes through the words of each text. Where one is an anchor, the windows that it may be part of are cut out and looked up in the
   set, as strings, so each hit is verified. Anchors and windows are broadcast after a check of their size.
4. A set too large for that is joined by shuffle: hashes of all token windows meet hashes of the set, and texts come back for rows with hits only.
5. Hits are merged into spans of words, which are counted, or cut out of the texts, or decide which documents go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, n_words, small, split_words, stored, stored_bytes, words

WINDOW = 10
#: Bytes of stored words, anchors, windows or rows with hits up to which they are broadcast.
BROADCAST = 8 << 20
#: What separates words before A-Z are lower-cased: every ASCII character but letters and digits.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A word with what separates it from the word before.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows are told apart by id and text, so that an id may come twice.
KEY = ["doc_id", "_hash", "_length"]


def _lowered(word: Column) -> Column:
    """ascii_lower(), by the faster lower() where a word has ASCII characters only."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(ascii_lower(word))


def windows_of(words_col: str, length: int | str) -> Column:
    """All runs of so many words, joined by spaces, in order; none if there are fewer words."""
    return F.expr(f"IF(size({words_col}) >= {length}, transform(sequence(1, size({words_col}) - {length} + 1), i -> array_join(slice({words_col}, i, {length}), ' ')), array())")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (as string; null: empty), length and window of every item, distinct. Items without words have none."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(ascii_lower(F.col("text")), BREAKS).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("length", F.least(F.size("w"), F.lit(window)))
    return items.select("item_id", "length", F.explode(windows_of("w", "length")).alias("window")).distinct()


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_length", F.octet_length(F.coalesce("text", F.lit(""))))


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct (_row), so that none of its columns can clash, with KEY and text."""
    return _key(docs.select(F.struct("*").alias("_row")).select("_row", "_row.doc_id", "_row.text"))


def _with(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """rows joined with found, a table of KEY and others, by KEY; null ids are equal."""
    other = found.withColumnsRenamed({"doc_id": "_d", "_hash": "_h", "_length": "_l"})
    on = rows["doc_id"].eqNullSafe(other["_d"]) & (rows["_hash"] == other["_h"]) & (rows["_length"] == other["_l"])
    out = rows.join(other, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop("_d", "_h", "_l")


def _window(at: str, length: str) -> Column:
    return _lowered(F.expr(f"array_join(slice(_w, {at} + 1, {length}), ' ')"))


def _anchored(docs: DataFrame, grams: DataFrame, broadcast: int) -> DataFrame:
    """length, window, anchor and off (the anchor's first place in it) of all windows whose words are all in the texts; stored."""
    each = grams.select("length", "window").distinct().select("length", "window", F.posexplode(F.split("window", " ")).alias("off", "word"))
    vocabulary = stored(each.select("word").distinct(), "vocabulary")
    found = docs.select(F.explode_outer(split_words(F.col("text"), BREAKS)).alias("word")).select(_lowered(F.col("word")).alias("word"))
    if stored_bytes(vocabulary) <= broadcast:
        counts = found.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:
        counts = found.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")
    best = each.join(small(stored(counts, "counts"), broadcast), "word", "left").groupBy("length", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "word")).alias("b"))
    return stored(best.filter("b.n > 0").select("length", "window", F.col("b.word").alias("anchor"), F.col("b.off").alias("off")), "anchored")


def _hits(docs: DataFrame, grams: DataFrame, broadcast: int) -> DataFrame:
    """KEY, at, end (words, from 0) and window of every occurrence of a window; stored."""
    windows = _anchored(docs, grams, broadcast)
    anchors = stored(windows.groupBy("anchor").agg(F.collect_set(F.struct("length", "off")).alias("offs")), "anchors")
    rows = docs.select(*KEY, split_words(F.col("text"), BREAKS).alias("_w"))
    # the outer form, though no array is empty: it saves a check of the size that splits each text once more
    each = rows.select(*KEY, "_w", F.posexplode_outer("_w").alias("_pos", "_word"))
    # an empty string before the first word is no word; windows that reach into one at either end match nothing
    at = (F.col("at") - F.when(F.element_at("_w", 1) == "", 1).otherwise(0)).alias("at")
    if stored_bytes(windows) <= broadcast and stored_bytes(anchors) <= broadcast:
        near = each.withColumn("_word", _lowered(F.col("_word"))).join(F.broadcast(anchors), F.col("_word") == F.col("anchor"))
        near = near.select(*KEY, "_w", "_pos", F.explode("offs").alias("_o")).select(*KEY, "_w", (F.col("_pos") - F.col("_o.off")).alias("at"), F.col("_o.length").alias("length"))
        near = near.filter("at >= 0 AND at + length <= size(_w)").select(*KEY, at, "length", _window("at", "length").alias("window"))
        return stored(near.join(F.broadcast(windows.select("length", "window")), ["length", "window"]).select(*KEY, "at", (F.col("at") + F.col("length")).alias("end"), "window").distinct(), "hits")
    sums = windows.select("length", F.xxhash64("window").alias("_sum"), "window")
    maybe = None
    for n in sorted(r[0] for r in windows.select("length").distinct().collect()):  # at most `window` of them
        part = each.filter(F.col("_pos") + n <= F.size("_w")).select(*KEY, F.col("_pos").alias("at"), F.lit(n).alias("length"), F.xxhash64(_window("_pos", str(n))).alias("_sum"))
        maybe = part if maybe is None else maybe.unionByName(part)
    if maybe is None:
        return stored(docs.select(*KEY, F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit("").alias("window")).filter("false"), "hits")
    maybe = maybe.distinct().join(sums, ["length", "_sum"]).groupBy(*KEY).agg(F.collect_list(F.struct("at", "length", "window")).alias("_m"))
    back = _with(rows.dropDuplicates(KEY), stored(maybe, "candidates"), "inner")
    back = back.select(*KEY, "_w", F.explode("_m").alias("_m")).select(*KEY, "_w", "_m.at", "_m.length", "_m.window")
    back = back.filter(_window("at", "length") == F.col("window")).select(*KEY, at, "length", "window")
    return stored(back.select(*KEY, "at", (F.col("at") + F.col("length")).alias("end"), "window"), "hits")


def _spans(hits: DataFrame) -> DataFrame:
    """KEY, start and end of the runs of words that hits cover."""
    order = Window.partitionBy(*KEY).orderBy("at", "end")
    marked = hits.select(*KEY, "at", "end").distinct().withColumn("_new", F.coalesce(F.col("at") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    return marked.withColumn("_run", F.sum(F.col("_new").cast("int")).over(order)).groupBy(*KEY, "_run").agg(F.min("at").alias("start"), F.max("end").alias("end")).drop("_run")


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, start and end (places of words from 0, end left out) of the runs of words that windows cover, with the row's key (_hash, _length). Equal rows have them once."""
    return _spans(_hits(_key(docs.select("doc_id", "text")), stored(benchmark_windows(benchmark, window), "windows"), broadcast))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast: int = BROADCAST) -> DataFrame:
    """For every row doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, with the row's key (_hash, _length).

    Null texts have no words. Repeated rows give a row each. Only doc_id and text are read; an empty benchmark leaves all rows clean, no rows give
    no rows. A very long text is one array of words in one task; its windows are made one at a time.
    """
    docs = _key(docs.select("doc_id", "text"))
    grams = stored(benchmark_windows(benchmark, window), "windows")
    hits = _hits(docs, grams, broadcast)
    covered = _spans(hits).groupBy(*KEY).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    items = hits.select(*KEY, "window").distinct().join(small(grams.select("window", "item_id").distinct(), broadcast), "window").groupBy(*KEY).agg(F.sort_array(F.collect_set("item_id")).alias("_items"))
    found = stored(_with(covered, items, "inner"), "found")
    rows = docs.select(*KEY, n_words(split_words(F.col("text"), BREAKS)).alias("n_words"))
    joined = _with(rows, small(found, broadcast), "left")
    hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("_items", F.array().cast("array<string>"))
    return joined.select(*KEY, "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).drop("_hash", "_length")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows; docs' own columns."""
    dirty = stored(hit_spans(docs, benchmark).select(*KEY).distinct(), "dirty")
    return _with(_packed(docs), small(dirty, BROADCAST), "left_anti").select("_row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast: int = BROADCAST) -> DataFrame:
    """docs, every row, with the words of contaminated spans and what separates each from the word before cut out of text; docs' own columns."""
    spans = hit_spans(docs, benchmark, window, broadcast).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_s"))
    rows = _with(_packed(docs), small(stored(spans, "spans"), broadcast), "left")
    rows = rows.withColumn("_p", F.when(F.col("_s").isNotNull(), F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))))
    # what is between spans: from each span's end (or the start of the text) to the next one's start (or the end)
    ends = "concat(array(0), transform(_s, s -> s.end))"
    starts = "concat(transform(_s, s -> s.start), array(size(_p)))"
    kept = F.expr(f"flatten(transform(arrays_zip({ends}, {starts}), x -> slice(_p, x['0'] + 1, x['1'] - x['0'])))")
    cut = F.concat(F.array_join(kept, ""), F.regexp_extract("text", BREAKS[:-1] + r"*\z", 0))
    text = F.when(F.col("_s").isNotNull(), cut).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0), range(1, len(w) - n + 2) t(i)),
hits AS (SELECT DISTINCT r, i, n, item_id FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g)) JOIN g USING (n) WHERE gram = array_to_string(w[i:i + n - 1], ' ')),
covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, range(n) t(k) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
