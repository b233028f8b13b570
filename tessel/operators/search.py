"""BM25 and lexical search, by a scan of the texts or by a stored inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_tokens, score_text
from .combinators import kept, rank_position_score
from .incremental import bucket_of

K1, B = 1.2, 0.75
#: What an inverse document frequency of 0 or less counts as.
LEAST_IDF = 1e-6
MOST_TERMS = 8
#: Postings of a batch, about: it ends with the text that reaches them.
BATCH = 100_000
#: What the bytes of a text are for words_of(): A-Z lower-cased, all but letters and digits white space.
_LETTERS = bytes(ord(c.lower()) if (c := chr(b)).isascii() and c.isalnum() else 32 for b in range(256))


def words_of(text: Column) -> Column:
    """ASCII words and digits, lower-cased A-Z only."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    import re

    return [t for t in dict.fromkeys(re.split(r"[^a-z0-9]+", query.lower())) if len(t) > 1][:MOST_TERMS]


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(docs: DataFrame, key: str, text: Column, query: str, k: int | None = 20) -> DataFrame:
    """key and score of the documents that hold any of the query's terms, best first.

    One scan: for each document its length and the counts of the few query terms, kept; document frequencies and the mean length come from an
    aggregation of those narrow rows. No postings of other words are made.
    """
    terms = query_terms(query)
    words = words_of(text)
    rows = docs.select(F.col(key).alias("_key"), words.alias("_w")).select("_key", F.size("_w").alias("_len"), *[_times("_w", t).alias(f"_t{i}") for i, t in enumerate(terms)])
    rows = kept(rows)
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_t{i}") > 0).cast("int")).alias(f"_df{i}") for i in range(len(terms))])
    return _ranked(rows, stats, len(terms), key, k)


def term_weight(df: Column, times: Column) -> Column:
    """What a term that df texts have and this one `times` times adds to its score; reads _n, _len and _avg."""
    tf = times.cast("double")
    idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))).otherwise(0.0)


def _ranked(rows: DataFrame, stats: DataFrame, terms: int, key: str, k: int | None) -> DataFrame:
    """key and score from rows (_key, _len and _t of each term) and the one row of stats (_n, _avg and _df of each term)."""
    joined = rows.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(terms):
        score = score + term_weight(F.col(f"_df{i}"), F.col(f"_t{i}"))
    hit = sum((F.col(f"_t{i}") for i in range(terms)), F.lit(0)) > 0
    out = joined.filter(hit).select(F.col("_key").alias(key), score.alias("score"))
    return out.orderBy(F.desc("score"), key).limit(k) if k else out


def _words(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The words of each text (the last column), as words_of() gives them."""
    for text in batch.column(batch.num_columns - 1).cast(pa.binary()):
        yield (text.as_py() or b"").translate(_LETTERS).split()


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, the columns before the text, words and times."""
    for batch in batches:
        terms, times, of, words = [], [], [], []

        def made(batch=batch):
            own = [c.take(pa.array(np.concatenate(of))) for c in batch.columns[:-1]]
            out = [pa.array(terms, pa.string()), *own, pa.array(np.concatenate(words)), pa.array(times, pa.int64())]
            return pa.RecordBatch.from_arrays(out, ["term", *batch.schema.names[:-1], "words", "times"])

        for i, found in enumerate(_words(batch)):
            if found:
                n = Counter(found)
                terms.extend(n)
                times.extend(n.values())
                of.append(np.full(len(n), i, np.int32))
                words.append(np.full(len(n), len(found), np.int32))
                if len(terms) >= BATCH:
                    yield made()
                    terms, times, of, words = [], [], [], []
        if terms:
            yield made()


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the text, and its number of words."""
    for batch in batches:
        n = pa.array([len(w) for w in _words(batch)], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "_n"])


def _form(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def postings(docs: DataFrame, key: str, text: Column, group: str) -> DataFrame:
    """term, key, group, times (in the text) and words (of the text) of every term of every text. group says what an update replaces together.

    A text's terms are counted where it is read, so nothing is shuffled to make them; a row that is there twice has its postings twice (see Index.bm25).
    """
    own = docs.select(*dict.fromkeys((key, group)))
    return docs.select(*own.columns, text.alias("_text")).mapInArrow(_posted, f"term string, {_form(own)}, words int, times long")


def lengths(docs: DataFrame, text: Column, group: str) -> DataFrame:
    """group, docs and words: what statistics over all texts are summed from."""
    own = docs.select(group)
    sizes = docs.select(group, text.alias("_text")).mapInArrow(_sized, f"{_form(own)}, _n int")
    return sizes.groupBy(group).agg(F.count("*").alias("docs"), F.sum("_n").alias("words"))


@dataclass
class Index:
    """A stored inverted index: postings() in buckets of their term, as a BucketStore reads them, and lengths()."""

    postings: DataFrame
    lengths: DataFrame
    key: str

    def bm25(self, query: str, k: int | None = 20) -> DataFrame:
        """bm25()'s rows from the postings of the query's terms; only their buckets are read."""
        terms = query_terms(query)
        n = self.postings.schema["bucket"].metadata["buckets"]
        hits = self.postings.filter(F.col("bucket").isin(*[bucket_of(F.lit(t), n) for t in terms]) & F.col("term").isin(*terms))
        hits = hits.groupBy("term", *[c for c in self.postings.columns if c not in ("term", "times", "bucket")]).agg(F.sum("times").alias("times"))
        one = [F.col("term") == t for t in terms]
        rows = hits.groupBy(F.col(self.key).alias("_key")).agg(F.max("words").alias("_len"), *[F.sum(F.when(c, F.col("times")).otherwise(0)).alias(f"_t{i}") for i, c in enumerate(one)])
        found = hits.agg(*[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(f"_df{i}") for i, c in enumerate(one)])
        whole = self.lengths.agg(F.sum("docs").alias("_n"), (F.sum("words") / F.sum("docs")).alias("_avg"))
        return _ranked(rows, found.crossJoin(F.broadcast(whole)), len(terms), self.key, k)  # both one row


def is_index(df: DataFrame | None) -> bool:
    """True for postings that a BucketStore has read."""
    return df is not None and "bucket" in df.columns and "buckets" in df.schema["bucket"].metadata


def lexical(docs: DataFrame, key: str, query: str, parts: list[tuple[Column, float]], least: float = 0.0, k: int | None = 20) -> DataFrame:
    """key and score: the best weighted score_text() of a row's parts."""
    scores = [score_text(query, part) * weight for part, weight in parts]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = docs.select(F.col(key), best.alias("score")).filter(F.col("score") > least)
    return out.orderBy(F.desc("score"), key).limit(k) if k else out


def search(docs: DataFrame, key: str, text: Column | None, query: str, fallback: list[tuple[Column, float]], k: int = 20, index: Index | None = None) -> DataFrame:
    """key, place score (1 - place / n) and method: BM25, by an index if there is one, or lexical scores where no document holds a term."""
    if query_terms(query):
        hits = kept(index.bm25(query, k) if index else bm25(docs, key, text, query, k))  # k rows
        if not hits.isEmpty():
            return rank_position_score(hits, F.desc("score"), F.col(key)).withColumn("method", F.lit("bm25"))
    return lexical(docs, key, query, fallback, 0.0, k).withColumn("method", F.lit("lexical"))


__all__ = ["bm25", "lexical", "query_terms", "query_tokens", "search", "words_of"]
