"""Exact deduplication with a heavy-hitter split.

1. Every text becomes a SHA-256 digest (null counts as empty); the narrow table of ids and digests is stored.
2. Misra-Gries summaries of k counters, one for each partition, are merged. They hold every digest of more than n/(k+1) rows.
3. An exact count over those at most k candidates verifies them and finds each one's winner. Winners (at most k rows) are broadcast,
   so rows of heavy digests never shuffle.
4. All other digests go through one ordinary shuffle; none of those groups has more than n/(k+1) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Counters of a Misra-Gries summary, and so the most winners that are broadcast.
COUNTERS = 1024
#: Bytes of stored rows to drop up to which they are broadcast.
BROADCAST = 8 << 20


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8, in lower-case hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def misra_gries(values: list, summary: dict, k: int = COUNTERS) -> dict:
    """Adds values to a summary of at most k counters. Each counter is below the true count by at most n/(k+1)."""
    for v in values:
        if v in summary:
            summary[v] += 1
        elif len(summary) < k:
            summary[v] = 1
        else:
            for key in [key for key, c in summary.items() if c == 1]:
                del summary[key]
            for key in summary:
                summary[key] -= 1
    return summary


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: dict = {}
        for batch in batches:
            misra_gries(batch.column(0).to_pylist(), summary, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(summary), pa.string()), pa.array(list(summary.values()), pa.int64())], ["digest", "n"])

    return run


def heavy_digests(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most k digests (column digest) that include all of more than n/(k+1) rows."""
    parts = digests.select("digest").mapInArrow(_summaries(k), "digest string, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """For each row its id, keep_id (largest id among equal texts), group_size, kept and text_sha256.

    Null texts equal empty ones. Null ids lose to all others; where a group has only null ids, keep_id is null and its rows are kept.
    Repeated rows (same id and text) count towards group_size and are all kept if their id is. Other columns are ignored. No rows give no rows.
    Only digests are grouped, so a very long text costs no more than its hash. k: counters of a summary, and so the most digests that count as heavy.
    """
    digests = stored(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")), "digests")
    winners = F.broadcast(
        digests.join(F.broadcast(heavy_digests(digests, k)), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    marked = digests.join(winners, "digest", "left")
    same = Window.partitionBy("digest")
    heavy = marked.filter(F.col("group_size").isNotNull()).select("doc_id", "keep_id", "group_size", "digest")
    rest = marked.filter(F.col("group_size").isNull()).select("doc_id", F.max("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"), "digest")
    return heavy.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops; all columns stay. Rows are dropped by id and text, so another text of the same id stays."""
    out = stored(exact_dedup(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_dropped"), F.col("text_sha256").alias("_sha")).distinct(), "dropped")
    return docs.join(small(out, BROADCAST), docs[id_col].eqNullSafe(out["_dropped"]) & (digest(docs[text_col]) == out["_sha"]), "left_anti")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
