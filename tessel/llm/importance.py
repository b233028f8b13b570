"""Importance resampling of documents towards a target, by hashed n-gram features.

1. One scan of each text keeps the running zlib state of the last n word starts; every word extends each by a space and itself. A state is a feature's
   crc32, so no feature is ever built as a string. A text's buckets are stored as 16-bit numbers; each task also adds up how often it met each bucket.
2. A bucket's gain comes from its counts over all documents and over the target. There are as many gains as buckets: a bounded table for the tasks.
3. A text's weight is the sum of its buckets' gains; a Gumbel number from a hash of the id makes the score, so reruns agree.
4. Scores are sorted over all tasks by range; a range numbers its rows and is shifted by the rows of the ranges before.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small, stored

RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
BROADCAST = 8 << 20
#: Bytes of UTF-8 to what words are made of: A-Z lower-cased, letters, digits and all beyond ASCII as they are, the rest a space.
_BYTES = bytes(b + 32 if chr(b) in UPPER else b if b > 127 or chr(b) in LOWER or chr(b) in "0123456789" else 32 for b in range(256))


def buckets_of(text: str | None, run: int = RUN, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words of a text and the bucket of every run of 1 to `run` consecutive words, repeats kept."""
    crc, ring, out = zlib.crc32, [], array("I")
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
    for word in parts:
        spaced = b" " + word
        ring = [crc(word), *[crc(spaced, state) for state in ring[: run - 1]]]
        out.extend(ring)
    return len(parts), (np.frombuffer(out, np.uint32) % buckets).astype(np.uint16)


def _scan(run: int, buckets: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            words, found = [], []
            for text in batch.column(1):
                n, own = buckets_of(text.as_py(), run, buckets)
                seen += np.bincount(own, minlength=buckets)
                words.append(n)
                found.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(found, pa.binary()), pa.array([None] * len(words), pa.list_(pa.int64()))], ["doc_id", "n_words", "buckets", "seen"])
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.schema.field(0).type), pa.array([-1], pa.int64()), pa.array([None], pa.binary()), pa.array([seen.tolist()], pa.list_(pa.int64()))], ["doc_id", "n_words", "buckets", "seen"])

    return go


def scan(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and buckets of each row of (doc_id, text), and a row with n_words -1 and the counts by bucket (seen) of each task; stored."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets have 16 bits")
    return stored(texts.mapInArrow(_scan(run, buckets), f"doc_id {dict(texts.dtypes)['doc_id']}, n_words long, buckets binary, seen array<long>"), "buckets")


def bucket_counts(scanned: DataFrame, name: str) -> DataFrame:
    """bucket and its count over all rows of scan(); at most as many rows as buckets."""
    return scanned.filter("seen IS NOT NULL").select(F.posexplode("seen").alias("bucket", "n")).filter("n > 0").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(scanned: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from counts over all documents and all of the target."""
    both = bucket_counts(scanned, "s").join(bucket_counts(target, "t"), "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    every = F.broadcast(both.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c.upper()) for c in "st"]))  # one row
    every_bucket = scanned.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").fillna(0.0, ["s", "t"])
    ratio = (F.col("t") + 1) * (F.col("S_") + buckets) / ((F.col("s") + 1) * (F.col("T_") + buckets))
    rows = every_bucket.crossJoin(every.select(F.col("S").alias("S_"), F.col("T").alias("T_"))).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # as many rows as buckets
        out[r["bucket"]] = r["gain"]
    return out


def _weigh(table: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b.as_buffer(), np.uint16) for b in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in own], pa.int64()), pa.array([int(table[x].sum()) for x in own], pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return go


def gumbel(key: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths from a hash of the seed and a key; null counts as an empty key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place (1, 2, 3...) in an order over all of them; columns _range and _n are in use. Rows that tie in all of order get places in any order."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    shifts = stored(sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n")), "shifts")
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("place", at).join(small(shifts, BROADCAST), "_range").withColumn("place", (F.col("place") + F.col("_n")).cast("long")).drop("_range", "_n")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row; rank is null for rows that aren't drawn.

    Null and empty texts have no words, no features and weight 0. Of the rows with at least `least_words` words, percent % are drawn (rounded down), highest
    scores first, ties to smaller ids, null ids last. Repeated rows have equal scores and a rank each. An empty target gives every bucket its gain
    against nothing; no rows give no rows. Other columns are ignored. A very long text is scanned once and stored as 2 bytes for each feature.
    """
    scanned = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, buckets)
    table = gains(scanned, scan(target.select(F.lit(0).alias("doc_id"), F.col(target_col).alias("text")), run, buckets), buckets)
    rows = scanned.filter("n_words >= 0").select("doc_id", "n_words", "buckets")
    weighed = rows.mapInArrow(_weigh(table), f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_features long, weight long")
    weighed = stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
    able = weighed.filter(F.col("n_words") >= least_words)
    most = percent * able.count() // 100
    drawn = ranked(able, F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("rank", F.when(F.col("place") <= most, F.col("place"))).drop("place")
    return drawn.unionByName(weighed.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose id is drawn; docs' own columns."""
    ids = stored(resample(docs, target, id_col, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct(), "drawn")
    return docs.join(small(ids, BROADCAST), docs[id_col].eqNullSafe(ids["_drawn"]), "left_semi")


#: crc32 by bytes: a table of 256 steps made from the polynomial, then a reduction over the bytes of each distinct feature.
ORACLE = r"""
WITH steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
split AS (SELECT kind, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (SELECT kind, r, array_to_string(w[i:i + n], ' ') AS f FROM (SELECT kind, r, w, n, unnest(range(1, len(w) - n + 1)) AS i FROM split, range(3) t(n)) ),
counted AS (SELECT kind, r, f, count(*) AS n FROM grams GROUP BY ALL),
coded AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda k: ('0x' || substr(hex(encode(f)), 2 * k + 1, 2))::BIGINT)),
   lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8))) % 10000 AS b FROM (SELECT DISTINCT f FROM counted), steps),
hits AS (SELECT kind, r, b, sum(n)::BIGINT AS n FROM counted JOIN coded USING (f) GROUP BY ALL),
sums AS (SELECT coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t_all FROM hits),
gains AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT b, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM hits GROUP BY b), sums),
weights AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM hits JOIN gains USING (b) WHERE kind = 0 GROUP BY r),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score FROM split LEFT JOIN weights USING (r) WHERE kind = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
