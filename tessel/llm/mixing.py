"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Expected copies are the same for all documents of a source: target / source size. Their prefix sum within a source, plus one offset drawn
for the source, crosses integers; a document is taken once for each integer crossed in its step. Repeats of (doc_id, source, size) are one row of
the sum, as wide as there are repeats, and each of them has a step of its own. Documents are summed in order of a size band
(an eighth of a power of two), block and size, so that copies are even over sizes and the words taken come near the target. The prefix sum is
made in two levels, cells (band, block) first and rows in their cell after, so that no task holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, n_words, split_words, stored

#: Fixed values of the contract: weights by rank of the source, repeated; the share of all sizes; the cap in sizes of a source.
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
SEED = "mix-1"
#: Rows (expected) of a block of a source's size band, and bands over which a source's rows are taken to spread.
BLOCK_ROWS, BANDS = 500_000, 16


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with each one's target.

    Targets are min(cap * size, level * weight) with the one level at which they add up to share of all sizes: what repeated resharing of
    the excess ends at. Sources are put in order of cap / weight; the level is found where the sources before are at their caps;
    of the levels that leave their own source under its cap, the first in that order is the largest.
    """
    everything = Window.partitionBy()
    n = len(weights)
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % n + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(cap))
    ranked = ranked.withColumn("_total", F.sum("source_size").over(everything) * F.lit(share)).withColumn("_all_w", F.sum("_w").over(everything))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(everything))
    return ranked.select("source", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap")).alias("target"))


def steps(sized: DataFrame, seed: str = SEED, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From sized (doc_id, source, size, stored), one row for each distinct (doc_id, source, size): rows (how often it is there), source_size, target, and first, rate and offset, from which copies() has how often the mix takes each of them.

    Null sources are one source, the last. A source of size 0 has target 0 and none of its rows is taken. Repeated rows have places of their own, from first on.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    targets = stored(source_targets(sources, weights, share, cap).withColumn("_offset", offset), "targets")
    bits = F.bin(F.col("size") + 8)
    band = F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 2, 3)).alias("_band")
    # one hex digit of the id's hash at least, and as many as keep blocks small
    digits = max(1, math.ceil(math.log(max(1, sized.count() / BANDS / BLOCK_ROWS), 16)))
    block = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, digits).alias("_block")
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).select("*", band, block)
    counted = units.groupBy("source", "_band", "_block").agg(F.sum("rows").alias("_n"))
    before = Window.partitionBy("source").orderBy("_band", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(F.col("source").alias("_source"), F.col("_band").alias("_b"), F.col("_block").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = units.withColumn("_end", F.sum("rows").over(Window.partitionBy("source", "_band", "_block").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_band") == F.col("_b")) & (F.col("_block") == F.col("_k")))
    numbered = numbered.join(targets.select(F.col("source").alias("_s"), "source_size", "target", "_offset"), F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    first = F.col("_before") + F.col("_end") - F.col("rows")
    return numbered.select("doc_id", "source", "size", "rows", "source_size", "target", first.alias("first"), rate.alias("rate"), F.col("_offset").alias("offset"))


def copies(place: Column, cap: float = CAP) -> Column:
    """How often the mix takes the row at a place, counted from 1, beside rate and offset."""
    crossed = F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))
    return F.least(crossed, F.lit(int(cap))).cast("int")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and size (white-space words; null text: 0) of every row, stored."""
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(split_words(F.col(text_col), SPACES)).alias("size")), "sizes")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mix takes, repeats counted) of every row.

    Other columns are ignored; no rows give no rows. Only sizes of texts move, so a very long text is read once.
    """
    each = steps(sizes(docs), seed).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "source", "size", "source_size", "target", (copies(F.col("first") + F.col("_i")) * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of docs as the mix takes them, repeats included, with docs' own columns. Steps are found on narrow rows and come back by doc_id, source and size.

    Repeats of these three are put in order of a hash of their texts; which of those with equal texts is taken is open.
    """
    found = stored(steps(sizes(docs), seed).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "rows", "first", "rate", "offset"), "steps")
    size = n_words(split_words(docs["text"], SPACES))
    names = docs.columns
    # the steps grow with the rows, so they are merged, not broadcast, at any size
    once = found.filter("rows = 1").withColumn("copies", copies(F.col("first") + 1)).filter("copies > 0").hint("merge")
    joined = docs.join(once, docs["doc_id"].eqNullSafe(once["_d"]) & docs["source"].eqNullSafe(once["_s"]) & (size == once["_z"]))
    out = joined.select(*[docs[c] for c in names], F.explode(F.sequence(F.lit(1), once["copies"])).alias("_copy")).select(*names)
    more = found.filter("rows > 1").hint("merge")
    if more.isEmpty():
        return out
    joined = docs.join(more, docs["doc_id"].eqNullSafe(more["_d"]) & docs["source"].eqNullSafe(more["_s"]) & (size == more["_z"]))
    # numbered by text and by the task that met them, so that no task holds all repeats of a row
    kept = stored(joined.select(F.struct(*[docs[c] for c in names]).alias("row"), F.xxhash64(docs["text"]).alias("_t"), F.spark_partition_id().alias("_part"), *[more[c] for c in more.columns]), "repeats")
    unit = ["_d", "_s", "_z"]
    cells = kept.groupBy(*unit, "_t", "_part").agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*unit).orderBy("_t", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.select(*[F.col(c).alias(f"_{c}") for c in (*unit, "_t", "_part")], "_before")
    same = F.lit(True)
    for c in (*unit, "_t", "_part"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = kept.withColumn("_row", F.row_number().over(Window.partitionBy(*unit, "_t", "_part").orderBy("rows"))).join(cells, same)
    taken = placed.withColumn("_copies", copies(F.col("first") + F.col("_before") + F.col("_row"))).filter("_copies > 0")
    return out.unionByName(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0.0)) AS own
  FROM ranked WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, coalesce(least(cap, (max(own) FILTER (own <= cap / w) OVER ()) * w), cap) AS target,
    CAST('0x' || substr(md5('mix-1:' || coalesce(source, '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM levels),
units AS (
  SELECT doc_id, source, size, count(*) AS n, lpad(length(bin(size + 8))::VARCHAR, 2, '0') || substr(bin(size + 8), 2, 3) AS band,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 1) AS block FROM sized GROUP BY ALL),
placed AS (
  SELECT u.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY u.source ORDER BY band, block, size, doc_id) AS place
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, CAST(least(floor(place * rate + u) - floor((place - 1) * rate + u), 2) * size AS BIGINT) AS taken
FROM placed, range(n)
"""
