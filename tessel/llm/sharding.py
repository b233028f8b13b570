"""Jump consistent hashing in SQL expressions only.

A key's shard among n is the last jump below n of a walk that the key alone decides; with one more shard the same walk either ends where it
did or jumps to the new shard. There is no ring table. The 64-bit linear congruential steps are done on 32-bit halves, since SQL arithmetic
fails on overflow. One walk gives both the shard among n and the shard among n + 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Fixed value: the multiplier of the published jump hash.
MULTIPLIER = 2862933555777941757
MASK = 0xFFFFFFFF
BROADCAST = 8 << 20
#: Rows (expected) of a block of a shard. Blocks are numbered by a task each, so that none numbers a whole shard, however large.
BLOCK_ROWS = 500_000


def _advance(hi: str, lo: str) -> tuple[str, str]:
    """SQL for the halves of key * MULTIPLIER + 1 modulo 2**64."""
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & MASK

    def times(x: str, y: int) -> str:
        return f"((({x} & 65535) * {y}L + shiftleft((shiftrightunsigned({x}, 16) * {y}L) & 65535L, 16)) & {MASK}L)"

    upper = f"(shiftrightunsigned({lo}, 16) * {ml}L)"
    low = f"(({lo} & 65535L) * {ml}L + shiftleft({upper} & 65535L, 16) + 1L)"
    carry = f"(shiftrightunsigned({low}, 32) + shiftrightunsigned({upper}, 16))"
    return f"(({carry} + {times(hi, ml)} + {times(lo, mh)}) & {MASK}L)", f"({low} & {MASK}L)"


def jump_hash(key: str, shards: int) -> Column:
    """A struct of shard (0 to shards - 1) and grown (0 to shards) for a long column; null keys count as 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    k = f"coalesce({key}, 0L)"
    hi, lo = _advance(f"shiftrightunsigned({k}, 32)", f"({k} & {MASK}L)")
    next_hi, next_lo = _advance("s.hi", "s.lo")
    return F.expr(
        f"""aggregate(sequence(1, {shards + 1}),
            named_struct('hi', {hi}, 'lo', {lo}, 'j', 0L, 'shard', 0L, 'grown', 0L),
            (s, i) -> IF(s.j > {shards}, s, named_struct('hi', {next_hi}, 'lo', {next_lo},
                'j', CAST((s.j + 1) * (2147483648D / (shiftrightunsigned(s.hi, 1) + 1)) AS BIGINT),
                'shard', IF(s.j < {shards}, s.j, s.shard), 'grown', s.j)),
            s -> named_struct('shard', CAST(s.shard AS INT), 'grown', CAST(s.grown AS INT)))"""
    )


def add_shard(docs: DataFrame, shards: int, key: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """docs with the shard of each row's key; no shuffle. A column of that name is replaced."""
    return docs.withColumn(shard_col, jump_hash(f"`{key}`", shards)["shard"])


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is `key`: doc_id and the number of shards decide, and one more shard takes rows only into itself. Equal texts with different ids
    may so land in different shards. slot numbers a shard's rows from 0 without gaps: blocks of rows are numbered on their own and shifted by
    the rows of the blocks before, so a shard is never in one task. Null ids count as id 0, null texts as empty; repeated rows get a slot each.
    Other columns are ignored; no rows give no rows. Only sizes and sums of texts move, so a very long text is read once.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))

    rows = keyed.withColumn("_jump", jump_hash("doc_id", shards)).select("*", F.col("_jump.shard").alias("shard"), F.col("_jump.grown").alias("grown_shard"))
    # one hex digit of a hash of id and text at least, and as many as keep blocks small; a null or repeated id is in many blocks if its texts differ
    digits = max(1, math.ceil(math.log(max(1, docs.count() / shards / BLOCK_ROWS), 16)))
    rows = stored(rows.drop("_jump").withColumn("_block", F.substring(F.md5(F.concat_ws(",", "doc_id", "text_crc32", "size")), 1, digits)), "placed")
    cells = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(cells.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    within = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_row", F.row_number().over(within)).join(small(offsets, BROADCAST), ["shard", "_block"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
