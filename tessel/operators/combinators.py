"""Best, first and merged rows per key, top k, caps and tiers: what almost every ranked query is made of."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _keys(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else keys


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tessel-')}"


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where that is unset and Spark runs in one process; else None."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return base or (_own_folder() if spark.sparkContext.master.startswith("local") else None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    base = shared_folder(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/tessel/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, *by: str) -> DataFrame:
    """df made once: written to the shared folder, in a folder for each value of `by`, and read again, or cached where there is none. For what several tables are made from.

    Lineage is cut, an executor may be lost, the size is known to the planner, and what is built on it is planned without what it was made from.
    """
    if not shared_folder(df.sparkSession):
        return df.persist()
    path = scratch(df.sparkSession, "kept")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_clear(df: DataFrame, *by: str) -> DataFrame:
    """kept(), whose shuffle files go when it is written, not when the driver happens to collect its garbage. For work whose shuffles are large beside its result."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return kept(df, *by)
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def let_go(*made: DataFrame) -> None:
    """Deletes what kept() made, once nothing that is still to run reads it."""
    for df in made:
        spark = df.sparkSession
        if not shared_folder(spark):
            df.unpersist()
        for path in {m[1] for f in df.inputFiles() if (m := re.match(r"(.*/tessel/kept-[0-9a-f]{32})/", f))}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that a task of an aggregation holds in memory, about.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt into tasks of about so many rows, evenly or by keys. For work that costs or holds more than its bytes say: the planner, which goes by bytes or by a
    fixed number, would leave it to a few tasks that grow with the input. Rows are counted first."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *keys)


def best_per_key(df: DataFrame, keys: str | list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in this order. The order should end in a unique column.

    An aggregation of structs rather than a window: partial results combine before the shuffle, so a hot key does not gather its rows.
    """
    return _first(df, _keys(keys), list(order))


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    named = df.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    rank = F.struct(*[F.col(f"_o{i}") for i in range(len(order))])
    rest = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return named.groupBy(*keys).agg(F.min_by(rest, rank).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def first_per_key(df: DataFrame, keys: str | list[str], ordinal: str) -> DataFrame:
    return _first(df, _keys(keys), [F.col(ordinal)])


def last_per_key(df: DataFrame, keys: str | list[str], ordinal: str) -> DataFrame:
    named = _keys(keys)
    rest = F.struct(*[F.col(c) for c in df.columns if c not in named])
    return df.groupBy(*named).agg(F.max_by(rest, ordinal).alias("_row")).select(*[F.col(c) if c in named else F.col(f"_row.{c}") for c in df.columns])


#: Evidence kept of a key.
MOST_EVIDENCE = 64


def smallest(df: DataFrame, groups: str | list[str], value: str, n: int, name: str | None = None) -> DataFrame:
    """groups and a sorted list of the n smallest distinct values of each; nulls don't count and groups without values are left out.

    Distinct first, then a group limit that Spark applies before the shuffle too, then a list: no task holds more than n values of a group.
    """
    few = top_k_per_group(df.select(*_keys(groups), value).filter(F.col(value).isNotNull()).distinct(), groups, n, F.col(value))
    return few.groupBy(*_keys(groups)).agg(F.array_sort(F.collect_list(value)).alias(name or value))


def merge_per_key(df: DataFrame, key: str, score: str = "score", evidence: str = "evidence", tier_rank: str = "tier_rank") -> DataFrame:
    """key, its best score, the first MOST_EVIDENCE of its distinct evidence in order, and its lowest tier rank."""
    best = df.groupBy(key).agg(F.max(score).alias(score), F.min(tier_rank).alias(tier_rank))
    lists = smallest(df.select(F.col(key).alias("_k"), F.explode(evidence).alias("_e")), "_k", "_e", MOST_EVIDENCE, evidence)
    none = F.array().cast(df.schema[evidence].dataType)
    return best.join(lists, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, score, F.coalesce(evidence, none).alias(evidence), tier_rank)


def merge_text(df: DataFrame, key: str, text: str, ordinal: str, glue: str = " Also: ") -> DataFrame:
    """Texts of a key joined in order; repeats once."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(ordinal, text))), lambda r: r[text])
    return df.groupBy(key).agg(F.array_join(F.array_distinct(ordered), glue).alias(text), F.min(ordinal).alias(ordinal))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, groups: str | list[str], k: int, *order: Column) -> DataFrame:
    """At most k rows of each group; Spark keeps only k rows of a group before the shuffle (window group limit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*_keys(groups)).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def rank_position_score(df: DataFrame, *order: Column, name: str = "score") -> DataFrame:
    """1 - place / rows, for a result small enough to be ranked as a whole (a top-k)."""
    everything = Window.partitionBy()
    return df.withColumn(name, 1.0 - (F.row_number().over(Window.orderBy(*order)) - 1) / F.count("*").over(everything))


def rank_position_score_by(df: DataFrame, group: str, *order: Column, name: str = "score") -> DataFrame:
    """rank_position_score() within each group, for groups of a top-k."""
    every = Window.partitionBy(group)
    return df.withColumn(name, 1.0 - (F.row_number().over(every.orderBy(*order)) - 1) / F.count("*").over(every))


def budgeted_tiers(df: DataFrame, key: str, core: Column, usable: Column, first: int, rest: int, *order: Column, name: str = "tier") -> DataFrame:
    """Tiers of ranked rows: core ones up to first, usable ones up to rest, then others up to rest; what is beyond all has a null tier.

    key and order are unique. Rows with a tier are among the first of their kind, which three top-k scans find; only those few are ranked by windows
    and joined back.
    """
    every = df.withColumn("_core", core).withColumn("_usable", usable)
    some = lambda rows, k: rows.orderBy(*order).limit(k)
    ranked = some(every.filter("_core"), first).unionByName(some(every.filter("_usable"), first + rest)).unionByName(some(every, first + 2 * rest)).dropDuplicates([key])
    w = Window.partitionBy("_core").orderBy(*order)
    ranked = ranked.withColumn("_must", F.col("_core") & (F.row_number().over(w) <= first))
    ranked = ranked.withColumn("_should", ~F.col("_must") & F.col("_usable") & (F.row_number().over(Window.partitionBy("_must", "_usable").orderBy(*order)) <= rest))
    left = ~F.col("_must") & ~F.col("_should")
    ranked = ranked.withColumn("_ignored", left & (F.row_number().over(Window.partitionBy("_must", "_should").orderBy(*order)) <= rest))
    tier = F.when(F.col("_must"), "mustRead").when(F.col("_should"), "shouldInspect").when(F.col("_ignored"), "ignoreForNow")
    found = F.broadcast(ranked.select(F.col(key).alias("_key"), tier.alias(name)))  # at most 2 * first + 3 * rest rows
    return df.join(found, df[key] == F.col("_key"), "left").drop("_key")
