"""Text rules, shared storage and small helpers used by every operator here."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that ends a word, as a regular expression class; the same bytes at which bytes.split() splits.
SPACES = r"[\x20\x09-\x0D]+"
#: What separates benchmark words: every ASCII character but letters and digits. For text whose A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else, unlike lower(), which also maps other alphabets."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str) -> Column:
    """The array that split() gives; it may begin or end with an empty string (see n_words)."""
    return F.split(F.coalesce(text, F.lit("")), separators)


def n_words(parts: Column) -> Column:
    """Number of words in what split_words() returned, as a long."""
    n = F.size(parts)
    first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    last = F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (n - first - last).cast("long")


def words(text: Column, separators: str) -> Column:
    """The words of a text, without empty strings at either end."""
    parts = split_words(text, separators)
    return F.slice(parts, F.when(F.element_at(parts, 1) == "", 2).otherwise(1), n_words(parts).cast("int"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A temporary one only where that is unset and Spark runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tessel-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


class _Made(threading.local):
    """For each open clearing() of a thread, the paths made since; other threads' are not touched."""

    def __init__(self):
        self.open: list[list[str]] = []


_MADE = _Made()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}"
    if _MADE.open:
        _MADE.open[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch paths that were made inside, once the block has ended well. For work whose result is written to a path made before."""
    _MADE.open.append([])
    try:
        yield
    finally:
        made = _MADE.open.pop()
    for path in made:
        remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, its size is known to the planner, and losing an executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes that the planner assumes for a stored table: the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int) -> DataFrame:
    """df, marked for broadcast if it is a stored table whose files take at most limit bytes; otherwise the planner chooses."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
