"""A feed of file changes kept up to date: the last hash of each path, and batches of real changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _changes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, seen = state.get if state.exists else (None, None)
    rows = pd.concat(list(parts)).sort_values(["ts", "hash"], kind="stable")
    out = []
    for ts, new in zip(rows["ts"], rows["hash"], strict=True):
        at = ts.value
        if seen is not None and at < seen:
            continue  # older than what is known
        if new != last:
            out.append((key[0], ts, new, "deleted" if new is None else "new" if last is None else "changed"))
        last, seen = new, at
    state.update((last, seen))
    yield pd.DataFrame(out, columns=["path", "ts", "hash", "status"])


def hash_changes(feed: DataFrame) -> DataFrame:
    """path, ts, hash and status (new, changed, deleted) of events (path, ts, hash; a null hash is a deletion) that change what is known of a path.
    State is one hash and time for each path; events older than that are ignored."""
    return feed.groupBy("path").applyInPandasWithState(_changes, "path string, ts timestamp, hash string, status string", "hash string, seen long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(feed: DataFrame, width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Events in tumbling windows, with a watermark for late ones."""
    return feed.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def follow(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Calls apply with each batch of changes; a batch comes again after a failure, so apply must be idempotent (a keyed recompute is)."""
    writer = changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply(df))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
