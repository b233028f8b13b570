"""Connected components of an edge table, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of an edge; loops and repeats do no harm, null ends are ignored.

    Each round every node takes the smallest node it sees as parent, parents are followed twice, and edges are redrawn between the nodes
    reached; edges inside a tree vanish. Rounds grow with the logarithm of the longest path. All tables are stored, none is collected.
    """
    edges = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    label = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).withColumnRenamed("a", "v"), "parents")
        for _ in range(2):
            up = parent.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            parent = parent.join(up, F.col("p") == F.col("_v")).select("v", F.col("_p").alias("p"))
        parent = stored(parent, "parents")
        one, two = (parent.select(F.col("v").alias(f"v{i}"), F.col("p").alias(f"p{i}")) for i in (1, 2))
        edges = stored(edges.join(one, F.col("a") == F.col("v1")).join(two, F.col("b") == F.col("v2")).select(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).filter("a <> b").distinct(), "edges")
        if label is None:
            label = parent.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            label = stored(label.join(one, F.col("root") == F.col("v1"), "left").select("node", F.coalesce("p1", "root").alias("root")), "labels")
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label
