"""Session defaults, for programs that make their own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessel", **conf: str) -> SparkSession:
    """UTC, adaptive plans, Arrow; everything else is Spark's or the caller's choice."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=fixed | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
