"""Scores of discovery results against expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of each metric in the whole.
WEIGHTS = {"must_read_precision": 0.22, "must_read_coverage": 0.18, "chain_accuracy": 0.16, "reuse_accuracy": 0.12, "impact_coverage": 0.12, "noise_suppression": 0.04, "suppression_quality": 0.08, "explanation_quality": 0.02, "latency": 0.06}


def ratio(hits: Column, all_: Column) -> Column:
    """1 where nothing was expected."""
    return F.when(all_ == 0, 1.0).otherwise(hits / all_)


def latency_score(ms: Column) -> Column:
    return F.when(ms <= 2500, 1.0).when(ms <= 5000, 0.8).otherwise(0.6)


def production_score(metrics: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(w) * metrics[name] for name, w in WEIGHTS.items()))


def score_cases(cases: DataFrame) -> DataFrame:
    """Each case with its metrics and production_score.

    cases: id, found (array of paths read), expected, forbidden (arrays), limit (int or null), chain, wanted_chain, reuse, wanted_reuse, tests, wanted_tests,
    reasons, wanted_reasons (arrays) and latency_ms. Arrays are compared by equality; patterns are resolved before.
    """
    c = F.col
    both = lambda a, b: F.size(F.array_intersect(c(a), c(b)))
    forbidden, n = both("found", "forbidden"), F.size("found")
    over = c("limit").isNotNull() & (n > c("limit"))
    m = {
        "must_read_precision": F.when(over | (n == 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - forbidden / n)),
        "must_read_coverage": ratio(both("expected", "found"), F.size(F.array_distinct("expected"))),
        "chain_accuracy": ratio(both("wanted_chain", "chain"), F.size(F.array_distinct("wanted_chain"))),
        "reuse_accuracy": ratio(both("wanted_reuse", "reuse"), F.size(F.array_distinct("wanted_reuse"))),
        "impact_coverage": ratio(both("wanted_tests", "tests"), F.size(F.array_distinct("wanted_tests"))),
        "noise_suppression": F.when(forbidden == 0, 1.0).otherwise(0.0),
        "suppression_quality": ratio(both("wanted_reasons", "reasons"), F.size(F.array_distinct("wanted_reasons"))),
        "explanation_quality": F.when(n == 0, 0.0).otherwise(1.0),
        "latency": latency_score(c("latency_ms")),
    }
    named = cases.select("id", "latency_ms", *[v.alias(k) for k, v in m.items()])
    return named.withColumn("production_score", production_score({k: c(k) for k in WEIGHTS}))


def summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("cases"), F.avg("production_score").alias("score"), F.sum("latency_ms").alias("latency_ms"))


def slowest_stages(stages: DataFrame, k: int = 5) -> DataFrame:
    """stages: case, stage, ms."""
    return stages.groupBy("stage").agg(F.sum("ms").alias("ms")).orderBy(F.desc("ms"), "stage").limit(k)
