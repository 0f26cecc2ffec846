"""Weighted blend of several scores, and the search for its weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.operators.joins import dealt

WEIGHTS = ["a", "b", "c", "d"]


def join_scores(tables: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One column per score table, joined on the pair key; all share the key's partitioning."""
    named = [t.select(*key, F.col("score").alias(name)) for name, t in tables.items()]
    return reduce(lambda left, right: left.join(right, key), named)


def blend(scores: list[str], weights: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [w * F.col(s) for s, w in zip(scores, weights)])


def with_simplex(df: DataFrame, steps: int = 10) -> DataFrame:
    """Each row with every way to divide ``steps`` among four weights, as nested generators."""
    numbers = lambda last: F.explode(F.sequence(F.lit(0), last))
    return (
        df.withColumn("a", numbers(F.lit(steps)))
        .withColumn("b", numbers(F.lit(steps) - F.col("a")))
        .withColumn("c", numbers(F.lit(steps) - F.col("a") - F.col("b")))
        .withColumn("d", F.lit(steps) - F.col("a") - F.col("b") - F.col("c"))
    )


def weight_simplex(spark: SparkSession, steps: int = 10) -> DataFrame:
    return with_simplex(spark.range(1).select(), steps).select(*WEIGHTS)


def weight_accuracy(df: DataFrame, scores: list[str], label: str = "label", steps: int = 10) -> DataFrame:
    """Accuracy of every weighting.

    The scores are dealt evenly, each row is widened in place, and then only sums per weighting move.
    """
    total = blend(scores, [F.col(w) for w in WEIGHTS])
    correct = (total > steps / 2).cast("int") == F.col(label)
    return (
        with_simplex(dealt(df.select(*scores, label)), steps)
        .groupBy(*WEIGHTS)
        .agg(F.count("*").alias("n"), F.sum(correct.cast("int")).cast("bigint").alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("n"))
    )


def best_weights(df: DataFrame, scores: list[str], label: str = "label", steps: int = 10) -> DataFrame:
    """The weighting with the highest accuracy; of equals the first in order of its weights."""
    tried = weight_accuracy(df, scores, label, steps)
    return tried.orderBy(F.desc("correct"), "a", "b", "c").limit(1)


def blend_with_best(df: DataFrame, best: DataFrame, scores: list[str], steps: int = 10) -> DataFrame:
    """Add the winning blend as ``score`` and its prediction; ``best`` is a one-row table."""
    winner = best.select(F.struct(*WEIGHTS).alias("w")).scalar()
    weighted = df.withColumn("_w", winner)
    total = blend(scores, [F.col(f"_w.{w}") for w in WEIGHTS])
    return (
        weighted.withColumn("score", total / steps)
        .withColumn("prediction", (total > steps / 2).cast("int"))
        .drop("_w")
    )
