"""Train and test splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.operators.ranking import hash_key, hash_rank


def random_split(df: DataFrame, ids: list[str], train_percent: int = 80, seed: int = 42) -> DataFrame:
    """Add ``is_train``: the first ``train_percent`` of the rows (rounded down) in hash order."""
    return _cut(hash_rank(df, ids, seed=seed), train_percent)


def stratified_split(
    df: DataFrame, ids: list[str], label: str = "label", train_percent: int = 80, seed: int = 42
) -> DataFrame:
    """Add ``is_train`` so that each label is divided in the same proportion."""
    return _cut(hash_rank(df, ids, [label], seed=seed), train_percent)


def validation_split(df: DataFrame, ids: list[str], held_out_percent: int = 20, seed: int = 42) -> DataFrame:
    """Add ``is_validation``: the last part of the shuffled rows."""
    cut = random_split(df, ids, 100 - held_out_percent, seed)
    return cut.withColumn("is_validation", ~F.col("is_train")).drop("is_train")


def folds(df: DataFrame, ids: list[str], k: int = 5, label: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``fold`` from 0 to k-1, of equal sizes, within each label if one is named."""
    ranked = hash_rank(df, ids, [label] if label else [], seed=seed)
    fold = F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")
    return ranked.withColumn("fold", fold).drop("rank", "group_size")


def bootstrap(df: DataFrame, ids: list[str], ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """A sample with replacement of exactly ``ratio`` times the rows, rounded, the same in every run.

    Each draw is a hash of its number and takes the row of that rank.
    """
    rows = df.count()
    draws = df.sparkSession.range(int(ratio * rows + 0.5)).withColumn("draw", hash_key(seed, F.lit("draw"), F.col("id")))
    number = F.conv(F.substring("draw", 1, 15), 16, 10).cast("bigint")
    drawn = draws.select((F.pmod(number, F.lit(max(1, rows))) + 1).alias("rank"))
    return drawn.join(hash_rank(df, ids, seed=seed).drop("group_size"), "rank").drop("rank")


def _cut(ranked: DataFrame, train_percent: int) -> DataFrame:
    is_train = F.col("rank") <= F.floor(F.col("group_size") * train_percent / 100)
    return ranked.withColumn("is_train", is_train).drop("rank", "group_size")
