"""Repeatable random order, and exact ranks in it without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int, *ids: Column) -> Column:
    """A random-looking text key, the same in every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_rank(df: DataFrame, ids: list[str], groups: list[str] = (), seed: int = 42, digits: int = 4) -> DataFrame:
    """Add ``rank`` (from 1) in hash order and ``group_size``, per group.

    Rows are cut into ``16 ** digits`` slices by the first digits of their key. The ranks within a
    slice come from a window over that slice; the rows before it from a running sum over the slice
    counts, a table whose size is fixed by ``digits`` and the number of groups.
    """
    groups = list(groups)
    keyed = df.withColumn("_key", hash_key(seed, *[F.col(i) for i in ids])).withColumn(
        "_slice", F.substring("_key", 1, digits)
    )
    counts = keyed.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *groups,
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("group_size"),
    )
    within = Window.partitionBy(*groups, "_slice").orderBy("_key", *ids)
    ranked = keyed.withColumn("_within", F.row_number().over(within)).join(offsets, [*groups, "_slice"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_within")).drop("_key", "_slice", "_before", "_within")
