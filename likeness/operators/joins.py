"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table by the given keys onto as many tasks as the session shuffles with.

    For few bytes with much work behind each row, as ids of pairs or strings that become a row per
    character: adaptive execution, which looks at bytes, would put so small a table into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_one(many: DataFrame, one: DataFrame, keys: list[str], spread_by: str, salts: int = 16) -> DataFrame:
    """Inner join where ``one`` has a single short row, or a few, per key and ``many`` any number.

    The rows of a key are dealt onto ``salts`` parts by ``spread_by`` and the single row is sent to
    each, so a key with a third of all rows is no task's burden.
    """
    parts = F.sequence(F.lit(0), F.lit(salts - 1))
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = one.withColumn("_salt", F.explode(parts))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")
