"""Token tables: ordered streams, bags and counts.

Every operator here is a row-local projection: a document's tokens are sorted and counted
inside its own row, so none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.text import tokenize

_TO_THE_END = 1 << 30
SKETCH_SIZE = 14


def once(value: Column) -> Column:
    """A column that is worked out once per row, whatever reads it.

    Spark puts a column's expression in the place of its name if it is named once, which inside a lambda means to work it out for each
    element. It does not do so through a generator, and one over a single value changes nothing else.
    """
    return F.explode_outer(F.array(value))


def with_tokens(docs: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return docs.withColumn(out, tokenize(F.col(text)))


def with_token_numbers(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Add token list length and number of different tokens."""
    return docs.withColumn("num_tokens", F.size(tokens).cast("bigint")).withColumn(
        "num_unique_tokens", F.size(F.array_distinct(tokens)).cast("bigint")
    )


def explode_with_position(df: DataFrame, keys: str | list[str], array: str, out: str) -> DataFrame:
    """One row per array element and its position.

    The outer form is used on purpose: for the inner one the optimizer adds a filter on the
    array's size below the projection, which computes the whole array expression again.
    """
    keys = [keys] if isinstance(keys, str) else keys
    return df.select(*keys, F.posexplode_outer(array).alias("pos", out)).filter(F.col("pos").isNotNull())


def token_positions(docs: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """One row per token with its zero-based position."""
    return explode_with_position(docs, doc_id, tokens, "token")


def with_bag(docs: DataFrame, tokens: str = "tokens", out: str = "bag") -> DataFrame:
    """Add the token bag: an array of (token, cnt) sorted by token.

    The tokens are sorted and each is compared with the one before it; the distance between two
    run heads is the count. Arrays that are read twice get a column of their own, so each is
    computed once.
    """
    ordered = docs.withColumn("_sorted", F.sort_array(tokens))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("_sorted"))
    changes = F.zip_with("_sorted", before, lambda token, last: F.when(~token.eqNullSafe(last), token))
    heads = F.transform(
        changes, lambda token, i: F.when(token.isNotNull(), F.struct(token.alias("token"), i.alias("pos")))
    )
    headed = ordered.withColumn("_heads", F.array_compact(heads)).withColumn("_end", F.size("_sorted"))
    runs = F.zip_with(
        "_heads",
        F.slice("_heads", 2, _TO_THE_END),
        lambda head, following: F.struct(
            head["token"].alias("token"),
            (F.coalesce(following["pos"], F.col("_end")) - head["pos"]).cast("bigint").alias("cnt"),
        ),
    )
    return headed.withColumn(out, runs).drop("_sorted", "_heads", "_end")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """One row per document and different token with its count."""
    bags = with_bag(docs.select(doc_id, tokens), tokens)
    return explode_with_position(bags, doc_id, "bag", "entry").select(doc_id, "entry.token", "entry.cnt")


def token_sketches(docs: DataFrame, groups: list[str], tokens: str = "tokens", size: int = SKETCH_SIZE) -> DataFrame:
    """A mergeable sketch of the different tokens of each group: (groups..., sketch).

    The sketch is some kilobytes of binary, whatever it has seen. ``2 ** size`` is its number of buckets.
    """
    cut = docs.select(*groups, F.explode_outer(tokens).alias("token"))
    return cut.groupBy(*groups).agg(F.hll_sketch_agg("token", size).alias("sketch"))


def merged_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of parts, as of several batches, as one for each of the coarser ``groups``."""
    return sketches.groupBy(*groups).agg(F.hll_union_agg("sketch").alias("sketch"))


def approximate_numbers(sketches: DataFrame) -> DataFrame:
    """Add ``num_unique_tokens``, off by a relative error of about ``1.04 / sqrt(2 ** size)`` in the mean."""
    return sketches.withColumn("num_unique_tokens", F.hll_sketch_estimate("sketch"))
