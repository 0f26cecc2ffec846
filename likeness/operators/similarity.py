"""Measures of a pair of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.cutting import counted_tokens
from likeness.operators.joins import dealt, join_one
from likeness.operators.structure import CODER, KIND_NAMES, features_of_codes
from likeness.operators.tokens import with_bag, with_tokens
from likeness.session import stored

# Names and order of one side of the feature vector.
FEATURE_KEYS = [
    "num_tokens",
    "num_methods",
    "num_if",
    "num_for",
    "num_while",
    "num_return",
    "num_imports",
    "num_package",
    "num_expressions",
    "num_statements",
    "num_systemcall",
    "num_javacall",
    "num_variables",
    "num_var_declarations",
    "num_method_calls",
    "max_depth",
    "avg_method_length",
    "num_unique_tokens",
    "token_overlap",
    "ast_levenshtein_distance",
    "ast_levenshtein_similarity",
]
PAIR_KEYS = FEATURE_KEYS[-3:]
DOC_KEYS = FEATURE_KEYS[:-3]

#: The letters of kind sequences; others are possible and only make the bound of the distance weaker.
SEQUENCE_LETTERS = sorted(KIND_NAMES)
FIRST_LIMIT = 8
LIMIT_STEPS = 6


def profiles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Everything a pair measure needs of a document: features, kind sequence and token bag.

    A text is cut into tokens once, and the result written, as both sides of a pair are attached from it.
    """
    cut = stored(counted_tokens(docs, doc_id, text=text, code=CODER), "tokens")
    return stored(features_of_codes(cut.drop("bag"), doc_id).join(cut.select(doc_id, "bag"), doc_id), "profiles")


def bags_of(docs: DataFrame, *keep: str, text: str = "text", sequence: bool = False, sketch: bool = False) -> DataFrame:
    """Token bag and token numbers of each document, without any shuffle; with a hash of the token ``sequence``, or a ``sketch``, if asked for."""
    if not sequence:
        return counted_tokens(docs, "doc_id", *keep, text=text, sketch=sketch)
    bags = with_bag(with_tokens(docs.select("doc_id", *keep, text), text))
    return bags.select(
        "doc_id",
        *keep,
        F.size("tokens").cast("bigint").alias("num_tokens"),
        F.size("bag").cast("bigint").alias("num_unique_tokens"),
        "bag",
        F.sha2(F.to_json("tokens"), 256).alias("sequence"),
    )


def bag_overlap(bag1: Column, bag2: Column) -> Column:
    """Size of the intersection of two token bags.

    Both sorted bags are merged; a token of both stands next to itself and counts its smaller entry.
    """
    merged = F.sort_array(F.concat(bag1, bag2))
    shared = F.zip_with(
        merged,
        F.slice(merged, 2, 1 << 30),
        lambda entry, following: F.when(
            entry["token"] == following["token"], F.least(entry["cnt"], following["cnt"])
        ).otherwise(F.lit(0).cast("bigint")),
    )
    return F.aggregate(shared, F.lit(0).cast("bigint"), lambda total, cnt: total + cnt)


def least_distance(kinds1: Column, kinds2: Column) -> Column:
    """What the edit distance of two sequences is at least, by their lengths and by how often each kind of statement stands in them."""
    surplus = []
    for letter in SEQUENCE_LETTERS:
        count = lambda s: F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))  # noqa: E731, B023
        surplus.append(count(kinds1) - count(kinds2))
    more = sum((F.greatest(d, F.lit(0)) for d in surplus), F.lit(0))
    fewer = sum((F.greatest(-d, F.lit(0)) for d in surplus), F.lit(0))
    return F.greatest(more, fewer, F.abs(F.length(kinds1) - F.length(kinds2)))


def with_sequence_distance(pairs: DataFrame, kinds1: str = "kinds1", kinds2: str = "kinds2", out: str = "distance") -> DataFrame:
    """Add the unit-cost edit distance of two kind sequences, exactly, by rising limits.

    Within a limit only a band of the table is filled. The first limit is twice what the distance is at least, each further one four
    times the last; a limit that would fill half of the table gives way to the whole one. Each step is a column of its own, so that
    it is worked out once.
    """
    longest = F.greatest(F.length(kinds1), F.length(kinds2))
    rows = pairs.withColumn("_limit", 2 * least_distance(F.col(kinds1), F.col(kinds2)) + FIRST_LIMIT).withColumn(out, F.lit(-1))
    for step in range(LIMIT_STEPS):
        limit = F.col("_limit") * 4**step
        full = F.lit(step == LIMIT_STEPS - 1) | (2 * limit >= longest)
        within = F.expr(f"levenshtein({kinds1}, {kinds2}, CAST(_limit * {4**step} AS INT))")
        found = F.when(full, F.levenshtein(kinds1, kinds2)).otherwise(within)
        rows = rows.withColumn(out, F.when(F.col(out) >= 0, F.col(out)).otherwise(found))
    return rows.withColumn(out, F.col(out).cast("bigint")).drop("_limit")


def sequence_similarity(distance: Column, kinds1: Column, kinds2: Column) -> Column:
    longest = F.greatest(F.length(kinds1), F.length(kinds2))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance / longest)


def attach(pairs: DataFrame, docs: DataFrame, side: int) -> DataFrame:
    """Join the columns of a document table to one side of a pair table, suffixed by the side."""
    renamed = docs.select([F.col(c).alias(f"doc{side}" if c == "doc_id" else f"{c}{side}") for c in docs.columns])
    return pairs.join(renamed, f"doc{side}")


def attach_firsts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Join the columns of a document table to the first side of a pair table, where a document may have any number of pairs.

    Only documents that are first in a pair take part; the pairs of each are dealt onto several tasks.
    """
    firsts = docs.join(pairs.select(F.col("doc1").alias("doc_id")).distinct(), "doc_id", "left_semi")
    renamed = firsts.select([F.col(c).alias("doc1" if c == "doc_id" else f"{c}1") for c in docs.columns])
    return join_one(pairs, renamed, ["doc1"], "doc2")


def token_overlap(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Add ``token_overlap`` and both token numbers to a pair table, given bags of both sides."""
    both = attach(attach_firsts(dealt(pairs, "doc1", "doc2"), left), right, 2)
    return both.withColumn("token_overlap", bag_overlap(F.col("bag1"), F.col("bag2"))).drop("bag1", "bag2")


def measure_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Add the three pair measures, given profiles of both sides."""
    both = attach(attach_firsts(dealt(pairs, "doc1", "doc2"), left), right, 2)
    both = both.withColumn("token_overlap", bag_overlap(F.col("bag1"), F.col("bag2"))).drop("bag1", "bag2")
    return with_sequence_distance(both, out="ast_levenshtein_distance").withColumn(
        "ast_levenshtein_similarity",
        sequence_similarity(F.col("ast_levenshtein_distance"), F.col("kinds1"), F.col("kinds2")),
    )


def pair_vector(measured: DataFrame, out: str = "features") -> DataFrame:
    """Add the feature vector: the ordered keys of the left side, then of the right; missing is 0."""

    def side(number: int) -> list[Column]:
        names = [key if key in PAIR_KEYS else f"{key}{number}" for key in FEATURE_KEYS]
        return [F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in names]

    return measured.withColumn(out, F.array(*side(1), *side(2)))


def feature_keys(rows: DataFrame, features: str = "features") -> DataFrame:
    """Ordered union of the keys of all feature maps: (pos, name).

    Keys stand in the order of the row that first shows them and of their place in it.
    """
    seen = rows.select("row", F.posexplode(F.map_keys(features)).alias("place", "name"))
    first = seen.groupBy("name").agg(F.min(F.struct("row", "place")).alias("first"))
    # One row per feature name from here on.
    keys = first.agg(F.array_sort(F.collect_list(F.struct("first", "name"))).alias("keys"))
    return keys.select(F.posexplode("keys").alias("pos", "key")).select("pos", "key.name")


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is all zero."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
