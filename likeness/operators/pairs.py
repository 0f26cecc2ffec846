"""Pair tables: which documents are compared with which.

A corpus has one row per document with ``doc_id``, ``case_id``, ``role`` (original, plagiarized,
non-plagiarized) and ``label``. Pair tables hold ids only; texts are joined when pairs are measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.operators.joins import join_one
from likeness.operators.ranking import hash_key, hash_rank
from likeness.session import stored

ORIGINAL = "original"
PLAGIARIZED = "plagiarized"
NON_PLAGIARIZED = "non-plagiarized"


def first_as_original(docs: DataFrame, doc_id: str = "doc_id", case_id: str = "case_id") -> DataFrame:
    """Add ``is_original``: the document with the smallest id of its case.

    The minimum is a partial aggregate, so a case of any size costs one row per task.
    """
    firsts = docs.groupBy(case_id).agg(F.min(doc_id).alias(doc_id)).select(doc_id, F.lit(True).alias("_first"))
    return docs.join(firsts, doc_id, "left").withColumn("is_original", F.col("_first").isNotNull()).drop("_first")


def case_pairs(corpus: DataFrame) -> DataFrame:
    """Each original with every variant of its case: (case_id, doc1, doc2, label).

    The result grows with the variants; the variants of a large case are dealt onto several tasks.
    """
    originals = corpus.filter(F.col("role") == ORIGINAL).select("case_id", F.col("doc_id").alias("doc1"))
    variants = corpus.filter(F.col("role") != ORIGINAL).select("case_id", F.col("doc_id").alias("doc2"), "label")
    return join_one(variants, originals, ["case_id"], "doc2").select("case_id", "doc1", "doc2", "label")


def one_pair(docs: DataFrame, original_id, suspect_id) -> DataFrame:
    """A pair table with the given two documents, empty unless both exist."""
    found = docs.filter(F.col("doc_id").isin([original_id, suspect_id])).agg(
        F.countDistinct("doc_id").alias("n"),
    )
    return found.filter(F.col("n") == len({original_id, suspect_id})).select(
        F.lit(original_id).alias("doc1"), F.lit(suspect_id).alias("doc2")
    )


def positive_pairs(corpus: DataFrame) -> DataFrame:
    """Each original with every plagiarized document of its case, label 1."""
    copies = corpus.filter(F.col("role").isin(ORIGINAL, PLAGIARIZED))
    return case_pairs(copies).withColumn("label", F.lit(1))


def negative_pairs(corpus: DataFrame, k: int = 5, rings: int = 64, seed: int = 42) -> DataFrame:
    """Each original with ``k`` non-plagiarized documents of other cases, label 0; with all there are, if fewer.

    All candidates stand in one hash order, those of a case together, so an original's own case is a
    stretch that its draws step over. What is left is cut into ``k`` parts, from a place that is the
    original's own, and a hash draws one candidate of each: always different ones, and any can be drawn.
    Cases are counted in ``rings`` slices.
    """
    number = lambda *of: F.conv(F.substring(hash_key(seed, *of), 1, 15), 16, 10).cast("bigint")
    candidates = corpus.filter((F.col("role") == NON_PLAGIARIZED) & F.col("case_id").isNotNull())
    candidates = candidates.select(F.col("doc_id").alias("doc2"), F.col("case_id").alias("case2")).distinct()
    ranked = stored(hash_rank(candidates, ["doc2"], ["case2"], seed + 1), "candidates")
    cases = stored(_stretches(ranked.filter(F.col("rank") == 1).select("case2", F.col("group_size").alias("own")), rings, seed), "cases")
    placed = join_one(ranked, cases.select("case2", "first"), ["case2"], "doc2").select(
        "doc2", (F.col("first") + F.col("rank") - 1).alias("place")
    )

    originals = corpus.filter(F.col("role") == ORIGINAL).select(F.col("doc_id").alias("doc1"), "case_id").distinct()
    total = F.lit(cases.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0])
    own = originals.filter(F.col("case_id").isNotNull()).join(cases.withColumnRenamed("case2", "case_id"), "case_id", "left")
    left = own.fillna(0, ["first", "own"]).withColumn("left", total - F.col("own")).filter("left > 0")
    draws = left.withColumn("parts", F.least(F.lit(k), F.col("left"))).withColumn("i", F.explode(F.expr("sequence(0, parts - 1)")))
    begin, end = F.expr("i * left div parts"), F.expr("(i + 1) * left div parts")
    drawn = begin + F.pmod(number(F.lit("draw"), F.col("doc1"), F.col("i")), end - begin)
    turned = draws.withColumn("place", F.pmod(drawn + F.pmod(number(F.lit("from"), F.col("doc1")), F.col("left")), F.col("left")))
    over = F.when(F.col("place") < F.col("first"), F.col("place")).otherwise(F.col("place") + F.col("own"))
    return turned.withColumn("place", over).join(placed, "place").select("case_id", "doc1", "doc2", F.lit(0).alias("label"))


def _stretches(cases: DataFrame, rings: int, seed: int) -> DataFrame:
    """Add ``first``: the candidates (``own``) of all cases before, in order of ring and hash."""
    key = hash_key(seed + 1, F.col("case2"))
    ring = F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), F.lit(rings))
    dealt = cases.withColumn("turn", key).withColumn("ring", ring)
    before = lambda window: F.coalesce(F.sum("own").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # As many rows as there are rings.
    offsets = dealt.groupBy("ring").agg(F.sum("own").alias("own")).select(
        "ring", before(Window.partitionBy(F.lit(0)).orderBy("ring")).alias("_before")
    )
    within = dealt.withColumn("_within", before(Window.partitionBy("ring").orderBy("turn", "case2")))
    return within.join(offsets, "ring").select("case2", "own", (F.col("_before") + F.col("_within")).alias("first"))


def training_pairs(corpus: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Positive and negative pairs in random but repeatable order."""
    both = positive_pairs(corpus).unionByName(negative_pairs(corpus, k, seed=seed))
    return both.withColumn("turn", hash_key(seed, F.col("doc1"), F.col("doc2"))).orderBy("turn")
