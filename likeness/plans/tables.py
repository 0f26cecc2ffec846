"""Views of the stored tables in the shape the operators take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.operators.pairs import NON_PLAGIARIZED, ORIGINAL, PLAGIARIZED, case_pairs, first_as_original
from likeness.operators.similarity import bags_of, measure_pairs, profiles, token_overlap
from likeness.session import stored

# Rewrites that turn prose into code-like text: some sentence openers become keywords, commas
# argument lists, sentence ends semicolons, lines blocks, junk marks assignments and comments.
CODE_REWRITES = [
    (". ", "; "),
    (".\n", ";\n"),
    (", ", "(x, y) "),
    ("The ", "if (a < f(b)) "),
    ("De ", "if (c) "),
    ("Of ", "for (i = 0; i < g(n); i++) "),
    ("La ", "for (i; j) "),
    ("And ", "while (more()) "),
    ("Der ", "while (true) "),
    ("To ", "return "),
    ("In ", "System.out "),
    ("Is ", "java.util "),
    ("It ", "import "),
    ("A ", "package "),
    ("On ", "class "),
    ("Be ", "try { "),
    ("That ", "public static "),
    ("This ", "else "),
    ("%%%", " ="),
    ("###", " // "),
    ("***", " /* "),
    ("$$$", " */ "),
    ("\n", "\n}\n{ "),
]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out to all cores.

    Text work is heavy per row, and a file with one row group is one task. An input with at least
    as many splits as there are cores, as any large one has, is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_code(text: Column) -> Column:
    body = reduce(lambda t, rule: F.replace(t, *map(F.lit, rule)), CODE_REWRITES, text)
    return F.concat(F.lit("{ "), body, F.lit(" }"))


def code_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents rewritten as code: (doc_id, case_id, text)."""
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", F.concat_ws("/", "lang", "source").alias("case_id"), as_code(F.col("text")).alias("text"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as they are: (doc_id, case_id, lang, text)."""
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", F.concat_ws("/", "lang", "source").alias("case_id"), "lang", "text")


def with_roles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add role and label: a case's first document is the original, ``quality`` labels the others."""
    judged = labels.select("doc_id", F.col("quality").alias("label"))
    role = (
        F.when(F.col("is_original"), ORIGINAL)
        .when(F.col("label") == 1, PLAGIARIZED)
        .when(F.col("label") == 0, NON_PLAGIARIZED)
        .otherwise("unknown")
    )
    return (
        first_as_original(docs)
        .join(judged, "doc_id", "left")
        .withColumn("role", role)
        .withColumn("label", F.when(~F.col("is_original"), F.col("label")))
        .drop("is_original")
    )


def corpus_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus without its texts: (doc_id, case_id, role, label)."""
    docs = documents(spark, folder).select("doc_id", "case_id")
    return with_roles(docs, read_table(spark, folder, "labels"))


def conversation_files(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as submitted batches: (batch_id, path, doc_id, text), the user's turns on top."""
    turns = read_table(spark, folder, "conversations")
    name = F.format_string("t%d.java", "turn")
    path = F.when(F.col("role") == "user", name).otherwise(F.concat(F.lit("replies/"), name))
    return turns.select(
        F.col("conv_id").alias("batch_id"),
        path.alias("path"),
        (F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"),
        "text",
    )


def corpus_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a path in the layout of a labelled code corpus: (doc_id, path)."""
    ids = corpus_ids(spark, folder)
    level = F.concat(F.lit("L"), (F.col("doc_id") % 6 + 1).cast("string"))
    number = F.col("doc_id").cast("string")
    case = F.concat(F.lit("corpus/case-"), F.translate("case_id", "/", "-"))
    path = (
        F.when(F.col("role") == ORIGINAL, F.concat(case, F.lit("/original/"), number, F.lit(".java")))
        .when(F.col("role") == NON_PLAGIARIZED, F.concat(case, F.lit("/non-plagiarized/"), number, F.lit("/Main.java")))
        .otherwise(F.concat(case, F.lit("/plagiarized/"), level, F.lit("/"), number, F.lit("/Main.java")))
    )
    return ids.select("doc_id", path.alias("path"))


def bags_in_pairs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bags of the documents that are in some pair, written once."""
    wanted = pairs.select(F.explode(F.array("doc1", "doc2")).alias("doc_id")).distinct()
    return stored(bags_of(texts.join(wanted, "doc_id", "left_semi")), "bags")


def scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled case pairs with four plain scores in 200ths, standing in for models in evaluations.

    Only documents that some pair needs are tokenised, each once.
    """
    pairs = stored(case_pairs(corpus_ids(spark, folder)).filter(F.col("label").isNotNull()), "ids")
    bags = bags_in_pairs(documents(spark, folder).select("doc_id", "text"), pairs)
    both = token_overlap(pairs, bags, bags)
    parts = "200 * {} div greatest({}, 1)"
    larger, smaller = "greatest(num_tokens1, num_tokens2)", "least(num_tokens1, num_tokens2)"
    return both.select(
        "case_id",
        "doc1",
        "doc2",
        "label",
        F.expr(parts.format("token_overlap", larger)).alias("votes_a"),
        F.expr(parts.format("token_overlap", smaller)).alias("votes_b"),
        F.expr(parts.format(smaller, larger)).alias("votes_c"),
        F.expr(
            parts.format(
                "least(num_unique_tokens1, num_unique_tokens2)", "greatest(num_unique_tokens1, num_unique_tokens2)"
            )
        ).alias("votes_d"),
    )


def measured_pairs(spark: SparkSession, folder: str, labelled: bool = False) -> DataFrame:
    """All case pairs of the code documents, or the ``labelled`` ones, with their features and measures.

    Only documents that some pair needs are profiled.
    """
    every = case_pairs(corpus_ids(spark, folder))
    pairs = stored(every.filter(F.col("label").isNotNull()) if labelled else every, "ids")
    docs = code_documents(spark, folder).select("doc_id", "text")
    if labelled:
        wanted = pairs.select(F.explode(F.array("doc1", "doc2")).alias("doc_id")).distinct()
        docs = docs.join(wanted, "doc_id", "left_semi")
    profiled = profiles(docs)
    return measure_pairs(pairs, profiled, profiled)
