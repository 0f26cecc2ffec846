"""From raw documents to packed training sequences, in stages over whole tables.

Each stage takes all that the one before has kept, and its decisions take effect. All but the last return
the columns of ``documents``. Rows without ``doc_id`` do not get beyond the second stage. An empty table
goes through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm import decontamination, jaccard, packing, quality_rules, recompression
from likeness.llm.packs import rest_of, with_rest
from likeness.session import stored


#: Bytes of texts on their way to a Python worker at a time, for this session.
BATCH_BYTES = 4 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The stages' batches are bounded by their bytes from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.75 or more, the document of the smallest id stays."""
    return jaccard.one_of_each_group(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that an earlier document has go; documents that lose all their words go."""
    found = recompression.substring_dedup(docs.withColumn("_rest", rest_of(docs)), tag="_rest")
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    columns = with_rest(left.select("doc_id", "text", "tag", "n_removed"), docs)
    # The length is brought up to date, where the table has one.
    return columns.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else columns


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_substrings),
    ("benchmark_decontamination", benchmark_leaks),
    ("packing", sequences),
]

#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
