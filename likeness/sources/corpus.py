"""Reading corpora, submitted batches and labelled pair vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR_SCHEMA = T.StructType(
    [T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())]
)


#: Two code points that are no characters keep the genuine replacement characters of a text apart from those put in.
_ESCAPE = "\ufdd0"
_REPLACED = "\ufffd"


def decoded(content: Column) -> Column:
    """Bytes as text; those that are no UTF-8 are dropped, while replacement characters that the text itself has stay."""
    kept = F.replace(F.replace(content.cast("string"), F.lit(_ESCAPE), F.lit(_ESCAPE + "a")), F.lit(_REPLACED), F.lit(_ESCAPE + "b"))
    dropped = F.replace(F.make_valid_utf8(kept), F.lit(_REPLACED), F.lit(""))
    return F.replace(F.replace(dropped, F.lit(_ESCAPE + "b"), F.lit(_REPLACED)), F.lit(_ESCAPE + "a"), F.lit(_ESCAPE))


def load_corpus(spark: SparkSession, path: str, suffix: str = ".java") -> DataFrame:
    """All files below a folder, one row each, with the facts their path carries.

    Besides: ``doc_id`` (64 bits of the path's hash, for joins), ``file_id`` (128 bits of it), ``n_bytes`` and ``content_sha256``.
    Spark's file sources leave out files of no bytes.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(path)
        .select(
            "path",
            decoded(F.col("content")).alias("text"),
            F.col("length").alias("n_bytes"),
            F.sha2("content", 256).alias("content_sha256"),
        )
    )
    return label_from_path(files).withColumn("doc_id", F.xxhash64("path")).withColumn("file_id", F.md5("path"))


def path_part(path: Column, from_end: int) -> Column:
    """A part of a path counted from its end, 1 being the file name."""
    return F.element_at(F.split(path, "/"), -from_end)


def label_from_path(files: DataFrame, path: str = "path") -> DataFrame:
    """Add case_id, role, label and level as the folder names tell them.

    The level is the folder two above the file's own, so for a non-plagiarized file it is that
    word; an original has none. The label of an original is null.
    """
    column = F.col(path)
    role = F.regexp_extract(column, "/(original|non-plagiarized|plagiarized)/", 1)
    return (
        files.withColumn("case_id", F.regexp_extract(column, "(case-[^/]+)/", 1))
        .withColumn("role", role)
        .withColumn(
            "label", F.when(F.col("role") == "non-plagiarized", 0).when(F.col("role") == "plagiarized", 1)
        )
        .withColumn("level", F.when(F.col("role").isin("non-plagiarized", "plagiarized"), path_part(column, 3)))
    )


def counts_in_batch(path: str = "path", suffix: str = ".java") -> Column:
    """Whether a file counts: a code file that lies at the top of its batch."""
    return ~F.col(path).contains("/") & F.col(path).endswith(suffix)


def load_batch(files: DataFrame, batch: str = "batch_id", path: str = "path", suffix: str = ".java") -> DataFrame:
    """The files of submitted batches that count."""
    return files.filter(counts_in_batch(path, suffix))


def read_pairs(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Labelled vectors, with a fixed schema."""
    return spark.read.schema(PAIR_SCHEMA).format(kind).load(path)


def parse_pairs(lines: DataFrame, column: str = "json") -> DataFrame:
    """Labelled vectors from JSON text."""
    parsed = F.from_json(column, PAIR_SCHEMA)
    kept = [c for c in lines.columns if c != column]
    return lines.select(*kept, parsed.alias("pair")).select(*kept, "pair.features", "pair.label")
