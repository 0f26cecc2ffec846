"""Writing pair vectors, feature names, models, metrics and reports."""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.operators.similarity import FEATURE_KEYS


def write_pairs(pairs: DataFrame, path: str, kind: str = "parquet", by_case: bool = True) -> None:
    """Labelled vectors, in one folder per case."""
    writer = pairs.write.mode("overwrite").format(kind)
    (writer.partitionBy("case_id") if by_case else writer).save(path)


def feature_key_table(spark: SparkSession) -> DataFrame:
    names = F.array(*[F.lit(name) for name in FEATURE_KEYS])
    return spark.range(1).select(F.posexplode(names).alias("pos", "name"))


def write_feature_keys(spark: SparkSession, path: str) -> None:
    feature_key_table(spark).coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """Any saved model, its class read from its own metadata."""
    return DefaultParamsReader.loadParamsInstance(path, spark)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON row per model: the rates and the confusion matrix, actual classes in rows."""
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    rates = [F.col("f1").alias("f1_score") if c == "f1" else F.col(c) for c in metrics.columns if c not in ("tn", "fp", "fn", "tp")]
    metrics.select(*rates, matrix.alias("confusion_matrix")).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str, mode: str = "append") -> None:
    """Report rows as JSON, by default added to what the folder holds, so that its history grows."""
    report.write.mode(mode).json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    comparison = "struct<file1:string,file2:string,prediction:int,confidence:array<double>,error:string>"
    schema = (
        "batch_id string, page bigint, total_files bigint, total_comparisons bigint, threshold int, error string, "
        f"comparisons array<{comparison}>, submitted_at timestamp"
    )
    return spark.read.schema(schema).json(path)
