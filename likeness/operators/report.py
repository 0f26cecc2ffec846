"""Reports on submitted batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.operators.joins import join_one

# Wording shown to readers.
PLAGIARIZED_TEXT = "Plagiarized"
NOT_PLAGIARIZED_TEXT = "Not Plagiarized"
NO_CONFIDENCE_TEXT = "No confidence score available."
TOO_FEW_FILES_TEXT = "ZIP must contain at least 2 Java files"


def accepted_batches(files: DataFrame, batch: str = "batch_id", counts: Column | None = None) -> DataFrame:
    """Number of files per batch, with an error for batches of fewer than two.

    ``counts`` says which files count; a batch without any has a row and its error too.
    """
    counted = files.groupBy(batch).agg(F.count_if(F.lit(True) if counts is None else counts).alias("total_files"))
    return counted.withColumn("error", F.when(F.col("total_files") < 2, F.lit(TOO_FEW_FILES_TEXT)))


def status_label(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit(PLAGIARIZED_TEXT)).otherwise(F.lit(NOT_PLAGIARIZED_TEXT))


def confidence_pct(probability: Column, digits: int = 1) -> Column:
    """A probability as a percentage, or a message where there is none."""
    shown = F.format_string(f"%.{digits}f%%", probability * 100)
    return F.when(probability.isNotNull(), shown).otherwise(F.lit(NO_CONFIDENCE_TEXT))


def plagiarized_pairs(comparisons: DataFrame) -> DataFrame:
    return comparisons.filter(F.col("prediction") == 1)


def report_summary(
    files: DataFrame, comparisons: DataFrame, batch: str = "batch_id", counts: Column | None = None
) -> DataFrame:
    """Per batch: files, comparisons, listed pairs and plagiarized pairs, or the error of a rejected one.

    ``counts`` says which files count, as for ``accepted_batches``. The number of comparisons follows from their number. A listed row may
    stand for several pairs, where files are copies of each other; ``pairs`` says for how many.
    """
    every = accepted_batches(files, batch, counts)
    listed = comparisons.groupBy(batch).agg(
        F.count("*").alias("listed"),
        F.sum(F.when(F.col("prediction") == 1, F.col("pairs")).otherwise(0)).cast("bigint").alias("plagiarized_pairs"),
    )
    return (
        every.join(listed, batch, "left")
        .withColumn("total_comparisons", (F.col("total_files") * (F.col("total_files") - 1) / 2).cast("bigint"))
        .fillna(0, ["listed", "plagiarized_pairs"])
    )


def batch_report(
    files: DataFrame,
    comparisons: DataFrame,
    submitted_at: Column,
    page_size: int = 1000,
    batch: str = "batch_id",
    counts: Column | None = None,
    percent: int | None = None,
) -> DataFrame:
    """Nested report rows: (batch, page, total_files, total_comparisons, threshold, error, comparisons[], submitted_at).

    A rejected batch has a row with its error and no comparisons. ``threshold`` is the share of common tokens, in ``percent``, from which
    comparisons are listed; null if all are.
    A batch that lists up to ``page_size`` comparisons is one row. Longer lists are dealt onto
    pages by hash, so no row and no task holds more than about a page.
    """
    summary = report_summary(files, comparisons, batch, counts).select(
        batch, "total_files", "total_comparisons", "error", "listed"
    )
    pages = F.ceil(F.greatest(F.col("listed"), F.lit(1)) / page_size)
    entry = F.struct("file1", "file2", "prediction", "confidence", "error")
    placed = (
        join_one(comparisons, summary.select(batch, "listed"), [batch], "file2")
        .withColumn("page", F.pmod(F.xxhash64("file1", "file2"), pages))
        .groupBy(batch, "page")
        .agg(F.array_sort(F.collect_list(entry)).alias("comparisons"))
    )
    empty = F.array().cast(placed.schema["comparisons"].dataType)
    return summary.join(placed, batch, "left").select(
        batch,
        F.coalesce("page", F.lit(0)).alias("page"),
        "total_files",
        "total_comparisons",
        F.lit(percent).cast("int").alias("threshold"),
        "error",
        F.coalesce("comparisons", empty).alias("comparisons"),
        submitted_at.alias("submitted_at"),
    )


def report_history(reports: DataFrame, slice_days: int = 7) -> DataFrame:
    """Each pair's probability in every saved report, with the one of the report before.

    A pair that is in most reports is cut into slices of time. A row finds its predecessor in its
    slice; the first of a slice takes the last of the slice before, from a table of slices.
    """
    rows = reports.select("submitted_at", F.explode_outer("comparisons").alias("c")).filter(F.col("c").isNotNull())
    pair = ["file1", "file2"]
    slice_number = F.floor(F.unix_timestamp("submitted_at") / (slice_days * 86400))
    probability = F.element_at("c.confidence", 2)
    sliced = rows.select("submitted_at", "c.file1", "c.file2", "c.prediction", probability.alias("p1")).withColumn(
        "slice", slice_number
    )
    lasts = sliced.groupBy(*pair, "slice").agg(F.max_by("p1", "submitted_at").alias("last"))
    earlier = lasts.select(
        *pair, "slice", F.lag("last").over(Window.partitionBy(*pair).orderBy("slice")).alias("carried")
    )
    over_time = Window.partitionBy(*pair, "slice").orderBy("submitted_at")
    placed = sliced.withColumn("place", F.row_number().over(over_time)).withColumn("near", F.lag("p1").over(over_time))
    previous = F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("near"))
    return (
        placed.join(earlier, [*pair, "slice"])
        .withColumn("previous_p1", previous)
        .withColumn("change", F.col("p1") - F.col("previous_p1"))
        .select("submitted_at", *pair, "prediction", "p1", "previous_p1", "change")
    )


def row_errors(df: DataFrame, valid: Column, message: str, guarded: list[str]) -> DataFrame:
    """Set ``error`` on rows that cannot be scored and blank their results; the others keep theirs."""
    blanked = {name: F.when(valid, F.col(name)) for name in guarded}
    return df.withColumns(blanked).withColumn("error", F.when(~valid, F.lit(message)))
