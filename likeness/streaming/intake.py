"""Submissions that keep arriving: each batch is reported on once it is complete.

The files of a batch may land in several pieces. A batch is closed when nothing of it has come for a while; until
then only its number of files is kept as state. Its files are read from where they landed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from likeness.plans.workflows import report_batches
from likeness.session import shared_folder, stored
from likeness.sources.corpus import counts_in_batch
from likeness.sources.sinks import write_report

SUBMISSION_SCHEMA = "batch_id string, path string, text string, submitted_at timestamp"


def submissions(spark: SparkSession, folder: str, files_each: int = 1000) -> DataFrame:
    """The stream of submitted files, a row each; they land in the folder in any number of pieces."""
    return spark.readStream.schema(SUBMISSION_SCHEMA).option("maxFilesPerTrigger", files_each).parquet(folder)


def closed_batches(stream: DataFrame, quiet: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Batches of which nothing has come for the ``quiet`` time: (batch_id, first_at, closed_at, landed, top_files).

    Time is that of the newest submission, less ``late``; files that come even later are not waited for.
    """
    seen = stream.withWatermark("submitted_at", late).groupBy(F.session_window("submitted_at", quiet).alias("open"), "batch_id")
    counted = seen.agg(F.count("*").alias("landed"), F.count_if(counts_in_batch()).alias("top_files"))
    return counted.select("batch_id", F.col("open.start").alias("first_at"), F.col("open.end").alias("closed_at"), "landed", "top_files")


def files_of(batches: DataFrame, landed: DataFrame) -> DataFrame:
    """The files of closed batches; only what landed while one of them was open is read."""
    span = batches.agg(F.min("first_at").alias("a"), F.max("closed_at").alias("b")).first()
    if span.a is None:
        return landed.limit(0)
    near = landed.filter(F.col("submitted_at").between(span.a, span.b))
    within = (F.col("submitted_at") >= F.col("first_at")) & (F.col("submitted_at") < F.col("closed_at"))
    return near.join(batches.select("batch_id", "first_at", "closed_at"), "batch_id").filter(within).drop("first_at", "closed_at")


def report_on_arrival(
    spark: SparkSession,
    folder: str,
    model,
    out: str,
    percent: int = 30,
    once: bool = False,
    quiet: str = "10 minutes",
    late: str = "10 minutes",
    files_each: int = 1000,
) -> StreamingQuery:
    """Write a report for each batch that is complete, also for one that has fewer than two files to compare, or none.

    What has been reported is kept in the stream's own checkpoint below the shared folder, so the
    query goes on where it stopped.
    """

    def report_new(closed: DataFrame, number: int) -> None:
        batches = stored(closed, "closed")
        files = stored(files_of(batches, spark.read.schema(SUBMISSION_SCHEMA).parquet(folder)), "submitted")
        named = files.select("batch_id", F.xxhash64("batch_id", "path").alias("doc_id"), F.col("path").alias("file"), "text")
        # Micro-batches in which nothing closes write nothing; one that is run again after a failure replaces its own folder.
        if not named.isEmpty():
            write_report(report_batches(named, model, percent=percent), f"{out}/run={number}", mode="overwrite")

    progress = f"{shared_folder(spark)}/intake-{hashlib.md5(out.encode()).hexdigest()}"
    closed = closed_batches(submissions(spark, folder, files_each), quiet, late)
    writer = closed.writeStream.outputMode("append").option("checkpointLocation", progress).foreachBatch(report_new)
    return (writer.trigger(availableNow=True) if once else writer).start()
