from pyspark.sql import functions as F

from likeness.plans.queries import QUERIES


def test_reports_compare_every_turn(spark, tmp_path):
    """Replies are files of their batch like the user's turns."""
    turns = [(1, 0, "user", "alpha beta gamma"), (1, 1, "assistant", "one two three four"), (1, 2, "assistant", "one two three five")]
    rows = spark.createDataFrame([*turns, (2, 0, "assistant", "alone")], "conv_id long, turn long, role string, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    summary = {r.batch_id: r for r in QUERIES["report_summary"](spark, str(tmp_path)).collect()}
    assert (summary[1].total_files, summary[1].total_comparisons, summary[1].listed, summary[1].plagiarized_pairs) == (3, 3, 1, 1)
    assert summary[2].total_files == 1
    found = QUERIES["plagiarized_pairs"](spark, str(tmp_path)).collect()
    assert [(r.batch_id, r.file1, r.file2) for r in found] == [(1, "t1.java", "t2.java")]
    listed = QUERIES["batch_report"](spark, str(tmp_path)).filter(F.col("file1").isNotNull()).collect()
    assert [(r.batch_id, r.file1, r.file2, r.total_files) for r in listed] == [(1, "t1.java", "t2.java", 3)]
