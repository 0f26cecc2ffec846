import hashlib
import json
import os

from pyspark.sql import functions as F

from likeness.operators import evaluate, report, similar, similarity
from likeness.sources import corpus, sinks


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_corpus_of_files(spark, tmp_path):
    for name in ("original/T1.java", "plagiarized/L2/01/A.java", "non-plagiarized/07/B.java", "plagiarized/L2/01/notes.txt"):
        write(f"{tmp_path}/set/case-03/{name}", f"// {name}\nclass A {{}}\n")
    rows = {r.role: r for r in corpus.load_corpus(spark, f"{tmp_path}/set").collect()}
    assert set(rows) == {"original", "plagiarized", "non-plagiarized"}
    assert [rows[k].label for k in ("original", "plagiarized", "non-plagiarized")] == [None, 1, 0]
    assert [rows[k].level for k in ("original", "plagiarized", "non-plagiarized")] == [None, "L2", "non-plagiarized"]
    assert {r.case_id for r in rows.values()} == {"case-03"}
    assert rows["original"].text == "// original/T1.java\nclass A {}\n"


def test_bytes_that_are_no_text_are_dropped(spark, tmp_path):
    cases = [b"plain", b"a\xffb\xc3(\xa9", "é€😀".encode(), "\ufffd genuine \ufdd0a \ufdd0b".encode(), b"\xf0\x9f\x98", b"x\xe2\x82y\xfe\xfe", b"\xff", b"\xed\xa0\x80z\x00"]
    for i, content in enumerate(cases):
        os.makedirs(f"{tmp_path}/set/case-{i}/original")
        with open(f"{tmp_path}/set/case-{i}/original/A.java", "wb") as f:
            f.write(content)
    rows = {r.case_id: r for r in corpus.load_corpus(spark, f"{tmp_path}/set").collect()}
    for i, content in enumerate(cases):
        row = rows[f"case-{i}"]
        assert (row.text, row.n_bytes, row.content_sha256) == (content.decode("utf-8", "ignore"), len(content), hashlib.sha256(content).hexdigest())
    assert len({r.file_id for r in rows.values()}) == len({r.doc_id for r in rows.values()}) == len(cases)


def test_batches_take_top_files_and_refuse_single_ones(spark):
    files = spark.createDataFrame(
        [("x", "A.java"), ("x", "B.java"), ("x", "lib/C.java"), ("x", "notes.txt"), ("y", "A.java"), ("z", "lib/A.java")],
        "batch_id string, path string",
    )
    found = {r.batch_id: r for r in report.accepted_batches(files, counts=corpus.counts_in_batch()).collect()}
    assert (found["x"].total_files, found["x"].error) == (2, None)
    assert found["y"].total_files == 1 and found["y"].error
    assert found["z"].total_files == 0 and found["z"].error
    assert {r.path for r in corpus.load_batch(files).collect()} == {"A.java", "B.java"}


def test_pairs_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c1", [1.0, 2.5], 1), ("c2", [0.0, 1.0], 0)], "case_id string, features array<double>, label int")
    for kind in ("parquet", "json"):
        path = f"{tmp_path}/{kind}"
        sinks.write_pairs(rows, path, kind)
        assert {(tuple(r.features), r.label) for r in corpus.read_pairs(spark, path, kind).collect()} == {((1.0, 2.5), 1), ((0.0, 1.0), 0)}
        assert {d for d in os.listdir(path) if d.startswith("case_id=")} == {"case_id=c1", "case_id=c2"}


def test_feature_names(spark, tmp_path):
    sinks.write_feature_keys(spark, f"{tmp_path}/keys")
    rows = sorted(spark.read.json(f"{tmp_path}/keys").collect(), key=lambda r: r.pos)
    assert [r.name for r in rows] == similarity.FEATURE_KEYS and len(rows) == 21


def test_pair_vector_order_and_missing_values(spark):
    columns = [F.lit(float(i)).alias(f"{k}1") for i, k in enumerate(similarity.DOC_KEYS)]
    columns += [F.lit(None).cast("double").alias(f"{k}2") for k in similarity.DOC_KEYS]
    columns += [F.lit(100.0 + i).alias(k) for i, k in enumerate(similarity.PAIR_KEYS)]
    vector = similarity.pair_vector(spark.range(1).select(*columns)).first().features
    assert vector == [*range(18), 100, 101, 102] + [0] * 18 + [100, 101, 102]


def test_metrics_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (0, 0), (0, 1)], "label int, prediction int")
    sinks.write_metrics(evaluate.binary_metrics(evaluate.confusion_matrix(rows)), f"{tmp_path}/metrics")
    saved = spark.read.json(f"{tmp_path}/metrics").first()
    assert saved.confusion_matrix == [[1, 1], [0, 1]] and saved.f1_score == 2 / 3


def comparisons(spark, n):
    rows = [("b", f"f{i:03}", f"g{i:03}", i % 2, [1 - i / n, i / n], None, 1) for i in range(n)]
    return spark.createDataFrame(
        rows, "batch_id string, file1 string, file2 string, prediction int, confidence array<double>, error string, pairs int"
    )


def test_report_pages_hold_everything_once(spark, tmp_path):
    files = spark.createDataFrame([("b", i) for i in range(40)] + [("empty", 1), ("empty", 2), ("single", 1)], "batch_id string, n int")
    made = report.batch_report(files, comparisons(spark, 200), F.lit("2025-01-01").cast("timestamp"), page_size=50)
    sinks.write_report(made, f"{tmp_path}/reports")
    back = sinks.read_reports(spark, f"{tmp_path}/reports")
    pages = back.filter("batch_id = 'b'").collect()
    assert len(pages) == 4 and {p.total_comparisons for p in pages} == {780}
    assert sorted(c.file1 for p in pages for c in p.comparisons) == [f"f{i:03}" for i in range(200)]
    assert [c.comparisons for c in back.filter("batch_id = 'empty'").collect()] == [[]]
    single = back.filter("batch_id = 'single'").first()
    assert single.error == report.TOO_FEW_FILES_TEXT and single.comparisons == [] and single.total_comparisons == 0
    one = report.batch_report(files, comparisons(spark, 20), F.lit("2025-01-01").cast("timestamp"))
    assert one.filter("batch_id = 'b'").count() == 1


def test_copies_count_as_all_their_pairs(spark):
    files = spark.createDataFrame([("b", i, f"f{i}", "int a = 1 ;") for i in range(4)] + [("one", 9, "f9", "x")], "batch_id string, doc_id long, file string, text string")
    found = similar.similar_pairs(similarity.bags_of(files, "batch_id"), 30)
    judged = found.select("batch_id", similar.pairs_behind().alias("pairs"), F.lit(1).alias("prediction"))
    made = {r.batch_id: r for r in report.report_summary(files, judged).collect()}
    assert (made["b"].listed, made["b"].plagiarized_pairs, made["b"].total_comparisons, made["b"].error) == (3, 6, 6, None)
    assert made["one"].plagiarized_pairs == 0 and made["one"].error == report.TOO_FEW_FILES_TEXT


def test_history_across_slices(spark):
    entry = "struct<file1:string,file2:string,prediction:int,confidence:array<double>>"
    days = [(d, [("a", "b", int(p > 0.5), [1 - p, p])]) for d, p in ((1, 0.575), (2, 0.25), (30, 0.75), (31, 0.5), (90, 1.0))]
    frame = spark.createDataFrame(days, f"day int, comparisons array<{entry}>")
    reports = frame.select(F.timestamp_seconds(F.col("day") * 86400).alias("submitted_at"), "comparisons")
    rows = report.report_history(reports).orderBy("submitted_at").collect()
    assert [r.previous_p1 for r in rows] == [None, 0.575, 0.25, 0.75, 0.5]


def test_wording(spark):
    row = spark.range(1).select(
        report.status_label(F.lit(1)), report.status_label(F.lit(0)), report.status_label(F.lit(None).cast("int")),
        report.confidence_pct(F.lit(0.575)), report.confidence_pct(F.lit(0.12345), 2), report.confidence_pct(F.lit(None).cast("double")),
    ).first()
    assert tuple(row) == ("Plagiarized", "Not Plagiarized", "Not Plagiarized", "57.5%", "12.35%", "No confidence score available.")


def test_errors_leave_other_rows_alone(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "id int, p1 double")
    found = {r.id: r for r in report.row_errors(rows, F.col("p1").isNotNull(), "failed", ["p1"]).collect()}
    assert (found[1].error, found[1].p1, found[2].error) == (None, 0.5, "failed")


def test_saved_lines_are_json(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([("b", 1)], "batch_id string, page int"), f"{tmp_path}/r")
    lines = []
    for part in os.listdir(f"{tmp_path}/r"):  # one of the parts holds the row, others may be empty
        if part.endswith(".json"):
            with open(f"{tmp_path}/r/{part}") as f:
                lines += f.readlines()
    assert [json.loads(line) for line in lines] == [{"batch_id": "b", "page": 1}]


def test_shuffles_of_a_stored_table_do_not_stay(spark):
    """Once a table is written, what was shuffled for it takes no disk; a table made from it is whole."""
    from likeness.session import stored

    def blocks():
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = local.getAllFiles()
        return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))

    rows = spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(5, "k").groupBy("k").count()
    before = blocks()
    kept = stored(rows, "counted")
    assert blocks() <= before
    assert kept.count() == 7 and rows.count() == 7
