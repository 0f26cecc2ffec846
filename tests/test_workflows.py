import os
import random

import pytest
from pyspark.sql import functions as F

from likeness.operators import pairs, report
from likeness.plans import workflows
from likeness.sources.sinks import read_reports
from likeness.streaming.intake import report_on_arrival

BODIES = {
    "sum": ["int sum = 0;", "for (int i = 0; i < n; i++) { sum += i; }", 'System.out.println("Sum " + sum);', "if (sum > 10) { reset(sum); }"],
    "read": ["Scanner in = new Scanner(System.in);", "while (in.hasNext()) { String line = in.nextLine(); count++; }", "return count;"],
    "sort": ["int[] a = load();", "for (int i = 0; i < a.length; i++) for (int j = 0; j < i; j++) if (a[i] < a[j]) swap(a, i, j);", "print(a);"],
}


def program(name, lines):
    return f"public class {name} {{ public static void main(String[] args) {{ {' '.join(lines)} }} }}"


@pytest.fixture(scope="module")
def corpus(spark):
    """Three cases with renamed copies and with unrelated programs."""
    draw = random.Random(11)
    rows = []
    for case, body in BODIES.items():
        rows.append((len(rows), case, "original", None, None, program(case.title(), body)))
        for i in range(24):
            copy = [line.replace("i", f"k{i}") if draw.random() < 0.3 else line for line in body]
            rows.append((len(rows), case, "plagiarized", 1, f"L{i % 6 + 1}", program(f"C{i}", copy)))
        for i in range(16):
            mixed = [f"double v{draw.randint(0, 99)} = f{draw.randint(0, 9)}(x, {j});" for j in range(draw.randint(4, 12))]
            rows.append((len(rows), case, "non-plagiarized", 0, "non-plagiarized", program(f"N{i}", mixed)))
    schema = "doc_id int, case_id string, role string, label int, level string, text string"
    return spark.createDataFrame(rows, schema).repartition(8).cache()


@pytest.fixture(scope="module")
def trained(corpus):
    return workflows.train(workflows.pair_examples(corpus), trees=20, boosting={"maxIter": 5, "maxDepth": 3})


def test_training_on_a_corpus(corpus, trained):
    assert workflows.pair_examples(corpus).count() == 120
    metrics = {r.model: r for r in trained.metrics.collect()}
    assert set(metrics) == {"svm", "boosted_trees", "random_forest", "logistic_regression"}
    assert all(r.accuracy > 0.85 for r in metrics.values())
    w = trained.weights.first()
    assert w.a + w.b + w.c + w.d == 10
    blend = trained.blend_metrics.first()
    assert blend.accuracy > 0.85 and blend.auc > 0.85
    assert {"accuracy", "macro avg"} < {r.name for r in trained.blend_report.collect()}


def test_one_original_against_one_suspect(corpus, trained):
    model = trained.models["boosted_trees"]
    ids = {r.role: r.doc_id for r in corpus.filter("case_id = 'sort'").orderBy("doc_id").collect()}
    docs = corpus.select("doc_id", "text")
    copied = workflows.compare_two(docs, ids["original"], ids["plagiarized"], model).first()
    other = workflows.compare_two(docs, ids["original"], ids["non-plagiarized"], model).first()
    assert (copied.prediction, other.prediction) == (1, 0)
    assert sum(copied.confidence) == pytest.approx(1.0)


def test_batches_are_reported_when_complete(spark, corpus, trained, tmp_path):
    """A batch in two pieces is one report; batches with no or one file at the top have a row with an error."""
    model = trained.models["boosted_trees"]
    rows = corpus.filter("case_id = 'sum'").orderBy("doc_id").limit(4).collect()

    def land(piece, files, minute):
        table = [(batch, path, text, f"2025-03-01 10:{minute:02}:00") for batch, path, text in files]
        frame = spark.createDataFrame(table, "batch_id string, path string, text string, at string")
        frame.selectExpr("batch_id", "path", "text", "to_timestamp(at) AS submitted_at").coalesce(1).write.parquet(f"{tmp_path}/in/{piece}")

    def run():
        query = report_on_arrival(spark, f"{tmp_path}/in/*", model, f"{tmp_path}/out", once=True, files_each=1, quiet="5 minutes", late="1 minute")
        query.awaitTermination(300)
        return {r.batch_id: r for r in read_reports(spark, f"{tmp_path}/out").collect()} if os.path.exists(f"{tmp_path}/out") else {}

    land("a", [("b1", f"F{i}.java", r.text) for i, r in enumerate(rows[:2])] + [("lib", "lib/A.java", "int a;"), ("one", "A.java", "x")], 0)
    land("b", [("b1", f"F{i}.java", r.text) for i, r in enumerate(rows[2:], 2)] + [("b1", "Twin.java", rows[0].text), ("b1", "lib/F0.java", rows[0].text)], 3)
    assert run() == {}
    land("c", [("later", "A.java", "int b;")], 30)
    found = run()
    assert set(found) == {"b1", "lib", "one"}
    assert (found["b1"].total_files, found["b1"].total_comparisons, found["b1"].threshold, found["b1"].error) == (5, 10, 30, None)
    assert any("Twin.java" in (c.file1, c.file2) for c in found["b1"].comparisons)
    assert all(c.prediction in (0, 1) and c.error is None and "/" not in c.file1 + c.file2 for c in found["b1"].comparisons)
    for batch, total in (("lib", 0), ("one", 1)):
        assert found[batch].total_files == total and found[batch].error == report.TOO_FEW_FILES_TEXT and found[batch].comparisons == []


def test_whole_corpus_from_candidates_to_report(spark, trained):
    lines = [f"int v{i} = f{i % 5}(a, {i});" for i in range(40)]
    other = [f"double w{i} = g(b[{i}]);" for i in range(40)]
    texts = {1: lines, 2: lines, 3: lines[:30] + ["stop();"] + lines[30:], 4: other, 5: [f"String s{i} = h(c);" for i in range(30)]}
    docs = spark.createDataFrame([(i, program("P", body)) for i, body in texts.items()], "doc_id long, text string")
    found = {(r.doc1, r.doc2): r for r in workflows.report_corpus(docs, trained.models["boosted_trees"]).collect()}
    assert set(found) == {(1, 2), (1, 3)} and found[1, 2].is_copy and not found[1, 3].is_copy
    for pair, parts in (((1, 2), 1), ((1, 3), 2)):
        r = found[pair]
        assert r.prediction == 1 and r.status == report.PLAGIARIZED_TEXT and r.shown_confidence.endswith("%")
        assert r.sections == parts and r.section_tokens == r.num_tokens1


def test_reordered_files_are_scored_themselves(spark, trained):
    """Only files with the same tokens in the same order share a score."""
    model, lines = trained.models["boosted_trees"], BODIES["sum"]
    texts = [program("P", lines), program("P", lines[::-1]), program("P", lines), program("Q", [*lines, "reset(n);"])]
    rows = [("b", i, f"F{i}.java", text) for i, text in enumerate(texts, 1)]
    files = spark.createDataFrame(rows, "batch_id string, doc_id long, file string, text string")
    found = {(r.doc1, r.doc2): r for r in workflows.compare_batches(files, model).collect()}
    assert {k: r.pairs for k, r in found.items()} == {(1, 2): 2, (1, 3): 1, (1, 4): 2, (2, 4): 1}
    wanted = spark.createDataFrame(list(found), "doc1 long, doc2 long")
    alone = {(r.doc1, r.doc2): r.confidence for r in workflows.compare(wanted, files, model).collect()}
    assert {k: r.confidence for k, r in found.items()} == alone


def test_network(corpus):
    small = workflows.train_network(corpus, size=8, rounds=2, hidden=[8], network_rounds=30)
    table = workflows.evaluate_network(corpus, small).collect()
    assert len(table) == pairs.case_pairs(corpus).count()
    assert all(0 <= r.score <= 1 and r.prediction == int(r.score > 0.5) for r in table)
    rates = {(r.case_id, r.level): r for r in workflows.rates_by_level(workflows.evaluate_network(corpus, small)).collect()}
    assert rates[None, "L1"].tn + rates[None, "L1"].fp + rates[None, "L1"].fn + rates[None, "L1"].tp == sum(r.level == "L1" for r in table)
    assert {r.level for r in table} == {"L1", "L2", "L3", "L4", "L5", "L6", "non-plagiarized"}
