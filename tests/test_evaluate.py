import math
import random

import pytest
from pyspark.sql import functions as F

from likeness.operators import ensemble, evaluate


def pair_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def scores(seed, digits, n=400):
    draw = random.Random(seed)
    return [(round(draw.random(), digits), int(draw.random() < 0.4)) for _ in range(n)]


@pytest.mark.parametrize("seed, digits", [(1, 1), (2, 2), (3, 9)])
@pytest.mark.parametrize("slices", [4, 256])
def test_rank_auc_against_all_pairs(spark, seed, digits, slices):
    rows = scores(seed, digits)
    frame = spark.createDataFrame(rows, "score double, label int")
    assert evaluate.auc_rank(frame, slices=slices).first().auc == pytest.approx(pair_auc(rows), abs=1e-12)
    stretched = frame.withColumn("score", F.exp("score") * 3)
    assert evaluate.auc_rank(stretched, slices=slices).first().auc == pytest.approx(pair_auc(rows), abs=1e-12)


def test_rank_auc_of_one_class_is_nan(spark):
    assert math.isnan(evaluate.auc_rank(spark.createDataFrame([(0.5, 1)], "score double, label int")).first().auc)


def test_roc_and_area(spark):
    draw = random.Random(5)
    rows = [(draw.randint(0, 200), draw.randint(0, 1)) for _ in range(300)]
    points = evaluate.roc_points(spark.createDataFrame(rows, "votes int, label int"))
    found = sorted(points.collect(), key=lambda r: r.step)
    p, n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    wanted = [
        (sum(v * 100 >= i * 200 and y == 1 for v, y in rows) / p, sum(v * 100 >= i * 200 and y == 0 for v, y in rows) / n)
        for i in range(100, -1, -1)
    ]
    for i, column in enumerate(("tpr", "fpr")):
        assert [r[column] for r in found] == pytest.approx([w[i] for w in wanted])
    area = sum((b[1] - a[1]) * (a[0] + b[0]) / 2 for a, b in zip(wanted, wanted[1:]))
    assert evaluate.auc_trapezoid(points).first().auc == pytest.approx(area)


def test_roc_of_one_class_has_zero_rates(spark):
    points = evaluate.roc_points(spark.createDataFrame([(100, 1)], "votes int, label int"))
    assert {r.fpr for r in points.collect()} == {0.0} and points.count() == 101


def test_confusion_and_metrics(spark):
    rows = [(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 4
    frame = spark.createDataFrame(rows, "label int, prediction int")
    r = evaluate.binary_metrics(evaluate.confusion_matrix(frame)).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (4, 3, 2, 5)
    assert (r.accuracy, r.precision, r.recall) == pytest.approx((9 / 14, 5 / 8, 5 / 7))
    assert r.f1 == pytest.approx(2 * (5 / 8) * (5 / 7) / (5 / 8 + 5 / 7))
    none = evaluate.binary_metrics(evaluate.confusion_matrix(frame.filter("label = 0 and prediction = 0"))).first()
    assert (none.accuracy, none.precision, none.recall, none.f1) == (1.0, 0.0, 0.0, 0.0)


def test_classification_report_averages(spark):
    rows = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 1 + [(1, 0)] * 1
    report = {r.name: r for r in evaluate.classification_report(spark.createDataFrame(rows, "label int, prediction int")).collect()}
    assert report["accuracy"].f1 == 0.7 and report["accuracy"].support == 10
    assert report["macro avg"].recall == pytest.approx((0.75 + 0.5) / 2)
    assert report["weighted avg"].recall == pytest.approx(0.7)


def test_groups_add_up(spark):
    rows = [(c, l, y, p) for c in "ab" for l in ("L1", "L2") for y in (0, 1) for p in (0, 1)]
    frame = spark.createDataFrame(rows, "case string, level string, label int, prediction int")
    table = evaluate.evaluate_by_group(frame, ["case", "level"]).collect()
    assert len(table) == 9
    assert {(r.case, r.level) for r in table if r.grouping == 2} == {(None, "L1"), (None, "L2")}
    for grouping, size in ((0, 4), (1, 8), (2, 8), (3, 16)):
        assert {r.tn + r.fp + r.fn + r.tp for r in table if r.grouping == grouping} == {size}


def test_scores_come_in_order(spark):
    rows = [(i % 17, i, (i * 37 % 101) // 10 / 10) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc1 int, doc2 int, score double").repartition(7)
    found = [tuple(r) for r in evaluate.sort_scores(frame, ["doc1", "doc2"]).collect()]
    assert found == sorted(rows, key=lambda r: (-r[2], r[0], r[1]))


def test_ties_of_votes(spark):
    row = spark.range(1).select(
        evaluate.vote_predict(F.lit(100), 200, tie=1), evaluate.vote_predict(F.lit(100), 200, tie=0),
        evaluate.vote_predict(F.lit(99), 200), evaluate.threshold_predict(F.lit(0.5)),
    ).first()
    assert tuple(row) == (1, 0, 0, 0)
    assert spark.range(1).select(evaluate.vote_predict(F.lit(None).cast("int"), 200)).first()[0] is None


def test_class_weights_balance(spark):
    frame = spark.createDataFrame([(1,)] * 6 + [(0,)] * 2, "label int")
    weights = {r.label: r.weight for r in evaluate.class_weights(frame).collect()}
    assert weights == {1: 8 / 12, 0: 8 / 4}


def test_simplex_and_search(spark):
    grid = ensemble.weight_simplex(spark).collect()
    assert len(grid) == len(set(grid)) == 286
    assert {sum(r) for r in grid} == {10}
    rows = [(0.9, 0.1, 0.2, 0.4, 1), (0.2, 0.8, 0.1, 0.4, 0), (0.7, 0.9, 0.3, 0.2, 1), (0.1, 0.4, 0.9, 0.4, 0)]
    frame = spark.createDataFrame(rows, "w double, x double, y double, z double, label int")
    names = ["w", "x", "y", "z"]
    best = ensemble.best_weights(frame, names).first()
    accuracy = lambda g: sum((sum(a * b for a, b in zip(g, r)) > 5) == (r[4] == 1) for r in rows)
    wanted = max(sorted(tuple(g) for g in grid), key=accuracy)
    assert (best.a, best.b, best.c, best.d) == wanted and best.accuracy == accuracy(wanted) / 4
    blended = ensemble.blend_with_best(frame, ensemble.best_weights(frame, names), names).collect()
    assert [r.prediction for r in blended] == [int(r.score > 0.5) for r in blended]
