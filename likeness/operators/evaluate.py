"""Evaluation of predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = 100


def ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is 0 where there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def confusion_columns(label: str = "label", prediction: str = "prediction") -> list[Column]:
    y, p = F.col(label), F.col(prediction)
    return [
        _count((y == 0) & (p == 0)).alias("tn"),
        _count((y == 0) & (p == 1)).alias("fp"),
        _count((y == 1) & (p == 0)).alias("fn"),
        _count((y == 1) & (p == 1)).alias("tp"),
    ]


def confusion_matrix(
    df: DataFrame, groups: list[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    return df.groupBy(*groups).agg(*confusion_columns(label, prediction))


def binary_metrics(confusion: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and F1; each is 0 where it has no denominator."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = F.col("precision"), F.col("recall")
    return (
        confusion.withColumn("accuracy", ratio(tp + tn, tn + fp + fn + tp))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * precision * recall, precision + recall))
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy and both averages."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    n, hit = F.col("n"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    parts = F.array(
        F.struct(F.col("y").alias("class"), n.alias("support"), hit.alias("hits"), F.lit(0).alias("chosen")),
        F.struct(F.col("p").alias("class"), F.lit(0).alias("support"), F.lit(0).alias("hits"), n.alias("chosen")),
    )
    per_class = (
        cells.select(F.inline(parts))
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("hits").alias("hits"), F.sum("chosen").alias("chosen"))
        .withColumn("precision", ratio(F.col("hits"), F.col("chosen")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
        )
    )
    # The classes are few; they are put in one row, so that the predictions are read only once.
    scores = ["precision", "recall", "f1"]
    rows = per_class.agg(
        F.collect_list(F.struct(F.col("class").cast("string").alias("name"), *scores, "support")).alias("classes"),
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("total"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[ratio(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(f"weighted_{s}") for s in scores],
    )

    def line(name: str, values: list[Column]) -> Column:
        named = [value.cast("double").alias(s) for s, value in zip(scores, values)]
        return F.struct(F.lit(name).alias("name"), *named, F.col("total").alias("support"))

    averages = F.array(
        line("accuracy", [F.lit(None), F.lit(None), F.col("accuracy")]),
        line("macro avg", [F.col(f"macro_{s}") for s in scores]),
        line("weighted avg", [F.col(f"weighted_{s}") for s in scores]),
    )
    return rows.select(F.inline(F.concat("classes", averages)))


def roc_points(df: DataFrame, votes: str = "votes", trees: int = 200, label: str = "label") -> DataFrame:
    """Rates at thresholds 1.00, 0.99 … 0.00: (step, threshold, tpr, fpr).

    A row passes threshold ``i/100`` if ``votes / trees >= i/100``, decided in whole numbers. Rows
    are first counted by the highest threshold they pass, which leaves 101 rows.
    """
    highest = F.floor(F.col(votes) * THRESHOLDS / trees).cast("int")
    passed = df.groupBy(highest.alias("i")).agg(_count(F.col(label) == 1).alias("pos"), _count(F.col(label) == 0).alias("neg"))
    steps = df.sparkSession.range(THRESHOLDS + 1).select(F.col("id").cast("int").alias("i"))
    all_steps = steps.join(passed, "i", "left").fillna(0, ["pos", "neg"])
    downwards = Window.partitionBy(F.lit(0)).orderBy(F.desc("i"))
    everything = Window.partitionBy(F.lit(0))
    rate = lambda name: ratio(F.sum(name).over(downwards), F.sum(name).over(everything))
    return all_steps.select(
        (F.lit(THRESHOLDS) - F.col("i")).alias("step"),
        (F.col("i") / THRESHOLDS).alias("threshold"),
        rate("pos").alias("tpr"),
        rate("neg").alias("fpr"),
    )


def auc_trapezoid(points: DataFrame) -> DataFrame:
    """Area under the given points, from the first to the last; there is no added start at (0, 0)."""
    in_order = Window.partitionBy(F.lit(0)).orderBy("step")
    width = F.col("fpr") - F.lag("fpr").over(in_order)
    height = (F.col("tpr") + F.lag("tpr").over(in_order)) / 2
    return points.select((width * height).alias("piece")).agg(F.coalesce(F.sum("piece"), F.lit(0.0)).alias("auc"))


def auc_rank(df: DataFrame, score: str = "score", label: str = "label", slices: int = 256) -> DataFrame:
    """Exact area under the ROC curve; equal scores count half. NaN if a class is missing.

    Equal scores are counted first. The different scores are cut into slices at their quantiles,
    so the running count needs one window per slice and one over the slice totals.
    """
    counted = df.groupBy(F.col(score).alias("score")).agg(
        _count(F.col(label) == 1).alias("pos"), _count(F.col(label) == 0).alias("neg")
    )
    marks = [i / slices for i in range(1, slices)]
    bounds = counted.agg(F.percentile_approx("score", marks).alias("b")).scalar()
    sliced = counted.withColumn("bounds", bounds).withColumn(
        "slice", F.size(F.filter("bounds", lambda b: b < F.col("score")))
    ).drop("bounds")
    totals = sliced.groupBy("slice").agg(F.sum("neg").alias("slice_neg"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("slice", F.coalesce(F.sum("slice_neg").over(earlier), F.lit(0)).alias("before"))
    lower = Window.partitionBy("slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("within", F.coalesce(F.sum("neg").over(lower), F.lit(0))).join(offsets, "slice")
    below = F.col("before") + F.col("within")
    sums = ranked.agg(
        F.sum(F.col("pos") * (2 * below + F.col("neg"))).alias("twice"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(
        F.when(both, F.col("twice") / (2.0 * F.col("p") * F.col("n"))).otherwise(F.lit(float("nan"))).alias("auc")
    )


def evaluate_by_group(df: DataFrame, groups: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Confusion cells and rates for every combination of the groups, each of them over all others, and all rows.

    ``grouping`` has a bit for each group that a row is summed over, the last group's being the lowest.
    """
    levels = df.cube(*groups).agg(F.grouping_id().alias("grouping"), *confusion_columns(label, prediction))
    return binary_metrics(levels)


def threshold_predict(probability: Column, threshold: float = 0.5) -> Column:
    """1 where the probability is above the threshold."""
    return (probability > threshold).cast("int")


def vote_predict(votes: Column, trees: int, tie: int = 1) -> Column:
    """Majority of the trees; ``tie`` is 1 in service and 0 in evaluation. Without votes there is no prediction."""
    return F.when(votes * 2 > trees, 1).when(votes * 2 < trees, 0).when(votes * 2 == trees, tie)


def sort_scores(df: DataFrame, ids: list[str], score: str = "score") -> DataFrame:
    """Highest score first; the ids order equal scores, so that those too can be sorted in parts."""
    return df.orderBy(F.desc(score), *ids)


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Add the balanced weight ``n / (classes * n_of_class)`` to each row."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(F.lit(0))
    weights = counts.select(
        label, (F.sum("_n").over(whole) / (F.count("*").over(whole) * F.col("_n"))).alias(out)
    )
    # One row per class of a classifier.
    return df.join(F.broadcast(weights), label)
