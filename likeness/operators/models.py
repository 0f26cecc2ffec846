"""Classifiers on pair vectors and embeddings, trained and applied with Spark ML.

Training tables have ``features`` as an array of doubles and an integer ``label``; arrays become
vectors only at this boundary.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from likeness.functions.cutting import counted_tokens, cut_words, near_totals, near_words, word_sums
from likeness.operators.evaluate import class_weights, threshold_predict, vote_predict
from likeness.operators.ranking import hash_rank
from likeness.operators.similarity import attach, attach_firsts, cosine_similarity
from likeness.operators.splits import folds
from likeness.session import shared_folder, stored

# The hyper-parameters of the models.
FOREST_TREES = 200
FOREST_DEPTH = 15
FOREST_MIN_ROWS = 5
FOREST_SAMPLE = 0.8
REGRESSION_TOLERANCE = 1e-4
EMBEDDING_SIZE = 128
EMBEDDING_WINDOW = 5
EMBEDDING_ROUNDS = 30
HIDDEN_LAYERS = [512, 256, 64]
#: Draws that stand for the kernel, and rounds of the factors: of the methods chosen here.
FOURIER_DRAWS = 512
FACTOR_ROUNDS = 10
#: Blocks of words in the factorisation, at least, and values in one block at most, while the session's number of partitions allows it.
FACTOR_BLOCKS = 8
BLOCK_RATINGS = 1 << 23
#: Values of word vectors that every task holds, at most.
HELD_VALUES = 1 << 23
#: Marks by which tasks leave out most words that have no vector.
MARKS = 1 << 24
NETWORK_ROUNDS = 30
FULL_GRID = {
    "maxDepth": [3, 4, 5, 6],
    "stepSize": [0.01, 0.1, 0.2],
    "maxIter": [100, 200, 300],
    "subsamplingRate": [0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.8", "0.9", "all"],
}
# A small grid, the default of the search in rungs.
SHORT_GRID = {"maxDepth": [3, 5], "stepSize": [0.1, 0.2]}


def with_vector(df: DataFrame, features: str = "features", out: str = "vector") -> DataFrame:
    return df.withColumn(out, array_to_vector(features))


def train_random_forest(train: DataFrame, trees: int = FOREST_TREES, seed: int = 42) -> RandomForestClassificationModel:
    forest = RandomForestClassifier(
        featuresCol="vector",
        labelCol="label",
        numTrees=trees,
        maxDepth=FOREST_DEPTH,
        minInstancesPerNode=FOREST_MIN_ROWS,
        subsamplingRate=FOREST_SAMPLE,
        featureSubsetStrategy="all",
        impurity="gini",
        seed=seed,
        leafCol="leaf",
    )
    return forest.fit(with_vector(train))


def leaf_votes(model: RandomForestClassificationModel) -> DataFrame:
    """The class each leaf of each tree votes for: (tree, leaf, vote), leaves numbered from the left as in the ``leaf`` column.

    Read from the nodes as the model saves them. Nodes are numbered from the root with left branches first, so
    leaves in the order of their nodes stand from left to right.
    """
    path = f"{shared_folder(SparkSession.active())}/forest-{uuid.uuid4().hex}"
    model.save(path)
    nodes = SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    from_left = F.row_number().over(Window.partitionBy("treeID").orderBy("id")) - 1
    leaves = nodes.filter("leftChild < 0").withColumn("leaf", from_left)
    return leaves.select(F.col("treeID").alias("tree"), "leaf", F.col("prediction").cast("int").alias("vote"))


def forest_votes(model: RandomForestClassificationModel, df: DataFrame) -> DataFrame:
    """Add ``votes``: how many trees vote for class 1, each by the majority in the leaf reached.

    The leaves' classes are one value of the plan, as large as the model and not the data.
    """
    by_tree = leaf_votes(model).groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("leaf", "vote"))).alias("leaves"))
    trees = by_tree.agg(F.array_sort(F.collect_list(F.struct("tree", F.col("leaves.vote").alias("votes")))).alias("trees"))
    table = stored(trees.select(F.col("trees.votes").alias("votes")), "leaf-votes").scalar()
    scored = model.transform(with_vector(df)).withColumn("_leaf", vector_to_array("leaf")).withColumn("_table", table)
    votes = F.zip_with("_leaf", "_table", lambda leaf, tree: F.get(tree, leaf.cast("int")))
    total = F.aggregate(votes, F.lit(0), lambda acc, v: acc + v)
    return scored.withColumn("votes", total).drop("_leaf", "_table", "leaf", "vector", "rawPrediction", "probability", "prediction")


def forest_predict(voted: DataFrame, trees: int = FOREST_TREES, tie: int = 1) -> DataFrame:
    """Add prediction and confidence from votes; a tie is 1 in service and 0 in evaluation."""
    p1 = F.col("votes") / trees
    p0 = (F.lit(trees) - F.col("votes")) / trees
    return voted.withColumn("prediction", vote_predict(F.col("votes"), trees, tie)).withColumn(
        "confidence", F.array(p0, p1)
    )


def boosted_trees(seed: int = 42, **params) -> GBTClassifier:
    return GBTClassifier(featuresCol="vector", labelCol="label", lossType="logistic", seed=seed, **params)


def train_boosted_trees(train: DataFrame, seed: int = 42, **params):
    return boosted_trees(seed, **params).fit(with_vector(train))


def grid_search_cv(
    train: DataFrame, ids: list[str], grid: dict | None = None, k: int = 5, parallelism: int = 4, seed: int = 42, **fixed
) -> CrossValidatorModel:
    """Boosted trees with the parameters of the best mean F1 over ``k`` stratified folds, of the full grid unless another is given."""
    estimator = boosted_trees(seed, **fixed)
    builder = ParamGridBuilder()
    for name, values in (grid or FULL_GRID).items():
        builder = builder.addGrid(estimator.getParam(name), values)
    f1 = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=builder.build(),
        evaluator=f1,
        numFolds=k,
        foldCol="fold",
        parallelism=parallelism,
    )
    return search.fit(stored(with_vector(folds(train, ids, k, "label", seed)), "folds"))


def grid_search_by_rungs(
    train: DataFrame,
    ids: list[str],
    grid: dict | None = None,
    k: int = 5,
    rungs: tuple[int, ...] = (5, 20),
    keep: float = 0.25,
    parallelism: int = 4,
    seed: int = 42,
    **fixed,
) -> DataFrame:
    """The grid in rungs: all parameter sets with few rounds of boosting, the best part of them with more, and so on.

    Result: (rung, rounds, params, mean_f1), a row for each set and rung; the best set is the first of the last rung. A grid over ``maxIter``
    is not for this search, since the rungs set it. The folds are those of ``grid_search_cv``, with ``parallelism`` fits at a time.
    """
    spark, names = train.sparkSession, list(grid or SHORT_GRID)
    sets = [dict(zip(names, values)) for values in product(*(grid or SHORT_GRID).values())]
    folded = stored(with_vector(folds(train, ids, k, "label", seed)), "folds")
    f1 = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
    rows = []
    for rung, rounds in enumerate(rungs):
        estimator = boosted_trees(seed, maxIter=rounds, **fixed)
        maps = [{estimator.getParam(n): v for n, v in params.items()} for params in sets]
        search = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=f1, numFolds=k, foldCol="fold", parallelism=parallelism)
        found = sorted(zip(search.fit(folded).avgMetrics, range(len(sets)), sets), key=lambda x: (-x[0], x[1]))
        rows += [(rung, rounds, ", ".join(f"{n}={v}" for n, v in sorted(params.items())), float(mean)) for mean, _, params in found]
        sets = [params for _, _, params in found[: max(1, math.ceil(keep * len(found)))]]
    return spark.createDataFrame(rows, "rung int, rounds int, params string, mean_f1 double")


def train_svm(train: DataFrame, rounds: int = 100) -> PipelineModel:
    """Linear support vectors with balanced weights, and a logistic curve from margin to probability."""
    svm = LinearSVC(
        featuresCol="vector",
        labelCol="label",
        weightCol="weight",
        rawPredictionCol="margin",
        predictionCol="svm_prediction",
        maxIter=rounds,
        regParam=0.01,
    )
    curve = LogisticRegression(featuresCol="margin", labelCol="label", maxIter=rounds)
    return Pipeline(stages=[svm, curve]).fit(with_vector(class_weights(train)))


@dataclass
class KernelSvm:
    """Support vectors with a Gaussian kernel, by random Fourier features in front of linear ones.

    The kernel ``exp(-gamma |x - y|^2)`` is the mean of ``2 cos(w x + b) cos(w y + b)`` over normal ``w`` and even ``b``; some
    hundred draws of them take its place. All draws follow from the seed, so a model is a few numbers and its linear part.
    """

    linear: PipelineModel
    inputs: int
    draws: int
    gamma: float
    seed: int

    def with_fourier(self, df: DataFrame, out: str = "vector") -> DataFrame:
        """Add the Fourier features as a vector, worked out in Arrow batches; every task makes the draws from the seed."""
        inputs, draws, gamma, seed = self.inputs, self.draws, self.gamma, self.seed

        def waves(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            random = np.random.default_rng(seed)
            directions = random.normal(scale=np.sqrt(2 * gamma), size=(draws, inputs))
            shifts = random.uniform(0, 2 * np.pi, draws)
            for part in parts:
                known = [x for x in part if x is not None]
                table = iter(np.cos(np.stack(known) @ directions.T + shifts) * np.sqrt(2 / draws) if known else [])
                yield pd.Series([None if x is None else next(table) for x in part], dtype=object)

        return df.withColumn(out, array_to_vector(F.pandas_udf(waves, "array<double>")("features")))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.linear.transform(self.with_fourier(df))

    def save(self, path: str) -> None:
        facts = json.dumps({"inputs": self.inputs, "draws": self.draws, "gamma": self.gamma, "seed": self.seed})
        SparkSession.active().range(1).select(F.lit(facts).alias("value")).write.mode("overwrite").text(f"{path}/kernel")
        self.linear.write().overwrite().save(f"{path}/linear")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KernelSvm:
        facts = json.loads(spark.read.text(f"{path}/kernel").first().value)
        return KernelSvm(PipelineModel.load(f"{path}/linear"), **facts)


def kernel_width(train: DataFrame, features: str = "features") -> tuple[int, float]:
    """Number of inputs and ``1 / (inputs * variance of all entries)``, in one sum over the rows."""
    entries = train.select(F.size(features).alias("n"), F.explode(features).alias("x"))
    facts = entries.agg(F.max("n"), F.var_pop("x")).first()
    return facts[0], 1.0 / (facts[0] * facts[1]) if facts[1] else 1.0


def train_kernel_svm(train: DataFrame, draws: int = FOURIER_DRAWS, rounds: int = 100, seed: int = 42) -> KernelSvm:
    """Support vectors with a Gaussian kernel and balanced weights, and a logistic curve from margin to probability."""
    inputs, gamma = kernel_width(train)
    svm = LinearSVC(
        featuresCol="vector",
        labelCol="label",
        weightCol="weight",
        rawPredictionCol="margin",
        predictionCol="svm_prediction",
        maxIter=rounds,
        regParam=1.0 / max(train.count(), 1),
        standardization=False,
    )
    curve = LogisticRegression(featuresCol="margin", labelCol="label", maxIter=rounds)
    model = KernelSvm(None, inputs, draws, gamma, seed)
    model.linear = Pipeline(stages=[svm, curve]).fit(model.with_fourier(class_weights(train)))
    return model


def train_logistic_regression(train: DataFrame, rounds: int = 1000):
    """Logistic regression with the unit penalty spread over the rows."""
    regression = LogisticRegression(
        featuresCol="vector",
        labelCol="label",
        maxIter=rounds,
        tol=REGRESSION_TOLERANCE,
        regParam=1.0 / max(train.count(), 1),
        standardization=False,
    )
    return regression.fit(with_vector(train))


def train_mlp(train: DataFrame, inputs: int, hidden: list[int] | None = None, rounds: int = NETWORK_ROUNDS, seed: int = 42):
    network = MultilayerPerceptronClassifier(
        featuresCol="vector", labelCol="label", layers=[inputs, *(hidden or HIDDEN_LAYERS), 2], maxIter=rounds, seed=seed
    )
    return network.fit(with_vector(train))


def score_pairs(model, df: DataFrame, width: int | None = None) -> DataFrame:
    """Add prediction and confidence ``[p0, p1]``; a vector that is null or of another width gets an ``error``.

    A forest is served by the votes of its trees, where a tie is 1; other models by their probability.
    """
    size = F.size("features")
    sound = F.col("features").isNotNull() & ~F.exists("features", lambda x: x.isNull() | F.isnan(x))
    valid = F.coalesce(sound & (size == width) if width else sound, F.lit(False))
    known = df.withColumn("error", F.when(~valid, F.lit("features do not fit the model")))
    fit = known.filter(F.col("error").isNull())
    if isinstance(model, RandomForestClassificationModel):
        good = forest_predict(forest_votes(model, fit), model.getNumTrees)
    else:
        scored = model.transform(with_vector(fit)).withColumn("confidence", vector_to_array("probability"))
        good = scored.withColumn("prediction", threshold_predict(F.element_at("confidence", 2)))
    kept = [*df.columns, "prediction", "confidence", "error"]
    bad = (
        known.filter(F.col("error").isNotNull())
        .withColumn("prediction", F.lit(None).cast("int"))
        .withColumn("confidence", F.lit(None).cast("array<double>"))
    )
    return good.select(kept).unionByName(bad.select(kept))


def with_max_confidence(scored: DataFrame) -> DataFrame:
    return scored.withColumn("max_confidence", F.array_max("confidence"))


def train_word2vec(
    docs: DataFrame,
    text: str = "text",
    size: int = EMBEDDING_SIZE,
    rounds: int = EMBEDDING_ROUNDS,
    partitions: int | None = None,
    seed: int = 42,
) -> Word2VecModel:
    """Word vectors by skip-grams. The vocabulary and its vectors are held by the driver; ``train_word_factors`` has no such limit."""
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = cut_words(docs, text=text)
    return Word2Vec(
        inputCol="words",
        outputCol="vector",
        vectorSize=size,
        windowSize=EMBEDDING_WINDOW,
        minCount=1,
        maxIter=rounds,
        numPartitions=partitions,
        seed=seed,
    ).fit(words)


def _half_pairs(docs: DataFrame, window: int, text: str) -> DataFrame:
    """Each pair of words once: (a, b, cnt), dealt by ``a``; a word with itself counts in both orders.

    A task counts its documents' pairs before they move.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = near_words(docs, window, text).repartition(tasks, "a").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counted.select("a", "b", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).alias("cnt"))


def _both_orders(half: DataFrame, one: str, two: str, names: tuple[str, str]) -> DataFrame:
    """Rows of two sides in both orders, those of equal sides once."""
    order = lambda x, y: F.struct(F.col(x).alias(names[0]), F.col(y).alias(names[1]))
    orders = F.when(F.col(one) == F.col(two), F.array(order(one, two))).otherwise(F.array(order(one, two), order(two, one)))
    return half.withColumn("_p", F.explode(orders)).select("_p.*", *[c for c in half.columns if c not in (one, two)])


def word_pairs(docs: DataFrame, window: int = EMBEDDING_WINDOW, text: str = "text") -> DataFrame:
    """How often two words stand within a window of each other: (word, context, cnt), in both orders."""
    return _both_orders(_half_pairs(docs, window, text), "a", "b", ("word", "context"))


def train_word_factors(
    docs: DataFrame,
    text: str = "text",
    size: int = EMBEDDING_SIZE,
    rounds: int = FACTOR_ROUNDS,
    window: int = EMBEDDING_WINDOW,
    shift: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Word vectors (word, vector) without a vocabulary on the driver: factors of a table of shifted positive mutual information.

    Counts, marginals and information are tables, and Spark's alternating least squares factors them; nothing is as large as the vocabulary in one
    place. Words are numbered by rank in hash order. ``train_word2vec`` is the other choice, for vocabularies that fit the driver.
    """
    spark = docs.sparkSession
    totals = near_totals(docs, window, text).groupBy("word").agg(F.sum("total").alias("total"))
    numbered = stored(hash_rank(totals, ["word"], seed=seed).select("word", F.col("rank").cast("int").alias("number"), "total"), "words")
    pairs_in_all = float(numbered.agg(F.coalesce(F.sum("total"), F.lit(1))).first()[0])
    side = lambda name: numbered.select(F.col("word").alias(name), F.col("number").alias(f"{name}_no"), F.col("total").alias(f"{name}_total"))
    # Pairs move once to be summed and to meet their first word, and once more to the second; orders are doubled only for the factors.
    known = _half_pairs(docs, window, text).join(side("a"), "a").select("b", "cnt", "a_no", "a_total").join(side("b"), "b")
    information = F.log(F.col("cnt") * pairs_in_all / (F.col("a_total") * F.col("b_total"))) - float(np.log(shift))
    positive = stored(known.select("a_no", "b_no", information.alias("information")).filter("information > 0"), "information")
    # A word's factors go to every block that has a context of it, in each round: as few blocks as their size allows.
    blocks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(FACTOR_BLOCKS, 2 * positive.count() // BLOCK_RATINGS)))
    # With a folder for it, Spark's factors are kept there after each round and the round's shuffles deleted.
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/factors")
    als = ALS(
        rank=size,
        maxIter=rounds,
        implicitPrefs=True,
        userCol="word_no",
        itemCol="context_no",
        ratingCol="information",
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=1,
        seed=seed,
    )
    factors = als.fit(_both_orders(positive, "a_no", "b_no", ("word_no", "context_no"))).userFactors.select(F.col("id").alias("number"), array_to_vector("features").alias("vector"))
    return numbered.select("word", "number").join(factors, "number").select("word", "vector")


def _held_words(docs: DataFrame, vectors: DataFrame, size: int, text: str, held: int) -> tuple[list[str], np.ndarray, np.ndarray, DataFrame | None]:
    """Words whose vectors every task holds, their summed vectors and the number of these; and what vectors are left, if any.

    All words, if together they have at most ``held`` values; else those that most documents have.
    """
    most = max(1, held // size)
    if vectors.count() <= most:
        chosen, rest = vectors, None
    else:
        bags = counted_tokens(docs, "doc_id", text=text, words=True).select(F.explode_outer("bag").alias("w"))
        counts = bags.groupBy("w.token").agg(F.count("*").alias("docs")).withColumnRenamed("token", "word")
        words = stored(vectors.select("word").distinct().join(counts, "word").orderBy(F.desc("docs"), "word").limit(most), "held-words")
        chosen, rest = vectors.join(words.select("word"), "word", "left_semi"), vectors.join(words.select("word"), "word", "left_anti")
    got = chosen.toArrow()
    names = got.column("word").to_pylist()
    values = np.array(got.column("vector").combine_chunks().flatten(), "f8").reshape(len(names), -1)
    known: dict[str, int] = {}
    place = np.fromiter((known.setdefault(word, len(known)) for word in names), "i8", len(names))
    table = np.zeros((len(known), values.shape[1] if len(names) else size))
    np.add.at(table, place, values)
    return list(known), table, np.bincount(place, minlength=len(known)).astype("f8"), rest


def _marks(vectors: DataFrame) -> np.ndarray:
    """Marks that let the words of a table pass and few others; all pass where there are very many."""
    marks = np.ones(1, bool)
    if vectors.count() <= MARKS >> 4:
        marks = np.zeros(MARKS, bool)
        marks[np.array(vectors.select((F.crc32(F.col("word").cast("binary")) % MARKS).alias("at")).toArrow().column("at"), "i8")] = True
    return marks


def doc_embedding(docs: DataFrame, vectors: DataFrame, size: int = EMBEDDING_SIZE, text: str = "text", held: int = HELD_VALUES) -> DataFrame:
    """Mean vector of the known words of each document, repeats counted; zeros if none is known.

    ``vectors`` has (word, vector). Vectors of common words, up to ``held`` values, go to every task, where a document's words are
    counted and its vectors summed; only rarer words move to their vectors.
    """
    plain = stored(vectors.filter("word IS NOT NULL").select("word", vector_to_array("vector").alias("vector")), "vectors")
    words, table, times, rest = _held_words(docs, plain, size, text, held)
    summed = word_sums(docs, words, table, times, None if rest is None else _marks(rest), text=text)
    if rest is not None:
        summed = stored(summed, "sums")
        met = summed.filter("word IS NOT NULL").select("doc_id", "word", F.col("cnt").cast("double").alias("weight")).join(rest, "word")
        scaled = F.transform("vector", lambda x: x * F.col("weight"))
        summed = summed.filter("word IS NULL").select("doc_id", "total", "weight").unionByName(met.select("doc_id", scaled.alias("total"), "weight"))
    # One row for a document, with those of its rare words.
    gathered = summed.groupBy("doc_id").agg(F.collect_list("total").alias("totals"), F.sum("weight").alias("weight"))
    total = F.aggregate(F.slice("totals", 2, 1 << 30), F.get("totals", F.lit(0)), lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y))
    known = gathered.select("doc_id", F.transform(total, lambda x: x / F.col("weight")).alias("embedding"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return docs.select("doc_id").join(known, "doc_id", "left").select(
        "doc_id", F.coalesce("embedding", zeros).alias("embedding")
    )


def nn_pair_vector(pairs: DataFrame, embeddings: DataFrame, out: str = "features") -> DataFrame:
    """Add ``[embedding 1, embedding 2, cosine]`` and the cosine to a pair table."""
    both = attach(attach_firsts(pairs, embeddings), embeddings, 2)
    cosine = cosine_similarity(F.col("embedding1"), F.col("embedding2"))
    return (
        both.withColumn("cosine", cosine)
        .withColumn(out, F.concat("embedding1", "embedding2", F.array("cosine")))
        .drop("embedding1", "embedding2")
    )


