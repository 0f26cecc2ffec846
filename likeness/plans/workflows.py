"""Whole jobs: training on a labelled corpus, and scoring batches, pairs and suspects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.operators import candidates, ensemble, evaluate, models, pairs, report, sections, similar, similarity, splits
from likeness.session import stored
from likeness.sources.corpus import counts_in_batch

VECTOR_WIDTH = 2 * len(similarity.FEATURE_KEYS)


def pair_examples(corpus: DataFrame) -> DataFrame:
    """Labelled vectors of all case pairs: (case_id, doc1, doc2, label, features).

    Each document is profiled once.
    """
    profiled = similarity.profiles(corpus.select("doc_id", "text"))
    measured = similarity.measure_pairs(stored(pairs.case_pairs(corpus), "ids"), profiled, profiled)
    return similarity.pair_vector(measured).select("case_id", "doc1", "doc2", "label", "features")


@dataclass
class Trained:
    """Fitted classifiers by name, their held-out metrics, and the held-out blend with its rank AUC and its report by class."""

    models: dict
    metrics: DataFrame
    weights: DataFrame
    blend_metrics: DataFrame
    blend_report: DataFrame


def train(examples: DataFrame, trees: int = models.FOREST_TREES, boosting: dict | None = None, seed: int = 42) -> Trained:
    """Fit all classifiers on one stratified split and search the weights of their blend.

    Training rows are used by every model, so they are written once. Weights are found on a part
    of the held-out rows and judged on the other.
    """
    key = ["doc1", "doc2"]
    rows = stored(splits.stratified_split(examples, key, seed=seed), "examples")
    train_rows = rows.filter("is_train")
    held_out = splits.folds(rows.filter(~F.col("is_train")), key, 2, "label", seed)
    fitted = {
        "svm": models.train_svm(train_rows),
        "boosted_trees": models.train_boosted_trees(train_rows, seed, **(boosting or {})),
        "random_forest": models.train_random_forest(train_rows, trees, seed),
        "logistic_regression": models.train_logistic_regression(train_rows),
    }
    scored = {}
    for name, model in fitted.items():
        if name == "random_forest":
            result = models.forest_predict(models.forest_votes(model, held_out), trees, tie=0)
        else:
            result = models.score_pairs(model, held_out, VECTOR_WIDTH)
        score = F.element_at("confidence", 2).alias("score")
        scored[name] = stored(result.select(*key, "fold", "label", "prediction", score), name)
    tables = [
        evaluate.binary_metrics(evaluate.confusion_matrix(t)).select(F.lit(name).alias("model"), "*")
        for name, t in scored.items()
    ]
    metrics = tables[0]
    for table in tables[1:]:
        metrics = metrics.unionByName(table)
    names = list(scored)
    facts = scored[names[0]].select(*key, "fold", "label")
    joined = stored(ensemble.join_scores(scored, key).join(facts, key), "blend")
    weights = ensemble.best_weights(joined.filter("fold = 0"), names)
    blended = stored(ensemble.blend_with_best(joined.filter("fold = 1"), weights, names), "blended")
    rates = evaluate.binary_metrics(evaluate.confusion_matrix(blended))
    blend_metrics = rates.select("*", evaluate.auc_rank(blended).scalar().alias("auc"))
    return Trained(fitted, metrics, weights, blend_metrics, evaluate.classification_report(blended))


def compare(wanted: DataFrame, docs: DataFrame, model) -> DataFrame:
    """Score a pair table (doc1, doc2) against documents (doc_id, text): prediction and confidence."""
    listed = stored(wanted, "wanted")
    ids = listed.select(F.explode(F.array("doc1", "doc2")).alias("doc_id")).distinct()
    profiled = similarity.profiles(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"))
    vectors = similarity.pair_vector(similarity.measure_pairs(listed, profiled, profiled))
    kept = stored(vectors.select(*wanted.columns, "features"), "vectors")
    return models.score_pairs(model, kept, VECTOR_WIDTH)


def compare_two(docs: DataFrame, original_id, suspect_id, model) -> DataFrame:
    """One original against one suspect."""
    two = docs.filter(F.col("doc_id").isin([original_id, suspect_id]))
    return compare(pairs.one_pair(two, original_id, suspect_id), two, model)


def compare_batches(files: DataFrame, model, percent: int = 30) -> DataFrame:
    """Scored comparisons of submitted batches (batch_id, doc_id, file, text).

    Every pair of files whose texts resemble each other by at least ``percent`` is listed and
    scored. Copies of a file are linked to its first one; ``pairs`` counts what a row stands for.
    Copies have the same tokens in the same order, so all their vectors are equal.
    """
    found = similar.similar_pairs(similarity.bags_of(files, "batch_id", sequence=True), percent)
    wanted = found.select("batch_id", "doc1", "doc2", similar.pairs_behind(F.col("is_copy")).alias("pairs"))
    scored = compare(wanted, files, model)
    names = files.select("doc_id", "file")
    named = similarity.attach(similarity.attach(scored, names, 2), names, 1)
    return named.select("batch_id", "doc1", "doc2", "file1", "file2", "prediction", "confidence", "error", "pairs")


def report_batches(files: DataFrame, model, submitted_at: Column | None = None, percent: int = 30) -> DataFrame:
    """Report rows of submitted batches (batch_id, doc_id, file, text), ready to be written.

    ``file`` is a path within the batch. Only code files at its top count and are compared; a batch with fewer than two of them, or
    none, has a row with an error.
    """
    top = counts_in_batch("file")
    comparisons = stored(compare_batches(files.filter(top), model, percent), "comparisons")
    when = F.current_timestamp() if submitted_at is None else submitted_at
    return report.batch_report(files, comparisons, when, counts=top, percent=percent)


def report_corpus(corpus: DataFrame, model, percent: int = 75, shortest: int = sections.SHORTEST) -> DataFrame:
    """All near copies of a corpus (doc_id, text), scored, with how much of them lies in common sections.

    Columns: doc1, doc2, is_copy, token_overlap, num_tokens1, num_tokens2, prediction, confidence, error, status, shown_confidence, sections,
    section_tokens. Candidates come from the signatures of the whole corpus; only documents of some pair are profiled, and
    only pairs that are called plagiarized are searched for sections.
    """
    found = stored(candidates.candidate_pairs(corpus, percent), "candidates")
    scored = compare(found.select("doc1", "doc2"), corpus, model).select("doc1", "doc2", "prediction", "confidence", "error")
    judged = stored(found.join(scored, ["doc1", "doc2"]), "judged")
    shown = sections.overlap_snippets(report.plagiarized_pairs(judged), corpus, shortest)
    extents = shown.groupBy("doc1", "doc2").agg(
        F.count("*").alias("sections"), F.sum(F.col("end1") - F.col("start1")).alias("section_tokens")
    )
    return (
        judged.withColumn("status", report.status_label(F.col("prediction")))
        .withColumn("shown_confidence", report.confidence_pct(F.element_at("confidence", 2)))
        .join(extents, ["doc1", "doc2"], "left")
        .fillna(0, ["sections", "section_tokens"])
    )


@dataclass
class TrainedNetwork:
    """Word vectors and the network on the pair vectors they give."""

    words: object
    network: object
    size: int


def train_network(
    corpus: DataFrame,
    size: int = models.EMBEDDING_SIZE,
    rounds: int = models.EMBEDDING_ROUNDS,
    hidden: list[int] | None = None,
    network_rounds: int = models.NETWORK_ROUNDS,
    seed: int = 42,
) -> TrainedNetwork:
    """Word vectors from all texts, then the network on positive and negative pairs."""
    words = models.train_word2vec(corpus, size=size, rounds=rounds, seed=seed)
    means = models.doc_embedding(corpus, words.getVectors(), size)
    drawn = pairs.training_pairs(corpus, seed=seed).drop("turn")
    vectors = models.nn_pair_vector(drawn, means).select("doc1", "doc2", "label", "features")
    rows = splits.validation_split(stored(vectors, "network"), ["doc1", "doc2"], seed=seed)
    network = models.train_mlp(rows.filter(~F.col("is_validation")), 2 * size + 1, hidden, network_rounds, seed)
    return TrainedNetwork(words, network, size)


def compare_by_network(wanted: DataFrame, docs: DataFrame, trained: TrainedNetwork) -> DataFrame:
    """Score a pair table by embeddings: prediction and confidence."""
    means = models.doc_embedding(docs, trained.words.getVectors(), trained.size)
    vectors = models.nn_pair_vector(wanted, means)
    return models.score_pairs(trained.network, vectors, 2 * trained.size + 1)


def rates_by_level(scored: DataFrame) -> DataFrame:
    """Rates of scored case pairs (case_id, level, label, prediction): by case and level, by case, by level over all cases, and over all."""
    return evaluate.evaluate_by_group(scored, ["case_id", "level"])


def evaluate_network(corpus: DataFrame, trained: TrainedNetwork) -> DataFrame:
    """Every case pair with its probability, truth and prediction, by case and level."""
    scored = compare_by_network(pairs.case_pairs(corpus), corpus.select("doc_id", "text"), trained)
    levels = corpus.select(F.col("doc_id").alias("doc2"), "level")
    return scored.join(levels, "doc2").select(
        "case_id", "level", "doc1", "doc2", F.element_at("confidence", 2).alias("score"), "label", "prediction"
    )
