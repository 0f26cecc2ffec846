"""The registered queries: every operator over the stored tables, whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.functions import text as tx
from likeness.operators import candidates, ensemble, evaluate, models, pairs, report, sections, similar, similarity, splits, structure, tokens
from likeness.plans import tables
from likeness.session import shared_folder, stored
from likeness.sources import corpus, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def r6(column) -> F.Column:
    return F.round(column, 6)


def big(column) -> F.Column:
    return F.col(column).cast("bigint").alias(column)


def bigs(df: DataFrame) -> DataFrame:
    """All integer columns as BIGINT and all doubles to six places, so that engines agree."""
    columns = []
    for name, kind in df.dtypes:
        if kind in ("int", "smallint", "tinyint"):
            columns.append(big(name))
        elif kind == "double":
            columns.append(r6(name).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(columns)


# Sources


@query
def label_from_path(spark, folder):
    return bigs(corpus.label_from_path(tables.corpus_paths(spark, folder)))


@query
def load_batch(spark, folder):
    return report.accepted_batches(tables.conversation_files(spark, folder), counts=corpus.counts_in_batch())


@query
def read_pairs(spark, folder):
    """Labelled vectors, written and read back, with all their values."""
    vectors = tables.read_table(spark, folder, "embeddings")
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    sinks.write_pairs(vectors.select(F.col("embedding").cast("array<double>").alias("features"), "label"), path, by_case=False)
    shown = F.array_join(F.transform("features", lambda x: F.format_string("%.8f", x)), ",")
    return bigs(corpus.read_pairs(spark, path).select("label", F.size("features").alias("width"), shown.alias("features")))


@query
def load_corpus(spark, folder):
    """Benchmark items written as a corpus of files, one each, and read back."""
    items = tables.read_table(spark, folder, "benchmark")
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    files = items.select(F.concat(F.lit("case-"), F.col("item_id").cast("string")).alias("item"), F.col("text").alias("value"))
    files.write.partitionBy("item").text(f"{path}/original")
    found = corpus.load_corpus(spark, path, ".txt")
    return bigs(found.select("case_id", "role", "label", "level", "n_bytes", F.md5("text").alias("text_md5")))


# Text and tokens


@query
def strip_comments(spark, folder):
    pages = tables.read_table(spark, folder, "pages")
    return pages.select(
        "page_id",
        tx.strip_comments(F.col("url")).alias("url"),
        F.md5(tx.strip_comments(F.col("html"))).alias("html_md5"),
    )


@query
def normalize_code(spark, folder):
    docs = tables.code_documents(spark, folder)
    return docs.select("doc_id", F.md5(tx.normalize_code(F.col("text"))).alias("text_md5"))


@query
def tokenize(spark, folder):
    docs = tokens.with_tokens(tables.code_documents(spark, folder))
    return docs.select("doc_id", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query
def word_tokens(spark, folder):
    docs = tables.documents(spark, folder).select("doc_id", tx.word_tokens(F.col("text")).alias("words"))
    return docs.select("doc_id", big_size("words"), F.md5(F.array_join("words", " ")).alias("words_md5"))


def big_size(name):
    return F.size(name).cast("bigint").alias(f"num_{name}")


@query
def token_positions(spark, folder):
    return bigs(tokens.token_positions(tokens.with_tokens(tables.documents(spark, folder))))


@query
def token_counts(spark, folder):
    return tokens.token_counts(tokens.with_tokens(tables.documents(spark, folder)))


@query
def token_numbers(spark, folder):
    docs = tokens.with_tokens(tables.documents(spark, folder))
    return tokens.with_token_numbers(docs).select("doc_id", "num_tokens", "num_unique_tokens")


@query
def approximate_token_numbers(spark, folder):
    """Different tokens of each language, from sketches of its cases, held against the exact number."""
    docs = stored(tokens.with_tokens(tables.documents(spark, folder)).select("lang", "case_id", "tokens"), "tokens")
    parts = tokens.token_sketches(docs, ["lang", "case_id"])
    merged = tokens.approximate_numbers(tokens.merged_sketches(parts, ["lang"])).withColumnRenamed("num_unique_tokens", "near")
    exact = docs.select("lang", F.explode_outer("tokens").alias("token")).groupBy("lang").agg(F.countDistinct("token").alias("num_unique_tokens"))
    bound = 4 * 1.04 / 2 ** (tokens.SKETCH_SIZE / 2)
    within = F.abs(F.col("near") - F.col("num_unique_tokens")) <= bound * F.col("num_unique_tokens") + 1
    return exact.join(merged, "lang").select("lang", "num_unique_tokens", within.alias("within_bound"))


# Structure


@query
def token_context(spark, folder):
    return bigs(structure.token_context(tables.code_documents(spark, folder)))


@query
def statement_kinds(spark, folder):
    return bigs(structure.statement_kinds(tokens.with_tokens(tables.code_documents(spark, folder))))


@query
def doc_features(spark, folder):
    return bigs(structure.doc_features(tables.code_documents(spark, folder)).drop("kinds"))


@query
def kind_sequence(spark, folder):
    return structure.kind_sequence(tables.code_documents(spark, folder))


def _ngrams(spark, folder, n):
    sequences = structure.kind_sequence(tables.code_documents(spark, folder))
    return structure.kind_ngrams(sequences, n).select("doc_id", "gram", "cnt")


@query
def kind_ngrams_2(spark, folder):
    return _ngrams(spark, folder, 2)


@query
def kind_ngrams_4(spark, folder):
    return _ngrams(spark, folder, 4)


@query
def named_ngrams(spark, folder):
    return structure.named_ngrams(structure.kind_sequence(tables.code_documents(spark, folder)))


# Pairs


@query
def case_pairs(spark, folder):
    return bigs(pairs.case_pairs(tables.corpus_ids(spark, folder)))


@query
def positive_pairs(spark, folder):
    return bigs(pairs.positive_pairs(tables.corpus_ids(spark, folder)))


@query
def negative_pairs(spark, folder):
    return bigs(pairs.negative_pairs(stored(tables.corpus_ids(spark, folder), "ids")))


@query
def training_pairs(spark, folder):
    return bigs(pairs.training_pairs(stored(tables.corpus_ids(spark, folder), "ids")))


@query
def one_pair(spark, folder):
    """The first and the last document, compared like any other pair."""
    docs = tables.documents(spark, folder)
    first, last = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    ends = stored(pairs.one_pair(docs, first, last), "pair")
    bags = tables.bags_in_pairs(docs.select("doc_id", "text"), ends)
    return similarity.token_overlap(ends, bags, bags)


def _similar(files, percent):
    return bigs(similar.similar_pairs(similarity.bags_of(files, "batch_id"), percent))


@query
def batch_pairs(spark, folder):
    return _similar(tables.conversation_files(spark, folder), 30)


@query
def case_near_copies(spark, folder):
    docs = tables.documents(spark, folder)
    return _similar(docs.select("doc_id", F.col("case_id").alias("batch_id"), "text"), 60)


@query
def overlap_snippets(spark, folder):
    """The common sections of all near copies of the corpus, those of every copy with every other."""
    docs = tables.documents(spark, folder)
    found = stored(candidates.candidate_pairs(docs), "candidates")
    # Fewer tokens make no section.
    listed = candidates.listed_pairs(found.filter(F.least("num_tokens1", "num_tokens2") >= sections.SHORTEST))
    return bigs(sections.overlap_snippets(listed, docs.select("doc_id", "text")))


@query
def candidate_pairs(spark, folder):
    """Near copies of the whole corpus, measured."""
    return bigs(candidates.candidate_pairs(tables.documents(spark, folder)))


# Measures


@query
def token_overlap(spark, folder):
    ids = stored(pairs.case_pairs(tables.corpus_ids(spark, folder)), "ids")
    bags = tables.bags_in_pairs(tables.documents(spark, folder).select("doc_id", "text"), ids)
    return similarity.token_overlap(ids.drop("label"), bags, bags)


@query
def sequence_measures(spark, folder):
    measured = tables.measured_pairs(spark, folder)
    return bigs(measured.select("case_id", "doc1", "doc2", *similarity.PAIR_KEYS))


@query
def pair_vector(spark, folder):
    vectors = similarity.pair_vector(tables.measured_pairs(spark, folder))
    flat = F.array_join(F.transform("features", lambda x: F.format_string("%.10f", x)), ",")
    return bigs(vectors.select("doc1", "doc2", "label", F.size("features").alias("width"), flat.alias("features")))


@query
def feature_keys(spark, folder):
    docs = tables.read_table(spark, folder, "documents")
    rows = docs.select(
        F.col("doc_id").alias("row"),
        F.map_from_arrays(
            F.array(F.lit("n_chars"), F.concat(F.lit("lang_"), "lang"), F.concat(F.lit("source_"), "source")),
            F.array("n_chars", F.lit(1), F.lit(1)),
        ).alias("features"),
    )
    return bigs(similarity.feature_keys(rows))


@query
def cosine_similarity(spark, folder):
    """Each vector with the first one of its label."""
    vectors = tables.read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    firsts = vectors.groupBy("label").agg(F.min("doc_id").alias("doc1"))
    star = vectors.select(F.col("doc_id").alias("doc2"), "label").join(firsts, "label")
    both = similarity.attach(similarity.attach(star, vectors.drop("label"), 2), vectors.drop("label"), 1)
    return bigs(
        both.select(
            "doc1", "doc2", similarity.cosine_similarity(F.col("embedding1"), F.col("embedding2")).alias("cosine")
        )
    )


# Splits


def _labelled(spark, folder):
    return tables.read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))


@query
def random_split(spark, folder):
    return bigs(splits.random_split(_labelled(spark, folder), ["doc_id"], seed=7))


@query
def seeded_split(spark, folder):
    return bigs(splits.random_split(_labelled(spark, folder), ["doc_id"], seed=42))


@query
def stratified_split(spark, folder):
    return bigs(splits.stratified_split(_labelled(spark, folder), ["doc_id"]))


@query
def validation_split(spark, folder):
    return bigs(splits.validation_split(_labelled(spark, folder), ["doc_id"]))


@query
def stratified_folds(spark, folder):
    return bigs(splits.folds(_labelled(spark, folder), ["doc_id"], 5, "label"))


@query
def bootstrap(spark, folder):
    return bigs(splits.bootstrap(_labelled(spark, folder), ["doc_id"]))


# Evaluation


def _predicted(spark, folder):
    """Scored pairs with a score, a prediction by threshold, a level and a language."""
    scored = tables.scored_pairs(spark, folder)
    return (
        scored.withColumn("score", F.col("votes_a") / 200)
        .withColumn("prediction", evaluate.threshold_predict(F.col("score"), 0.3))
        .withColumn("lang", F.substring_index("case_id", "/", 1))
        .withColumn("level", F.concat(F.lit("L"), (F.col("doc2") % 6 + 1).cast("string")))
    )


@query
def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(_predicted(spark, folder))


@query
def binary_metrics(spark, folder):
    return bigs(evaluate.binary_metrics(evaluate.confusion_matrix(_predicted(spark, folder))))


@query
def classification_report(spark, folder):
    return bigs(evaluate.classification_report(_predicted(spark, folder)))


@query
def roc_points(spark, folder):
    return bigs(evaluate.roc_points(_predicted(spark, folder), "votes_a"))


@query
def auc_trapezoid(spark, folder):
    return bigs(evaluate.auc_trapezoid(evaluate.roc_points(_predicted(spark, folder), "votes_a")))


@query
def auc_rank(spark, folder):
    counted = stored(_predicted(spark, folder).select("score", "label"), "scores")
    return bigs(evaluate.auc_rank(counted))


@query
def evaluate_by_group(spark, folder):
    return bigs(evaluate.evaluate_by_group(_predicted(spark, folder), ["lang", "level"]))


@query
def sort_scores(spark, folder):
    return bigs(evaluate.sort_scores(_predicted(spark, folder).select("doc1", "doc2", "score"), ["doc1", "doc2"]))


@query
def class_weights(spark, folder):
    return bigs(evaluate.class_weights(_labelled(spark, folder)))


@query
def vote_predict(spark, folder):
    votes = tables.scored_pairs(spark, folder)
    return bigs(
        votes.select(
            "doc1",
            "doc2",
            evaluate.vote_predict(F.col("votes_c"), 200, tie=1).alias("serving"),
            evaluate.vote_predict(F.col("votes_c"), 200, tie=0).alias("evaluating"),
        )
    )


@query
def threshold_predict(spark, folder):
    scored = tables.scored_pairs(spark, folder)
    return bigs(
        scored.select("doc1", "doc2", evaluate.threshold_predict(F.col("votes_c") / 200).alias("prediction"))
    )


# Ensemble

SCORES = ["p_a", "p_b", "p_c", "p_d"]


def _four_scores(spark, folder):
    scored = stored(tables.scored_pairs(spark, folder), "scores")
    key = ["doc1", "doc2"]
    named = {
        f"p_{x}": scored.select(*key, (F.col(f"votes_{x}") / 200).alias("score")) for x in ("a", "b", "c", "d")
    }
    return ensemble.join_scores(named, key).join(scored.select(*key, "label"), key)


def _model_scores(spark, folder):
    scored = tables.scored_pairs(spark, folder)
    return scored.select("doc1", "doc2", "label", *[(F.col(f"votes_{x}") / 200).alias(f"p_{x}") for x in "abcd"])


@query
def blend(spark, folder):
    joined = _four_scores(spark, folder)
    total = ensemble.blend(SCORES, [F.lit(w) for w in (1, 2, 3, 4)])
    return bigs(
        joined.select("doc1", "doc2", "label", (total / 10).alias("score"), (total > 5).cast("int").alias("prediction"))
    )


@query
def weight_accuracy(spark, folder):
    return bigs(ensemble.weight_accuracy(_model_scores(spark, folder), SCORES))


@query
def best_weights(spark, folder):
    return bigs(ensemble.best_weights(_model_scores(spark, folder), SCORES))


@query
def best_blend(spark, folder):
    """Accuracy and rank AUC of the best weighting."""
    scored = stored(_model_scores(spark, folder), "scores")
    blended = ensemble.blend_with_best(scored, ensemble.best_weights(scored, SCORES), SCORES)
    # Scores that differ only in their last bits count as equal.
    blended = blended.withColumn("score", F.round("score", 9))
    rates = evaluate.binary_metrics(evaluate.confusion_matrix(blended))
    return bigs(rates.select("accuracy", "f1", evaluate.auc_rank(blended).scalar().alias("auc")))


# Models


def _training(spark, folder):
    """Labelled pair vectors with one shared stratified split, written once since training reads them often."""
    vectors = similarity.pair_vector(tables.measured_pairs(spark, folder, labelled=True))
    rows = splits.stratified_split(vectors.select("doc1", "doc2", "label", "features"), ["doc1", "doc2"])
    return stored(rows, "pairs")


def _rated(scored):
    """Held-out rates and rank AUC of scored pairs, next to each other."""
    held_out = scored.filter(~F.col("is_train")).withColumn("score", F.element_at("confidence", 2))
    kept = stored(held_out.select("label", "prediction", "score"), "scored")
    rates = evaluate.binary_metrics(evaluate.confusion_matrix(kept))
    return rates.select("*", evaluate.auc_rank(kept).scalar().alias("auc"))


def _trained(train):
    def run(spark, folder):
        rows = _training(spark, folder)
        model = train(rows.filter("is_train"))
        return _rated(models.score_pairs(model, rows, 2 * len(similarity.FEATURE_KEYS)))

    return run


@query
def random_forest(spark, folder):
    """Held-out results of the forest by hard votes, with ties as in evaluation."""
    rows = _training(spark, folder)
    forest = models.train_random_forest(rows.filter("is_train"))
    return _rated(models.forest_predict(models.forest_votes(forest, rows), forest.getNumTrees, tie=0))


@query
def forest_votes(spark, folder):
    """Votes, served prediction and confidence of every labelled pair."""
    rows = _training(spark, folder)
    forest = models.train_random_forest(rows.filter("is_train"))
    voted = models.forest_predict(models.forest_votes(forest, rows), forest.getNumTrees)
    return voted.select("doc1", "doc2", "votes", "prediction", "confidence")


@query
def boosted_trees(spark, folder):
    return _trained(models.train_boosted_trees)(spark, folder)


@query
def grid_search_cv(spark, folder):
    """Mean F1 over the folds for each parameter set of the full grid."""
    rows = _training(spark, folder)
    found = models.grid_search_cv(rows.filter("is_train"), ["doc1", "doc2"])
    table = [
        (i, float(f1), ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda x: x[0].name)))
        for i, (f1, params) in enumerate(zip(found.avgMetrics, found.getEstimatorParamMaps()))
    ]
    return spark.createDataFrame(table, "candidate int, mean_f1 double, params string")


@query
def grid_search_by_rungs(spark, folder):
    """The short grid with few rounds of boosting, its best part with more."""
    return models.grid_search_by_rungs(_training(spark, folder).filter("is_train"), ["doc1", "doc2"])


@query
def kernel_support_vectors(spark, folder):
    return _trained(models.train_kernel_svm)(spark, folder)


@query
def support_vectors(spark, folder):
    return _trained(models.train_svm)(spark, folder)


@query
def logistic_regression(spark, folder):
    return _trained(models.train_logistic_regression)(spark, folder)


@query
def score_pairs(spark, folder):
    """Prediction, confidence and its maximum for every case pair, labelled or not."""
    rows = stored(similarity.pair_vector(tables.measured_pairs(spark, folder)).select("doc1", "doc2", "label", "features"), "pairs")
    model = models.train_logistic_regression(rows.filter(F.col("label").isNotNull()))
    scored = models.with_max_confidence(models.score_pairs(model, rows, 2 * len(similarity.FEATURE_KEYS)))
    return scored.select("doc1", "doc2", "prediction", "confidence", "max_confidence", "error")


def _word_vectors(spark, folder):
    """The stored vectors as vectors of words: each belongs to the first word of its document."""
    docs = tables.documents(spark, folder).select(
        F.col("doc_id").alias("vec_id"), tokens.once(tx.first_word(F.col("text"))).alias("word")
    )
    vectors = tables.read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    named = docs.filter(F.col("word").isNotNull()).join(vectors, "vec_id").groupBy("word")
    return named.agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        "word", array_to_vector("embedding").alias("vector")
    )


@query
def doc_embedding(spark, folder):
    docs = tables.documents(spark, folder).select("doc_id", "text")
    means = models.doc_embedding(docs, _word_vectors(spark, folder), size=64)
    return bigs(means.select("doc_id", F.posexplode_outer("embedding").alias("dim", "value")))


@query
def nn_pair_vector(spark, folder):
    """All values of the network's vectors for all case pairs: both embeddings and the cosine."""
    docs = tables.documents(spark, folder).select("doc_id", "text")
    means = stored(models.doc_embedding(docs, _word_vectors(spark, folder), size=64), "means")
    ids = pairs.case_pairs(tables.corpus_ids(spark, folder)).select("doc1", "doc2")
    vectors = models.nn_pair_vector(ids, means)
    return bigs(vectors.select("doc1", "doc2", F.posexplode_outer("features").alias("dim", "value")))


#: The network's registered runs are cut to these sizes; at full size its training alone takes minutes on a small table (see the README).
CUT_SIZE, CUT_LAYERS, CUT_ROUNDS = 16, [32, 16], 20


def _rated_network(spark, folder, vectors):
    """Held-out rates of a network on the pair vectors that word vectors give."""
    docs = tables.documents(spark, folder).select("doc_id", "text")
    means = stored(models.doc_embedding(docs, vectors(docs), CUT_SIZE), "means")
    drawn = pairs.training_pairs(stored(tables.corpus_ids(spark, folder), "ids")).drop("turn")
    rows = stored(models.nn_pair_vector(drawn, means).select("doc1", "doc2", "label", "features"), "pairs")
    marked = splits.validation_split(rows, ["doc1", "doc2"]).withColumn("is_train", ~F.col("is_validation"))
    network = models.train_mlp(marked.filter("is_train"), 2 * CUT_SIZE + 1, hidden=CUT_LAYERS, rounds=CUT_ROUNDS)
    return _rated(models.score_pairs(network, marked, 2 * CUT_SIZE + 1))


@query
def word2vec_network(spark, folder):
    """Word vectors by one round of skip-grams over all texts, and a network on the pair vectors they give."""
    return _rated_network(spark, folder, lambda docs: models.train_word2vec(docs, size=CUT_SIZE, rounds=1).getVectors())


@query
def word_factors_network(spark, folder):
    """The same with factors of mutual information as word vectors."""
    return _rated_network(spark, folder, lambda docs: models.train_word_factors(docs, size=CUT_SIZE))


# Reports


def _comparisons(spark, folder):
    """Similar pairs of all files of every conversation with a prediction from their overlap in 200ths."""
    files = tables.conversation_files(spark, folder)
    found = similar.similar_pairs(similarity.bags_of(files, "batch_id"), 20)
    votes = F.expr("200 * token_overlap div greatest(num_tokens1, num_tokens2, 1)")
    file = lambda doc: F.format_string("t%d.java", F.col(doc) % 100000)
    valid = F.greatest("num_tokens1", "num_tokens2") > 0
    scored = found.select(
        "batch_id",
        file("doc1").alias("file1"),
        file("doc2").alias("file2"),
        votes.alias("votes"),
        valid.alias("valid"),
        similar.pairs_behind().alias("pairs"),
    )
    p1 = F.col("votes") / 200
    rated = scored.withColumn("prediction", evaluate.vote_predict(F.col("votes"), 200)).withColumn(
        "confidence", F.array((200 - F.col("votes")) / 200, p1)
    )
    checked = report.row_errors(rated, F.col("valid"), "no tokens", ["prediction", "confidence"])
    return files, stored(checked, "comparisons")


@query
def batch_report(spark, folder):
    """The nested report, read back row by row."""
    files, comparisons = _comparisons(spark, folder)
    when = F.lit("2025-01-01 00:00:00").cast("timestamp")
    nested = report.batch_report(files, comparisons, when, page_size=5, percent=20)
    rows = nested.select(
        "batch_id", "total_files", "total_comparisons", "threshold", "error", F.posexplode_outer("comparisons").alias("place", "c")
    )
    return bigs(
        rows.select(
            "batch_id",
            "total_files",
            "total_comparisons",
            "threshold",
            "error",
            "c.file1",
            "c.file2",
            "c.prediction",
            F.element_at("c.confidence", 2).alias("p1"),
        )
    )


@query
def report_summary(spark, folder):
    files, comparisons = _comparisons(spark, folder)
    return bigs(report.report_summary(files, comparisons))


@query
def plagiarized_pairs(spark, folder):
    _, comparisons = _comparisons(spark, folder)
    p1 = F.element_at("confidence", 2)
    return bigs(
        report.plagiarized_pairs(comparisons).select(
            "batch_id",
            "file1",
            "file2",
            report.status_label(F.col("prediction")).alias("status"),
            report.confidence_pct(p1, 1).alias("confidence"),
        )
    )


@query
def status_and_confidence(spark, folder):
    scored = _predicted(spark, folder)
    known = F.when(F.col("doc2") % 7 != 0, F.col("score"))
    return bigs(
        scored.select(
            "doc1",
            "doc2",
            report.status_label(F.col("prediction")).alias("status"),
            report.confidence_pct(known, 1).alias("batch_confidence"),
            report.confidence_pct(known, 2).alias("single_confidence"),
        )
    )


@query
def report_history(spark, folder):
    """Every turn against its role, report by report, with the length of its text in 200ths as a probability."""
    turns = tables.read_table(spark, folder, "conversations")
    p1 = F.pmod(F.length("text"), F.lit(200)) / 200
    rows = turns.select(
        F.timestamp_seconds(F.lit(1700000000) + F.col("conv_id") * 86400).alias("submitted_at"),
        F.array(
            F.struct(
                F.format_string("t%d.java", "turn").alias("file1"),
                F.concat("role", F.lit(".java")).alias("file2"),
                evaluate.threshold_predict(p1).alias("prediction"),
                F.array(1 - p1, p1).alias("confidence"),
            )
        ).alias("comparisons"),
    )
    history = report.report_history(rows)
    return bigs(history.select(F.unix_timestamp("submitted_at").alias("submitted_at"), *history.columns[1:]))


@query
def row_errors(spark, folder):
    rows = tables.read_table(spark, folder, "documents").join(
        tables.read_table(spark, folder, "labels"), "doc_id", "left"
    )
    scored = rows.select("doc_id", F.col("quality").alias("prediction"), (F.col("n_chars") % 200 / 200).alias("p1"))
    return bigs(report.row_errors(scored, F.col("prediction").isNotNull(), "no label", ["prediction", "p1"]))
