import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from likeness.functions import cutting
from likeness.operators import evaluate, models, splits
from likeness.sources.sinks import load_model, save_model


@pytest.fixture(scope="module")
def examples(spark):
    draw = random.Random(3)
    rows = []
    for i in range(300):
        label = int(draw.random() < 0.6)
        likeness = min(1.0, max(0.0, draw.gauss(0.7 if label else 0.35, 0.12)))
        rows.append((i, [draw.random(), likeness, draw.random(), likeness * 2], label))
    frame = spark.createDataFrame(rows, "id int, features array<double>, label int")
    return splits.stratified_split(frame, ["id"]).cache()


def held_out_auc(scored):
    rows = scored.filter(~F.col("is_train")).withColumn("score", F.element_at("confidence", 2))
    return evaluate.auc_rank(rows).first().auc


@pytest.mark.parametrize("name", ["boosted", "svm", "kernel", "regression", "network"])
def test_classifiers_learn(examples, name):
    train = examples.filter("is_train")
    model = {
        "boosted": lambda: models.train_boosted_trees(train, maxIter=10, maxDepth=3),
        "svm": lambda: models.train_svm(train),
        "kernel": lambda: models.train_kernel_svm(train),
        "regression": lambda: models.train_logistic_regression(train),
        "network": lambda: models.train_mlp(train, 4, hidden=[8]),
    }[name]()
    scored = models.score_pairs(model, examples, 4)
    assert held_out_auc(scored) > 0.9
    sums = scored.select(F.round(F.element_at("confidence", 1) + F.element_at("confidence", 2), 9).alias("s"))
    assert {r.s for r in sums.distinct().collect()} == {1.0}


def test_a_forest_is_served_by_votes_and_bad_vectors_get_an_error(examples):
    forest = models.train_random_forest(examples.filter("is_train"), trees=4)
    width = len(examples.first().features)
    by_votes = models.forest_predict(models.forest_votes(forest, examples), 4)
    mixed = examples.unionByName(examples.limit(3).withColumn("features", F.lit(None).cast(examples.schema["features"].dataType)))
    mixed = mixed.unionByName(examples.limit(2).withColumn("features", F.slice("features", 1, 1)))
    served = models.score_pairs(forest, mixed, width)
    result = lambda df: sorted((r.prediction, *r.confidence) for r in df.select("prediction", "confidence").collect())
    assert result(served.filter("error IS NULL")) == result(by_votes)
    assert [(r.prediction, r.confidence) for r in served.filter("error IS NOT NULL").collect()] == [(None, None)] * 5


def test_forest_votes_are_those_of_its_trees(examples, tmp_path, spark):
    forest = models.train_random_forest(examples.filter("is_train"), trees=15)
    voted = models.forest_votes(forest, examples)
    by_hand = models.with_vector(examples)
    for i, tree in enumerate(forest.trees):
        tree.setPredictionCol(f"t{i}").setRawPredictionCol(f"r{i}").setProbabilityCol(f"p{i}").setLeafCol(f"l{i}")
        by_hand = tree.transform(by_hand)
    total = sum(F.col(f"t{i}") for i in range(15)).cast("int")
    wanted = {r.id: r.v for r in by_hand.select("id", total.alias("v")).collect()}
    assert {r.id: r.votes for r in voted.select("id", "votes").collect()} == wanted
    predicted = models.forest_predict(voted, 15)
    assert held_out_auc(predicted) > 0.9
    save_model(forest, str(tmp_path / "forest"))
    again = models.forest_votes(load_model(spark, str(tmp_path / "forest")), examples)
    assert {r.id: r.votes for r in again.select("id", "votes").collect()} == wanted


def test_bad_rows_get_an_error_and_the_others_a_score(spark, examples):
    model = models.train_logistic_regression(examples.filter("is_train"))
    rows = spark.createDataFrame(
        [(1, [0.1, 0.9, 0.2, 1.8]), (2, [0.5]), (3, None), (4, [0.1, float("nan"), 0.0, 0.0])],
        "id int, features array<double>",
    )
    found = {r.id: r for r in models.score_pairs(model, rows, 4).collect()}
    assert found[1].prediction == 1 and found[1].error is None
    assert all(found[i].prediction is None and found[i].error for i in (2, 3, 4))


def test_search_returns_the_best(examples):
    found = models.grid_search_cv(examples.filter("is_train"), ["id"], {"maxDepth": [1, 3]}, k=3, maxIter=3)
    assert len(found.avgMetrics) == 2 and max(found.avgMetrics) > 0.8
    assert found.bestModel.getMaxIter() == 3


def test_search_tries_the_full_grid_unless_told_otherwise(spark, examples, monkeypatch):
    tried = []
    monkeypatch.setattr(models.CrossValidator, "fit", lambda self, rows: tried.append(self.getEstimatorParamMaps()))
    models.grid_search_cv(examples.filter("is_train"), ["id"])
    assert len({tuple(sorted((p.name, v) for p, v in params.items())) for params in tried[0]}) == 324


def test_embeddings_are_means_of_known_words(spark):
    from pyspark.ml.linalg import Vectors

    vectors = spark.createDataFrame([("a", Vectors.dense([1.0, 0.0])), ("b", Vectors.dense([0.0, 2.0]))], ["word", "vector"])
    docs = spark.createDataFrame([(1, "a a b zz"), (2, "zz"), (3, "")], "doc_id int, text string")
    found = {r.doc_id: r.embedding for r in models.doc_embedding(docs, vectors, 2).collect()}
    assert found[1] == pytest.approx([2 / 3, 2 / 3]) and found[2] == [0.0, 0.0] and found[3] == [0.0, 0.0]
    wanted = spark.createDataFrame([(1, 2), (1, 1)], "doc1 int, doc2 int")
    vector = {r.doc2: r for r in models.nn_pair_vector(wanted, models.doc_embedding(docs, vectors, 2)).collect()}
    assert vector[2].cosine == 0.0 and vector[1].cosine == pytest.approx(1.0)
    assert len(vector[1].features) == 5


@pytest.mark.parametrize("held", [1, 4, 100])
def test_embeddings_are_the_same_however_many_vectors_are_held(spark, held):
    """Words held by every task and words that move give one mean; an id's rows count together, a word's vectors each."""
    from pyspark.ml.linalg import Vectors

    rows = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 1.0]), ("c", [1.0, 1.0]), ("d", [0.5, 0.0])]
    vectors = spark.createDataFrame([(w, Vectors.dense(v)) for w, v in rows], ["word", "vector"])
    docs = spark.createDataFrame([(1, "a a b zz"), (2, "c c a"), (3, None), (4, "d"), (4, "b b zz"), (None, "a")], "doc_id int, text string")
    found = sorted(((r.doc_id or 0, tuple(round(x, 9) for x in r.embedding)) for r in models.doc_embedding(docs, vectors, 2, held=held).collect()))
    four = (round(0.5 / 3, 9), round(4 / 3, 9))
    assert found == [(0, (0.0, 0.0)), (1, (round(2 / 3, 9),) * 2), (2, (1.8, 0.8)), (3, (0.0, 0.0)), (4, four), (4, four)]


def test_no_vector_moves_where_all_are_held(spark):
    """Where all words are held they are summed as texts are cut, and only the sums meet the documents."""
    from pyspark.ml.linalg import Vectors

    vectors = spark.createDataFrame([(f"w{i}", Vectors.dense([float(i)])) for i in range(30)], ["word", "vector"])
    docs = spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "doc_id int, text string")
    plan = models.doc_embedding(docs, vectors, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_bootstrap_repeats_rows(spark):
    drawn = splits.bootstrap(spark.range(399), ["id"], 0.8)
    assert drawn.count() == 319 and drawn.distinct().count() < 319


def test_doc_embedding_query_keeps_every_document(spark):
    """Each document has its 64 values, all of them zeros where none of its words is known."""
    from likeness.plans.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    ids = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    found = {}
    for r in QUERIES["doc_embedding"](spark, folder).collect():
        found.setdefault(r.doc_id, {})[r.dim] = r.value
    assert set(found) == ids and all(set(v) == set(range(64)) for v in found.values())
    assert any(not any(v.values()) for v in found.values())


def test_fourier_features_stand_for_the_kernel(spark, tmp_path):
    """Inner products are near exp(-gamma |x - y|^2), and a ring, which no line cuts off, is learnt; a saved model is the same."""
    draw = random.Random(5)
    rows = []
    for i in range(400):
        angle, radius = draw.uniform(0, 6.283), draw.gauss(1.0 if i % 2 else 2.5, 0.15)
        rows.append((i, [radius * math.cos(angle), radius * math.sin(angle)], i % 2))
    ring = splits.stratified_split(spark.createDataFrame(rows, "id int, features array<double>, label int"), ["id"]).cache()
    model = models.train_kernel_svm(ring.filter("is_train"))
    some = [(r.features, r.vector) for r in model.with_fourier(ring).limit(12).collect()]
    for x, a in some:
        for y, b in some:
            assert abs(a.dot(b) - math.exp(-model.gamma * sum((p - q) ** 2 for p, q in zip(x, y)))) < 0.2
    assert held_out_auc(models.score_pairs(model, ring, 2)) > 0.95
    assert held_out_auc(models.score_pairs(models.train_svm(ring.filter("is_train")), ring, 2)) < 0.8
    model.save(str(tmp_path / "kernel"))
    again = models.KernelSvm.load(spark, str(tmp_path / "kernel"))
    score = lambda m: sorted((r.id, r.confidence) for r in models.score_pairs(m, ring, 2).select("id", "confidence").collect())
    assert score(again) == score(model)


def test_skip_grams_learn_from_words_cut_in_batches(spark):
    """No column of tokens is cut in the plan that is trained on, and every word of the texts has a vector."""
    docs = spark.createDataFrame([(f"a{i} = b[{i % 3}]; // no word", ) for i in range(12)] + [("",)], "text string")
    plans = []

    class Trainer(models.Word2Vec):
        def fit(self, words):
            plans.append(words._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(words)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(models, "Word2Vec", Trainer)
        vectors = models.train_word2vec(docs, size=4, rounds=1, partitions=2).getVectors().collect()
    assert "MapInArrow" in plans[0] and "regexp" not in plans[0]
    assert {r.word for r in vectors} == {f"a{i}" for i in range(12)} | set("=b[]012;")
    assert all(len(r.vector) == 4 for r in vectors)


def test_word_pairs_by_hand(spark):
    docs = spark.createDataFrame([("a b a c",), ("c b",), ("",), (None,)], "text string")
    counted = Counter()
    for words in (["a", "b", "a", "c"], ["c", "b"]):
        for i in range(len(words)):
            for j in range(i + 1, min(i + 3, len(words))):
                counted[words[i], words[j]] += 1
                counted[words[j], words[i]] += 1
    assert {(r.word, r.context): r.cnt for r in models.word_pairs(docs, 2).collect()} == dict(counted)


def test_word_pairs_are_counted_before_they_move(spark):
    """A task hands on a pair once, in one order, however often it stands there; small holds change no sum."""
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(60))) for _ in range(50)] + ["solo", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    pairs, totals = Counter(), Counter()
    for words in ((t or "").split() for t in texts):
        for i, j in ((i, j) for i in range(len(words)) for j in range(max(0, i - 5), min(i + 6, len(words))) if i != j):
            pairs[words[i], words[j]] += 1
            totals[words[i]] += 1
    once = cutting.near_words(docs, 5).collect()
    assert len(once) == len({frozenset((r.a, r.b)) for r in once}) <= 36
    for held in (1, 5, 1 << 21):
        summed = Counter()
        for r in cutting.near_words(docs, 5, held=held).collect():
            summed[r.a, r.b] += r.n
            summed[r.b, r.a] += r.n
        assert summed == pairs
    found = Counter()
    for r in cutting.near_totals(docs, 5).collect():
        found[r.word] += r.total
    assert found == totals and "solo" not in {r.word for r in cutting.near_totals(docs, 5).collect()}


def test_word_factors_tell_topics_apart(spark):
    draw = random.Random(7)
    topics = [[f"{t}{i}" for i in range(12)] for t in "abc"]
    docs = [(n, " ".join(draw.choice(topics[n % 3]) for _ in range(40))) for n in range(90)]
    vectors = models.train_word_factors(spark.createDataFrame(docs, "doc_id int, text string"), size=6, rounds=5)
    found = {r.word: r.vector.toArray() for r in vectors.collect()}
    assert len(found) == 36
    cosine = lambda x, y: float(x @ y) / ((float(x @ x) * float(y @ y)) ** 0.5 or 1)
    near = [cosine(found[f"{t}0"], found[f"{t}{i}"]) for t in "abc" for i in range(1, 12)]
    far = [cosine(found["a0"], found[f"{t}{i}"]) for t in "bc" for i in range(12)]
    assert sum(near) / len(near) > sum(far) / len(far) + 0.4


def test_rungs_keep_the_best_sets(examples):
    grid = {"maxDepth": [1, 3], "stepSize": [0.1, 0.3]}
    found = models.grid_search_by_rungs(examples.filter("is_train"), ["id"], grid, k=3, rungs=(1, 4), keep=0.5).collect()
    first, last = [r for r in found if r.rung == 0], [r for r in found if r.rung == 1]
    assert (len(first), len(last)) == (4, 2) and {r.rounds for r in last} == {4}
    assert {r.params for r in last} == {r.params for r in sorted(first, key=lambda r: -r.mean_f1)[:2]} or len({r.mean_f1 for r in first}) < 4
    whole = models.grid_search_cv(examples.filter("is_train"), ["id"], grid, k=3, maxIter=1)
    assert sorted(round(x, 9) for x in whole.avgMetrics) == sorted(round(r.mean_f1, 9) for r in first)
