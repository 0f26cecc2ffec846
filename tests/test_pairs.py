import hashlib
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from likeness.operators import blocks, candidates, pairs, similar, similarity, splits
from likeness.operators.ranking import hash_rank
from likeness.operators.tokens import with_tokens


@pytest.fixture(scope="module")
def corpus(spark):
    """Three cases, one of them with most of the documents."""
    rows = []
    for i in range(120):
        case = "big" if i % 5 else ("left" if i % 2 else "right")
        role = "original" if i in (0, 1, 5) else ("plagiarized" if i % 3 else "non-plagiarized")
        label = None if role == "original" else int(role == "plagiarized")
        rows.append((i, case, role, label))
    return spark.createDataFrame(rows, "doc_id int, case_id string, role string, label int").cache()


def test_case_pairs(corpus):
    rows = corpus.collect()
    wanted = {
        (a.doc_id, b.doc_id) for a in rows for b in rows
        if a.case_id == b.case_id and a.role == "original" != b.role
    }
    found = pairs.case_pairs(corpus).collect()
    assert {(r.doc1, r.doc2) for r in found} == wanted and len(found) == len(wanted)
    positive = pairs.positive_pairs(corpus).collect()
    labels = {r.doc_id: r.label for r in rows}
    assert {(r.doc1, r.doc2) for r in positive} == {p for p in wanted if labels[p[1]] == 1}


@pytest.mark.parametrize("k, rings", [(5, 64), (5, 1), (3, 4), (200, 2)])
def test_negative_pairs_are_k_of_other_cases(corpus, k, rings):
    rows = corpus.collect()
    case = {r.doc_id: r.case_id for r in rows}
    role = {r.doc_id: r.role for r in rows}
    found = pairs.negative_pairs(corpus, k, rings).collect()
    for original in (r for r in rows if r.role == "original"):
        drawn = [r.doc2 for r in found if r.doc1 == original.doc_id]
        others = [d for d in case if role[d] == "non-plagiarized" and case[d] != original.case_id]
        assert len(drawn) == len(set(drawn)) == min(k, len(others))
        assert set(drawn) <= set(others)


def test_training_pairs_come_in_hash_order(spark, corpus):
    found = pairs.training_pairs(corpus.repartition(5)).collect()
    turns = [hashlib.md5(f"42|{r.doc1}|{r.doc2}".encode()).hexdigest() for r in found]
    assert [r.turn for r in found] == turns == sorted(turns) and {r.label for r in found[:10]} == {0, 1}


def test_any_candidate_can_be_drawn(spark):
    """Different negatives grow with the corpus, also beside a case that has most of the candidates."""
    rows = [(i, f"c{i}", "original") for i in range(600)]
    rows += [(1000 + i, f"c{i % 600 if i % 2 else 0}", "non-plagiarized") for i in range(3000)]
    corpus = spark.createDataFrame(rows, "doc_id long, case_id string, role string").withColumn("label", F.lit(None).cast("int"))
    case = {i: c for i, c, _ in rows}
    found = [(r.doc1, r.doc2) for r in pairs.negative_pairs(corpus).collect()]
    assert len(found) == len(set(found)) == 3000 and set(Counter(a for a, _ in found).values()) == {5}
    assert all(case[a] != case[b] for a, b in found)
    # 3000 draws of 3000 candidates meet about 1 - 1/e of them.
    assert 1700 < len({b for _, b in found}) < 2100


def test_hash_rank_is_the_order_of_the_keys(spark):
    rows = spark.range(1000).withColumn("label", F.when(F.col("id") % 10 == 0, 1).otherwise(0))
    ranked = hash_rank(rows, ["id"], ["label"], digits=1).collect()
    for label, size in ((0, 900), (1, 100)):
        assert sorted(r["rank"] for r in ranked if r.label == label) == list(range(1, size + 1))
        assert {r.group_size for r in ranked if r.label == label} == {size}


def test_splits_have_exact_sizes(spark):
    rows = spark.range(101).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    assert splits.random_split(rows, ["id"]).filter("is_train").count() == 80
    assert splits.validation_split(rows, ["id"]).filter("is_validation").count() == 21
    by_label = splits.stratified_split(rows, ["id"]).filter("is_train").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in by_label} == {0: 60, 1: 20}
    sizes = Counter(r.fold for r in splits.folds(rows, ["id"], 5).collect())
    assert sorted(sizes.values()) == [20, 20, 20, 20, 21]


def bag_jaccard(a, b):
    shared = sum((a & b).values())
    return shared, sum(a.values()) + sum(b.values()) - shared


def batches(seed):
    draw = random.Random(seed)
    docs = []
    for batch in range(4):
        base = [draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 30))]
        for _ in range(25):
            words = list(base)
            for _ in range(draw.randint(0, 8)):
                words[draw.randrange(len(words))] = draw.choice("abcdefghijklmnopqrstuvwxyz")
            docs.append((batch, len(docs), " ".join(words if draw.random() < 0.9 else [])))
    return docs


@pytest.mark.parametrize("seed, percent", [(1, 50), (2, 80), (3, 20), (4, 100)])
def test_similar_pairs_against_all_pairs(spark, seed, percent):
    docs = batches(seed)
    frame = spark.createDataFrame(docs, "batch_id int, doc_id int, text string")
    bags = {(b, d): Counter(t.split()) for b, d, t in docs}
    groups = {}
    for (b, d), bag in sorted(bags.items()):
        groups.setdefault((b, frozenset(bag.items())), []).append(d)
    firsts = {(b, ds[0]): len(ds) for (b, _), ds in groups.items()}
    wanted = {(b, ds[0], d) for (b, _), ds in groups.items() for d in ds[1:]}
    for b, x in firsts:
        for c, y in firsts:
            if b == c and x < y:
                shared, union = bag_jaccard(bags[b, x], bags[b, y])
                if union and shared * 100 >= percent * union and shared:
                    wanted.add((b, x, y))
    found = similar.similar_pairs(similarity.bags_of(frame, "batch_id"), percent).collect()
    assert {(r.batch_id, r.doc1, r.doc2) for r in found} == wanted
    assert len(found) == len(wanted)
    for r in found:
        assert r.token_overlap == bag_jaccard(bags[r.batch_id, r.doc1], bags[r.batch_id, r.doc2])[0]


def test_heavy_tokens_are_cut_into_blocks(spark):
    """A token that all files of a batch have meets in many keys, and no pair is lost or doubled."""
    texts = [(0, i, f"same only{i // 2} a{i}") for i in range(90)]
    bags = similarity.bags_of(spark.createDataFrame(texts, "batch_id int, doc_id int, text string"), "batch_id")
    groups = similar.copy_groups(similar.with_bag_key(bags))
    plain = sorted(map(tuple, similar.candidate_groups(groups, 20).collect()))
    cut = sorted(map(tuple, similar.candidate_groups(groups, 20, block=7).collect()))
    assert cut == plain and len(plain) == 90 * 89 // 2
    rows = similar.rarest_tokens(groups, 20, block=7).withColumn("blocks", F.ceil(F.col("docs") / 7))
    assert rows.filter("docs = 90").first()["blocks"] == 13


def test_candidates_are_all_pairs_with_their_overlap(spark, monkeypatch):
    """Copies in a star; of the others each pair at the threshold, also within one bucket."""
    rng = random.Random(6)
    text = [f"w{rng.randrange(400)}" for _ in range(150)]
    docs = [(i, " ".join(text)) for i in range(40)] + [(100 + i, " ".join(text[: 140 + i])) for i in range(9)]
    docs += [(200 + i, f"other words {i} {i * 7} {i * 13}") for i in range(20)] + [(299, None), (300, ""), (301, ""), (302, "x y"), (303, "x y")]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    found = {(r.doc1, r.doc2): r for r in candidates.candidate_pairs(frame).collect()}
    ends = [0, *range(100, 109)]
    wanted = {(0, i) for i in range(1, 40)} | {(a, b) for a in ends for b in ends if a < b} | {(300, 301), (302, 303)}
    assert set(found) == wanted
    assert found[100, 108].token_overlap == 140 and found[0, 3].is_copy and not found[0, 100].is_copy
    monkeypatch.setattr(candidates, "SMALL_BUCKET", 1)
    assert {(r.doc1, r.doc2): r for r in candidates.candidate_pairs(frame).collect()} == found


def test_every_pair_of_copies_and_near_copies_is_listed(spark):
    """Copies are linked to their first document only; listed are each two of them, and each with the near copies of the others."""
    rng = random.Random(6)
    text = [f"w{rng.randrange(400)}" for _ in range(150)]
    docs = [(i, " ".join(text)) for i in range(0, 60, 3)] + [(i, " ".join(text[:145])) for i in range(1, 20, 6)] + [(200, "x y"), (201, "x y"), (202, "alone")]
    found = candidates.candidate_pairs(spark.createDataFrame(docs + docs[:2], "doc_id int, text string"))
    near = [i for i, _ in docs if i < 200]
    listed = sorted(map(tuple, candidates.listed_pairs(found).distinct().collect()))
    assert listed == sorted([(a, b) for a in near for b in near if a < b] + [(200, 201)])


def test_candidates_recall_pairs_of_the_exact_join(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    near = [(i, t.text) for i, t in enumerate(docs.limit(60).collect())]
    rng = random.Random(9)
    for i, text in list(near):
        words = text.split(" ")
        for k in range(3):
            near.append((1000 + 10 * i + k, " ".join(w if rng.random() > 0.08 else f"new{rng.randrange(99)}" for w in words)))
    frame = spark.createDataFrame(near, "doc_id long, text string")
    exact = similar.similar_pairs(similarity.bags_of(frame.withColumn("batch_id", F.lit(0)), "batch_id"), 75)
    wanted = {(r.doc1, r.doc2) for r in exact.collect()}
    found = {(r.doc1, r.doc2) for r in candidates.candidate_pairs(frame).collect()}
    assert found <= wanted and len(found) >= 0.9 * len(wanted) > 50


def test_arriving_documents_meet_the_index(spark, tmp_path):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(12)]
    docs = []
    for i in range(120):
        words = list(base[i % 12])
        for _ in range(rng.randrange(6)):
            words[rng.randrange(120)] = f"x{rng.randrange(50)}"
        docs.append((i, " ".join(words)))
    docs += [(200 + i, docs[i][1]) for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = candidates.candidate_pairs(frame).collect()
    index = candidates.CorpusIndex(spark, str(tmp_path))
    parts = [frame.filter("doc_id < 50"), frame.filter("doc_id BETWEEN 50 AND 99"), frame.filter("doc_id >= 100")]
    added = [index.add(part, str(number)).collect() for number, part in enumerate(parts)]
    again = index.add(parts[2], "2").collect()
    key = lambda rows: sorted(map(tuple, rows))
    assert key(r for rows in added for r in rows) == key(whole) and key(again) == key(added[2])
    assert any(r.is_copy for r in added[2]) and len(whole) > 300


def test_overlap_is_symmetric_and_bounded(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").filter("n_chars < 3000")
    bags = similarity.bags_of(docs)
    star = docs.select(F.lit(0).cast("bigint").alias("doc1"), F.col("doc_id").alias("doc2"))
    back = star.select(F.col("doc2").alias("doc1"), F.col("doc1").alias("doc2"))
    there = {r.doc2: r for r in similarity.token_overlap(star, bags, bags).collect()}
    other = {r.doc1: r.token_overlap for r in similarity.token_overlap(back, bags, bags).collect()}
    assert other == {d: r.token_overlap for d, r in there.items()}
    assert all(r.token_overlap <= min(r.num_tokens1, r.num_tokens2) for r in there.values())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_sequence_measures(spark):
    rng = random.Random(12)
    plain = [("", ""), ("AB", ""), ("ABC", "ABC"), ("ABC", "AXC")]
    for n in (5, 40, 300):
        for changes in (0, 1, 9, 60, 400):
            one = [rng.choice("PIMVE+é") for _ in range(n)]
            two = list(one)
            for _ in range(changes):
                at = rng.randrange(len(two) + 1)
                two[at : at + rng.randrange(2)] = rng.choice(["", "V", "E", "X"])
            plain.append(("".join(one), "".join(two)))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(plain)], "i int, kinds1 string, kinds2 string")
    measured = similarity.with_sequence_distance(rows)
    s = similarity.sequence_similarity(F.col("distance"), F.col("kinds1"), F.col("kinds2"))
    found = measured.select("i", "distance", s.alias("s"), similarity.least_distance(F.col("kinds1"), F.col("kinds2")).alias("low")).orderBy("i").collect()
    assert [r.distance for r in found] == [edit_distance(a, b) for a, b in plain]
    assert all(0 <= r.low <= r.distance for r in found)
    assert [round(r.s, 6) for r in found[:4]] == [1.0, 0.0, 1.0, 0.666667]


def test_distance_of_long_sequences(spark):
    """Near copies of 20,000 statements: only a band of the table is filled."""
    rng = random.Random(13)
    one = [rng.choice("PIMVEL") for _ in range(20_000)]
    two = one[:7000] + list("VVVV") + one[7000:15_000] + one[15_009:]
    rows = spark.createDataFrame([("".join(one), "".join(two)), ("".join(one), "".join(one))], "kinds1 string, kinds2 string")
    assert sorted(r.distance for r in similarity.with_sequence_distance(rows).collect()) == [0, 13]


def test_pairs_of_one_large_case_are_dealt(spark):
    """All pairs have the same original: without broadcasts they are still measured in several tasks, from one reading of the texts."""
    docs = spark.createDataFrame([(i, f"int a = {i} ; f ( {i % 7} ) ;") for i in range(400)], "doc_id long, text string")
    wanted = docs.select(F.lit(0).cast("long").alias("doc1"), F.col("doc_id").alias("doc2")).filter("doc2 > 0")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        profiled = similarity.profiles(docs)
        pairs_with_originals = similarity.attach_firsts(wanted, profiled)
        rows = pairs_with_originals.groupBy(F.spark_partition_id()).count().collect()
        plan = similarity.pair_vector(similarity.measure_pairs(wanted, profiled, profiled))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(rows) >= 4 and max(r["count"] for r in rows) < 200
    assert "regexp_extract_all" not in plan


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 3.0])], "a array<double>, b array<double>")
    found = [r[0] for r in rows.select(similarity.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert found == [1.0, 0.0, 0.0]


def test_one_pair_needs_both_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    assert [tuple(r) for r in pairs.one_pair(docs, 2, 1).collect()] == [(2, 1)]
    assert pairs.one_pair(docs, 1, 3).count() == 0


@pytest.mark.parametrize("percent", [20, 60, 100])
def test_blocks_find_all_pairs_and_move_bags_by_block(spark, percent):
    """Small blocks of one class or two: every pair as by hand, each bag in as many cells as blocks are near, however many pairs it has."""
    rng = random.Random(percent)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(9)}" for _ in range(rng.choice([1, 2, 5, 9, 10, 25]))]
        rows.append((i % 2, i, " ".join(words) if i % 10 else ""))
    rows += [(1, 500, "x " * 70_000 + "y z"), (1, 501, "x " * 69_990 + "z"), (None, 502, "w1 w2"), (None, 503, "w1 w2 w1"), (0, 504, None)]
    bags = similarity.bags_of(spark.createDataFrame(rows, "batch_id int, doc_id int, text string"), "batch_id")
    keyed = blocks.with_code(similar.with_bag_key(bags))
    groups = similar.copy_groups(keyed, keep=("entries", "code"))
    counted = {(r.batch_id, r.doc_id): Counter({e.token: e.cnt for e in r.bag}) for r in bags.filter("num_tokens > 0 AND batch_id IS NOT NULL").collect()}
    first = {}
    for key in sorted(counted):
        first.setdefault((key[0], frozenset(counted[key].items())), key)
    wanted = {}
    for one, two in itertools.combinations(sorted(first.values()), 2):
        shared, both = (counted[one] & counted[two]).total(), counted[one].total() + counted[two].total()
        if one[0] == two[0] and shared * (100 + percent) >= both * percent:
            wanted[(one[0], one[1], two[1])] = (counted[one].total(), counted[two].total(), shared)
    for bags_of_block, entries in ((1 << 13, 1 << 21), (7, 1 << 21), (1 << 13, 60)):
        found = blocks.pairs_in_blocks(groups, percent, bags=bags_of_block, entries=entries).collect()
        assert {(r.batch_id, r.doc1, r.doc2): (r.num_tokens1, r.num_tokens2, r.token_overlap) for r in found} == wanted and len(found) == len(wanted)
    assert percent == 100 or len(wanted) > 30
    plan = similar.similar_pairs(bags, percent)._jdf.queryExecution().optimizedPlan().toString()
    assert "bag1" not in plan and "bag2" not in plan


def test_files_without_an_id_keep_their_rows(spark):
    rows = [(1, 1, "a b c d e"), (1, None, "a b c d f"), (1, 2, "a b c d e g"), (2, 3, "x y z")]
    bags = similarity.bags_of(spark.createDataFrame(rows, "batch_id int, doc_id int, text string"), "batch_id")
    found = sorted((r.doc1, r.doc2, r.num_tokens1, r.num_tokens2, r.token_overlap) for r in similar.similar_pairs(bags, 50).collect())
    assert found == [(1, 1, 5, 5, 5), (1, 2, 5, 6, 5), (2, 2, 6, 6, 6)]
