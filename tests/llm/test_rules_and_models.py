"""Quality rules, perplexity, decontamination."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from likeness.llm import decontamination, kneser_ney, quality_rules


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_counts(spark, docs, texts):
    more = texts + [(200, "a b\na b\n\n a b\r\n## $x|<>&%*\n" * 3), (201, "x y z\n\nx y z")]
    rows = spark.createDataFrame([(i, t, "en") for i, t in more], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    found = quality_rules.judged(rows, labels).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == sorted((i, *base_counts(t)) for i, t in more)
    # One label refutes nothing, so only the base rules reject.
    assert all(r.kept != r.base_failed for r in found)


def test_cutoffs_spare_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    bad = " ".join(f"w{i}#" for i in range(60))
    rows = [(i, good if i < 2000 else bad, "en") for i in range(2100)] + [(5000, bad, "xx"), (5001, bad, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 2000)) for i in range(2050)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs, labels).collect()}
    assert all(kept[i] for i in range(2000)) and not any(kept[i] for i in range(2000, 2100))
    assert kept[5000] and kept[5001]
    left = quality_rules.kept_documents(docs.withColumn("n_words", F.lit("own")), labels)
    assert left.columns == ["doc_id", "text", "lang", "n_words"] and left.filter("n_words = 'own'").count() == 2002


def test_binomial_tail(spark):
    row = spark.sql("SELECT 20L AS n, 1L AS k, 0.2D AS p").select(quality_rules._refuted("n", "k", "p")).first()
    assert row[0] == pytest.approx(0.8**20 + 20 * 0.2 * 0.8**19)


def test_kneser_ney_sums_to_one(spark):
    """Over all bytes, the probabilities after a context sum up to 1."""
    seen = [b"abab", b"abac", b"baba", b"cabc", b"abcb"]
    asked = {int.from_bytes(b"aba" + bytes([x]), "big"): 0 for x in range(256)}
    for i, gram in enumerate(seen):
        asked[int.from_bytes(gram, "big")] = i % 3 + 1
    table = spark.createDataFrame([(1, g, n) for g, n in asked.items()], "pack long, gram long, n long")
    logs = {r.gram: r.log2p for r in kneser_ney.log_probabilities(table).collect()}
    total = sum(2**p for g, p in logs.items() if g >> 8 == int.from_bytes(b"aba", "big"))
    assert total == pytest.approx(1, abs=1e-6)
    assert logs[int.from_bytes(b"abac", "big")] > logs[int.from_bytes(b"abaz", "big")]


def test_perplexity(spark, docs, texts, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    junk = spark.createDataFrame([(500, "XQ@@#9 ZZ!!" * 40, None, "s", 1, 1, "own")], docs.schema)
    found = kneser_ney.classify(docs.unionByName(junk), labels).collect()
    assert len(found) == len(texts) + 1
    score = {r.doc_id: r.perplexity for r in found}
    assert score[500] > 3 * max(score[i] for i in range(30))
    assert not {r.doc_id: r.kept for r in found}[500]
    assert {r.doc_id: r.kept for r in found}[90] and {r.doc_id: r.kept for r in found}[91]
    assert kneser_ney.classify(none, labels).count() == 0


QUESTION = "If a train with 12 cars leaves the city of Lyon at noon and each car weighs 40 kg, how many cars does the train have left after Anna takes 5 of them away"


def test_leaks(spark):
    other = QUESTION.replace("12", "17").replace("Lyon", "Bonn").replace("40 kg", "90 kg").replace("Anna", "Peter").replace(" 5 ", " 3 ")
    mixed = QUESTION.replace("each car weighs 40 kg", "every wagon costs a lot of money")
    rows = [(1, "Before that. " + QUESTION + " and more."), (2, "Some text here. " + other), (3, mixed[:40]), (4, None), (5, ""), (6, "Nothing of the kind is said in this text about trains or cars at all today")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + [rows[0]]], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, QUESTION), (7, QUESTION), (8, None), (9, "too short")], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.find_leaks(docs, items).collect()}
    assert set(found) == {1, 2} and found[1].item_id == 7
    assert found[1].verbatim and not found[2].verbatim
    left = decontamination.without_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    assert decontamination.find_leaks(docs.limit(0), items).count() == 0
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    """The same value of the question must have one counterpart."""
    item = "We know that 7 of the boxes are red and again 7 of the boxes are blue while the rest stay empty forever"
    one = item.replace("7", "9")
    two = "We know that 9 of the boxes are red and again 8 of the boxes are blue while the rest stay empty forever"
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontamination.find_leaks(docs, items).collect()] == [1]


PENS = "Alice bought 12 pens for 30 dollars, Bob bought 8 pens for 25 dollars, Cora bought 5 pens for 10 dollars."
UNITS = "Convert 5 km and 3 kg and 7 cm and 9 ml and 4 hours and 6 miles."
LIST = "12 km 5 kg 7 cm 8 g 3 ml 9 oz"


def test_items_dense_in_slots_and_short_ones(spark):
    """Items with few literal tokens are found, also with other values, but not where these contradict each other."""
    items = {1: PENS, 2: UNITS, 3: "What is 12 times 7?", 4: LIST, 5: "Photosynthesis", 6: QUESTION, 7: "?!", 8: ""}
    docs = {
        10 + i: "Some words come first. " + text + " More of them follow." for i, text in items.items()
    } | {
        30: PENS.replace("12", "17").replace("Bob", "Dora").replace("25", "90"),
        31: UNITS.replace("5 km", "8 cm").replace("7 cm", "2 ml").replace("9 ml", "1 kg"),
        32: "They ask: What is 3 times 4?",
        33: LIST.replace("7", "6"),
        34: "They ask: What is 3 plus 4?",
        35: "Convert 5 of them and 3 kg or 7 cm and 9.",
    }
    item = "Add 7 km, then 7 kg, then 7 cm, then 7 ml, then 7 miles."
    table = spark.createDataFrame([*docs.items(), (40, item.replace("7", "4")), (41, item.replace("7", "4", 2))], "doc_id long, text string")
    known = spark.createDataFrame([*items.items(), (20, item)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(table, known).collect()}
    assert set(found) == {(10 + i, i) for i in range(1, 7)} | {(30, 1), (31, 2), (32, 3), (40, 20)}
    assert all(found[10 + i, i].verbatim and found[10 + i, i].share == 1 for i in range(1, 7))
    assert not any(found[k].verbatim for k in [(30, 1), (32, 3), (40, 20)])


def test_each_benchmark_item_is_found_in_itself(spark, folder):
    stored_items = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").cast("long"), "text")
    more = spark.createDataFrame([(-1, PENS), (-2, UNITS), (-3, "What is 12 times 7?"), (-4, LIST)], "item_id long, text string")
    items = stored_items.unionByName(more)
    found = decontamination.find_leaks(items.withColumnRenamed("item_id", "doc_id"), items).filter("doc_id = item_id")
    got = {r.item_id: (r.share, r.verbatim) for r in found.collect()}
    assert got == {r.item_id: (1.0, True) for r in items.collect()}
