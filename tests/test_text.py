import pytest
from pyspark.sql import functions as F

from likeness.functions.text import normalize_code, strip_comments, tokenize, word_tokens
from likeness.operators import tokens
from likeness.operators.tokens import token_counts, token_positions, with_token_numbers, with_tokens


def tokens_of(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(tokenize(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        ("// only\n/* comments */", []),
        ("3.14159", ["3", ".", "14159"]),
        ("String[] a; int[][] b", ["String[]", "a", ";", "int[][]", "b"]),
        ("a&&b+=1", ["a", "&", "&", "b", "+", "=", "1"]),
        ("i++ <= --j != k == l >= m", ["i", "++", "<=", "--", "j", "!=", "k", "==", "l", ">=", "m"]),
        ('x = "a \\" b";', ["x", "=", '"a \\" b"', ";"]),
        ("c = '\\'';", ["c", "=", "'\\''", ";"]),
        ('lone " quote', ["lone", '"', "quote"]),
        ("List<T> x", ["List", "<", "T", ">", "x"]),
        ("été", ["é", "t", "é"]),
        ("a b﻿", ["a", "b"]),
    ],
)
def test_tokens(spark, text, expected):
    assert tokens_of(spark, text) == expected


def test_long_literals_are_one_token(spark):
    literal = '"' + "ab\\n" * 100_000 + '"'
    assert tokens_of(spark, f"x = {literal};") == ["x", "=", literal, ";"]
    assert len(tokens_of(spark, '"' + "ab " * 1000)) == 1001


def cleaned(spark, text):
    row = spark.createDataFrame([(text,)], "text string")
    return row.select(strip_comments(F.col("text")), normalize_code(F.col("text"))).first()


def test_comments_in_strings_are_dropped_too(spark):
    assert cleaned(spark, 'u = "http://x";\nv')[0] == 'u = "http:\nv'


def test_the_two_cleanings_differ_inside_block_comments(spark):
    text = "a /* see // here */ b\nc"
    one_pass, lines_first = cleaned(spark, text)
    assert one_pass == "a  b\nc"
    assert lines_first == "a /* see c"


def test_normalised_whitespace(spark):
    assert cleaned(spark, "  a \t\n b  c ")[1] == "a b c"


def test_word_tokens(spark):
    row = spark.createDataFrame([("foo.bar(x, 1);",)], "t string").select(word_tokens(F.col("t"))).first()
    assert row[0] == ["foo.bar", "(", "x", ",", "1", ")", ";"]


def test_counts_and_positions(spark):
    docs = with_tokens(spark.createDataFrame([(1, "b a b a b"), (2, ""), (3, "x")], "doc_id int, text string"))
    counts = {(r.doc_id, r.token): r.cnt for r in token_counts(docs).collect()}
    assert counts == {(1, "a"): 2, (1, "b"): 3, (3, "x"): 1}
    places = [(r.pos, r.token) for r in token_positions(docs).filter("doc_id = 1").orderBy("pos").collect()]
    assert places == list(enumerate("babab"))
    numbers = {r.doc_id: (r.num_tokens, r.num_unique_tokens) for r in with_token_numbers(docs).collect()}
    assert numbers == {1: (5, 2), 2: (0, 0), 3: (1, 1)}


def test_token_counts_do_not_shuffle(spark, folder):
    docs = with_tokens(spark.read.parquet(f"{folder}/documents.parquet"))
    assert "Exchange" not in token_counts(docs)._jdf.queryExecution().executedPlan().toString()


def test_sketches_merge_like_sets(spark):
    docs = spark.createDataFrame([(g, p, [f"t{(g * 3000 + p * 700 + i) % 20000}" for i in range(2000)]) for g in range(3) for p in range(5)], "g int, p int, tokens array<string>")
    merged = tokens.approximate_numbers(tokens.merged_sketches(tokens.token_sketches(docs, ["g", "p"]), ["g"]))
    exact = {r.g: r.n for r in docs.selectExpr("g", "explode(tokens) AS t").groupBy("g").agg(F.countDistinct("t").alias("n")).collect()}
    for r in merged.collect():
        assert abs(r.num_unique_tokens - exact[r.g]) <= 4 * 1.04 / 128 * exact[r.g]
    assert all(len(r.sketch) < 1 << 15 for r in merged.collect())
