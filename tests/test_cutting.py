from pyspark.sql import functions as F

from likeness.functions.cutting import counted_tokens, cut_words
from likeness.functions.text import word_tokens
from likeness.operators import structure
from likeness.operators.tokens import with_bag, with_token_numbers, with_tokens
from likeness.plans import tables

TEXTS = [
    None,
    "",
    " \t\n ",
    "// only a comment",
    "int[][] a = new String[3]; /* x */ if (a[0] == \"q\\\"r//\") { b++; } // end c",
    "for(int i=0;i<=9;i--)\x0b{ été = \U0001f600\U0001f601'x\\'y'   ... -- Foo[] _z }",
    "/* open \" quote ' here",
    "a\x1cb\x85c　d ((e)) ...f--g@h",
]


def test_batches_cut_like_columns(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    made = {r.doc_id: r for r in counted_tokens(docs, "doc_id", code=structure.CODER).collect()}
    cut = with_bag(with_token_numbers(with_tokens(docs))).withColumn("codes", structure.code_string(F.col("tokens")))
    for row in cut.collect():
        mine = made[row.doc_id]
        assert (mine.num_tokens, mine.num_unique_tokens, mine.bag, mine.codes) == (row.num_tokens, row.num_unique_tokens, row.bag, row.codes), row.text
    words = {r.doc_id: r.bag for r in counted_tokens(docs, "doc_id", words=True).collect()}
    for row in with_bag(docs.select("doc_id", word_tokens(F.col("text")).alias("tokens"))).collect():
        assert words[row.doc_id] == row.bag, row.doc_id


def test_words_are_those_of_the_column_in_their_order(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    wanted = {r.doc_id: r.words for r in docs.select("doc_id", word_tokens(F.col("text")).alias("words")).collect()}
    assert {r.doc_id: r.words for r in cut_words(docs, "doc_id").collect()} == wanted
    assert wanted[0] is None and wanted[1] == []


def test_labelled_pairs_need_no_other_profiles(spark, tmp_path, monkeypatch):
    docs = [(i, f"int a{i} ; b", "en", "s") for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    made = []
    profiles = tables.profiles
    monkeypatch.setattr(tables, "profiles", lambda d: made.append(profiles(d)) or made[-1])
    found = tables.measured_pairs(spark, str(tmp_path), labelled=True).collect()
    assert sorted((r.doc1, r.doc2, r.label) for r in found) == [(0, 1, 1), (0, 2, 0)]
    assert sorted(r.doc_id for r in made[0].collect()) == [0, 1, 2]


def test_calls_in_a_row_are_one_event(spark):
    """Only the last of several empty pairs of parentheses can matter, and it still does."""
    texts = ["if (a) f(x), g(y), h(z); b(c)(d)(e)", "f(x, y), g(x, y) h(x)(y) ) (a)(b) k;", "while (a(b)(c)) { (d)(e) f; }"]
    docs = spark.createDataFrame([(i, f"{{ {t} }}") for i, t in enumerate(texts)], "doc_id long, text string")
    events = structure.structure_events(with_tokens(docs))
    assert events.filter("event = '('").count() == 0
    marks = with_tokens(docs).select(structure.event_string(structure.code_string(F.col("tokens"))).alias("e")).collect()
    assert all("()()" not in r.e for r in marks)
    plain = structure.EVENT_REWRITES[:-1]
    before = structure.EVENT_REWRITES
    short = structure.features_of_codes(counted_tokens(docs, "doc_id", code=structure.CODER)).orderBy("doc_id").collect()
    structure.EVENT_REWRITES = plain
    try:
        long = structure.features_of_codes(counted_tokens(docs, "doc_id", code=structure.CODER)).orderBy("doc_id").collect()
    finally:
        structure.EVENT_REWRITES = before
    assert short == long


def test_first_word_cuts_no_more(spark):
    from likeness.functions.text import first_word

    docs = spark.createDataFrame([(t,) for t in [*TEXTS, "  (a b", "...", "/*x*/ // y\n z w"]], "text string")
    rows = docs.select(first_word(F.col("text")).alias("one"), F.get(word_tokens(F.col("text")), F.lit(0)).alias("all")).collect()
    assert all(r.one == r.all for r in rows)


def test_sketches_rule_out_pairs_before_bags_move(spark):
    from likeness.operators.similar import measured_above
    from likeness.operators.similarity import bags_of

    texts = ["a b c d", "a b c e", " ".join(f"w{i}" for i in range(40)), "x x x x y", "x x x y y", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    facts = bags_of(docs, sketch=True).select("doc_id", "num_tokens", "bag", "sketch")
    sizes = {r.doc_id: (r.num_tokens, sum(r.sketch)) for r in facts.collect()}
    assert all(a == b for a, b in sizes.values())
    met = spark.createDataFrame([(i, j) for i in range(6) for j in range(i + 1, 6)], "doc1 long, doc2 long")
    for percent in (1, 60, 75):
        found, plain = measured_above(met, facts, percent), measured_above(met, facts.drop("sketch"), percent)
        assert sorted(found.collect()) == sorted(plain.collect())
        assert found.columns == plain.columns
        twice = facts.unionByName(facts.filter("doc_id < 2"))
        assert sorted(measured_above(met, twice, percent).collect()) == sorted(measured_above(met, twice.drop("sketch"), percent).collect())
