import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from likeness.operators.structure import doc_features, kind_ngrams, kind_sequence, named_ngrams

GARDEN = """
package plots;
import java.time.LocalDate;
import java.util.*;
class Garden {
  static int litres(int beds) {
    String note = "if (dry) { water; }";
    int each = 4;
    if (beds > each) { System.err.println(note); }
    return each * beds;
  }
}
"""
SHELF = """
class Shelf {
  void arrange(String names) {
    names = trimmed(names);
    for (int i = 0; i < 3; i++) { System.out.println(names); }
    java.util.Arrays.sort(names);
    label(names);
  }
  boolean full() { return false; }
}
"""
BRANCHES = """
package shop.items;
import java.util.*;
class Shop extends Base implements Closeable {
  private int[] stock = {1, 2, 3};
  int[] stock() { return stock; }
  Item[] find(String name, int limit) throws Missing {
    if (limit < max(1, 2)) clear(); else if (name == null) { size = (int) limit / 2; } else reset();
    for (int i = 0; i < f(limit); i++)
      for (int j = 0; j < 3; j++)
        grid[i][j] = in.next();
    try (Reader r = open()) { java.util.X.y(); } catch (Failed e) { throw new Missing(); }
  }
}
"""


def features(spark, text):
    return doc_features(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().asDict()


@pytest.mark.parametrize(
    "text, expected",
    [
        (GARDEN, dict(num_package=1, num_methods=1, num_imports=2, num_if=1, num_return=1, num_systemcall=1,
                      num_variables=2, num_method_calls=0)),
        (SHELF, dict(num_methods=2, num_for=1, num_return=1, num_systemcall=1, num_javacall=1, num_method_calls=1)),
        (BRANCHES, dict(num_package=1, num_imports=1, num_methods=2, num_if=2, num_for=2, num_return=1,
                        num_variables=1, num_method_calls=2, num_javacall=1, num_expressions=3,
                        avg_method_length=2.0, num_var_declarations=0,
                        kinds="PIKVMBRMBQCLQCBELFCFCETCBJBE")),
        ("", dict(num_tokens=0, num_unique_tokens=0, num_statements=0, avg_method_length=0.0, max_depth=0, kinds="")),
        ("// nothing", dict(num_tokens=0, kinds="")),
    ],
)
def test_features_of_snippets(spark, text, expected):
    found = features(spark, text)
    assert {k: found[k] for k in expected} == expected


def test_one_shuffle_by_document(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = doc_features(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("MQFWCBSVE"), max_size=12).map("".join), min_size=1, max_size=20))
def test_ngrams_by_hand(spark, sequences):
    rows = spark.createDataFrame(list(enumerate(sequences)), "doc_id int, kinds string")
    for n in (2, 4):
        found = {(r.doc_id, r.code): r.cnt for r in kind_ngrams(rows, n).collect()}
        wanted = {}
        for i, s in enumerate(sequences):
            for j in range(len(s) - n + 1):
                wanted[i, s[j : j + n]] = wanted.get((i, s[j : j + n]), 0) + 1
        assert found == wanted
    named = {r.doc_id: r for r in named_ngrams(rows).collect()}
    for i, s in enumerate(sequences):
        assert named[i].expression_expression == sum(s[j : j + 2] == "EE" for j in range(len(s)))
        assert named[i].if_cond_block_vardec == s.count("QCBV")


def test_ngram_names(spark):
    docs = spark.createDataFrame([(1, GARDEN)], "doc_id int, text string")
    grams = {r.gram for r in kind_ngrams(kind_sequence(docs), 2).collect()}
    assert {"ImportDeclaration_ClassDeclaration", "MethodDeclaration_BlockStatement"} <= grams
