"""Common sections against a comparison of all tokens with all."""

import random
import re

import pytest

from likeness.operators import sections


def runs_of(a, b, n):
    found = []
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                if k >= n:
                    found.append((i, j, k))
    return sorted(found)


def tiles_of(runs, n):
    """Longest first; of each run the stretches of ``n`` places or more that are free on both sides."""
    left, right, tiles = set(), set(), []
    for i, j, k in sorted(runs, key=lambda r: (-r[2], r[0], r[1])):
        free = [i + x not in left and j + x not in right for x in range(k)] + [False]
        start, new = None, []
        for x, is_free in enumerate(free):
            if is_free and start is None:
                start = x
            elif not is_free and start is not None:
                new += [(i + start, j + start, x - start)] if x - start >= n else []
                start = None
        for a, b, c in new:
            left.update(range(a, a + c))
            right.update(range(b, b + c))
        tiles += new
    return sorted(tiles)


def texts():
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)]
    base = words(90)
    docs = [base, base[:40] + base[31:], base[20:60] + words(30) + base[:25], words(60), ["tick", "tock"] * 40, ["tick", "tock"] * 25 + ["end"]]
    docs += [["a"] * 70, ["a"] * 33 + ["b"] + ["a"] * 20, base[:5], [], [rng.choice("ab") for _ in range(80)], [rng.choice("ab") for _ in range(80)]]
    docs += [base * 2, base[60:] + base[:30]]
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("n", [1, 3, 12])
def test_sections_match_brute_force(spark, n):
    rows = list(enumerate(texts())) + [(50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pairs = [(a, b) for a in range(len(rows) - 1) for b in range(a + 1, len(rows) - 1)] + [(0, 50), (3, 999), (0, 1), (2, 2)]
    got = {}
    for r in sections.overlap_snippets(spark.createDataFrame(pairs, "doc1 long, doc2 long"), docs, n).collect():
        got.setdefault((r.doc1, r.doc2), []).append((r.start1, r.start2, r.end1 - r.start1))
        assert r.end2 - r.start2 == r.end1 - r.start1
        assert r.text1 == r.text2 == " ".join(rows[r.doc1][1].split()[r.start1 : r.end1])
    want = {}
    for a, b in set(pairs):
        if a < 50 and b < 50:
            one, two = rows[a][1].split(), rows[b][1].split()
            found = tiles_of(runs_of(one, two, n), n)
            want |= {(a, b): found} if found else {}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_texts_keep_their_layout_and_lose_comments(spark):
    one = 'int  a = "x y";\n// note\nfor (i\t=0; i<9; i++) { sum += i; }  // end'
    two = 'long b;\nint a = /* why */ "x y"; for (i=0; i<9; i++) {\n sum += i; } done();'
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    (row,) = sections.overlap_snippets(spark.createDataFrame([(1, 2)], "doc1 long, doc2 long"), docs, 5).collect()
    assert row.text1.startswith('int  a = "x y";') and row.text1.endswith("}") and "note" not in row.text1
    assert row.text2.startswith('int a =  "x y"; for (i=0;') and (row.start1, row.start2) == (0, 3)
    assert re.sub(r"\s+", "", row.text1) == re.sub(r"\s+", "", row.text2)


def test_a_run_is_met_at_its_ends_only(spark):
    """Text that repeats itself makes as many rows as there are diagonals, not as many as there are meetings."""
    docs = spark.createDataFrame([(1, "tick tock " * 300), (2, "tick tock " * 200)], "doc_id long, text string")
    streams = docs.selectExpr("doc_id", "split(trim(text), ' ') AS tokens")
    runs = sections.common_runs(spark.createDataFrame([(1, 2)], "doc1 long, doc2 long"), streams, 12)
    assert 400 < runs.count() < 520


def test_snippets_of_every_copy(spark, tmp_path):
    """The query has sections of copies with each other and of each copy with near copies, not of the first one only."""
    from likeness.plans.queries import QUERIES

    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    turned = words[60:] + words[:60]
    texts = [" ".join(words), " ".join(words[:115]), " ".join(words), " ".join(words[:115]), " ".join(turned), "few words", "few words"]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in QUERIES["overlap_snippets"](spark, str(tmp_path)).collect():
        found.setdefault((r.doc1, r.doc2), []).append((r.start1, r.start2, r.end1 - r.start1))
    cut = [t.split() for t in texts]
    assert {k: sorted(v) for k, v in found.items()} == {(a, b): tiles_of(runs_of(cut[a], cut[b], 12), 12) for a in range(5) for b in range(a + 1, 5)}


def test_ids_that_come_twice_come_twice(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "x a b c d")], "doc_id long, text string")
    found = sections.overlap_snippets(spark.createDataFrame([(1, 2)], "doc1 long, doc2 long"), docs, 3).collect()
    assert [(r.section, r.start1, r.end1, r.start2, r.end2) for r in found] == [(1, 0, 4, 1, 5)] * 2
