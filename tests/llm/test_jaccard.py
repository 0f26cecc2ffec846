import random

import numpy as np
import pytest

from likeness.llm import jaccard
from likeness.llm.components import components


def sets_of(texts, size=5):
    out = []
    for doc, text in texts:
        words = (text or "").encode().translate(jaccard.LOWER).split()
        runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        out.append((doc, runs))
    return out


def brute(texts, percent=75):
    sets = sets_of(texts)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets))


def chained(seed):
    """Short and long texts whose distances lie around the threshold."""
    rng = random.Random(seed)
    rows, doc = [], 0
    for n in (6, 12, 40, 70, 110, 250, 500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(7):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, n // 18))):
                spot = rng.randrange(len(words))
                words[spot : spot + rng.randrange(2)] = [f"w{rng.randrange(10**6)}"] * rng.randrange(2)
            rows.append((doc, " ".join(words)))
            doc += 1
            base = words if rng.random() < 0.5 else base
    return rows


def test_groups(docs, texts):
    found = jaccard.jaccard_groups(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(texts)


@pytest.mark.parametrize("percent", [75, 90])
def test_around_the_threshold(spark, percent):
    rows = chained(percent)
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, percent)


def test_one_of_each(docs, texts, none):
    kept = jaccard.one_of_each_group(docs)
    assert kept.dtypes == docs.dtypes
    rows = {(r.doc_id, r.text, r.tag, r.n_words) for r in kept.collect()}
    expected = {doc for doc, n, group in brute(texts) if doc == group or not n}
    assert {r[0] for r in rows} == expected and kept.count() == len(expected)
    assert all(tag == "own" and n == doc for doc, _, tag, n in rows)
    assert jaccard.jaccard_groups(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 50), (60, 100), (7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {**{i: 0 for i in range(21)}, 50: 50, 60: 50, 100: 50}
    assert {r.node: r.root for r in found} == expected and len(found) == len(expected)


def test_picked_segments_cover_the_differences():
    owner = np.array([0, 0, 0, 1, 1])
    one, two = np.array([5, 0, 3, 0, 9]), np.array([6, 8, 3, 0, 9])
    worth, need = np.array([2, 2, 1, 1, 1]), np.array([3, 2])
    pick = jaccard.chosen(one, two, worth, owner, need)
    assert np.bincount(owner, pick).tolist() == [3, 2] and (pick <= worth).all()
