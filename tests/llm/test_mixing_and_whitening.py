"""The mix against plain SQL and its own rules; whitening against numpy on whole numbers of any size."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.llm import mixing, whitening


def sainte_lague(votes: list, seats: int) -> list[int]:
    quotas = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * quotas[i] + 1), -i))
        quotas[best] += 1
    return quotas


@pytest.mark.parametrize("votes,seats", [([1e6] + [0.4] * 50, 60), ([3.0, 3.0, 3.0, 0.0], 7), ([5.0], 9), ([1.0] * 30, 11), ([7.5, 1.5, 4.0], 0)])
def test_highest_quotients(spark, votes, seats):
    rows = [(g, i, v, seats) for g in (0, 1) for i, v in enumerate(votes)]
    parties = spark.createDataFrame(rows, "g int, i int, votes double, seats long")
    got = defaultdict(dict)
    for r in mixing.highest_quotients(parties, "g", ["i"]).collect():
        got[r.g][r.i] = r.quota
    want = dict(enumerate(sainte_lague(votes, seats)))
    assert got[0] == want and got[1] == want


def mixed_rows():
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 120))), rng.choice(["é", "b", "b", "b", "", None, "z"])) for i in range(400)]
    rows += [(400, "one " * 9000, "b"), (401, None, "nothing"), (402, "", "nothing"), (403, " \t\n", "b"), (None, "no id", "b"), (None, "no id", "b")]
    return rows + [(500, "same row", "c")] * 5


@pytest.mark.parametrize("block,shard", [(32, 1 << 18), (8, 700), (1, 50)])
def test_mix_equals_sql(spark, block, shard):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS votes", "3 AS shard", "4 AS name")
    got = mixing.mix_sources(docs.repartition(6), block=block, shard_words=shard).toPandas()
    with duckdb.connect() as con:
        con.register("documents", docs.select("doc_id", "text", "source").toArrow())
        want = con.sql(mixing.sql(block=block, shard_words=shard)).df()
    key = lambda table: sorted(table[["doc_id", "size", "source_size", "target", "taken"]].fillna(-1).itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_mix_keeps_its_rules(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, block=8).toPandas()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all() and got["taken"].sum() > 0
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    # Targets by the rule as it reads: what is over is dealt again until no source is full.
    target, full, words = {}, set(), Fraction(3, 2) * sum(sizes.values())
    while True:
        rest = words - sum(2 * sizes[s] for s in full)
        deal = {s: 2 * sizes[s] if s in full else rest * weights[s] / sum(weights[o] for o in order if o not in full) for s in order}
        over = {s for s in order if deal[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for source in order:
        mine = got[got["source"].isna()] if source is None else got[got["source"] == source]
        assert mine["target"].iloc[0] == pytest.approx(float(deal[source]))
        assert mine["source_size"].iloc[0] == sizes[source]
        assert abs(mine["taken"].sum() - float(deal[source])) <= 8
    for row in got.itertuples():
        spans = [(s["start"], s["end"]) for s in row.spans]
        assert all(0 <= a < b <= row.size for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert row.passes * row.size + sum(b - a for a, b in spans) == row.taken


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mix_sources(empty).select("doc_id", "size", "target", "taken").orderBy("doc_id").collect()] == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_mix_query_and_reruns(spark, folder):
    first = mixing.op11_source_mixing(spark, folder).toPandas()
    again = mixing.op11_source_mixing(spark, folder).toPandas()
    assert sorted(first.itertuples(index=False)) == sorted(again.itertuples(index=False))


def lattice(rows):
    usable = [(i, v) for i, v in rows if v is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    widths = [len(v) for _, v in usable]
    width = max(set(widths), key=lambda w: (widths.count(w), w))
    return [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in usable if len(v) == width]


def check(found, rows, components):
    kept = lattice(rows)
    n, x = len(kept), np.array([v for _, v in kept], object)
    sums = x.sum(0)
    centred = n * x - sums
    covariance = np.array([[int((centred[:, i] * centred[:, j]).sum()) / n**3 for j in range(x.shape[1])] for i in range(x.shape[1])])
    values, vectors = np.linalg.eigh(covariance)
    top = min(components, int((values > values[-1] * len(values) * 1e-15).sum()))
    table = sorted((r.vec_id if r.vec_id is not None else -1, r.component, r) for r in found)
    assert len(table) == n * top
    far = sorted((i if i is not None else -1, int((c**2).sum())) for (i, _), c in zip(kept, centred))
    assert [(i, int(r.deviation_exact)) for i, c, r in table if c == 1] == far
    assert all(r.deviation == (int(r.deviation_exact) if r.deviation_exact < 1 << 63 else None) for _, _, r in table)
    z = np.array([r.whitened for _, _, r in table]).reshape(n, top)
    assert np.abs(z.T @ z / n - np.eye(top)).max() < 1e-6 and {r.identity_error < 1e-6 for _, _, r in table} == {True}
    order = sorted(range(n), key=lambda k: kept[k][0] if kept[k][0] is not None else -1)
    plain = (centred[order] / n).astype("f8") @ vectors[:, ::-1][:, :top] / np.sqrt(values[::-1][:top])
    signs = np.sign((plain * z).sum(0))
    assert np.abs(plain * signs - z).max() < 1e-6
    shares = [r.explained for _, _, r in table[:top]]
    assert np.allclose(shares, values[::-1][:top] / np.trace(covariance), rtol=1e-9)
    assert {r.n for _, _, r in table} == {n}


SCHEMA = "vec_id long, embedding array<double>"


def test_whitening_with_gaps_and_wide_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(700, 9)) * np.array([1, 2, 30, 4e2, 5, 6, 7e3, 8, 9]))]
    rows += [(800, None), (801, [1.0, None] + [0.0] * 7), (802, [float("nan")] * 9), (803, [float("inf")] + [0.0] * 8), (804, []), (805, [1.0, 2.0])]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "2 AS n").repartition(5)
    kept = [r for r in rows if r[0] != 805]
    check(whitening.whiten(table, 5).collect(), kept, 5)


def test_whitening_of_few_equal_and_flat_rows(spark):
    rows = [(None, [1.0, 2.0, 7.0]), (4, [3.0, 1.0, 7.0]), (4, [3.0, 1.0, 7.0])]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), [(i, v) for i, v in rows], 32)
    for flat in ([(1, [1.0, 2.0])], [(1, None)], []):
        assert whitening.whiten(spark.createDataFrame(flat, SCHEMA)).count() == 0


def test_bit_slices_add_up():
    rng = np.random.default_rng(4)
    for bits, rows in ((1, 1), (7, 64), (7, 200), (40, 131)):
        u = rng.integers(0, 1 << bits, (rows, 5)).astype("u8")
        both, own = whitening.cross_counts(whitening.planes(u, bits))
        exact = u.astype(object)
        for i in range(5):
            assert sum(int(c) << a for a, c in enumerate(own[i])) == exact[:, i].sum()
            for j in range(i, 5):
                assert sum(int(c) << a for a, c in enumerate(both[i, j])) == (exact[:, i] * exact[:, j]).sum()


def test_whitening_query(spark, folder):
    found = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet")).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()]
    check(found, rows, 32)
