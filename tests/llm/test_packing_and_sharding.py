"""Packing, sharding, URLs, licenses, and all registered queries and the pipeline on stored tables."""

import re
import zlib

import numpy as np
import pytest
from compare import connect, differences

from likeness.llm import licenses, packing, queries, sharding, urls

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def test_packing(docs, texts, none):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in texts]
    found = packing.pack_sequences(docs, PATH, length=256).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    assert sum(r.length for r in found) == sum(len(ids[i]) for i, _ in rows)
    for r in found:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(own) and bytes(r.ids) == own and r.doc_tokens == len(ids[r.doc_id])
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in found) > 0.9 * 256 * (len(held) - 1)
    assert packing.pack_sequences(none, PATH).count() == 0


def test_words_apart_are_tokens_apart():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    text = "It's A test, isn't it?! Über-ÉTÉ 3.14, don't; á x. y ... end.\n<|endoftext|> »q«, ok."
    run, _ = packing._pieces(PATH, 4096, True)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    row = next(iter(run(iter([batch])))).to_pylist()[0]
    assert np.frombuffer(row["ids"], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_least_squares():
    histogram = np.zeros(32, "i8")
    histogram[[31, 20, 10, 15]] = [5, 40, 40, 60]
    plan = packing.repeat_counts(histogram)
    used = np.zeros(32, "i8")
    for column, count in plan:
        assert sum(column) <= 32
        for cell in column:
            used[cell - 1] += count
    assert (used == histogram).all() and sum(c for _, c in plan) == 5 + 40 + 30


def test_sharding(docs, texts, none):
    found = sharding.shard_documents(docs, shards=4, slots=64).collect()
    facts = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found) == facts
    for shard in range(4):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    assert len({r.shard for r in found if 80 <= r.doc_id <= 82}) == 1
    assert sharding.shard_documents(none).count() == 0


def test_edits_even_out():
    sizes = [(i * 7919) % 1000 + 1 for i in range(512)]
    before = sharding.first_map(512, 16)
    after = sharding.rebalanced(before, sizes, 16)
    loads = [sum(s for s, h in zip(sizes, after) if h == k) for k in range(16)]
    assert max(loads) - min(loads) <= 10  # of 16,000
    assert sum(a != b for a, b in zip(before, after)) < 256
    assert sharding.rebalanced(after, sizes, 16) == after


def test_urls(spark):
    rows = [
        (1, "https://WWW.Example.com/en/a", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        (2, "http://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
        (3, "ftp://x.com", "x.com", "", None, "allow"),
        (4, "http://x.com/q?y#z", "x.com", "/q", "com/", "allow"),
        (5, "http://badnet/es/", "badnet", "/es/", None, "allow"),
        (6, "http://a.net/es/b", "a.net", "/es/b", "net/es/", "block"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "http://m.listed.org/a/?utm_source=x&b=2&a=1#t", "m.listed.org", "/a/", None, "block"),
        (9, "http://m.listed.org/a/?utm_source=x&b=2&a=1#t", "m.listed.org", "/a/", None, "block"),
        (10, "http://listed.org/a?b=3", "listed.org", "/a", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "clash") for r in rows], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("listed.org/a?a=1&b=2",), (None,)], "canonical string")
    found = urls.filter_urls(pages, listed).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in found) == sorted((r[0], r[2], r[3], r[4] or "", r[5]) for r in rows)
    assert urls.filter_urls(pages.limit(0), listed).count() == 0
    assert urls.filter_urls(pages, listed.limit(0)).filter("listed").count() == 0


def test_bad_hosts_are_listed(spark):
    """Through any entrance, and with all names; a path or a part of another word makes no bad host."""
    bad = ["spam-farm.example.com", "www.spam-farm.example.com", "m.casino-win.a.org", "www.free-bets.b.net", "cheap-pills.c.org", "blog.adult-x.d.net", "M.ADS-track.e.com"]
    good = ["notspam.example.com", "m.example.org", "loads-more.example.org", "x.org/spam-farm.example.com"]
    pages = spark.createDataFrame([(i, f"http://{h}/en/1") for i, h in enumerate(bad + good)], "page_id long, url string")
    found = urls.filter_urls(pages, urls.reported(pages)).filter("listed").collect()
    assert sorted(r.page_id for r in found) == list(range(len(bad)))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_list_is_not_empty_on_stored_tables(spark, size):
    folder = f"/root/testdata/{size}"
    names = "spam-farm|casino-win|free-bets|cheap-pills|adult-x|ads-track"
    bad = {r.page_id for r in spark.read.parquet(f"{folder}/pages.parquet").collect() if re.search(rf"://[^/?#]*\b({names})[.]", r.url or "")}
    found = urls.op2_url_filter(spark, folder).filter("listed").collect()
    assert bad and {r.page_id for r in found} == bad
    assert any(r.verdict == "block" and r.rule is None for r in found) or size == "sf0.001"


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License.", (5, 1, 3, 3, "mit", "mit,mit-line", 1.0)),
        (2, "x " * 50 + "LICENSED under the Apache License, Version 2.0", (58, 1, 53, 53, "apache", "apache,apache-2.0", 1.0)),
        (3, "It is licensed under CC by\nNC 4.0", (9, 0, None, None, "", "cc-by-nc-4.0", 1.0)),
        (4, None, (0, 0, None, None, "", "", 0.0)),
        (5, "", (0, 0, None, None, "", "", 0.0)),
        (6, "mit-license general public license mit license", (7, 3, 0, 5, "gpl,mit", "gpl,mit", 1.0)),
        (7, "under the mit of released", (5, 0, None, None, "", "mit-line", 0.8)),
    ]
    docs = spark.createDataFrame([(r[0], r[1], 3) for r in rows + [rows[0]]], "doc_id long, text string, n_words int")
    found = sorted((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in licenses.scan_licenses(docs).collect())
    assert [f[1] for f in found] == [rows[0][2]] + [r[2] for r in rows]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, folder, name):
    assert differences(queries.QUERIES[name](spark, folder), connect(folder), queries.SQL[name]) is None


def test_pipeline(spark, folder):
    """Stages keep the table's columns, drop what they should, and hand all their rows on."""
    import corpus_pipeline as pipeline
    from likeness.session import stored

    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.dtypes == first.dtypes
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(left, left[1:])) and len(left[-1]) > len(left[0]) / 2
    pieces = stored(pipeline.STAGES[-1][1](spark, docs, folder), "pieces")
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == left[-1]
    assert pieces.agg({"doc_tokens": "max"}).first()[0] > 0
