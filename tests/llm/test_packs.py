"""Columns that ride along with packed documents come back as they were."""

import datetime
import decimal
import tracemalloc

import pyarrow as pa
import pytest

from likeness.llm import quality_rules
from likeness.llm.decontamination import without_leaks
from likeness.llm.packs import chosen_documents, pack_documents, rest_of, with_rest


def test_other_columns_keep_their_values(spark):
    when = datetime.datetime(2024, 2, 29, 3, 4, 5, 123456)
    rows = [
        (1, "a text", when, when, b"\x00\xff", decimal.Decimal("12345678901234567890.0123456789"), 0.1, "x", [1, None], datetime.date(1999, 12, 31)),
        (2, None, None, None, None, None, float("nan"), None, None, None),
        (3, "", datetime.datetime(1970, 1, 1), when, b"", decimal.Decimal(0), 1e300, "", [], None),
    ]
    schema = (
        "doc_id long, text string, at timestamp, local timestamp_ntz, raw binary, price decimal(38,10), score double, "
        "N_WORDS string, marks array<int>, day date"
    )
    docs = spark.createDataFrame(rows, schema)
    packs = pack_documents(docs.withColumn("_own", rest_of(docs)), "_own")
    every = packs.selectExpr("pack", "explode(sequence(0, array_size(tags) - 1)) AS idx")
    back = with_rest(chosen_documents(packs, every), docs)
    assert back.columns == docs.columns and [f.dataType for f in back.schema] == [f.dataType for f in docs.schema]
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))


def test_leaks_without_an_id_go(spark):
    item = "a long river runs behind the old mill and turns its wheel until the late winter freezes all of it"
    docs = spark.createDataFrame([(None, f"see here: {item}."), (1, "nothing of the kind stands in this short text"), (2, item)], "doc_id long, text string")
    kept = without_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [1]


def peak_mb(run, texts):
    """Most memory of numpy and Python, in MB, while the texts pass in one batch of a task that has warmed up."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    list(run(iter([batch.slice(0, 2)])))
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def many_texts():
    return [" ".join(f"w{i * 7919 % 30011}{j * 104729 % 9973}" for j in range(400)) for i in range(800)]


def test_a_batch_of_texts_passes_in_small_parts():
    texts = many_texts()
    assert sum(map(len, texts)) > 2.5e6
    peak, rows = peak_mb(quality_rules._measured(False), texts)
    assert rows == len(texts) and peak < 30


def test_packing_learns_words_in_small_parts():
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from likeness.llm import packing

    texts = many_texts()
    peak, rows = peak_mb(packing._pieces(public.path("word_bpe_49k.json"), 2048, False)[0], texts)
    assert rows >= len(texts) and peak < 50
