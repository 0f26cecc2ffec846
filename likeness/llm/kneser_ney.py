"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes. Every pack names its different n-grams, with their counts in trusted documents;
summed up these are the model's highest order, and tables of different n-grams give the continuation counts
of the lower ones. Probabilities come from joins of these count tables, for the n-grams that occur, and go
back to the packs that asked for them. Both grow with the corpus, and so does what is exchanged. A document
is kept if its perplexity is at most a quantile of the trusted documents' of its language; these are held
out from the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.packs import Pack, pack_documents, unpacked
from likeness.session import stored

ORDER = 4
SHARD_BYTES = 8 << 20
#: One in so many trusted documents is not counted and serves for the thresholds.
HELD_OUT = 10


def grams(pack: Pack) -> np.ndarray:
    """For each byte the n-gram that ends there; zeros stand before a document's first byte."""
    data = np.frombuffer(pack.data, "u1").astype("u4")
    n = len(data)
    place = np.arange(n) - np.repeat(pack.starts[:-1], np.diff(pack.starts))
    out = data.copy()
    for back in range(1, ORDER):
        out[back:] |= np.where(place[back:] >= back, data[: n - back], 0).astype("u4") << np.uint32(8 * back)
    return out


def _members():
    def run(batches):
        for batch in batches:
            for number, ids in zip(batch.column("pack").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), number)), pa.array(np.arange(len(ids))), pa.array(ids)], names=["pack", "idx", "doc_id"]
                )

    return run, "pack long, idx long, doc_id long"


def _marked(row: dict, name: str, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[np.array(row[name].as_py() or [], "i8")] = True
    return out


def _counts():
    def run(batches):
        for pack, row in unpacked(batches):
            found = grams(pack)
            mine = found[np.repeat(_marked(row, "trusted", len(pack)), np.diff(pack.starts))]
            different = np.unique(found)
            own, number = np.unique(mine, return_counts=True)
            counts = np.zeros(len(different), "i8")
            counts[np.searchsorted(different, own)] = number
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(different), pack.number)), pa.array(different.astype("i8")), pa.array(counts)], names=["pack", "gram", "n"]
            )

    return run, "pack long, gram long, n long"


def _scores():
    def run(batches):
        for pack, row in unpacked(batches):
            known, logs = np.zeros(0, "i8"), np.zeros(0)
            if row["answers"].is_valid:
                values = row["answers"].values
                known, logs = np.asarray(values.field("gram")), np.asarray(values.field("log2p"))
                order = np.argsort(known)
                known, logs = known[order].astype("u4"), logs[order]
            found = grams(pack)
            each = logs[np.searchsorted(known, found)] if len(found) else np.zeros(0)
            total = np.append(0.0, np.cumsum(each))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(pack.ids),
                    pa.array(pack.tags, pa.string()),
                    pa.array(np.diff(pack.starts)),
                    pa.array(total[pack.starts[1:]] - total[pack.starts[:-1]]),
                    pa.array(_marked(row, "held", len(pack))),
                ],
                names=["doc_id", "lang", "n_bytes", "log2p", "held"],
            )

    return run, "doc_id long, lang string, n_bytes long, log2p double, held boolean"


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What modified Kneser-Ney takes from counts of one, two, and three or more."""
    n1, n2, n3, n4 = counts.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first()
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    more = [i - (i + 1) * y * b / a if a else 0.0 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(i)) for i, d in enumerate(more, 1))


def log_probabilities(grams_of_packs: DataFrame) -> DataFrame:
    """(gram, log2p) for every n-gram that occurs, from the trusted counts ``n`` in (pack, gram, n)."""
    whole = stored(grams_of_packs.groupBy("gram").agg(F.sum("n").alias("c")), "grams")
    counts = {ORDER: whole.filter("c > 0").select(F.col("gram").alias("key"), "c")}
    for k in range(ORDER - 1, 0, -1):  # how many different bytes stand before each shorter n-gram
        shorter = F.col("key").bitwiseAND((1 << 8 * k) - 1)
        counts[k] = counts[k + 1].groupBy(shorter.alias("key")).agg(F.count("*").alias("c"))
    lower, answer = None, None
    for k in range(1, ORDER + 1):
        known = stored(counts[k], f"counts{k}")
        one, two, three = discounts(known)
        take = F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(three)
        context = F.shiftright("key", 8)
        spread = known.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(take).alias("taken"))
        asked = whole.select(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("key")).distinct()
        if k == 1:
            totals = spread.first()  # one context, the empty one
            total, taken = (totals["total"], totals["taken"]) if totals else (None, None)
            parts = asked.join(known, "key", "left").withColumn("total", F.lit(total).cast("double")).withColumn("taken", F.lit(taken).cast("double"))
            parts = parts.withColumn("lower", F.lit(1 / 256))
        else:
            parts = (
                asked.withColumn("context", context)
                .join(known, "key", "left")
                .join(spread, "context", "left")
                .withColumn("short", F.col("key").bitwiseAND((1 << 8 * (k - 1)) - 1))
                .join(lower.select(F.col("key").alias("short"), F.col("p").alias("lower")), "short")
            )
        own = F.greatest(F.coalesce(F.col("c") - take, F.lit(0.0)), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise((own + F.col("taken") * F.col("lower")) / F.col("total"))
        # What no discount leaves room for is not impossible.
        answer = parts.select("key", F.greatest(p, F.lit(1e-12)).alias("p"))
        lower = stored(answer, f"p{k}") if k < ORDER else answer
    return lower.select(F.col("key").alias("gram"), F.log2("p").alias("log2p"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, weight: float = 64.0) -> DataFrame:
    """Perplexity by byte and verdict: doc_id, lang, n_bytes, perplexity, threshold, kept.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; documents that ``labels`` (doc_id, quality, toxic) calls good
    and not toxic are trusted. A text counts with ``weight`` further bytes of its language's mean, so short
    ones are not judged by chance. Null and empty texts have just these. ``threshold`` is the ``quantile`` of
    the held-out trusted documents of the language; without any there is none, and all are kept. A null language is
    one of its own. Rows with equal ids are judged each; rows without an id are left out. Columns of other
    names are ignored. Empty tables give an empty result.
    """
    packs = pack_documents(docs, "lang", SHARD_BYTES)
    run, schema = _members()
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    members = packs.select("pack", "ids").mapInArrow(run, schema).join(good, "doc_id", "left_semi")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    lists = [F.collect_list(F.when(which, F.col("idx"))).alias(name) for which, name in ((~held, "trusted"), (held, "held"))]
    told = stored(members.groupBy("pack").agg(*lists), "trusted")
    sources = packs.join(told, "pack", "left")
    run, schema = _counts()
    asked = stored(sources.mapInArrow(run, schema), "asked")
    answers = asked.select("pack", "gram").join(log_probabilities(asked), "gram")
    replies = answers.groupBy("pack").agg(F.collect_list(F.struct("gram", "log2p")).alias("answers"))
    run, schema = _scores()
    scores = stored(sources.join(replies, "pack", "left").mapInArrow(run, schema), "scores")
    language = F.coalesce("lang", F.lit(""))
    scores = scores.withColumn("language", language)
    means = scores.filter("held").groupBy("language").agg((F.sum("log2p") / F.greatest(F.sum("n_bytes"), F.lit(1))).alias("mean"))
    mean = F.coalesce("mean", F.lit(0.0))
    judged = scores.join(means, "language", "left").withColumn(
        "perplexity", F.round(F.pow(F.lit(2.0), -(F.col("log2p") + weight * mean) / (F.col("n_bytes") + weight)), 9)
    )
    judged = stored(judged, "perplexity")
    limits = judged.filter("held").groupBy("language").agg(F.percentile_approx("perplexity", quantile, 100000).alias("threshold"))
    verdict = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.join(limits, "language", "left").select("doc_id", "lang", "n_bytes", "perplexity", "threshold", verdict.alias("kept"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
