"""Quality rules with controlled risk: how many good documents each cutoff may cost is bounded by exact tests.

Each rule rejects documents whose share of something exceeds a cutoff. For each stratum (language) cutoffs
are tried from lax to strict on the labelled documents: a cutoff passes if so few good ones among ``n``
exceed it that a true rate of ``alpha`` is refuted by the exact binomial tail. The first cutoff that fails
ends the search (a fixed sequence needs no correction); the level is divided by the number of rules and
strata (Bonferroni). ``alpha`` is the total over all rules. Without enough labels nothing is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.llm.packs import mix, passing_packs
from likeness.llm.words import WordSpans, hashes_of
from likeness.session import stored

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits"]
#: Each rule: the count that is judged and what it is a share of.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "digits": ("n_digits", "word_chars"),
}
STEPS = 64
RESULTS = [*COUNTS, "base_failed", "kept", "stratum", "limits"]


def _per_doc(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype="i8"))
    return total[starts[1:]] - total[starts[:-1]]


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def measures(pack) -> dict[str, np.ndarray]:
    """The counts of every document of a pack."""
    raw = np.frombuffer(pack.data, "u1")
    spans = WordSpans(pack)
    n_docs = len(pack)
    n_words = np.diff(spans.starts)
    chars = (raw & 0xC0) != 0x80
    chars &= ~_table(b"\x20\x09\x0a\x0b\x0c\x0d")[raw]
    out = {"n_words": n_words, "word_chars": _per_doc(chars, pack.starts)}
    for name, which in (("n_symbols", SYMBOLS), ("n_marks", MARKS), ("n_upper", bytes(range(65, 91))), ("n_digits", b"0123456789")):
        out[name] = _per_doc(_table(which)[raw], pack.starts)

    breaks = np.flatnonzero(raw == 10)
    ends = np.sort(np.concatenate([breaks, pack.starts[1:]]), kind="stable")
    begins = np.sort(np.concatenate([pack.starts[:-1], breaks + 1]), kind="stable")
    line_doc = np.searchsorted(breaks, pack.starts[:-1]) + np.arange(n_docs)  # first line of each document
    doc = np.searchsorted(line_doc, np.arange(len(begins)), "right") - 1
    worded = np.searchsorted(spans.begin, ends) > np.searchsorted(spans.begin, begins)
    begins, ends, doc = begins[worded], ends[worded], doc[worded]
    line = mix(hashes_of(pack.data, begins, ends) + (ends - begins).astype("u8"))
    out["n_lines"] = np.bincount(doc, minlength=n_docs)
    order = np.lexsort((line, doc))
    same = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][same], minlength=n_docs)

    hashes = spans.hashes()
    n_windows = np.maximum(n_words - 2, 0)
    owner = np.repeat(np.arange(n_docs), n_windows)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + spans.starts[:-1][owner]
    window = mix(mix(mix(hashes[first]) + hashes[first + 1]) + hashes[first + 2])
    order = np.lexsort((window, owner))
    same = (window[order][1:] == window[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(owner), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + 2, bool)
    for i in range(3):
        covered[first[twice] + i] = True
    out["n_repeat_words"] = _per_doc(covered[: len(hashes)], spans.starts)
    return out


def _measured(with_text: bool):
    def run(batches):
        for pack, rows in passing_packs(batches):
            found = measures(pack)
            columns = [c for c in rows.schema.names if with_text or c != "text"]
            arrays = [rows.column(c) for c in columns] + [pa.array(found[c].astype("i8")) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(arrays, names=columns + COUNTS)

    return run


def measured(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """The documents' columns with the counts, ``base_failed`` and ``stratum`` beside them."""
    rows = docs.select(*[c for c in docs.columns if c.lower() not in RESULTS]).withColumn("text", F.col("text").cast("string"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if with_text or f.name != "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    found = rows.mapInArrow(_measured(with_text), f"{fields}, {counts}")
    return found.withColumn("base_failed", failed).withColumn("stratum", stratum)


@F.pandas_udf(T.DoubleType())
def _refuted(n: pd.Series, k: pd.Series, rate: pd.Series) -> pd.Series:
    """Probability of at most ``k`` among ``n`` at the given rate, exactly; 1 where ``k`` is not below the mean."""

    def tail(size: int, count: int, p: float) -> float:
        if size <= 0 or count >= size * p:
            return 1.0
        steps = np.arange(1, count + 1)
        logs = np.log(size - steps + 1) - np.log(steps) + np.log(p) - np.log1p(-p)
        return float(np.exp(size * np.log1p(-p) + np.append(0.0, np.cumsum(logs))).sum())

    return pd.Series([tail(int(a), int(b), float(c)) for a, b, c in zip(n, k, rate)])


def share(rule: str):
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.least(F.col(part) / F.col(whole), F.lit(1.0))).otherwise(0.0)


def cutoffs(found: DataFrame, labels: DataFrame, alpha: float = 0.05, level: float = 0.05) -> DataFrame:
    """(stratum, limits): for each rule the strictest cutoff, in steps, that the labelled documents allow.

    Labels of a document that contradict each other count as good, so a rule has to spare it.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct()
    known = found.filter("not base_failed").join(good, "doc_id", "left_semi")
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(share(r) * STEPS).cast("int").alias("step")) for r in RULES])
    hits = known.select("stratum", F.explode(rules).alias("r")).groupBy("stratum", "r.rule", "r.step").agg(F.count("*").alias("k"))
    grid = hits.select("stratum").distinct().select("stratum", F.explode(F.array(*map(F.lit, RULES))).alias("rule"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("step")).join(hits, ["stratum", "rule", "step"], "left")
    # A document at step s is over every cutoff below s. The table has STEPS rows for a stratum and rule.
    stricter = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("stratum", "rule")
    tested = grid.fillna(0, ["k"]).select(
        "stratum", "rule", "step", F.sum("k").over(whole).alias("n"), F.coalesce(F.sum("k").over(stricter), F.lit(0)).alias("lost")
    )
    n_tests = tested.select("stratum").distinct().count() * len(RULES)
    tail = _refuted("n", "lost", F.lit(alpha / len(RULES)))
    failed = tested.withColumn("fails", tail > level / max(1, n_tests))
    # From lax to strict, up to the first that fails; step STEPS never rejects anything.
    limit = F.coalesce(F.max(F.when(F.col("fails"), F.col("step"))) + 1, F.lit(0))
    best = failed.groupBy("stratum", "rule").agg(F.least(limit, F.lit(STEPS)).alias("step"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "step"))).alias("limits"))


def judged(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, level: float = 0.05) -> DataFrame:
    """Measures and verdict of every document, together with all columns of ``docs`` but the text.

    ``docs`` has ``doc_id``, ``text`` (null: no words) and ``lang``, the stratum (null is a stratum of its own);
    ``labels`` has ``doc_id`` and ``quality``. ``base_failed``: under 50 words, or over half of the words in
    repeated runs of three. ``kept``: not failed, and no rule of the stratum exceeded. Equal rows are judged
    each. Columns of ``docs`` that clash with the counts are taken over by these. Empty tables give an empty result.
    """
    found = stored(measured(docs), "measured")
    return verdicts(found, stored(cutoffs(found, labels, alpha, level), "limits"))


def verdicts(found: DataFrame, limits: DataFrame) -> DataFrame:
    over = F.lit(False)
    for rule in RULES:
        over = over | (F.ceil(share(rule) * STEPS) > F.coalesce(F.col("limits")[rule], F.lit(STEPS)))
    # A row for each stratum; whether it is broadcast is left to Spark's size check.
    return found.join(limits, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over)


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, level: float = 0.05) -> DataFrame:
    """The documents that ``judged`` keeps, as they are. The text is measured twice rather than moved."""
    few = docs.select("doc_id", "text", "lang")
    limits = stored(cutoffs(stored(measured(few), "measured"), labels, alpha, level), "limits")
    clash = {c: f"_own_{c}" for c in docs.columns if c.lower() in RESULTS}
    renamed = docs.withColumnsRenamed(clash)
    kept = verdicts(measured(renamed, with_text=True), limits).filter("kept")
    return kept.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept")
