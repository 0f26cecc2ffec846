"""License scans: an exact set-similarity join of text blocks with license statements.

A block is a stretch of 64 words, a new one beginning every 32. A statement is found in a block that has a
given share of its words. Words are ordered from the rarest to the most frequent one over all blocks. A
block that has ``t`` words of a statement of size ``n`` has one of the statement's ``n - t + 1`` rarest, and
that one is among the rarest of the block's own words that any statement uses (prefix filter). Blocks
with fewer such words than ``t`` are out (length filter), and so are pairs whose words after the first
common one cannot suffice any more (positional filter). What is left is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.session import stored

# Wording of license statements, and phrases with their labels.
STATEMENTS = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-line", "released under the mit license"),
]
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STRIDE = 64, 32


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(f"({WORD}+)"), F.lit(1))


def places_of(words: Column, joined: Column, phrase: str) -> Column:
    """Where a phrase's words stand one after the other, counted from 0; looked for only where the text has it."""
    parts = phrase.split()

    def stands(i):
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == part)
        return F.coalesce(found, F.lit(False))

    last = F.size(words) - len(parts)
    there = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stands)
    return F.when(joined.contains(f" {phrase} "), there).otherwise(F.array().cast("array<int>"))


def needed(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def scanned(docs: DataFrame, statements, phrases, percent: int) -> DataFrame:
    """Per document: phrase places and, of each block, the words that statements use; short blocks are out."""
    vocabulary = sorted({w for _, s in statements for w in s.split()})
    least = min(needed(len(set(s.split())), percent) for _, s in statements)
    read = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    read = read.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    words = F.col("words")
    n_blocks = F.greatest(F.ceil((F.size(words) - BLOCK) / STRIDE).cast("int"), F.lit(0))
    blocks = F.transform(
        F.sequence(F.lit(0), n_blocks),
        lambda i: F.array_intersect(F.slice(words, i * STRIDE + 1, BLOCK), F.lit(vocabulary)),
    )
    found = [places_of(words, F.col("joined"), phrase) for _, phrase in phrases]
    labels = F.array(*[F.when(F.size(p) > 0, F.lit(label)) for (label, _), p in zip(phrases, found)])
    return read.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.array_sort(F.flatten(F.array(*found))).alias("places"),
        F.array_sort(F.array_compact(labels)).alias("base"),
        F.filter(blocks, lambda b: F.size(b) >= least).alias("blocks"),
    )


def statement_matches(blocks: DataFrame, statements, percent: int) -> DataFrame:
    """(row, label, score): statements that reach the threshold in some block of ``blocks`` (row, block, tokens)."""
    used = sorted({w for _, wording in statements for w in wording.split()})
    counts = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count()
    often = {r["token"]: r["count"] for r in counts.filter(F.col("token").isin(used)).collect()}  # words of statements only
    order = sorted(used, key=lambda w: (often.get(w, 0), w))
    rows = []
    for label, wording in statements:
        tokens = sorted(set(wording.split()), key=order.index)
        least = needed(len(tokens), percent)
        listed = ", ".join(f"'{t}'" for t in tokens)
        rows += [f"('{label}', array({listed}), {least}, {i}, '{t}')" for i, t in enumerate(tokens[: len(tokens) - least + 1])]
    # A row for each word in the statements' prefixes, whatever the input: a fixed bound.
    prefix = blocks.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS s(label, statement, least, i, token)")
    sorted_blocks = blocks.select("row", "block", F.filter(F.lit(order), lambda w: F.array_contains("tokens", w)).alias("tokens"))
    entries = sorted_blocks.select("row", "block", "tokens", F.posexplode("tokens").alias("j", "token"))
    met = entries.join(F.broadcast(prefix), "token").filter(
        (F.size("tokens") >= F.col("least"))
        & (F.col("j") <= F.size("tokens") - F.col("least"))
        & (F.least(F.size("tokens") - F.col("j"), F.size("statement") - F.col("i")) >= F.col("least"))
    )
    common = F.size(F.array_intersect("tokens", "statement"))
    return (
        met.withColumn("common", common)
        .filter(F.col("common") >= F.col("least"))
        .groupBy("row", "label")
        .agg(F.max(F.col("common") / F.size("statement")).alias("score"))
    )


def scan_licenses(docs: DataFrame, statements=STATEMENTS, phrases=PHRASES, percent: int = 80) -> DataFrame:
    """Licenses named in each text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``docs`` has ``doc_id`` and ``text`` (null: empty); other columns are ignored. Words are runs of letters,
    digits and anything beyond ASCII, A-Z lower-cased. The base columns tell the places of ``phrases``;
    ``labels`` adds the statements found to their labels; ``score`` is the largest share of a statement that
    was found, 1 with a phrase and 0 with nothing. Equal rows, and a null doc_id, are judged like any other.
    An empty table gives an empty result.
    """
    # Block words are few: most blocks lack the words of any statement.
    found = stored(scanned(docs, statements, phrases, percent), "blocks")
    blocks = found.select("row", F.posexplode("blocks").alias("block", "tokens"))
    matches = statement_matches(blocks, statements, percent)
    per_row = matches.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    base = F.col("base")
    return found.join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql() -> str:
    """The same by brute force: every block is held against every statement."""
    shares = ", ".join(
        f"{{'label': '{label}', 'share': list_max(list_transform(blocks, lambda b: len(list_intersect(b, {_list(sorted(set(s.split())))})))) / {len(set(s.split()))}.0}}"
        for label, s in STATEMENTS
    )
    places = {
        label: f"list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split())) + ")"
        for label, phrase in PHRASES
    }
    base = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for label, p in places.items())
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), parts AS (
  SELECT doc_id, w, flatten([{", ".join(places.values())}]) AS places,
    list_sort(list_filter([{base}], lambda x: x IS NOT NULL)) AS base,
    list_transform(range(0, 1 + greatest(CAST(ceil((len(w) - {BLOCK}) / {STRIDE}.0) AS BIGINT), 0)), lambda i: w[i * {STRIDE} + 1 : i * {STRIDE} + {BLOCK}]) AS blocks
  FROM words
), judged AS (
  SELECT *, list_filter([{shares}], lambda x: x.share * 100 >= 80) AS hits FROM parts
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, list_transform(hits, lambda x: x.label)))), ','), '') AS labels,
  CAST(CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(list_max(list_transform(hits, lambda x: x.share)), 0.0) END AS DOUBLE) AS score
FROM judged
"""


SQL = _sql()
