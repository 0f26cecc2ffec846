"""Benchmark decontamination by template: finds test questions even with other numbers, names and units.

Texts become templates: runs of letters or of digits are tokens, A-Z lower-cased; numbers, names (capitalised
within a sentence) and units (after a number) become placeholders, neighbouring ones of a kind a single one.
Windows of template tokens are joined by hash with those of the benchmark. Windows of one occurrence lie at
the same distance from the item's; within it each value of an item's slot must have one counterpart only,
else the match is chance.

An item's windows are those with enough literal tokens. If these are less than half of them, as in lists of
numbers, names and units, all its windows count. An item shorter than a window is one window of its own length.
Windows with next to no literal tokens fit anything of their shape and are matched with their values.

Before the join a bitmap of fixed size, which every task gets, drops windows that no item has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.keys import places
from likeness.llm.packs import Pack, mix, passing_packs
from likeness.llm.words import hashes_of
from likeness.session import stored

# Units of measure that may follow a number.
UNITS = "mm cm m km kg g mg l ml s ms min h kb mb gb tb w kw v hz khz mhz ghz usd eur gbp ft in lb oz mph kmh days hours minutes seconds years meters metres kilometers kilograms grams liters litres miles inches feet dollars euros percent".split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x9D39247E33776D41, 0x2AF7398005AAA5C7, 0x44DB015024623547))
#: Bits of the bitmap; its size does not depend on the input.
FILTER_BITS = 24
#: Windows of fewer literal tokens are hashed with the values of their slots.
FEWEST_LITERALS = 2


def _classes() -> np.ndarray:
    out = np.zeros(256, "i1")
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    out[48:58] = 2
    return out


class Template:
    """The template tokens of a pack: hash, owner, first and last byte, and whether it is a placeholder."""

    def __init__(self, pack: Pack):
        raw = np.frombuffer(pack.data, "u1")
        n = len(raw)
        low = raw.copy()
        capital = (raw >= 65) & (raw <= 90)
        low[capital] += 32
        # Capital letters with accents, in the two bytes that UTF-8 has for them.
        accented = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) if n else np.zeros(0, "i8")
        low[accented + 1] += 32
        capital[accented] = True
        kind = _classes()[raw]
        fresh = np.ones(n + 1, bool)
        fresh[1:n] = kind[1:] != kind[:-1]
        fresh[pack.starts] = True
        edges = np.flatnonzero(fresh)
        begin, end = edges[:-1], edges[1:]
        token = kind[begin] > 0 if n else np.zeros(0, bool)
        begin, end = begin[token], end[token]
        doc = np.searchsorted(pack.starts, begin, "right") - 1
        data = low.tobytes()
        hashes = hashes_of(data, begin, end)
        number = kind[begin] == 2 if n else np.zeros(0, bool)
        follows = np.zeros(len(begin), bool)
        follows[1:] = doc[1:] == doc[:-1]
        stops = np.append(0, np.cumsum(np.isin(raw, list(b".!?:\n"))))
        opens = np.ones(len(begin), bool)
        opens[1:] = (stops[begin[1:]] > stops[end[:-1]]) | ~follows[1:]
        name = (capital[begin] if n else number) & ~opens & ~number
        units = np.sort(hashes_of(" ".join(UNITS).encode(), *_spans(UNITS)))
        unit = places(units, hashes)[0] & ~number & ~name
        unit[1:] &= number[:-1] & follows[1:]
        unit[:1] = False
        hashes = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, hashes)))
        slot = number | name | unit
        joins = np.zeros(len(begin), bool)
        joins[1:] = slot[1:] & slot[:-1] & follows[1:] & (hashes[1:] == hashes[:-1])
        lead = np.flatnonzero(~joins)
        last = np.append(lead[1:], len(begin)) - 1
        self.hashes, self.doc, self.slot = hashes[lead], doc[lead], slot[lead]
        begin, end = begin[lead], end[last] if len(lead) else end
        self.value = hashes_of(data, begin, end)
        self.starts = np.searchsorted(self.doc, np.arange(len(pack) + 1))

    def windows(self, sizes: list[int]):
        """For each size: hash and first token of each window, and how many of its tokens are no placeholders."""
        total = np.zeros(len(self.hashes), "u8")
        slots = np.append(0, np.cumsum(self.slot))
        for size in range(1, max(sizes, default=0) + 1):
            n = len(self.hashes) - size + 1
            if n < 1:
                return
            total = mix(total[:n] + self.hashes[size - 1 :])
            if size in sizes:
                first = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
                literals = size - (slots[first + size] - slots[first])
                hashes = total[first]
                bare = np.flatnonzero(literals < FEWEST_LITERALS)
                exact = np.zeros(len(bare), "u8")
                for i in range(size):
                    exact = mix(exact + self.value[first[bare] + i])
                hashes[bare] = exact
                yield size, hashes, first, literals


def _spans(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words])
    begin = np.cumsum(size + 1) - size - 1
    return begin, begin + size


def _of_items(template: Template, size: int, literal: int):
    """The windows by which items are found, with how many of them their item has."""
    tokens = np.diff(template.starts)
    for length, hashes, first, literals in template.windows(list(range(1, size + 1))):
        doc = template.doc[first]
        if length < size:
            chosen, counts = tokens[doc] == length, np.ones(len(tokens), "i8")
        else:
            enough = literals >= literal
            counts = np.bincount(doc[enough], minlength=len(tokens))
            every = np.maximum(tokens - size + 1, 0)
            dense = 2 * counts < every
            chosen, counts = enough | dense[doc], np.where(dense, every, counts)
        yield length, hashes[chosen], first[chosen], counts


def _windows(size: int, literal: int, lengths=None, bitmap=None):
    """Windows of items, or with ``lengths`` and ``bitmap`` those of documents that may be an item's."""

    def of_documents(template):
        for length, hashes, first, _ in template.windows(lengths):
            spot = hashes >> np.uint64(64 - FILTER_BITS)
            hit = bitmap.value[(spot >> np.uint64(6)).astype("i8")] >> (spot & np.uint64(63)) & np.uint64(1) == 1
            yield length, hashes[hit], first[hit], np.zeros(len(template.starts) - 1, "i8")

    def run(batches):
        for pack, rows in passing_packs(batches):
            template = Template(pack)
            for length, hashes, first, counts in _of_items(template, size, literal) if bitmap is None else of_documents(template):
                doc = template.doc[first]
                values = [template.value[a : a + length][template.slot[a : a + length]].view("i8") for a in first.tolist()]
                owner = rows.column("id").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [
                        owner,
                        pa.array(hashes.view("i8")),
                        pa.array(first - template.starts[doc]),
                        pa.array(counts[doc].astype("i8")),
                        pa.array(values, pa.list_(pa.int64())),
                        pa.array(np.full(len(first), length)),
                    ],
                    names=["id", "hash", "place", "n_windows", "slots", "length"],
                )

    return run, "id long, hash long, place long, n_windows long, slots array<long>, length long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 8, literal: int = 5, share: float = 0.5) -> DataFrame:
    """Documents that hold a benchmark item, also with other slot values: a row per document and item.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``; other columns are ignored.
    An item is found if consistent windows cover at least ``share`` of its windows: of those with at least
    ``literal`` literal tokens, or of all if these are less than half. An item of fewer than ``size`` template tokens
    is found where all of it stands. Result: doc_id, item_id, n_windows (of the item), n_found, share, verbatim
    (all slot values the same). Null texts and those without any token cannot match. Rows of equal ids are taken
    together; a null id is one of its own. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    run, schema = _windows(size, literal)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string"))
    known = stored(items.mapInArrow(run, schema).dropDuplicates(["id", "hash", "place"]), "windows")
    spot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = known.groupBy(F.shiftrightunsigned(spot, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(63).cast("int"))).alias("bits")
    )
    bitmap = np.zeros(1 << FILTER_BITS - 6, "u8")
    for word, bits in words.collect():  # at most as many rows as the bitmap has words
        bitmap[word] = bits & (1 << 64) - 1
    lengths = [r.length for r in known.select("length").distinct().collect()]  # ``size`` rows at most
    run, schema = _windows(size, literal, lengths, spark.sparkContext.broadcast(bitmap))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    there = texts.mapInArrow(run, schema).select(
        F.col("id").alias("doc_id"), "hash", F.col("place").alias("doc_place"), F.col("slots").alias("doc_slots")
    )
    met = there.join(known.drop("length").withColumnRenamed("id", "item_id"), "hash").withColumn("distance", F.col("doc_place") - F.col("place"))
    # Slots of a window come in pairs; windows without any keep a row.
    paired = met.select(
        "doc_id", "item_id", "distance", "place", "n_windows",
        F.explode_outer(F.arrays_zip(F.col("slots").alias("ours"), F.col("doc_slots").alias("theirs"))).alias("pair"),
    )
    one_value = paired.groupBy("doc_id", "item_id", "distance", "pair.ours").agg(
        F.min("pair.theirs").alias("low"),
        F.max("pair.theirs").alias("high"),
        F.collect_set("place").alias("places"),  # places within an item
        F.first("n_windows").alias("n_windows"),
    )
    occurrence = one_value.groupBy("doc_id", "item_id", "distance").agg(
        F.bool_and(F.col("low").eqNullSafe(F.col("high"))).alias("consistent"),
        F.bool_and(F.col("low").isNull() | (F.col("low") == F.col("ours"))).alias("verbatim"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.first("n_windows").alias("n_windows"),
    )
    # Each distance may be counted once, so a text that repeats an item does not gather more places than it has.
    found = occurrence.filter("consistent").select("*", F.explode("places").alias("place")).groupBy("doc_id", "item_id").agg(
        F.first("n_windows").alias("n_windows"), F.countDistinct("place").alias("n_found"), F.max("verbatim").alias("verbatim")
    )
    covered = F.col("n_found") / F.col("n_windows")
    return found.filter(covered >= share).select("doc_id", "item_id", "n_windows", "n_found", covered.alias("share"), "verbatim")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents in which no item is found. Rows of equal ids stay or go together, those of a null id too."""
    leaks = find_leaks(docs, benchmark, **settings).select("doc_id").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id"))
    return docs.alias("d").join(leaks.alias("l"), same, "left_anti").select(docs.columns)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
