"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots; a versioned table says which shard holds which slot. Bytes are
summed by slot, and rebalancing edits the table: a few slots move, records never change their slot. Equal
texts share a slot, unless they alone would fill a good part of a shard; then they are dealt by id.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from likeness.session import stored

SLOTS = 4096
#: Parts of a slot within which rows are numbered, so that no task numbers a whole shard.
SLICES = 32
#: Equal texts are dealt by id if they hold more than this share of an even shard.
HEAVY = 0.25


def first_map(slots: int, shards: int) -> list[int]:
    return [slot % shards for slot in range(slots)]


def rebalanced(held_by: list[int], sizes: list[int], shards: int) -> list[int]:
    """The map after edits that even out the shards' sizes, each between the fullest and the emptiest.

    Works on the table of slots, whose length is fixed. A slot moves, or two are exchanged, whichever comes
    closest to half of the difference; every edit lessens the difference, so this ends.
    """
    held_by, loads = list(held_by), [0] * shards
    members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(held_by):
        loads[shard] += sizes[slot]
        if sizes[slot]:
            members[shard].append((sizes[slot], slot))
    while True:
        full, empty = max(range(shards), key=loads.__getitem__), min(range(shards), key=loads.__getitem__)
        gap = loads[full] - loads[empty]
        there = sorted(members[empty])
        best = (gap, None, None)
        for size, slot in members[full]:
            best = min(best, (abs(gap - 2 * size), slot, -1)) if size < gap else best
            at = bisect_left(there, (size - gap // 2, -1))
            for other_size, other in there[max(0, at - 1) : at + 1]:
                moved = size - other_size
                if 0 < moved < gap:
                    best = min(best, (abs(gap - 2 * moved), slot, other))
        if best[1] is None or best[0] >= gap:
            return held_by
        for slot, source, target in ((best[1], full, empty), (best[2], empty, full)):
            if slot >= 0:
                held_by[slot] = target
                members[source].remove((sizes[slot], slot))
                members[target].append((sizes[slot], slot))
                loads[source] -= sizes[slot]
                loads[target] += sizes[slot]


def map_table(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """All versions of the map, stored: (version, slot_id, shard)."""
    tables = [
        spark.range(len(held_by)).select(
            F.lit(version).alias("version"), F.col("id").cast("int").alias("slot_id"), F.get(F.lit(held_by), F.col("id").cast("int")).alias("shard")
        )
        for version, held_by in enumerate(versions, 1)
    ]
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return stored(whole, "slot-map")


def slotted(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Size, checksum and slot of every record: doc_id, size, text_crc32, slot_id, slice."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = stored(
        docs.select(
            F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("print")
        ),
        "records",
    )
    groups = facts.groupBy("print", "size").agg(F.sum("size").alias("bytes"))
    total = facts.agg(F.sum("size")).first()[0] or 0
    # At most shards / HEAVY groups can hold so much, so the table is short whatever the input.
    heavy = groups.filter(F.col("bytes") > F.lit(total * HEAVY / shards)).select("print", "size", F.lit(True).alias("heavy"))
    key = F.when(F.col("heavy"), F.xxhash64("print", "doc_id")).otherwise(F.xxhash64("print", "size"))
    return facts.join(F.broadcast(heavy), ["print", "size"], "left").select(
        "doc_id",
        "size",
        "text_crc32",
        F.pmod(key, F.lit(slots)).cast("int").alias("slot_id"),
        F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.lit(SLICES)).cast("int").alias("slice"),
    )


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, held_by: list[int] | None = None) -> DataFrame:
    """Every record with its shard and its place there: doc_id, size, text_crc32, slot_id, shard, slot.

    Shards end up nearly equal in bytes. ``held_by`` is the map in force (at first slot modulo shards); its
    edited version is stored beside it. ``docs`` has ``doc_id`` and ``text``; a null text counts as empty, a
    null doc_id is an id like any other; other columns are ignored; equal rows have a place each. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    rows = slotted(docs, shards, slots)
    parts = stored(rows.groupBy("slot_id", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "slots")
    sizes = [0] * slots
    for slot, size in parts.groupBy("slot_id").agg(F.sum("bytes")).collect():  # a row for each slot at most
        sizes[slot] = size
    before = held_by or first_map(slots, shards)
    table = map_table(spark, [before, rebalanced(before, sizes, shards)])
    in_force = table.filter("version = 2").drop("version")
    # Both tables have a row for each slot, or part of one, at most: their sizes are parameters.
    shard = Window.partitionBy("shard").orderBy("slot_id", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.join(F.broadcast(in_force), "slot_id").select(
        "slot_id", "slice", "shard", F.coalesce(F.sum("n").over(shard), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("slot_id", "slice").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(within))
    return numbered.join(F.broadcast(offsets), ["slot_id", "slice"]).select(
        "doc_id", "size", "text_crc32", "slot_id", "shard", (F.col("before") + F.col("place") - 1).alias("slot")
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "slot_id"
    )
