"""The corpus as packs: rows of some megabytes of text that numpy code can take as one array.

A pack holds consecutive documents of an input split, their texts compressed. Packs are written once,
bucketed by their number, to the folder all executors share. So what is found out about a pack elsewhere
(shared keys, counts, intervals) comes back to it by a join that does not shuffle the text.

Rows without ``doc_id`` cannot be named in a result and are left out. A null text is an empty one that is
marked. Rows with equal ids are kept apart by their place in the pack.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.session import shared_folder

PACK_BYTES = 2 << 20
PACK_DOCS = 1 << 16
#: Bytes of text that a task works on at a time where texts only pass it; arrays of numbers take some thirty times as much.
PASSING_BYTES = 1 << 19
PACK_SCHEMA = "pack long, ids binary, lens binary, tags array<string>, n_bytes long, body binary"


class Pack:
    """One unpacked row: ``ids``, ``lens`` (-1: null text), ``starts`` (one more than documents) and the bytes."""

    def __init__(self, number: int, ids: np.ndarray, lens: np.ndarray, tags, data: bytes):
        self.number, self.ids, self.lens, self.tags, self.data = number, ids, lens, tags, data
        self.starts = np.concatenate([[0], np.cumsum(np.maximum(lens, 0))]).astype("i8")

    def __len__(self) -> int:
        return len(self.ids)

    def texts(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist())]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, memoryview, np.ndarray]:
    """Offsets, bytes and validity of a string column, without a copy of the bytes."""
    column = column.cast(pa.large_binary())
    valid = np.ones(len(column), bool) if not column.null_count else np.asarray(column.is_valid())
    if not len(column):
        return np.zeros(1, "i8"), memoryview(b""), valid
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, memoryview(data if data is not None else b""), valid


def _pack_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    number, squeeze = task << 24, zstandard.ZstdCompressor(level=3)
    held: list[tuple] = []
    total = 0

    def row():
        nonlocal number, held, total
        body = b"".join(h[3] for h in held)
        out = {
            "pack": [number],
            "ids": [np.concatenate([h[0] for h in held]).tobytes()],
            "lens": [np.concatenate([h[1] for h in held]).tobytes()],
            "tags": [[t for h in held for t in h[2]]],
            "n_bytes": [len(body)],
            "body": [squeeze.compress(body)],
        }
        number, held, total = number + 1, [], 0
        return pa.RecordBatch.from_pydict(out, schema=_ARROW)

    for batch in batches:
        ids = np.asarray(batch.column(0).cast(pa.int64()))
        offsets, data, valid = text_buffers(batch.column(1))
        tags = batch.column(2).to_pylist()
        at = 0
        while at < len(ids):
            room = int(np.searchsorted(offsets, offsets[at] + max(1, size - total), "left"))
            to = min(max(at + 1, room), len(ids), at + PACK_DOCS - sum(len(h[0]) for h in held))
            lens = np.where(valid[at:to], np.diff(offsets[at : to + 1]), -1).astype("<i8")
            held.append((ids[at:to].astype("<i8"), lens, tags[at:to], bytes(data[offsets[at] : offsets[to]])))
            total += int(offsets[to] - offsets[at])
            at = to
            if total >= size or sum(len(h[0]) for h in held) >= PACK_DOCS:
                yield row()
    if held:
        yield row()


_ARROW = pa.schema(
    [
        ("pack", pa.int64()),
        ("ids", pa.binary()),
        ("lens", pa.binary()),
        ("tags", pa.list_(pa.string())),
        ("n_bytes", pa.int64()),
        ("body", pa.binary()),
    ]
)


def pack_documents(docs: DataFrame, tag: str | None = None, size: int = PACK_BYTES) -> DataFrame:
    """Write the documents (``doc_id``, ``text`` and one more column if asked for) as a bucketed table of packs."""
    spark = docs.sparkSession
    tags = F.col(tag).cast("string") if tag else F.lit(None).cast("string")
    rows = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), tags.alias("tag")
    )
    name = f"packs_{uuid.uuid4().hex}"
    buckets = shuffle_tasks(spark)
    packed = rows.mapInArrow(lambda batches: _pack_rows(batches, size), PACK_SCHEMA)
    packed.write.bucketBy(buckets, "pack").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write a table in buckets of ``key`` to the shared folder: joins on the key do not move it again."""
    spark = df.sparkSession
    name, buckets = f"{name}_{uuid.uuid4().hex}", shuffle_tasks(spark)
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    dealt.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def shuffle_tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pack, dict]]:
    """Each pack of the batches with what else its row holds."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i] for j, n in enumerate(names)}
            pack = Pack(
                row["pack"].as_py(),
                np.frombuffer(row["ids"].as_py(), "<i8"),
                np.frombuffer(row["lens"].as_py(), "<i8"),
                row["tags"].as_py() if "tags" in row else None,
                zstandard.ZstdDecompressor().decompress(row["body"].as_py()),
            )
            yield pack, row


def passing_packs(batches: Iterator[pa.RecordBatch], size: int = PASSING_BYTES) -> Iterator[tuple[Pack, pa.RecordBatch]]:
    """Documents on their way through one task, some at a time, with the rows they come from.

    The batches have a column ``text``; ids are not looked at. What Arrow holds on to goes back at the end: the next task has the worker.
    """
    for batch in batches:
        offsets, data, valid = text_buffers(batch.column(batch.schema.get_field_index("text")))
        at, n = 0, batch.num_rows
        while at < n:
            to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "left"))), n)
            lens = np.where(valid[at:to], np.diff(offsets[at : to + 1]), -1)
            yield Pack(0, np.arange(to - at), lens, None, bytes(data[offsets[at] : offsets[to]])), batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def with_replies(packs: DataFrame, replies: DataFrame) -> DataFrame:
    """Packs with the rows that belong to them, as an array ``replies``; null where there are none.

    What a pack gets is bounded by what it has asked for.
    """
    columns = [c for c in replies.columns if c != "pack"]
    gathered = replies.groupBy("pack").agg(F.collect_list(F.struct(*columns)).alias("replies"))
    return packs.join(gathered, "pack", "left")


#: Formats that keep all digits of the columns that ride along.
REST_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def rest_of(docs: DataFrame):
    """All columns but ``doc_id`` and ``text`` as one string, to ride along as a tag."""
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    return F.to_json(F.struct(*names), REST_FORMATS) if names else F.lit(None).cast("string")


def with_rest(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, tag) in the columns of ``docs``."""
    fields = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = rows.withColumn("_rest", F.from_json("tag", schema, REST_FORMATS)) if fields else rows
    cast = {f.name: f.dataType for f in docs.schema}
    return rows.select(
        *[F.col(c).cast(cast[c]) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns]
    )


def _restored(batches):
    for pack, row in unpacked(batches):
        chosen = np.array(row["chosen"].as_py() or [], "i8")
        texts = [pack.data[pack.starts[i] : pack.starts[i + 1]].decode("utf-8", "replace") if pack.lens[i] >= 0 else None for i in chosen]
        yield pa.RecordBatch.from_arrays(
            [pa.array(pack.ids[chosen]), pa.array(texts, pa.string()), pa.array([pack.tags[i] for i in chosen], pa.string())],
            names=["doc_id", "text", "tag"],
        )


def chosen_documents(packs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents (doc_id, text, tag) at the places (pack, idx) of ``chosen``."""
    places = chosen.groupBy("pack").agg(F.collect_list("idx").alias("chosen"))
    return packs.join(places, "pack").mapInArrow(_restored, "doc_id long, text string, tag string")


def mix(values: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values, one to one."""
    values = values.astype("u8", copy=True)
    values ^= values >> np.uint64(31)
    values *= np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    return values
