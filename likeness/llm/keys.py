"""Which 64-bit keys of a corpus are shared, found without moving the text.

Every pack names its different keys once. The keys are dealt by hash into buckets of bounded size, where
sorted runs are merged, and each pack is told which of its keys stand elsewhere too, and how often. A key
that a third of all documents have costs one entry for each pack, not one for each document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.packs import Pack, mix, shuffle_tasks, unpacked
from likeness.session import stored

BUCKET_BYTES = 8 << 20
_ASKED = "bucket long, pack long, keys binary, docs binary, occurrences binary"
_TOLD = "pack long, keys binary, docs binary, occurrences binary, n_first long"


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    if not len(ordered):
        return np.zeros(0, "i8")
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def counted(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, in how many documents of the pack each stands, and how often."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    first = group_starts(k)
    new_doc = np.ones(len(k), bool)
    new_doc[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return k[first], np.add.reduceat(new_doc.astype("i8"), first) if len(k) else first, np.diff(np.append(first, len(k)))


def _ask(emit: Callable, buckets: int):
    def run(batches):
        for pack, row in unpacked(batches):
            keys, docs, occurrences = emit(pack, row)
            bucket = (mix(keys) % np.uint64(buckets)).astype("i8")
            order = np.argsort(bucket, kind="stable")
            keys, docs, occurrences, bucket = keys[order], docs[order].astype("<i4"), occurrences[order].astype("<i4"), bucket[order]
            first = group_starts(bucket)
            last = np.append(first[1:], len(bucket))
            cut = lambda values: [values[a:b].tobytes() for a, b in zip(first, last)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[first]),
                    pa.array(np.full(len(first), pack.number)),
                    pa.array(cut(keys), pa.binary()),
                    pa.array(cut(docs), pa.binary()),
                    pa.array(cut(occurrences), pa.binary()),
                ],
                names=["bucket", "pack", "keys", "docs", "occurrences"],
            )

    return run


def _tell(table: pa.Table) -> pa.Table:
    blobs = table.column("keys").to_pylist()
    packs = table.column("pack").to_numpy()
    keys = np.frombuffer(b"".join(blobs), "<u8")
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), "<i4")
    occurrences = np.frombuffer(b"".join(table.column("occurrences").to_pylist()), "<i4")
    place = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
    order = np.argsort(keys, kind="stable")
    first = group_starts(keys[order])
    size = np.diff(np.append(first, len(keys)))
    total_docs = np.add.reduceat(docs[order].astype("i8"), first) if len(first) else first
    total = np.add.reduceat(occurrences[order].astype("i8"), first) if len(first) else first
    shared = np.repeat(total_docs >= 2, size)
    back = order[shared]
    rows = np.argsort(place[back], kind="stable")
    back, d, t = back[rows], np.repeat(total_docs, size)[shared][rows], np.repeat(total, size)[shared][rows]
    lead = np.zeros(len(keys), bool)
    lead[order[first]] = True
    at = group_starts(place[back])
    end = np.append(at[1:], len(back))
    return pa.table(
        {
            "pack": pa.array(packs[place[back][at]] if len(at) else np.zeros(0, "i8"), pa.int64()),
            "keys": pa.array([keys[back[a:b]].tobytes() for a, b in zip(at, end)], pa.binary()),
            "docs": pa.array([d[a:b].astype("<i8").tobytes() for a, b in zip(at, end)], pa.binary()),
            "occurrences": pa.array([t[a:b].astype("<i8").tobytes() for a, b in zip(at, end)], pa.binary()),
            # Each key's occurrences once, so that a plain sum over all rows is their number.
            "n_first": pa.array([int((t[a:b] * lead[back[a:b]]).sum()) for a, b in zip(at, end)], pa.int64()),
        }
    )


def shared_keys(packs: DataFrame, emit: Callable[[Pack, dict], tuple], keys_per_byte: float) -> DataFrame:
    """For each pack its keys that two or more documents have, with their numbers of documents and occurrences.

    ``emit`` gives a pack's different keys with both numbers, from the pack and its row. The result is written out, as it is read again.
    """
    n_bytes = packs.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(4 * shuffle_tasks(packs.sparkSession), int(n_bytes * keys_per_byte * 16 / BUCKET_BYTES))
    asked = packs.mapInArrow(_ask(emit, buckets), _ASKED)
    return stored(asked.groupBy("bucket").applyInArrow(_tell, _TOLD), "keys")


def told_keys(replies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pack's shared keys in order, with the numbers of documents and occurrences."""
    rows = replies.as_py() or []
    keys = np.frombuffer(b"".join(r["keys"] for r in rows), "<u8")
    docs = np.frombuffer(b"".join(r["docs"] for r in rows), "<i8")
    occurrences = np.frombuffer(b"".join(r["occurrences"] for r in rows), "<i8")
    order = np.argsort(keys)
    return keys[order], docs[order], occurrences[order]


def places(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: which of ``wanted`` are in ``ordered``, and where."""
    if not len(ordered):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), "i8")
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return ordered[at] == wanted, at
