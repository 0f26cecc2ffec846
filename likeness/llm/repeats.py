"""Repeated stretches of at least ``window`` units (bytes or words), found exactly over the whole corpus.

A unit is removed if it is covered by a window that also starts in a document with a smaller id.

1. Every window names an anchor by its own content only, so equal windows name the same one. Neighbouring
   windows mostly share it and form a fragment.
2. Anchors of one document only are out (``keys.shared_keys``).
3. Fragments with shared anchors are dealt to shards by anchor, with their text. Within a pack, fragments
   that are equal to one of a smaller document are settled at once and not sent. An anchor with very many
   fragments is split over shards by pack.
4. Each shard finds its equal windows. First windows of split anchors are merged across shards, dealt by
   content.
5. Intervals go back to their packs.

What differs between operators (``method``): the anchors, how a shard finds equal windows, the units.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.keys import counted, group_starts, places, shared_keys, told_keys
from likeness.llm.packs import mix, pack_documents, shuffle_tasks, unpacked, with_replies

SHARD_BYTES = 2 << 20
HOT_FRAGMENTS = 8192
FRAGMENT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("idx", "<i8"), ("start", "<i8"), ("count", "<i8"), ("size", "<i8"), ("split", "<i8")])
INTERVAL = np.dtype([("idx", "<i8"), ("start", "<i8"), ("end", "<i8")])
FIRST = np.dtype([("doc", "<i8"), ("pack", "<i8"), ("idx", "<i8"), ("start", "<i8")])
_SENT = "shard long, pack long, kind int, meta binary, body binary"
_FIELDS = ["shard", "pack", "kind", "meta", "body"]
PIECES, REMOVED, FIRSTS = 0, 1, 2


def no_runs() -> tuple:
    return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")


def runs_of(keys: np.ndarray, starts: np.ndarray, window: int) -> tuple:
    """Runs of neighbouring windows with one key: (key, document, first window, number of windows).

    ``keys`` has one for each place in the pack; windows that leave their document don't count.
    """
    n = len(keys)
    new = np.ones(n, bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    ends = np.maximum(starts[1:] - window + 1, starts[:-1])
    new[starts[:-1][starts[:-1] < n]] = True
    new[ends[ends < n]] = True
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, n))
    docs = np.searchsorted(starts, first, "right") - 1
    inside = first < ends[docs]
    return keys[first[inside]], docs[inside], first[inside], counts[inside]


def shard_of(pack: int, shards: int) -> int:
    """Where what is settled about a pack waits for the rest."""
    return (pack * 0x9E3779B97F4A7C15 >> 20) % shards


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=_FIELDS)


def _fragments(method, shards: int):
    def run(batches):
        for pack, row in unpacked(batches):
            shared, _, often = told_keys(row["replies"])
            units = method.units(pack)
            keys, docs, starts, counts = method.anchors(units)
            hit, at = places(shared, keys)
            keys, docs, starts, counts, often = keys[hit], docs[hit], starts[hit], counts[hit], often[at[hit]]
            texts = [method.text(units, s, c) for s, c in zip(starts.tolist(), counts.tolist())]
            ids = pack.ids[docs]
            smallest: dict[bytes, int] = {}
            for text, doc in zip(texts, ids.tolist()):
                if smallest.setdefault(text, doc) > doc:
                    smallest[text] = doc
            settled = np.fromiter((smallest[t] for t in texts), "i8", len(texts)) < ids
            begin = starts - units.starts[docs]
            out = []
            if settled.any():
                found = np.zeros(int(settled.sum()), INTERVAL)
                found["idx"], found["start"] = docs[settled], begin[settled]
                found["end"] = begin[settled] + counts[settled] + method.window - 1
                out.append((shard_of(pack.number, shards), pack.number, REMOVED, found.tobytes(), b""))
            parts = -(-often // HOT_FRAGMENTS)
            sub = np.uint64(pack.number * 0x9E3779B1 & (1 << 63) - 1) % parts.astype("u8") if len(parts) else parts.astype("u8")
            shard = (mix(keys + sub * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(shards)).astype("i8")
            sent = np.flatnonzero(~settled)
            sent = sent[np.argsort(shard[sent], kind="stable")]
            meta = np.zeros(len(sent), FRAGMENT)
            meta["key"], meta["doc"], meta["idx"], meta["start"] = keys[sent], ids[sent], docs[sent], begin[sent]
            meta["count"], meta["split"] = counts[sent], parts[sent] > 1
            body = [texts[i] for i in sent.tolist()]
            meta["size"] = [len(t) for t in body]
            first = group_starts(shard[sent])
            for a, b in zip(first, np.append(first[1:], len(sent))):
                out.append((int(shard[sent[a]]), pack.number, PIECES, meta[a:b].tobytes(), b"".join(body[a:b])))
            yield _rows(out)

    return run


def _resolve(method, shards: int):
    def intervals_of(meta, begin, end):
        """What is covered by the windows ``begin`` to ``end`` (exclusive) of the pieces."""
        found = np.zeros(len(meta), INTERVAL)
        found["idx"], found["start"], found["end"] = meta["idx"], meta["start"] + begin, meta["start"] + end + method.window - 1
        return found

    def chunk(meta, pack_of, texts, out_intervals, out_firsts):
        """Pieces in the order of their keys, all pieces of a key at once."""
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(t, len(known)) for t in texts), "i8", len(texts))
        smallest = np.full(len(known), np.iinfo("i8").max)
        np.minimum.at(smallest, which, meta["doc"])
        later = meta["doc"] > smallest[which]
        if later.any():
            out_intervals.append((pack_of[later], intervals_of(meta[later], 0, meta["count"][later])))
        # From here on the different pieces, each in the place of its first document.
        lead = np.empty(len(known), "i8")
        lead[which[::-1]] = np.arange(len(texts))[::-1]
        key, count, split = meta["key"][lead], meta["count"][lead], meta["split"][lead] > 0
        first = group_starts(key)
        several = np.repeat(np.diff(np.append(first, len(key))) > 1, np.diff(np.append(first, len(key))))
        many = np.flatnonzero(several)
        gone = {}
        if len(many):
            counts = count[many]
            same = method.same([texts[i] for i in lead[many].tolist()], counts)
            piece = np.repeat(many, counts)
            place = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
            least = np.full(int(same.max()) + 1, np.iinfo("i8").max)
            np.minimum.at(least, same, smallest[piece])
            removed = smallest[piece] > least[same]
            at = np.flatnonzero(removed)
            if len(at):
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) != 1) | (piece[at[1:]] != piece[at[:-1]])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(at)) - 1
                holders = np.flatnonzero(~later)
                holders = holders[np.argsort(which[holders], kind="stable")]
                held = which[holders]
                for p, x, y in zip(piece[at[begin]].tolist(), place[at[begin]].tolist(), place[at[end]].tolist()):
                    gone.setdefault(p, []).append((x, y + 1))
                    mine = holders[np.searchsorted(held, p) : np.searchsorted(held, p, "right")]
                    out_intervals.append((pack_of[mine], intervals_of(meta[mine], x, np.full(len(mine), y + 1))))
        for i in np.flatnonzero(split[which] & ~later).tolist():
            p, m = int(which[i]), meta[i]
            left = np.ones(int(m["count"]), bool)
            for x, y in gone.get(p, []):
                left[x:y] = False
            for w in np.flatnonzero(left).tolist():
                entry = (int(m["doc"]), int(pack_of[i]), int(m["idx"]), int(m["start"]) + w)
                out_firsts.append((method.one_window(texts[i], w), *entry))

    def run(table: pa.Table) -> pa.Table:
        out, intervals, firsts = [], [], []
        kinds, packs = table.column("kind").to_pylist(), table.column("pack").to_pylist()
        metas, bodies = table.column("meta"), table.column("body")
        meta, pack_of, texts = [], [], []
        for i, kind in enumerate(kinds):
            blob = metas[i].as_py()
            if kind == REMOVED:
                out.append((shard_of(packs[i], shards), packs[i], REMOVED, blob, b""))
                continue
            m, body = np.frombuffer(blob, FRAGMENT), bodies[i].as_py()
            ends = np.cumsum(m["size"]).tolist()
            texts += [body[e - s : e] for e, s in zip(ends, m["size"].tolist())]
            meta.append(m)
            pack_of.append(np.full(len(m), packs[i]))
        if meta:
            meta, pack_of = np.concatenate(meta), np.concatenate(pack_of)
            order = np.argsort(meta["key"], kind="stable")
            meta, pack_of = meta[order], pack_of[order]
            first = group_starts(meta["key"])
            filled = np.cumsum(meta["size"])[np.append(first[1:], len(meta)) - 1]
            # Whole keys, as many at a time as make up one working set.
            block = filled // SHARD_BYTES
            cuts = np.append(first[group_starts(block)], len(meta))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                chunk(meta[a:b], pack_of[a:b], [texts[i] for i in order[a:b].tolist()], intervals, firsts)
        if intervals:
            owner, found = np.concatenate([x[0] for x in intervals]), np.concatenate([x[1] for x in intervals])
            order = np.argsort(owner, kind="stable")
            owner, found = owner[order], found[order]
            at = group_starts(owner)
            for a, b in zip(at, np.append(at[1:], len(owner))):
                out.append((shard_of(int(owner[a]), shards), int(owner[a]), REMOVED, found[a:b].tobytes(), b""))
        by_shard: dict[int, list] = {}
        for entry in firsts:
            by_shard.setdefault(xxhash.xxh3_64_intdigest(entry[0]) % shards, []).append(entry)
        for shard, entries in by_shard.items():
            entries.sort()
            out.append((shard, -1, FIRSTS, np.array([e[1:] for e in entries], FIRST).tobytes(), b"".join(e[0] for e in entries)))
        return pa.Table.from_batches([_rows(out)])

    return run


def _merge(method, shards: int):
    width = method.window_bytes

    def run(table: pa.Table) -> pa.Table:
        out, runs = [], []
        for row in table.to_pylist():
            if row["kind"] == REMOVED:
                out.append((0, row["pack"], REMOVED, row["meta"], b""))
            else:
                runs.append((np.frombuffer(row["body"], f"V{width}"), np.frombuffer(row["meta"], FIRST)))
        if runs:
            # A byte after each window keeps numpy from taking zero bytes at the end as padding.
            texts = [np.frombuffer(b"".join(w.tobytes()[i : i + width] + b"\1" for i in range(0, len(w) * width, width)), f"S{width + 1}") for w, _ in runs]
            ordered = np.unique(np.concatenate(texts))
            smallest = np.full(len(ordered), np.iinfo("i8").max)
            spots = [np.searchsorted(ordered, t) for t in texts]
            for spot, (_, meta) in zip(spots, runs):
                np.minimum.at(smallest, spot, meta["doc"])
            by_pack: dict[int, list] = {}
            for spot, (_, meta) in zip(spots, runs):
                for m in meta[meta["doc"] > smallest[spot]]:
                    by_pack.setdefault(int(m["pack"]), []).append((int(m["idx"]), int(m["start"]), int(m["start"]) + method.window))
            for pack, found in by_pack.items():
                out.append((0, pack, REMOVED, np.array(found, INTERVAL).tobytes(), b""))
        return pa.Table.from_batches([_rows(out)])

    return run


def covered(units, replies, window: int) -> np.ndarray:
    """Which units of a pack are removed."""
    found = [np.frombuffer(r["meta"], INTERVAL) for r in replies.as_py() or []]
    n = int(units.starts[-1])
    depth = np.zeros(n + 1, "i8")
    for f in found:
        base = units.starts[f["idx"]]
        np.add.at(depth, base + f["start"], 1)
        np.add.at(depth, base + f["end"], -1)
    return np.cumsum(depth[:n]) > 0


def _finish(method, with_text: bool):
    def run(batches):
        for pack, row in unpacked(batches):
            units = method.units(pack)
            gone = covered(units, row["replies"], method.window)
            out = []
            for i, (a, b) in enumerate(zip(units.starts[:-1].tolist(), units.starts[1:].tolist())):
                cut = gone[a:b]
                n_removed = int(np.count_nonzero(cut))
                n_spans = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + cut[0]) if n_removed else 0
                digest = hashlib.sha256(method.kept(units, a, b, cut if n_removed else None)).hexdigest()
                text = None
                if with_text and pack.lens[i] >= 0:
                    text = method.remaining(pack, units, i, a, b, cut if n_removed else None).decode("utf-8", "replace")
                out.append((int(pack.ids[i]), b - a, n_removed, n_spans, digest, text, pack.tags[i]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "text", "tag"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def emit_anchors(method):
    def emit(pack, row):
        keys, docs, _, _ = method.anchors(method.units(pack))
        return counted(keys, docs)

    return emit


def without_repeats(docs: DataFrame, method, with_text: bool = False, tag: str | None = None) -> DataFrame:
    """Per document: doc_id, n_units, n_removed, n_spans, kept_sha256, text (what remains, if asked for), tag."""
    spark = docs.sparkSession
    packs = pack_documents(docs, tag)
    shared = shared_keys(packs, emit_anchors(method), method.anchors_per_byte)
    n_fragments = shared.agg(F.sum("n_first")).first()[0] or 0
    shards = max(2 * shuffle_tasks(spark), int(n_fragments * method.fragment_bytes // SHARD_BYTES))
    asked = with_replies(packs, shared.select("pack", "keys", "docs", "occurrences"))
    pieces = asked.mapInArrow(_fragments(method, shards), _SENT)
    resolved = pieces.groupBy("shard").applyInArrow(_resolve(method, shards), _SENT)
    merged = resolved.groupBy("shard").applyInArrow(_merge(method, shards), _SENT)
    answers = with_replies(packs, merged.select("pack", "meta"))
    schema = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, text string, tag string"
    return answers.mapInArrow(_finish(method, with_text), schema)
