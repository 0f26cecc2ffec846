"""Packing of token sequences by non-negative least squares on the histogram of lengths.

Documents are cut at multiples of the sequence length. Lengths are rounded up to a grid; combinations of up
to three grid lengths that fill a sequence are the columns of a least-squares problem whose right side is
the histogram. Its rounded solution says how often each combination is used; what is left of the histogram
is combined greedily, longest first. All this is about histograms of fixed size. Pieces then take their
places by their rank among the pieces of their grid length.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm.keys import group_starts, places
from likeness.llm.packs import passing_packs
from likeness.llm.words import LOWER, WordSpans
from likeness.operators.ranking import hash_rank
from likeness.session import stored

END = 1
#: Different words whose tokens a worker process keeps at hand; the number has no influence on the result.
KEPT_WORDS = 1 << 19
#: Words that go to the tokenizer at a time; the number has no influence on the result either.
LEARNT_WORDS = 1 << 12


class WordTokens:
    """Token ids of texts, word by word: this tokenizer treats what white space parts on its own.

    Words are known by their hash, in sorted arrays that take few bytes a word: a small recent pair and a
    large one into which it is merged now and then.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, "u8"), np.zeros(0, "u8")]
        self.at = [np.zeros(0, "i8"), np.zeros(0, "i8")]
        self.size = [np.zeros(0, "i4"), np.zeros(0, "i4")]
        self.flat, self.n_flat = np.zeros(1 << 16, "u2"), 0

    @classmethod
    def of_process(cls, path: str) -> WordTokens:
        """One for each worker process, which outlives its tasks."""
        kept = sys.modules.setdefault("_kept_word_tokens", types.ModuleType("_kept_word_tokens")).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _add(self, into: int, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        keys = np.append(self.keys[into], keys)
        order = np.argsort(keys)
        self.keys[into] = keys[order]
        self.at[into], self.size[into] = np.append(self.at[into], at)[order], np.append(self.size[into], size)[order]

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        begin, size = self.n_flat, np.empty(len(words), "i4")
        for at in range(0, len(words), LEARNT_WORDS):  # an encoding takes many times its ids' bytes
            some = words[at : at + LEARNT_WORDS]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            size[at : at + len(some)] = [len(ids) for ids in found]
            total = sum(map(len, found))
            while self.n_flat + total > len(self.flat):
                self.flat = np.append(self.flat, np.zeros(len(self.flat), "u2"))
            self.flat[self.n_flat : self.n_flat + total] = np.fromiter((i for ids in found for i in ids), "u2", total)
            self.n_flat += total
        self._add(1, keys, begin + np.cumsum(size, dtype="i8") - size, size)
        if len(self.keys[1]) * 4 > len(self.keys[0]):
            self._add(0, self.keys[1], self.at[1], self.size[1])
            for part in (self.keys, self.at, self.size):
                part[1] = part[1][:0]

    def of_words(self, data: bytes, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each word has."""
        order = np.argsort(hashes)
        first = group_starts(hashes[order])
        different, lead = hashes[order][first], order[first]
        if len(self.keys[0]) > KEPT_WORDS:
            self.clear()
        new = ~(places(self.keys[0], different)[0] | places(self.keys[1], different)[0])
        if new.any():
            spots = lead[new]
            self._learn(different[new], [data[b:e].decode("utf-8", "replace") for b, e in zip(begin[spots].tolist(), end[spots].tolist())])
        at, size = np.zeros(len(different), "i8"), np.zeros(len(different), "i8")
        for keys, starts, sizes in zip(self.keys, self.at, self.size):
            hit, spot = places(keys, different)
            at[hit], size[hit] = starts[spot[hit]], sizes[spot[hit]]
        times = np.diff(np.append(first, len(hashes)))
        start, counts = np.empty(len(hashes), "i8"), np.empty(len(hashes), "i8")
        start[order], counts[order] = np.repeat(at, times), np.repeat(size, times)
        spots = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return self.flat[spots].astype("<u4"), counts


def _with_marks_apart(data: bytes, spans: WordSpans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a full stop or comma after a letter cut off, which is a token of its own anyway, and the doc starts."""
    raw = np.frombuffer(data, "u1")
    begin, end = spans.begin, spans.end
    last = raw[end - 1] if len(end) else raw[:0]
    before = raw[np.maximum(end - 2, 0)] if len(end) else raw[:0]
    letter = ((before | 32) >= 97) & ((before | 32) <= 122) & (end - begin > 1)
    cut = letter & ((last == 46) | (last == 44))
    place = np.arange(len(begin)) + np.cumsum(cut) - cut
    b, e = np.empty(len(begin) + int(cut.sum()), "i8"), np.empty(len(begin) + int(cut.sum()), "i8")
    b[place], e[place] = begin, end - cut
    b[place[cut] + 1], e[place[cut] + 1] = end[cut] - 1, end[cut]
    shifted = np.append(place, len(b))
    return b, e, shifted[spans.starts]


def _pieces(tokenizer: str, length: int, keep_ids: bool):
    def run(batches):
        tokens = WordTokens.of_process(tokenizer)
        for pack, rows in passing_packs(batches):
            # The tokenizer lower-cases; doing it before makes fewer different words. Its special tokens are
            # in lower case, so texts that might spell one in capitals stay as they are.
            if b"<|" not in pack.data:
                pack.data = pack.data.translate(LOWER)
            spans = WordSpans(pack)
            begin, end, starts = _with_marks_apart(pack.data, spans)
            spans.begin, spans.end = begin, end
            ids, counts = tokens.of_words(pack.data, begin, end, spans.hashes())
            bounds = np.append(0, np.cumsum(counts))[starts]
            out = []
            for doc, a, b in zip(rows.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                whole = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                for at in range(0, len(whole), length):
                    piece = whole[at : at + length].tobytes()
                    out.append((doc, at, len(piece) // 4, zlib.crc32(piece), len(whole), piece if keep_ids else None))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    return run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def combinations(cells: int) -> list[tuple[int, ...]]:
    """One, two or three grid lengths that sum up to ``cells``."""
    found: list[tuple[int, ...]] = [(cells,)]
    found += [(cells - a, a) for a in range(1, cells // 2 + 1)]
    found += [(cells - a - b, a, b) for b in range(1, cells // 3 + 1) for a in range(b, (cells - b) // 2 + 1)]
    return found


def least_squares(columns: list[tuple[int, ...]], target: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Repeat counts, none negative, whose combinations come closest to the histogram (Lawson and Hanson)."""
    matrix = np.zeros((len(target), len(columns)))
    for j, column in enumerate(columns):
        np.add.at(matrix[:, j], np.array(column) - 1, 1)
    solution, active = np.zeros(len(columns)), np.zeros(len(columns), bool)
    for _ in range(rounds):
        slope = matrix.T @ (target - matrix @ solution)
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, float(np.abs(target).max())):
            break
        active[j] = True
        while True:
            mine = np.flatnonzero(active)
            trial = np.linalg.lstsq(matrix[:, mine], target, rcond=None)[0]
            if (trial > 0).all():
                solution[:] = 0
                solution[mine] = trial
                break
            held = solution[mine]
            low = trial <= 0
            step = float(np.min(held[low] / np.maximum(held[low] - trial[low], 1e-300)))
            solution[mine] = held + step * (trial - held)
            active[mine[low & (solution[mine] <= 1e-12 * max(1.0, float(held.max())))]] = False
            active &= solution > 0
            if not active.any():
                break
    return solution


def repeat_counts(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of grid lengths with their numbers of sequences; every piece of the histogram has its place.

    ``histogram[i]`` is the number of pieces of grid length ``i + 1``; sequences have ``len(histogram)`` cells.
    """
    cells, left = len(histogram), histogram.astype("i8").copy()
    columns = combinations(cells)
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(column, count):
        if count > 0:
            plan.append((column, count))
            for cell in column:
                left[cell - 1] -= count

    solution = least_squares(columns, left.astype(float))
    for j in np.argsort(-solution, kind="stable")[: 4 * cells]:
        need = Counter(columns[j])
        use(columns[j], min(int(round(solution[j])), *(int(left[c - 1]) // k for c, k in need.items())))
    while left.any():
        longest = int(np.flatnonzero(left)[-1]) + 1
        column, room = [longest], cells - longest
        spare = left.copy()
        spare[longest - 1] -= 1
        while room and spare[:room].any():
            fit = int(np.flatnonzero(spare[:room])[-1]) + 1
            column.append(fit)
            spare[fit - 1] -= 1
            room -= fit
        need = Counter(column)
        use(tuple(column), min(int(left[c - 1]) // k for c, k in need.items()))
    return plan


def pack_sequences(docs: DataFrame, tokenizer: str, length: int = 2048, grid: int = 8, keep_ids: bool = True) -> DataFrame:
    """Cut documents into pieces and put the pieces into sequences of at most ``length`` tokens.

    ``docs`` has ``doc_id`` and ``text`` (null: empty); other columns are ignored. Each document's tokens end
    with id 1, so an empty text has one token. Result, a row per piece: doc_id, start (tokens of the document
    before it), length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ``ids`` (little-endian
    unsigned 32-bit). Within a sequence the pieces lie without gaps from 0; the rest up to ``length`` is
    padding. Equal rows are packed each. A null doc_id stays null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    run, schema = _pieces(tokenizer, length, keep_ids)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = stored(texts.mapInArrow(run, schema), "pieces").withColumn("cell", F.ceil(F.col("length") / grid).cast("int"))
    cells = length // grid
    histogram = np.zeros(cells, "i8")
    for cell, count in pieces.groupBy("cell").count().collect():  # a row for each grid length at most
        histogram[cell - 1] = count
    rows, taken, sequences = [], np.zeros(cells, "i8"), 0
    for column, count in repeat_counts(histogram):
        for slot, cell in enumerate(column):
            first = int(taken[cell - 1])
            rows.append((cell, first, first + count, sequences, slot))
            taken[cell - 1] += count
        sequences += count
    layout = spark.createDataFrame(rows, "cell int, first long, until long, base long, slot int")
    named = pieces.withColumn("_doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ranked = hash_rank(named, ["_doc", "start", "ids_crc32"], ["cell"], digits=2).withColumn("rank", F.col("rank") - 1)
    # The layout has a row for each place in a combination: its size depends on the grid alone.
    placed = ranked.join(F.broadcast(layout), "cell").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    sequence = Window.partitionBy("sequence_id").orderBy("slot")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return (
        placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("first"))
        .withColumn("offset", F.sum("length").over(sequence) - F.col("length"))
        .select(*columns, *(["ids"] if keep_ids else []))
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
