"""Which sections two documents have in common, for listed pairs.

A common run is a stretch of tokens that stands in both documents and cannot be made longer on either side. It begins
where the same tokens follow different ones, and ends where they are followed by different ones. So runs are found
by their two ends only: an n-gram of one document meets the same n-gram of the other if what stands before it (or behind it)
differs. The many meetings inside a run, or inside text that repeats itself, are never made. On one diagonal
beginnings and ends take turns, which puts each with its own.

Runs can overlap. The longest are taken first; of each further one those pieces are kept that are still free
in both documents.

Texts move in compressed form to the cells of their pairs, and pairs of equal texts are worked out once in a cell. Tokens and
their places never become rows.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from likeness.functions.cutting import CODE_PATTERNS, with_text_code
from likeness.operators.cells import in_cells
from likeness.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHORTEST = 12
#: Shown in place of a mark that texts were once cut at.
MARK, SHOWN_MARK = "\x01", "\x02"


class Stream:
    """Tokens of one text as numbers, and its n-grams in the order of what stands before (or behind) them."""

    def __init__(self, tokens: np.ndarray, grams: np.ndarray, base: int):
        n = len(tokens) - len(grams) + 1
        self.grams, self.base, self.n = grams, base, n
        # 0 stands for the border of a text.
        self.before = grams * base + np.concatenate([[0], tokens[: len(grams) - 1] + 1]).astype("i8") if len(grams) else grams
        self.behind = grams * base + np.concatenate([tokens[n:] + 1, [0]]).astype("i8") if len(grams) else grams
        self.by_before, self.by_behind = np.argsort(self.before, kind="stable"), np.argsort(self.behind, kind="stable")
        self.sorted_before, self.sorted_behind = self.before[self.by_before], self.behind[self.by_behind]


def _met(one: Stream, two: Stream, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the same n-gram in both texts where its neighbour differs, or where there is none; by diagonal."""
    mine, order, theirs = getattr(one, side), getattr(two, f"by_{side}"), getattr(two, f"sorted_{side}")
    first, end = np.searchsorted(theirs, one.grams * one.base), np.searchsorted(theirs, (one.grams + 1) * one.base)
    some = np.flatnonzero(end > first)
    first, end, mine = first[some], end[some], mine[some]
    border = mine % one.base == 0
    same, other = np.where(border, first, np.searchsorted(theirs, mine)), np.where(border, first, np.searchsorted(theirs, mine, "right"))
    counts = np.concatenate([same - first, end - other])
    i = np.repeat(np.concatenate([some, some]), counts)
    within = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
    j = order[np.repeat(np.concatenate([first, other]), counts) + within]
    diagonal = np.lexsort((i, j - i))
    return i[diagonal], j[diagonal]


def runs_between(one: Stream, two: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All longest common runs of two texts: their starts in both and their lengths."""
    if not len(one.grams) or not len(two.grams):
        return (np.zeros(0, "i8"),) * 3
    i, j = _met(one, two, "before")
    return i, j, _met(one, two, "behind")[0] - i + one.n


def tiles_of(i: np.ndarray, j: np.ndarray, lengths: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Sections that do not overlap, longest runs first: their starts in both texts and their lengths, in order."""
    if not len(i):
        return []
    left, right = np.zeros(int((i + lengths).max()), bool), np.zeros(int((j + lengths).max()), bool)
    tiles = []
    for k in np.lexsort((j, i, -lengths)).tolist():
        a, b, size = int(i[k]), int(j[k]), int(lengths[k])
        taken = left[a : a + size] | right[b : b + size]
        if not taken.any():
            pieces = [(0, size)]
        else:
            turns = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype("i1")))
            pieces = [(s, e) for s, e in turns.reshape(-1, 2).tolist() if e - s >= n]
        for s, e in pieces:
            left[a + s : a + e] = right[b + s : b + e] = True
            tiles.append((a + s, b + s, e - s))
    return sorted(tiles)


class TextCell:
    """What texts of a cell have in common. Each text is cut once, when the first of its pairs comes."""

    def __init__(self, n: int):
        self.n, self.numbers, self.texts, self.streams, self.last = n, {}, {}, {}, (None, None)
        self.comments, self.pattern = map(re.compile, CODE_PATTERNS)
        #: N-grams are numbered by their halves: of each length on the way, the halves known so far in order, and their numbers.
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.expand = zstandard.ZstdDecompressor()

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """A number for each n-gram, equal for equal ones of all texts of the cell."""
        size, found = 1, ids
        while size < self.n:
            step = min(size, self.n - size)
            halves, place = np.unique(found[:-step] << 31 | found[step:], return_inverse=True)
            known, numbers = self.known.get(size + step, (halves[:0], halves[:0]))
            at = np.searchsorted(known, halves)
            new = np.append(known, -1)[at] != halves
            found = np.where(new, len(known) + np.cumsum(new) - 1, np.append(numbers, 0)[at])
            every = np.concatenate([known, halves[new]])
            order = np.argsort(every, kind="stable")
            self.known[size + step] = every[order], np.concatenate([numbers, found[new]])[order]
            found, size = found[place], size + step
        return found

    def numbered(self, key, tokens: list[str]) -> None:
        ids = np.fromiter((self.numbers.setdefault(t, len(self.numbers)) for t in tokens), "i8", len(tokens))
        self.streams[key] = Stream(ids, self.grams(ids), 1 << 31)

    def cut(self, key, code: bytes) -> None:
        text = self.comments.sub("", self.expand.decompress(code).decode()).replace(MARK, SHOWN_MARK)
        places = np.array([m.span() for m in self.pattern.finditer(text)], "i4").reshape(-1, 2)
        self.texts[key] = text, places
        self.numbered(key, [text[a:b] for a, b in places.tolist()])

    def sections(self, key1, key2) -> list[tuple]:
        found = []
        (one, places1), (two, places2) = self.texts[key1], self.texts[key2]
        for at, (i, j, length) in enumerate(tiles_of(*runs_between(self.streams[key1], self.streams[key2]), self.n), 1):
            text1, text2 = one[places1[i, 0] : places1[i + length - 1, 1]], two[places2[j, 0] : places2[j + length - 1, 1]]
            found.append((at, i, i + length, j, j + length, text1, text2))
        return found

    def rows(self, key1, key2, codes1: list[bytes], codes2: list[bytes], doc1, doc2) -> Iterator[tuple]:
        if self.last[0] != (key1, key2):
            for key, codes in ((key1, codes1), (key2, codes2)):
                if key not in self.streams:
                    self.cut(key, codes[0])
            self.last = (key1, key2), self.sections(key1, key2)
        for section in self.last[1]:
            yield doc1, doc2, *section

    def letters(self, row: tuple) -> int:
        return len(row[-1]) + len(row[-2])


class RunCell(TextCell):
    """The runs themselves, of texts that have been cut before."""

    def rows(self, key1, key2, codes1: list[bytes], codes2: list[bytes]) -> Iterator[tuple]:
        for key, codes in ((key1, codes1), (key2, codes2)):
            if key not in self.streams:
                self.numbered(key, json.loads(codes[0]))
        for start1, start2, length in zip(*(a.tolist() for a in runs_between(self.streams[key1], self.streams[key2]))):
            yield key1, key2, start1, start2, length

    def letters(self, row: tuple) -> int:
        return 0


def common_runs(pairs: DataFrame, streams: DataFrame, n: int = SHORTEST) -> DataFrame:
    """All longest common runs of ``n`` or more tokens of the pairs (doc1, doc2): start1, start2, length.

    ``streams`` has (doc_id, tokens), a row for each document.
    """
    keyed = pairs.select(F.col("doc1").alias("key1"), F.col("doc2").alias("key2")).filter("key1 IS NOT NULL AND key2 IS NOT NULL")
    items = streams.filter("tokens IS NOT NULL").select(F.col("doc_id").alias("key"), F.to_json("tokens").cast("binary").alias("code"))
    places = [StructField(c, IntegerType()) for c in ("start1", "start2", "length")]
    schema = StructType([StructField("doc1", pairs.schema["doc1"].dataType), StructField("doc2", pairs.schema["doc2"].dataType), *places])
    return in_cells(keyed, items, lambda: RunCell(n), schema)


def overlap_snippets(pairs: DataFrame, docs: DataFrame, n: int = SHORTEST) -> DataFrame:
    """The common sections of listed pairs, with their places and texts in both documents.

    ``pairs`` has (doc1, doc2), ``docs`` (doc_id, text). A row for each section: doc1, doc2, section (from 1, in the order of doc1),
    start1, end1, start2, end2 (tokens, the end not included), text1, text2 (as they stand, without comments). Sections
    have ``n`` tokens or more; pairs without any have no row, nor have those of a null text. Rows of an id that comes twice come twice.
    """
    listed = stored(pairs.select("doc1", "doc2").distinct(), "listed")
    ids = listed.select(F.explode(F.array("doc1", "doc2")).alias("doc_id")).distinct()
    texts = stored(with_text_code(docs.select("doc_id", "text")).join(ids, "doc_id", "left_semi"), "texts")
    named = lambda k: texts.select(F.col("doc_id").alias(f"doc{k}"), F.col("key").alias(f"key{k}"))
    keyed = listed.join(named(2), "doc2").join(named(1), "doc1").select("key1", "key2", "doc1", "doc2")
    items = texts.groupBy("key").agg(F.first("code").alias("code"))
    numbers = [StructField(c, IntegerType()) for c in ("section", "start1", "end1", "start2", "end2")]
    schema = StructType([*listed.schema.fields, *numbers, StructField("text1", StringType()), StructField("text2", StringType())])
    return in_cells(keyed, items, lambda: TextCell(n), schema, spread_by="doc2")
