"""Substring dedup by recompression: remove word runs that an earlier document has.

In rounds, runs of one symbol and then chosen pairs of neighbours get a new symbol. A symbol's name is a
hash of what it stands for, so every task names alike and equal stretches of text come to the same symbols,
except near their ends. What can depend on the text around a window is cut from the window's ends in each
round; the symbols left in the last round that leaves any are shared by all equal windows. The smallest of
them is the window's anchor. How anchors reveal and shards verify repeats: ``repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.packs import Pack, mix
from likeness.llm.repeats import no_runs, runs_of, without_repeats
from likeness.llm.words import WordSpans

ROUNDS = 5
BLOCK = 1 << 14


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Words as numbers, and the different words."""
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), "i8", len(words))
    return numbers, list(known)


def one_round(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, turn: int) -> tuple:
    """Name runs, then pairs; ``first`` and ``last`` (exclusive) bound each window's certain symbols."""
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    run = np.cumsum(new, dtype="i4") - np.int32(1)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(symbols))).astype("u8")
    named = symbols[at]
    named = np.where(length > 1, mix(named + length * np.uint64(0xA24BAED4963EE407)), named)
    # The outer runs of a window may go on outside of it.
    first, last = run[first] + 1, run[last - 1]
    side = (mix(named + np.uint64(turn * 0x9FB21C651E98DF25 & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
    joined = np.zeros(len(named), bool)
    joined[:-1] = ~side[:-1] & side[1:]
    # An outer right half may belong to a pair that begins outside, an outer left half to one that ends there.
    some = first < last
    first = first + (some & side[np.minimum(first, len(side) - 1)])
    some = first < last
    last = last - (some & ~side[np.maximum(last - 1, 0)])
    second = np.zeros(len(named), bool)
    second[1:] = joined[:-1]
    follower = np.append(named[1:], np.uint64(0))
    named = np.where(joined, mix(named * np.uint64(0xE7037ED1A0B428DB) + mix(follower)), named)
    number = np.cumsum(~second, dtype="i4") - np.int32(1)
    some = first < last
    new_first = np.where(some, number[np.minimum(first, len(number) - 1)], 0)
    new_last = np.where(some, number[np.maximum(last - 1, 0)] + 1, 0)
    return named[~second], new_first, new_last


def smallest_in(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of each (not empty) range."""
    out = np.empty(len(first), "u8")
    level = np.frexp((last - first).astype("f8"))[1] - 1
    table, span = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        mine = level == k
        out[mine] = np.minimum(table[first[mine]], table[last[mine] - span])
        if span < len(table):
            table = np.minimum(table[:-span], table[span:])
        span *= 2
    return out


class WordRepeats:
    """Windows of words; the anchor is a symbol of the last round that has a certain one within the window."""

    def __init__(self, window: int = 50):
        if window < 2:
            raise ValueError("windows have at least two words")
        self.window, self.window_bytes = window, 16
        self.anchors_per_byte = 1 / 40
        self.fragment_bytes = 7 * (window + 8)

    def units(self, pack: Pack) -> WordSpans:
        return WordSpans(pack)

    def anchors(self, units: WordSpans) -> tuple:
        n = len(units) - self.window + 1
        if n < 1:
            return no_runs()
        symbols = units.hashes()
        keys = np.empty(n, "u8")
        for a in range(0, n, BLOCK):
            keys[a : a + BLOCK] = self._anchors(symbols[a : a + BLOCK + self.window - 1])
        return runs_of(keys, units.starts, self.window)

    def _anchors(self, symbols: np.ndarray) -> np.ndarray:
        """The anchor of each window of one stretch of words."""
        n = len(symbols) - self.window + 1
        first = np.arange(n, dtype="i4")
        last = first + np.int32(self.window)
        keys = np.empty(n, "u8")
        # Neighbouring windows with the same certain symbols are one entry: ``live`` to ``until`` (exclusive).
        live, until = first, first + np.int32(1)
        for turn in range(ROUNDS + 1):
            if turn < ROUNDS:
                following, a, b = one_round(symbols, first, last, turn)
                ended = a >= b
            else:
                ended = np.ones(len(live), bool)
            if ended.any():
                ranked = mix(symbols + np.uint64((turn + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
                found = smallest_in(ranked, first[ended], last[ended])
                sizes = until[ended] - live[ended]
                spots = np.repeat(live[ended] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                keys[spots] = np.repeat(found, sizes)
            kept = ~ended
            if not kept.any():
                break
            symbols, first, last, live, until = following, a[kept], b[kept], live[kept], until[kept]
            new = np.ones(len(live), bool)
            new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (live[1:] != until[:-1])
            lead = np.flatnonzero(new)
            until = until[np.append(lead[1:], len(live)) - 1]
            first, last, live = first[lead], last[lead], live[lead]
        return keys

    def text(self, units: WordSpans, start: int, count: int) -> bytes:
        return units.join(start, start + count + self.window - 1)

    def same(self, texts: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Numbers of the different windows: stretches of 1, 2, 4, ... words are numbered from two halves each."""
        words = [t.split(b" ") for t in texts]
        sizes = np.fromiter(map(len, words), "i8", len(words))
        names = numbered([w for ws in words for w in ws])[0]
        span = 1
        while span < self.window:
            step = min(span, self.window - span)
            pairs = names[:-step] * (len(names) + 1) + names[step:]
            names = np.append(np.unique(pairs, return_inverse=True)[1], np.zeros(step, "i8"))
            span += step
        begin = np.repeat(np.cumsum(sizes) - sizes, counts)
        place = np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.unique(names[begin + place], return_inverse=True)[1]

    def one_window(self, text: bytes, place: int) -> bytes:
        return hashlib.blake2b(b" ".join(text.split(b" ")[place : place + self.window]), digest_size=16).digest()

    def kept(self, units: WordSpans, a: int, b: int, cut) -> bytes:
        whole = units.join(a, b)
        return whole if cut is None else b" ".join(w for w, c in zip(whole.split(), cut.tolist()) if not c)

    def remaining(self, pack: Pack, units: WordSpans, i: int, a: int, b: int, cut) -> bytes:
        """The text without the removed words; each word takes the white space after it along."""
        text = pack.data[pack.starts[i] : pack.starts[i + 1]]
        if cut is None:
            return text
        begins = [*(units.begin[a:b] - pack.starts[i]).tolist(), len(text)]
        return text[: begins[0]] + b"".join(text[x:y] for x, y, c in zip(begins, begins[1:], cut.tolist()) if not c)


def substring_dedup(docs: DataFrame, window: int = 50, with_text: bool = True, tag: str | None = None) -> DataFrame:
    """Remove each word covered by a run of ``window`` words that also starts in a document with a smaller id.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored, but for one named as ``tag``, which is
    handed on. Words are runs of anything but ASCII white space. Result, a row per document: doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space) and, if asked for, ``text``. A null text
    has no words, its ``text`` stays null. Shorter texts lose nothing. Equal ids do not remove from each
    other. Rows without an id are left out. An empty table gives an empty result.
    """
    found = without_repeats(docs, WordRepeats(window), with_text, tag)
    more = (["text"] if with_text else []) + (["tag"] if tag else [])
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256", *more)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
