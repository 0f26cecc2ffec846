"""Texts cut and counted in Arrow batches: what ``functions/text.py`` states as columns, several times faster.

A text's tokens are needed in most jobs only as a bag, their number and their classes, so a list of them is made for one text
at a time and never becomes a column. The patterns are those of ``functions/text.py``.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from likeness.functions import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text behind one batch of results.
SLICE_BYTES = 1 << 20
#: Cells of a sketch.
SKETCH_CELLS = 256
#: Different tokens whose class is remembered.
KNOWN_TOKENS = 1 << 18
#: Different pairs of words that a task holds before it hands them on.
HELD_PAIRS = 1 << 21
BAG = ArrayType(StructType([StructField("token", StringType()), StructField("cnt", LongType())]))


def as_python(pattern: str) -> str:
    """A pattern for Java in the syntax of Python; its ``\\w`` and ``\\s`` mean ASCII only."""
    ascii_only = pattern.replace(r"\s\S", r"\x00-\U0010FFFF").replace(r"\w", "[a-zA-Z0-9_]").replace(r"\s", r"\t\n\x0B\f\r\x20")
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04X}", ascii_only)


# Only plain values travel to the executors.
CODE_PATTERNS = [as_python(p) for p in (tx.COMMENT_PATTERN, tx.TOKEN_PATTERN)]
WORD_PATTERNS = [as_python(p) for p in (tx.LINE_COMMENT_PATTERN, tx.BLOCK_COMMENT_PATTERN, tx.SPACE_RUN_PATTERN, tx.WORD_PATTERN)]


def code_cutter() -> Callable[[str], list[str]]:
    """Python's form of ``text.tokenize``."""
    comments, tokens = map(re.compile, CODE_PATTERNS)
    return lambda text: tokens.findall(comments.sub("", text))


def word_cutter() -> Callable[[str], list[str]]:
    """Python's form of ``text.word_tokens``."""
    line, block, space, words = map(re.compile, WORD_PATTERNS)
    return lambda text: words.findall(space.sub(" ", block.sub("", line.sub("", text))).strip(" "))


def token_coder(words: dict[str, str], element_types: list[str]) -> Callable[[str], str]:
    """Python's form of ``structure.token_code``, given its codes of words and the types whose arrays count."""

    def code(token: str) -> str:
        if token in words:
            return words[token]
        first = token[:1]
        if token.endswith("]"):
            return "y" if "A" <= first <= "Z" or re.sub(r"(\[\])+$", "", token) in element_types else "x"
        return "u" if "A" <= first <= "Z" else "a" if "a" <= first <= "z" or first == "_" else "x"

    return code


def sketched(bag: Counter) -> list[int]:
    cells = [0] * SKETCH_CELLS
    for token, count in bag.items():
        cells[crc32(token.encode()) % SKETCH_CELLS] += count
    return cells


def sliced(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch whose last column is a text's bytes, in slices of about ``SLICE_BYTES``, with the texts of each."""
    start, held, texts = 0, 0, []
    for i, value in enumerate(batch.column(batch.num_columns - 1)):
        data = value.as_buffer()
        texts.append(None if data is None else data.to_pybytes().decode("utf-8", "replace"))
        held += 0 if data is None else data.size
        if held >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start), texts
            start, held, texts = i + 1, 0, []
    if texts:
        yield batch.slice(start), texts


def counted_tokens(
    docs: DataFrame, *keep: str, text: str = "text", words: bool = False, code: Callable[[str], str] | None = None, sketch: bool = False
) -> DataFrame:
    """The columns ``keep`` with num_tokens, num_unique_tokens and bag of each text; nulls for a null text.

    Tokens are those of ``tokenize``, with ``words`` those of ``word_tokens``. With ``code`` there is a column ``codes`` too: a mark for the
    beginning and what that function makes of each token, in their order. With ``sketch`` there is a column ``sketch``, the number of tokens
    in each cell of a hash: two texts share at most the sum of the smaller numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, codes = (word_cutter if words else code_cutter)(), {}

        def coded(tokens: list[str]) -> str:
            if len(codes) > KNOWN_TOKENS:
                codes.clear()
            for token in set(tokens).difference(codes):
                codes[token] = code(token)
            return "^" + "".join([codes[token] for token in tokens])

        for batch in batches:
            for rows, texts in sliced(batch):
                names, counts, offsets, sizes, strings, cells = [], [], [0], [], [], []
                for value in texts:
                    tokens = [] if value is None else cut(value)
                    bag = Counter(tokens)
                    ordered = sorted(bag)
                    names += ordered
                    counts += [bag[token] for token in ordered]
                    offsets.append(len(names))
                    sizes.append(None if value is None else len(tokens))
                    if code:
                        strings.append(None if value is None else coded(tokens))
                    if sketch:
                        cells.append(None if value is None else sketched(bag))
                missing = [value is None for value in texts]
                number = [None if gone else b - a for gone, a, b in zip(missing, offsets, offsets[1:])]
                entries = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["token", "cnt"])
                bags = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries, mask=pa.array(missing))
                made = [pa.array(sizes, pa.int64()), pa.array(number, pa.int64()), bags]
                if code:
                    made.append(pa.array(strings, pa.string()))
                if sketch:
                    made.append(pa.array(cells, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *made], names=fields)

    kept = docs.select(*keep)
    added = [StructField("num_tokens", LongType()), StructField("num_unique_tokens", LongType()), StructField("bag", BAG)]
    schema = StructType([*kept.schema.fields, *added, *([StructField("codes", StringType())] if code else [])])
    if sketch:
        schema = schema.add("sketch", ArrayType(IntegerType()))
    fields = schema.names
    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(count, schema)


def with_text_code(docs: DataFrame) -> DataFrame:
    """The texts of (doc_id, text) that are not null in compressed form, with a key that is equal for equal texts: (doc_id, key, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for rows, texts in sliced(batch):
                data = [None if text is None else text.encode() for text in texts]
                keys = [None if d is None else blake2b(d, digest_size=16).digest() for d in data]
                codes = [None if d is None else squeeze.compress(d) for d in data]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(keys, pa.binary()), pa.array(codes, pa.binary())], names=["doc_id", "key", "code"])

    schema = StructType([docs.schema["doc_id"], StructField("key", BinaryType()), StructField("code", BinaryType())])
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema).filter("code IS NOT NULL")


def with_text_of(rows: DataFrame) -> DataFrame:
    """The texts behind the codes of (doc_id, code): (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            held, letters, start = [], 0, 0
            for i, code in enumerate(batch.column(1)):
                held.append(expand.decompress(code.as_py()).decode())
                letters += len(held[-1])
                if letters >= SLICE_BYTES or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(held)), pa.array(held, pa.string())], names=["doc_id", "text"])
                    held, letters, start = [], 0, i + 1

    return rows.select("doc_id", "code").mapInArrow(run, StructType([rows.schema["doc_id"], StructField("text", StringType())]))


def cut_words(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` with the ``words`` of each text in their order, those of ``word_tokens``; null for a null text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cutter()
        for batch in batches:
            for rows, texts in sliced(batch):
                cuts = [None if value is None else words(value) for value in texts]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(cuts, pa.list_(pa.string()))], names=fields)

    schema = StructType([*docs.select(*keep).schema.fields, StructField("words", ArrayType(StringType()))])
    fields = schema.names
    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(cut, schema)


def _numbered_words(texts: list[str | None], cut: Callable[[str], list[str]], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts as numbers, one text after the other, and the text that each is of."""
    cuts = [[] if value is None else cut(value) for value in texts]
    ids = np.fromiter((known.setdefault(w, len(known)) for words in cuts for w in words), "i8", sum(map(len, cuts)))
    return ids, np.repeat(np.arange(len(cuts)), [len(words) for words in cuts])


def near_words(docs: DataFrame, window: int, text: str = "text", held: int = HELD_PAIRS) -> DataFrame:
    """How often two words stand within a window of each other, in part: (a, b, n), each pair of words in one order only.

    A task holds counts of ``held`` different pairs at most and hands them on then, so a pair can come several times. Which of two words
    is ``a`` is told by their hashes, so a common word is it in half of its pairs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known, parts = word_cutter(), {}, []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype("i8")

        def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = list(known)
            words, rank, side = pa.array(names, pa.string()), np.empty(len(names), "i8"), np.array([crc32(w.encode()) & 1 for w in names], "i8")
            rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
            one, two = keys >> 32, keys & 0xFFFFFFFF
            turned = (rank[one] > rank[two]) ^ ((side[one] + side[two]) % 2 == 1)
            one, two = np.where(turned, two, one), np.where(turned, one, two)
            order = np.lexsort((two, one))
            for at in range(0, len(keys), 1 << 16):
                some = order[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(one[some])), words.take(pa.array(two[some])), pa.array(counts[some])], names=["a", "b", "n"])

        for batch in batches:
            for _, texts in sliced(batch):
                ids, of = _numbered_words(texts, cut, known)
                near = []
                for d in range(1, window + 1):
                    same = of[:-d] == of[d:]
                    x, y = ids[:-d][same], ids[d:][same]
                    near.append(np.minimum(x, y) << 32 | np.maximum(x, y))
                parts.append(np.unique(np.concatenate(near), return_counts=True))
                if sum(len(k) for k, _ in parts) > 2 * held:
                    parts = [merged()]
                    if len(parts[0][0]) > held or len(known) > held:
                        yield from rows(*parts[0])
                        known, parts = {}, []
        if parts:
            yield from rows(*merged())

    return docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(count, "a string, b string, n long")


def near_totals(docs: DataFrame, window: int, text: str = "text") -> DataFrame:
    """How many words stand within a window of each word, in part: (word, total), some rows for a word, none for one that is always alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = word_cutter()
        for batch in batches:
            for _, texts in sliced(batch):
                known: dict[str, int] = {}
                ids, of = _numbered_words(texts, cut, known)
                sizes = np.bincount(of, minlength=len(texts))
                place = np.arange(len(ids)) - (np.cumsum(sizes) - sizes)[of]
                around = np.minimum(place, window) + np.minimum(sizes[of] - 1 - place, window)
                totals = np.bincount(ids, around, len(known)).astype("i8")
                some = totals > 0
                words = pa.array(list(known), pa.string()).filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([words, pa.array(totals[some])], names=["word", "total"])

    return docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(count, "word string, total long")


def word_sums(
    docs: DataFrame, words: list[str], table: np.ndarray, times: np.ndarray, others: np.ndarray | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Sums of the vectors of the given words over each text, repeats counted: (key, total, weight, word, cnt).

    ``table`` has a row for each word, the sum of its vectors, and ``times`` their number. A text with none of the words has no total. ``others`` has
    marks, a byte each, at the ``crc32`` of further words, by its length: of those that may be among them each comes in a row of its own, with its number.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, number = word_cutter(), {word: i for i, word in enumerate(words)}
        for batch in batches:
            for rows, texts in sliced(batch):
                ids, totals, weights, names, counts = [], [], [], [], []
                for k, value in enumerate(texts):
                    bag = Counter([] if value is None else cut(value))
                    places = np.array([number.get(word, -1) for word in bag], "i8")
                    often = np.fromiter(bag.values(), "f8", len(bag))
                    known = places >= 0
                    if known.any():
                        ids.append(k)
                        totals.append(often[known] @ table[places[known]])
                        weights.append(float(often[known] @ times[places[known]]))
                        names.append(None)
                        counts.append(None)
                    if others is not None:
                        rest = [word for word, is_known in zip(bag, known.tolist()) if not is_known and others[crc32(word.encode()) % len(others)]]
                        ids += [k] * len(rest)
                        totals += [None] * len(rest)
                        weights += [None] * len(rest)
                        names += rest
                        counts += [bag[word] for word in rest]
                if ids:
                    made = [pa.array(totals, pa.list_(pa.float64())), pa.array(weights, pa.float64()), pa.array(names, pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(ids, pa.int64())), *made], names=fields)

    added = [StructField("total", ArrayType(DoubleType())), StructField("weight", DoubleType()), StructField("word", StringType()), StructField("cnt", LongType())]
    schema = StructType([docs.schema[key], *added])
    fields = schema.names
    return docs.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)
