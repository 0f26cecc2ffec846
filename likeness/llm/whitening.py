"""Whitening of embeddings with an exact scatter matrix from bit slices.

Every coordinate is a whole number. Less the least value of its dimension it is short, and bit ``a`` of dimension ``i`` of 64
rows is one word. The product sum of two dimensions is ``sum 2^(a + b) popcount(i_a & j_b)``: nothing is rounded, in whatever
order tasks are added up. The matrix is centred as whole numbers, ``n C - S S'``, before it meets a float.

What leaves a task does not depend on its rows: a count for each pair of dimensions and power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.session import stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Products beyond this are cut off before they become whole numbers.
FARTHEST = 9.0e18
CHUNK_CELLS = 1 << 20
SHOWN_CELLS = 1 << 17
#: Eigenvalues below this part of the largest one, times the dimension, are rounding of zero.
FLAT = 1e-15


def lattice(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows that can be used, with their coordinates as whole numbers: vec_id, x."""
    c = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & F.forall(c, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(c, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-FARTHEST)), F.lit(FARTHEST))) + offset)
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], width: int, cells: int = CHUNK_CELLS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their coordinates as a matrix of so many cells, or 64 rows."""
    rows = max(64, cells // max(width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(part.num_rows, width)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vectors in a task: rows, and the least and largest value of each dimension."""
    held: dict[int, tuple] = {}
    for batch in batches:
        lengths = np.asarray(batch.column("x").value_lengths())
        for width in np.unique(lengths).tolist():
            same = batch.filter(pa.array(lengths == width)) if (lengths != width).any() else batch
            for part, x in matrices(iter([same]), width):
                n, low, high = held.get(width, (0, x[0], x[0]))
                held[width] = (n + len(x), np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
    rows = [(w, n, i, int(lo), int(hi)) for w, (n, low, high) in held.items() for i, (lo, hi) in enumerate(zip(low, high))]
    columns = zip(*rows) if rows else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["width", "n", "dim", "low", "high"])


def planes(u: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of a matrix of whole numbers from 0: (dimensions, bits, words), 64 rows to a word."""
    rows, width = u.shape
    padded = np.zeros((width, -(-rows // 64) * 64), "u8")
    padded[:, :rows] = u.T
    sliced = [((padded >> np.uint64(a)) & np.uint64(1)).astype("u1") for a in range(bits)]
    return np.stack([np.packbits(s, axis=1, bitorder="little") for s in sliced], axis=1).view("<u8")


def cross_counts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of dimensions ``i <= j`` the common bits by power of two; of each dimension the bits by power."""
    width, bits, _ = words.shape
    counts = np.zeros((width, width, 2 * bits - 1), "i8")
    for i in range(width):
        for a in range(bits):
            common = np.bitwise_count(words[i:] & words[i, a]).sum(axis=2, dtype="i8")  # (j, b)
            counts[i, i:, a : a + bits] += common
    return counts, np.bitwise_count(words).sum(axis=2, dtype="i8")


def _slices(low: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(low)
        pairs, single = np.zeros((width, width, 2 * bits - 1), "i8"), np.zeros((width, bits), "i8")
        for _, x in matrices(batches, width):
            both, own = cross_counts(planes((x - low).view("u8"), bits))
            pairs, single = pairs + both, single + own
        i, j, power = np.nonzero(pairs)
        k, weight = np.nonzero(single)
        columns = [np.append(i, k), np.append(j, np.full(len(k), -1)), np.append(power, weight)]
        counts = np.append(pairs[i, j, power], single[k, weight])
        yield pa.RecordBatch.from_arrays([pa.array(c.astype("i8")) for c in (*columns, counts)], names=["i", "j", "power", "n"])

    return run


class Fit:
    """Exact sums of the fit list and what follows from them; bounded by the square of the dimension."""

    def __init__(self, n: int, low: np.ndarray, bits: int, sums: np.ndarray, scatter: np.ndarray, components: int):
        self.n, self.low, self.bits, self.sums = n, low, bits, sums
        centred = n * scatter - np.outer(sums, sums)  # Python integers: n^2 times the covariance
        self.covariance = np.array([[int(c) / (n * n) for c in row] for row in centred], "f8").reshape(centred.shape)
        self.trace = sum(int(c) for c in np.diag(centred)) / (n * n) if len(centred) else 0.0
        values, vectors = np.linalg.eigh(self.covariance) if len(centred) else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values, kind="stable")
        top = values[order][:1].sum()
        order = order[(values[order] > len(values) * FLAT * top) & (values[order] > 0)][:components]
        self.values, vectors = values[order], vectors[:, order]
        # One sign for all: the entry that is largest in absolute value is positive.
        lead = np.abs(vectors).argmax(0) if len(order) else np.zeros(0, "i8")
        self.vectors = vectors * np.sign(vectors[lead, np.arange(len(order))])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n x - S`` exactly, as 64-bit numbers where all of them fit, else as Python ones."""
        fits = self.n * (1 << self.bits) < 1 << 62
        u = (x - self.low).view("u8")
        return u.astype("i8") * self.n - self.sums.astype("i8") if fits else u.astype(object) * self.n - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype("f8") @ (self.vectors / np.sqrt(self.values))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Sums, covariance and components of lattice rows; None if there are none.

    The dimension is that of most rows, the larger one if two are as frequent.
    """
    table = rows.mapInArrow(_ranges, "width long, n long, dim long, low long, high long")
    spans = table.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    widest = Window.orderBy(F.desc("n"), F.desc("width"))
    chosen = spans.filter("dim = 0").withColumn("place", F.row_number().over(widest)).filter("place = 1").select("width")
    found = spans.join(F.broadcast(chosen), "width").orderBy("dim").collect()  # a row for each dimension
    if not found:
        return None
    low = np.array([r["low"] for r in found], "i8")
    bits = max(1, max(r["high"] - r["low"] for r in found).bit_length())
    width, n = len(found), found[0]["n"]
    counted = rows.filter(F.size("x") == width).mapInArrow(_slices(low, bits), "i long, j long, power long, n long")
    sums, scatter = np.zeros(width, object), np.zeros((width, width), object)
    for r in counted.groupBy("i", "j", "power").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["j"] < 0:
            sums[r["i"]] += r["n"] << r["power"]
        else:
            scatter[r["i"], r["j"]] += r["n"] << r["power"]
    scatter = scatter + np.triu(scatter, 1).T
    return Fit(n, low, bits, sums, scatter, components)


def _products(fitted: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.values)
        total, squares = np.zeros(k), np.zeros((k, k))
        for _, x in matrices(batches, len(fitted.low)):
            z = fitted.whitened(x)
            total, squares = total + z.sum(0), squares + z.T @ z
        flat = np.concatenate([total, squares.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "total"])

    return run


def identity_error(rows: DataFrame, fitted: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured on all rows."""
    k = len(fitted.values)
    sums = rows.mapInArrow(_products(fitted), "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    flat = np.zeros(k + k * k)
    for r in sums.collect():  # a row for each pair of components
        flat[r["cell"]] = r["total"]
    mean = flat[:k] / fitted.n
    # The rows are centred before; what is left of their mean is rounding.
    return float(np.abs(flat[k:].reshape(k, k) / fitted.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


_SHOWN = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def _shown(fitted: Fit, error: float):
    decimal = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.values)
        width = len(fitted.low)
        narrow = (fitted.n << fitted.bits) ** 2 * width < 1 << 62
        for part, x in matrices(batches, width, SHOWN_CELLS):
            rows, centred = len(x), fitted.centred(x)
            far = (centred.astype("i8" if narrow else object) ** 2).sum(1)
            far = [int(d) for d in far]
            exact = pa.array([d if d < 10**38 else None for d in far], pa.int64()).cast(decimal) if narrow else pa.array(
                [_decimal(d) for d in far], decimal
            )
            z = fitted.whitened(x)
            each = lambda values: pa.array(values).take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), rows)),
                    pa.array(np.full(rows * k, fitted.n)),
                    each([d if d < 1 << 63 else None for d in far]).cast(pa.int64()),
                    exact.take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(z.ravel()),
                    pa.array(np.tile(fitted.values / fitted.trace, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=[c.split()[0] for c in _SHOWN.split(", ")],
            )

    return run


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value) if value < 10**38 else None


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every usable row along the leading components of the covariance, scaled to variance one.

    Columns: vec_id, component (from 1), n, deviation, deviation_exact, whitened, explained, identity_error. ``vectors`` has ``vec_id`` and
    ``embedding``; other columns are ignored. Rows whose vector is null or holds a null or an entry that is not finite are
    left out, and so are empty vectors and those of another length than most rows have. A null vec_id is an id like any other and equal rows
    count each. Components without variance have no rows, since nothing can be scaled to one there. A deviation that does not fit a
    long is null in ``deviation`` and stands in ``deviation_exact``, as far as 38 digits hold it. Entries beyond 9e18 / 64 count as
    that. An empty table gives an empty result.
    """
    rows = stored(lattice(vectors), "lattice")
    fitted = fit(rows, components)
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], _SHOWN)
    used = rows.filter(F.size("x") == len(fitted.low))
    return used.mapInArrow(_shown(fitted, identity_error(used, fitted)), _SHOWN)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    whitened = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitened.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
