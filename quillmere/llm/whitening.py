"""Whitening of embeddings: principal components of integer vectors, scaled to unit variance.

Entries become integers, x = floor(1024 * c) + 100000, so that sums and deviations are exact. The
covariance is made of centred outer products in double-double arithmetic. A block of centred vectors
(each entry a double and its error) is split, without error, into slices of so few bits that the
product of two slices over the whole block is exact in a double, in whatever order it is added
(the error-free transformation of matrix products of Ozaki, Ogita, Oishi and Rump, 2012). These exact
products are added to a high and a low part by two-sum. Tasks hand on their high and low parts; they
meet row by row of the matrix and are merged the same way, streamed, so no task holds more than one
row of the sums. The driver gets width x width sums, whatever the number of vectors.

Eigenvalues and vectors come from LAPACK's tridiagonal divide-and-conquer solver (syevd, which
numpy.linalg.eigh calls). Vectors are then read once more and projected; the covariance of what
comes out, measured in the same way, gives the identity error.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are left out. All other vectors must
be of one width (else ValueError). Repeated and null ids are rows like others. Without vectors the
result is empty. A component without variance (eigenvalue of at most width * 2**-52 of the largest)
is whitened to 0 and explains 0; it then keeps its identity error of 1. An entry beyond 2**53 / 1024 is taken
as that bound; deviations are decimals (null beyond 38 digits), and the query gives null where one does not fit in a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import prepare, table, written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a block, bits of a slice and slices: 2 * BITS + log2(BLOCK) is at most 53, so slice products are exact.
BLOCK, BITS, SLICES = 4096, 20, 4
Centre = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its exact error (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Doubled:
    """An array of sums, each a high and a low double."""

    def __init__(self, high: np.ndarray, low: np.ndarray | None = None) -> None:
        self.high, self.low = high, np.zeros_like(high) if low is None else low

    def add(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        s, e = two_sum(self.high, high)
        t, f = two_sum(self.low, low + np.zeros_like(s))
        s, e = two_sum(s, e + t)
        self.high, self.low = two_sum(s, e + f)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """SLICES arrays that add up to high + low but for the last BITS * SLICES bits below a column's largest entry.

    Adding and taking away a power of two rounds to BITS bits; what is left is exact."""
    most = np.max(np.abs(high), axis=0)
    top = np.where(most > 0, 2.0 ** np.ceil(np.log2(np.where(most > 0, most, 1.0)) + 1e-9), 1.0)
    out = []
    for k in range(SLICES):
        anchor = top * 2.0 ** (53 - BITS * (k + 1))
        part = (high + anchor) - anchor
        out.append(part)
        high, low = two_sum(high - part, low)
    return out


def add_products(total: Doubled, high: np.ndarray, low: np.ndarray) -> None:
    """Adds the outer products of the rows high + low, by exact products of their slices."""
    for at in range(0, len(high), BLOCK):
        parts = slices(high[at : at + BLOCK], low[at : at + BLOCK])
        for i in range(SLICES):
            for j in range(i, SLICES - i):
                product = parts[i].T @ parts[j]
                total.add(product)
                if i != j:
                    total.add(product.T)


def add_rows(total: Doubled, high: np.ndarray) -> None:
    """Adds the rows, by exact sums of their slices."""
    for at in range(0, len(high), BLOCK):
        for part in slices(high[at : at + BLOCK], np.zeros_like(high[at : at + BLOCK])):
            total.add(part.sum(axis=0))


def centred(x: np.ndarray, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """x minus a centre of high and low doubles, as high and low doubles."""
    s, e = two_sum(x, -centre[0])
    return two_sum(s, e - centre[1])


def integers(vectors: pa.Array) -> np.ndarray:
    """The integer vectors of a batch, as doubles that hold them exactly."""
    if not len(vectors):
        return np.zeros((0, 1))
    widths = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors of {len(widths)} widths: {widths[:4]}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, int(widths[0]))
    return np.clip(np.floor(flat * SCALE), -(2.0**53), 2.0**53) + SHIFT


def doubles(vectors: pa.Array) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 1))
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _parts(totals: list[tuple[int, int, Doubled]]) -> Iterator[pa.RecordBatch]:
    """Rows (width, i, n, sums): row i of the matrices, high and low doubles as bytes."""
    for n, width, total in totals:
        high, low = np.atleast_2d(total.high), np.atleast_2d(total.low)
        sums = [np.concatenate([h, e]).tobytes() for h, e in zip(high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([width] * len(sums), pa.int32()), pa.array(np.arange(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array(sums, pa.binary())], names=["width", "i", "n", "sums"])


def _moments(batches: Iterator[pa.RecordBatch], rows: Callable[[pa.Array], np.ndarray], centre: Centre | None) -> Iterator[pa.RecordBatch]:
    """A task's sums of rows, or of their centred outer products."""
    n, total = 0, None
    for batch in batches:
        x = rows(batch.column("vector"))
        if not len(x):
            continue
        d = x.shape[1]
        if total is None:
            total = Doubled(np.zeros(d) if centre is None else np.zeros((d, d)))
        if total.high.shape[-1] != d:
            raise ValueError(f"vectors of two widths: {total.high.shape[-1]} and {d}")
        n += len(x)
        if centre is None:
            add_rows(total, x)
        else:
            add_products(total, *centred(x, centre))
    if total is not None:
        yield from _parts([(n, total.high.shape[-1], total)])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the parts of equal (width, i), which come sorted, one row of sums in memory."""
    held, n, total = None, 0, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([np.concatenate([total.high, total.low]).tobytes()], pa.binary())], names=["width", "i", "n", "sums"])

    for batch in batches:
        for width, i, count, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (width, i) != held:
                if held is not None:
                    yield done()
                held, n, total = (width, i), 0, Doubled(np.zeros(width))
            part = np.frombuffer(sums)
            n += count
            total.add(part[:width], part[width:])
    if held is not None:
        yield done()


PARTS = "width int, i int, n long, sums binary"


def moments(vectors: DataFrame, rows: Callable[[pa.Array], np.ndarray], centre: Centre | None = None) -> tuple[int, Doubled] | None:
    """(n, sums) of the column vector, or (n, centred outer products); None without rows."""
    found = vectors.select("vector").mapInArrow(partial(_moments, rows=rows, centre=centre), PARTS)
    merged = found.repartition(32, "width", "i").sortWithinPartitions("width", "i").mapInArrow(_merged, PARTS).collect()
    if not merged:
        return None
    if len({(r.width, r.n) for r in merged}) > 1:
        raise ValueError(f"vectors of several widths: {sorted({r.width for r in merged})}")
    sums = np.stack([np.frombuffer(r.sums) for r in sorted(merged, key=lambda r: r.i)])
    width = merged[0].width
    return merged[0].n, Doubled(sums[:, :width], sums[:, width:])


def exact_mean(n: int, sums: list[Fraction]) -> Centre:
    """Sums over n as high and low doubles."""
    means = [s / n for s in sums]
    high = np.array([float(m) for m in means])
    return high, np.array([float(m - Fraction(h)) for m, h in zip(means, high.tolist(), strict=True)])


def mean_and_covariance(vectors: DataFrame, rows: Callable[[pa.Array], np.ndarray]) -> tuple[int, list[Fraction], Centre, np.ndarray] | None:
    """(n, exact sums, mean, covariance with divisor n) of the column vector."""
    first = moments(vectors, rows)
    if first is None:
        return None
    n, sums = first
    exact = [Fraction(h) + Fraction(e) for h, e in zip(sums.high[0].tolist(), sums.low[0].tolist(), strict=True)]
    centre = exact_mean(n, exact)
    _, products = moments(vectors, rows, centre)
    return n, exact, centre, products.high / n + products.low / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over dimensions of (n * x - S)**2, from exact row sums of x**2 and x * S."""
    wide = x.astype(np.int64) if np.abs(x).max(initial=0) < 2**24 else x.astype(np.int64).astype(object)
    squares = (wide * wide).sum(axis=1).tolist()
    base, meet = 1 << 24, [0] * len(x)
    rest, shift = list(sums), 0
    while any(r not in (0, -1) for r in rest) or shift == 0:  # S in digits of 24 bits, the last one signed
        digits = [r % base for r in rest]
        meet = [m + (p << shift) for m, p in zip(meet, (wide * np.array(digits, wide.dtype)).sum(axis=1).tolist(), strict=True)]
        rest, shift = [r // base for r in rest], shift + 24
    meet = [m + (p << shift) for m, p in zip(meet, (wide * np.array(rest, wide.dtype)).sum(axis=1).tolist(), strict=True)]
    total = sum(s * s for s in sums)
    return [n * n * q - 2 * n * m + total for q, m in zip(squares, meet, strict=True)]


def _whitened(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], centre: Centre, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = integers(batch.column("vector"))
        if not len(x):
            continue
        high, low = centred(x, centre)
        y = high @ weights + low @ weights
        flat = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))
        deviation = pa.array([Decimal(v) if v < 10**38 else None for v in deviations(x, n, sums)], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([batch.column("id"), deviation, flat], names=["id", "deviation", "vector"])


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """(id, deviation decimal, vector of whitened components) of each usable row, and the fit: n, mean,
    covariance, eigenvalues, components (columns), explained and identity_error."""
    spark = rows.sparkSession
    prepare(spark)
    kind = dict(rows.select(F.col(key).alias("id")).dtypes)["id"]
    given = rows.where(usable(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    shape = f"id {kind}, deviation decimal(38,0), vector array<double>"
    fit = mean_and_covariance(given, integers)
    if fit is None:
        return spark.createDataFrame([], shape), {"n": 0, "explained": [], "identity_error": None}
    n, sums, centre, covariance = fit
    covariance = (covariance + covariance.T) / 2
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(covariance))
    some = values > max(len(covariance) * 2.0**-52 * values[0], 0.0)
    weights = np.where(some, vectors / np.sqrt(np.where(some, values, 1.0)), 0.0)
    out = given.mapInArrow(partial(_whitened, n=n, sums=[int(s) for s in sums], centre=centre, weights=weights), shape)
    out = written(out, "whitened")
    measured = mean_and_covariance(out, doubles)[3]
    return out, {
        "n": n, "mean": centre[0], "covariance": covariance, "eigenvalues": values, "components": vectors,
        "explained": np.where(some, values, 0.0) / trace if trace > 0 else np.zeros(len(values)), "identity_error": float(np.abs(measured - np.eye(len(values))).max()),
    }


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fit = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*(F.lit(float(e)) for e in fit["explained"])) if fit["n"] else F.array().cast("array<double>")
    each = rows.select("id", "deviation", F.posexplode("vector").alias("k", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("k") + 1).alias("component"), F.lit(fit["n"]).cast("long").alias("n"), F.expr("try_cast(deviation as long)").alias("deviation"), "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(fit["identity_error"]).cast("double").alias("identity_error"),
    )
