"""Embedding whitening: exact integer covariance by digit-slice products, then eigenvectors.

Vectors become integers. Each is split into limbs of LIMB bits, so that a float64 BLAS product of
limb matrices is exact; a task adds such products up, recombines the limbs as big integers once and
hands on one number per pair of dimensions. Spark adds the tasks' numbers, and the driver sees
d (d + 1) / 2 sums for d dimensions, whatever the number of rows, makes the covariance from them
without any rounding before the last division, and takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a limb; rows of a product. A product's sums stay below 2**(2 * LIMB) * ROWS = 2**40.
LIMB, ROWS = 12, 1 << 16
#: Scale and offset of the integers; entries beyond REACH times 1/SCALE count as that.
SCALE, OFFSET, REACH = 1024, 100_000, 2.0**52
#: Big integers travel as two numbers of 60 bits each.
HALF = 60


def integers(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): which rows hold ``dim`` finite entries, and those as floor(1024 c) + 100000."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    ends = np.cumsum(np.maximum(size, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.flatnonzero((size == dim) & (bad[ends] == bad[ends - np.maximum(size, 0)]))
    c = flat[(ends[good] - dim)[:, None] + np.arange(dim)]
    return good, np.floor(np.clip(c * SCALE, -REACH, REACH)).astype(np.int64) + OFFSET


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """float64 matrices with x = sum(limb << (LIMB * i)); the last one carries the sign."""
    out, most = [], int(max(x.max(initial=0), -1 - x.min(initial=0)))
    while most >> (LIMB - 1):
        out.append((x & ((1 << LIMB) - 1)).astype(float))
        x, most = x >> LIMB, most >> LIMB
    return [*out, x.astype(float)]


class Products:
    """n, the sums and the products of integer rows, exact."""

    def __init__(self, dim: int):
        self.n, self.dim = 0, dim
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.sums: dict[int, np.ndarray] = {}

    def add(self, x: np.ndarray) -> None:
        self.n += len(x)
        for a in range(0, len(x), ROWS):
            parts = limbs(x[a : a + ROWS])
            for i, p in enumerate(parts):
                self.sums[i] = self.sums.get(i, 0) + p.sum(axis=0).astype(np.int64)
                for j in range(i, len(parts)):
                    self.pairs[i, j] = self.pairs.get((i, j), 0) + (p.T @ parts[j]).astype(np.int64)

    def numbers(self) -> Iterator[tuple[int, int, int]]:
        """(i, j, value): products for i <= j, sums at j = -1, n at (-1, -1)."""
        yield -1, -1, self.n
        sums, products = np.zeros(self.dim, object), np.zeros((self.dim, self.dim), object)
        for i, s in self.sums.items():
            sums += s.astype(object) << (LIMB * i)
        for (i, j), m in self.pairs.items():
            products += (m if i == j else m + m.T).astype(object) << (LIMB * (i + j))
        for i in range(self.dim):
            yield i, -1, sums[i]
            yield from ((i, j, products[i, j]) for j in range(i, self.dim))


@dataclass(frozen=True)
class Whitening:
    """What rows are whitened with: n, sums, eigenvalues (falling), unit eigenvectors as columns."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def dimension(rows: DataFrame, vector_col: str) -> int:
    """The most frequent length of the vectors, the largest of several such; 0 without vectors."""
    found = rows.filter(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = 8) -> Whitening:
    """The whitening of all rows that count (see ``whiten``)."""
    dim = dimension(rows, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Products(dim)
        for b in batches:
            total.add(integers(b.column(0), dim)[1])
        if total.n:
            i, j, value = zip(*total.numbers(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals([v >> HALF for v in value]), _decimals([v & ((1 << HALF) - 1) for v in value])], ["i", "j", "hi", "lo"])

    parts = rows.select(F.col(vector_col).cast("array<double>")).mapInArrow(run, "i int, j int, hi decimal(38,0), lo decimal(38,0)")
    merged = parts.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect() if dim else []
    at = {(r["i"], r["j"]): (int(r["hi"]) << HALF) + int(r["lo"]) for r in merged}
    n = at.get((-1, -1), 0)
    if not n:
        return Whitening(dim, 0, [0] * dim, np.zeros(0), np.zeros((dim, 0)), 0.0)
    s = [at[i, -1] for i in range(dim)]
    # n^2 times the covariance is an integer: centring loses nothing, the division rounds once
    v = np.array([[(n * at[min(i, j), max(i, j)] - s[i] * s[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(v)
    k = min(components, dim)
    return Whitening(dim, n, s, np.maximum(values[::-1][:k], 0.0), np.ascontiguousarray(vectors[:, ::-1][:, :k]), float(np.trace(v)))


def _squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of int64 below 2**62, by limbs of 21 bits."""
    low, mid, high = y & 0x1FFFFF, (y >> 21) & 0x1FFFFF, y >> 42
    terms = [(low * low, 0), (low * mid, 22), (mid * mid, 42), (low * high, 43), (mid * high, 64), (high * high, 84)]
    return [sum(v << shift for v, (_, shift) in zip(row, terms, strict=True)) for row in zip(*(t.sum(axis=1).tolist() for t, _ in terms), strict=True)]


def project(x: np.ndarray, m: Whitening) -> tuple[list[int], np.ndarray]:
    """(deviation, whitened) of integer rows; a component without variance is NaN."""
    if m.n * int(np.abs(x).max(initial=0)) + max(map(abs, m.sums)) < 1 << 62:
        y = m.n * x - np.asarray(m.sums, np.int64)
        deviation, centred = _squares(y), y / m.n
    else:
        y = m.n * x.astype(object) - np.array(m.sums, object)
        deviation, centred = [int(v) for v in (y * y).sum(axis=1)], (y / m.n).astype(float)
    flat = m.values <= m.trace * m.dim * np.finfo(float).eps
    return deviation, (centred @ m.vectors) / np.sqrt(np.where(flat, np.nan, m.values))


def apply(rows: DataFrame, m: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation decimal, whitened array) of each row that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = integers(b.column(1), m.dim)
            deviation, w = project(x, m)
            fits = [Decimal(v) if v < 10**38 else None for v in deviation]
            flat = w.ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), pa.array(fits, pa.decimal128(38, 0)), lists], ["id", "deviation", "w"])

    kind = dict(rows.dtypes)[id_col]
    schema = f"id {kind}, deviation decimal(38,0), w array<double>"
    narrow = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return narrow.mapInArrow(run, schema) if m.n else rows.sparkSession.createDataFrame([], schema)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row per row and component.

    Rows whose vector is null, or holds a null, NaN or infinite entry, are left out, and so are
    vectors of another length than the most frequent one. Entries beyond 2**52 / 1024 count as that.
    Repeated rows and ids each count and each get their rows; a null id stays null. ``deviation`` is
    decimal(38, 0), null where it has more digits. A component without variance has null
    ``whitened``, ``explained`` 0 (null if nothing varies) and no part in ``identity_error``, which
    is the largest absolute entry of the whitened rows' covariance minus the identity, measured on
    all of them. An empty table gives an empty result. Other columns are not used.
    """
    m = fit(rows, vector_col, components)
    done = apply(rows, m, id_col, vector_col)
    k = len(m.values)
    live = [i for i in range(k) if m.values[i] > m.trace * m.dim * np.finfo(float).eps]
    w = lambda i: F.get("w", F.lit(i))
    error = None
    if live:  # covar_pop centres before it multiplies and merges its parts as such
        entries = [F.abs(F.covar_pop(w(i), w(j)) - F.lit(float(i == j))) for i in live for j in live if i <= j]
        error = done.agg(F.array_max(F.array(*entries)).alias("e")).first()["e"]
    explained = F.array(*[F.lit(float(v / m.trace) if m.trace else None).cast("double") for v in m.values])
    out = done.select(F.col("id").alias(id_col), "deviation", F.posexplode("w").alias("_i", "whitened"))
    return out.select(id_col, (F.col("_i") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("_i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
