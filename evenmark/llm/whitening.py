"""Whitening by shifted CholeskyQR: Gram passes over centred rows, triangular solves, an SVD of the composed factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task multiplies at once.
BLOCK = 4096
#: Directions of a singular value below this share of the largest are rounding: the data do not span them.
SPAN = 1e-10


@dataclass(frozen=True)
class Moments:
    """Rows, sums for each dimension, and the least and largest entry of all rows."""

    n: int
    sums: tuple[int, ...]
    low: int
    high: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n. Whole means are taken off as integers, so that a constant dimension becomes exactly zero."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        return (x - np.array(whole)).astype(float) - np.array(rest) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - sums)^2 of each row, exactly."""
        if self.n * (self.high - self.low) < 1 << 52 and self.n * max(abs(self.low), abs(self.high)) < 1 << 62 and x.shape[1] <= 1 << 10:
            y = np.abs(self.n * x - np.array(self.sums))
            a, b = y >> 26, y & (1 << 26) - 1
            parts = ((a * a).sum(1).tolist(), (a * b).sum(1).tolist(), (b * b).sum(1).tolist())
            return [(p << 52) + (q << 27) + r for p, q, r in zip(*parts, strict=True)]
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: its projection on `axes` (a row each, eigenvectors of the covariance) over the root of `values`."""

    moments: Moments
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ self.axes.T / np.sqrt(self.values)


def scaled(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64, offset: int = 1_000_000) -> DataFrame:
    """(id, x array<long>): entries as floor(scale * c) + offset. Rows whose vector is null, empty, or holds null or non-finite entries go."""
    v = F.transform(vector_col, lambda c: c.cast("double"))
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~odd).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c) + F.lit(offset)).alias("x"))


def _rows(column) -> np.ndarray:
    """The vectors of an Arrow list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def moments(x: DataFrame) -> Moments | None:
    """Of the commonest length of vectors (among equals the longest); None if there are no rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for part in _blocks(batches):
            col = part.column(0)
            sizes = np.diff(col.offsets.to_numpy())
            for d in np.unique(sizes):
                m = _rows(col.take(pa.array(np.flatnonzero(sizes == d))))
                had = found.setdefault(int(d), [0, np.zeros(d, np.int64), m.min(), m.max()])
                found[int(d)] = [had[0] + len(m), had[1] + m.sum(0), min(had[2], m.min()), max(had[3], m.max())]
        for d, (n, s, low, high) in found.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": [n], "s": pa.array([s], pa.list_(pa.int64())), "low": [int(low)], "high": [int(high)]})

    by_task = x.select("x").mapInArrow(add, "d int, n long, s array<long>, low long, high long")
    sums = by_task.select("d", "n", "low", "high", F.posexplode("s")).groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    best = F.struct("n", "d")
    last = sums.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy(best.desc()).limit(1).collect()
    return Moments(last[0].n, tuple(int(e.s) for e in last[0].s), last[0].low, last[0].high) if last else None


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a r^-1 for an upper triangular r, column by column."""
    q = np.empty_like(a)
    for j in range(r.shape[0]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(x: DataFrame, of) -> tuple[np.ndarray, np.ndarray]:
    """The products of the columns of of(block), summed over all rows, and the columns' sums: one small matrix a task, added up by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for part in _blocks(batches):
            q = of(_rows(part.column(0)))
            q = np.column_stack([q, np.ones(len(q))])
            total = total + q.T @ q
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"g": pa.array([total[np.triu_indices(len(total))]], pa.list_(pa.float64()))})

    found = x.select("x").mapInArrow(add, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("s")).toArrow()
    flat = np.empty(len(found))
    flat[found.column("pos").to_numpy()] = found.column("s").to_numpy()
    d = int((8 * len(flat) + 1) ** 0.5 - 1) // 2
    g = np.zeros((d, d))
    g[np.triu_indices(d)] = flat
    g = np.triu(g) + np.triu(g, 1).T
    return g[:-1, :-1], g[-1, :-1]


def factor(g: np.ndarray) -> np.ndarray:
    """The Cholesky factor of a Gram matrix, shifted if the smallest eigenvalue is lost in rounding."""
    d, values = len(g), np.linalg.eigvalsh(g)
    shift = 11 * (BLOCK * d + d * (d + 1)) * np.finfo(float).eps * values[-1]
    return np.linalg.cholesky(g if values[0] > 100 * shift else g + shift * np.eye(d)).T


def fit(x: DataFrame, most: int = 32, passes: int = 8, close: float = 1e-10) -> Whitening | None:
    """Fits on all rows of `x`. A pass forms the Gram matrix of Q = centred rows through the solves so far; its Cholesky factor
    becomes the next solve. Once Q is orthonormal to `close` where the data span it (at most `passes` passes, commonly three),
    the SVD of the composed factor gives the axes. Only d x d matrices reach the driver.

    Components that the data do not span (constant or dependent dimensions, fewer rows than dimensions) are left out.
    """
    m = moments(x)
    if m is None:
        return None
    x, d = x.where(F.size("x") == len(m.sums)), len(m.sums)
    factors: list[np.ndarray] = []
    composed = np.eye(d)
    for _ in range(passes):

        def q(block: np.ndarray, steps=tuple(factors)) -> np.ndarray:
            a = m.centred(block)
            for r in steps:
                a = solved(a, r)
            return a

        g, _ = gram(x, q)
        values, vectors = np.linalg.eigh(g)
        if values[-1] <= 0:
            return Whitening(m, np.empty((0, d)), np.empty(0), np.empty(0))
        if np.all((np.abs(values - 1) < close) | (values < 1e-6)):
            break
        r = factor(g)
        factors.append(r)
        composed = r @ composed
    # Q's last factor: its Cholesky factor, or where Q lacks directions the root of its Gram matrix
    last = np.linalg.cholesky(g).T if values[0] > 0.5 else np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    _, s, axes = np.linalg.svd(last @ composed)
    keep = np.flatnonzero(s > SPAN * s[0])[:most]
    axes = axes[keep]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return Whitening(m, axes, s[keep] ** 2 / m.n, s[keep] ** 2 / (s**2).sum())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32, scale: float = 64, offset: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error) for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries give no rows, nor do those of another length than the
    commonest (of equal counts, the longest). Repeated rows, null and repeated ids stay rows and count as often as they
    stand. An empty table, a single vector and equal vectors span no component and give no rows. Extra columns are left out.
    No row is shuffled: each pass reads the vectors and sends one d x d matrix a task.
    """
    kind = dict(rows.dtypes)[id_col]
    x = scaled(rows, id_col, vector_col, scale, offset)
    out = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(x, most)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    m, k = model.moments, len(model.values)
    x = x.where(F.size("x") == len(m.sums))
    products, sums = gram(x, model.apply)
    error = float(np.abs(products / m.n - np.outer(sums, sums) / m.n**2 - np.eye(k)).max())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            block, n = _rows(part.column(1)), part.num_rows
            each = pa.array(np.repeat(np.arange(n), k))
            dev = pa.array([Decimal(v) for v in m.deviations(block)], pa.decimal128(38, 0))
            cols = [part.column(0).take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), n), np.full(n * k, m.n), dev.take(each), model.apply(block).ravel(), np.tile(model.explained, n), np.full(n * k, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(emit, out).withColumnRenamed("id", id_col)


def op11(spark, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector; a deviation beyond a long is null here (the operator has it as a decimal)."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").try_cast("long"))
