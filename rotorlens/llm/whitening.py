"""Whitening of vectors by the exact scatter matrix of their integer parts, from bit slices.

Each entry c becomes x = floor(SCALE * c) + OFFSET. A task takes its rows in blocks; in a block each
dimension is shifted by its smallest value, and bit plane p of dimension d (one bit a row) is packed into 64-bit words.
The block's cross-product of two dimensions is the sum over their planes p and q of 2^(p + q) times the
popcount of the planes' AND; shifts are put back in integers. A dimension of ones gives the sums and the row
count in the same way. Tasks return one number per pair of dimensions, which Spark adds.

The driver gets dim * (dim + 1) / 2 integers, forms n * XX - S S^T in integers (so that centring loses
nothing), divides by n^2 and decomposes with eigh. Scoring is a product per batch in tasks.

Defined results: vectors that are null, hold null or non-finite entries, or an entry whose integer fits no long
take no part, nor do vectors of another than the commonest length; null ids and repeated rows are rows like
others. Components whose eigenvalue isn't above dim * 2^-52 of the largest (constant or dependent dimensions,
few rows) have no unit variance to scale to and give no rows; equal eigenvalues keep eigh's order. A component's largest entry
(the first of equals) is positive. A deviation beyond a long is the largest long. An empty table gives no rows; other columns aren't read. More
than `max_dim` dimensions raise an error, as the matrix is held by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import commonest_length, integers, widest

SCALE = 64.0
OFFSET = 1_000_000
KEPT = 32
MAX_DIM = 2048
BLOCK = 8192
TOP = 2 ** 63 - 1


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty bit planes of the columns of a non-negative matrix: their dimension, bit, and packed words."""
    dims, bits, words = [], [], []
    for p in range(int(y.max(initial=0)).bit_length()):
        plane = ((y >> p) & 1).astype(np.uint8).T
        some = np.flatnonzero(plane.any(1))
        packed = np.packbits(plane[some], axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        dims.append(some)
        bits.append(np.full(len(some), p))
        words.append(packed.view(np.uint64))
    if not dims:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), np.uint64)
    return np.concatenate(dims), np.concatenate(bits), np.concatenate(words)


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact X^T X (Python integers) of a matrix of longs, from popcounts."""
    n, dim = x.shape
    if not n:
        return np.zeros((dim, dim), object)
    low = x.min(0)
    y = x - low
    d, p, words = planes(y)
    counts = np.zeros((len(d), len(d)), np.int64)
    for a in range(len(d)):
        counts[a, a:] = np.bitwise_count(words[a] & words[a:]).sum(1)
    counts += np.triu(counts, 1).T
    exact = object if 2 * int(p.max(initial=0)) + n.bit_length() + 14 > 62 else np.int64
    weight = np.zeros((dim, len(d)), exact)
    weight[d, np.arange(len(d))] = [1 << int(b) for b in p]
    yy = (weight @ counts.astype(exact) @ weight.T).astype(object)
    low = low.astype(object)
    y_sum = np.array([int(s) for s in (weight @ np.diag(counts).astype(exact))], object)
    return yy + np.outer(low, y_sum) + np.outer(y_sum, low) + n * np.outer(low, low)


def _scatter(vector: str, dim: int, scale: float):
    def run(batches):
        total = np.zeros((dim + 1, dim + 1), object)
        for rb in batches:
            _, x = integers(rb.column(vector), dim, scale)
            for lo in range(0, len(x), BLOCK):
                part = x[lo:lo + BLOCK]
                total = total + cross_products(np.concatenate([part, np.ones((len(part), 1), np.int64)], 1))
        if total[dim, dim]:
            i, j = np.triu_indices(dim + 1)
            v = [int(t) for t in total[i, j]]
            wide = pa.decimal128(38, 0)
            # in two parts, as sums of squares of large longs pass 38 digits
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array([t >> 64 for t in v], pa.int64()).cast(wide),
                                              pa.array([Decimal(t & (2 ** 64 - 1)) for t in v], wide)], names=["i", "j", "hi", "lo"])
    return run


@dataclass
class Model:
    """n rows, integer sums of x - OFFSET, eigenvalues and unit components (columns) in falling order, the trace."""
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def fit(vectors: DataFrame, vector: str = "embedding", scale: float = SCALE, max_dim: int = MAX_DIM) -> Model:
    col = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    dim = commonest_length(col, "v")
    if dim > max_dim:
        raise ValueError(f"{dim} dimensions, at most {max_dim} are decomposed on the driver")
    xx = np.zeros((dim + 1, dim + 1), object)
    if dim:
        parts = col.mapInArrow(_scatter("v", dim, scale), "i int, j int, hi decimal(38,0), lo decimal(38,0)")
        for r in parts.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect():
            xx[r["i"], r["j"]] = xx[r["j"], r["i"]] = (int(r["hi"]) << 64) + int(r["lo"])
    n, sums = int(xx[dim, dim]), [int(s) for s in xx[dim, :dim]]
    if not n:
        return Model(0, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    s = np.array(sums, object)
    centred = n * xx[:dim, :dim] - np.outer(s, s)
    v = np.array([[int(c) / n ** 2 for c in row] for row in centred], np.float64)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    kept = e > dim * 2.0 ** -52 * max(float(e[0]), 0.0)
    e, u = e[kept], u[:, kept]
    at = np.abs(u).argmax(0)
    u = u * np.where(u[at, np.arange(len(at))] < 0, -1.0, 1.0)
    return Model(n, sums, e, u, int(np.trace(centred)) / n ** 2)


def _deviations(x: np.ndarray, model: Model) -> np.ndarray:
    """n * x - S, exact: longs where they and their squares' sums stay below 2^62, else Python integers."""
    big = model.n * widest(x) + max(map(abs, model.sums), default=0)
    exact = np.int64 if big * big * max(1, x.shape[1]) < 2 ** 62 else object
    return model.n * x.astype(exact) - np.array(model.sums, exact)


def _projected(dev: np.ndarray, model: Model, kept: int) -> np.ndarray:
    mean_free = np.array(dev / model.n, np.float64)
    return mean_free @ (model.components[:, :kept] / np.sqrt(model.values[:kept]))


def _second_moments(vector: str, model: Model, kept: int, scale: float):
    def run(batches):
        k = min(kept, len(model.values))
        total = np.zeros((k + 1, k + 1))
        for rb in batches:
            _, x = integers(rb.column(vector), len(model.sums), scale)
            z = np.concatenate([_projected(_deviations(x, model), model, kept), np.ones((len(x), 1))], 1)
            total += z.T @ z
        if total[k, k]:
            i, j = np.triu_indices(k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                             names=["i", "j", "v"])
    return run


def identity_error(vectors: DataFrame, model: Model, vector: str = "embedding", kept: int = KEPT, scale: float = SCALE) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = min(kept, len(model.values))
    if not k:
        return 0.0
    m = np.zeros((k + 1, k + 1))
    for r in vectors.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(
            _second_moments("v", model, kept, scale), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    mean = m[k, :k] / m[k, k]
    return float(np.abs(m[:k, :k] / m[k, k] - np.outer(mean, mean) - np.eye(k)).max())


def _rows(model: Model, kept: int, scale: float, error: float):
    k = min(kept, len(model.values))
    share = model.values[:k] / model.trace if model.trace else np.zeros(0)

    def run(batches):
        for rb in batches:
            at, x = integers(rb.column("v"), len(model.sums), scale)
            m = len(at)
            if not m:
                continue
            dev = _deviations(x, model)
            z = _projected(dev, model, kept)
            total = np.minimum((dev * dev).sum(1), TOP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                rb.column("id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, model.n), pa.int64()), pa.array(np.repeat(total, k), pa.int64()), pa.array(z.reshape(-1)),
                pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, model: Model, vec_id: str = "vec_id", vector: str = "embedding", kept: int = KEPT,
           scale: float = SCALE) -> DataFrame:
    """A row per vector and component (up to `kept`) of the model."""
    error = identity_error(vectors, model, vector, kept, scale)
    src = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(_rows(model, kept, scale, error), f"id {kind}, component int, n bigint, deviation bigint, "
                         "whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", vec_id)


def query(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings, fit(embeddings))
