"""Array-valued helpers for signal snapshots.

A snapshot's samples live in one `array<double>` cell, so every feature is
row-local: higher-order array functions run inside whole-stage codegen, and
the two FFT-based transforms are Arrow-batched pandas UDFs that stack a batch
of equal-length signals into one NumPy call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _lengths(s: pd.Series) -> pd.Series:
    return s.map(lambda a: -1 if a is None else len(a))


def _rows_fft(s: pd.Series, fn) -> pd.Series:
    """Apply `fn` to the batch grouped by signal length, so each group is
    one 2-D NumPy call."""
    out = [None] * len(s)
    lens = _lengths(s)
    for n in lens.unique():
        idx = np.flatnonzero(lens.to_numpy() == n)
        if n <= 0:
            continue
        block = np.stack([np.asarray(s.iat[i], dtype=float) for i in idx])
        res = fn(block)
        for j, i in enumerate(idx):
            out[i] = res[j]
    return pd.Series(out)


def _positive_mag(block: np.ndarray) -> np.ndarray:
    """|Y_k| for the strictly positive frequencies k = 1 .. (n-1)//2 (the
    Nyquist bin of an even n counts as negative)."""
    n = block.shape[1]
    y = np.fft.rfft(block, axis=1)
    return np.abs(y[:, 1:(n - 1) // 2 + 1])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fft_magnitude(samples: pd.Series) -> pd.Series:
    """SIG13 core: magnitudes of the positive-frequency FFT bins."""
    return _rows_fft(samples, _positive_mag)


def _envelope(block: np.ndarray) -> np.ndarray:
    """|analytic signal|: keep DC (and Nyquist for even n), double positive
    bins, zero negative ones, inverse FFT."""
    n = block.shape[1]
    y = np.fft.fft(block, axis=1)
    h = np.zeros(n)
    if n % 2 == 0:
        h[0] = h[n // 2] = 1.0
        h[1:n // 2] = 2.0
    else:
        h[0] = 1.0
        h[1:(n + 1) // 2] = 2.0
    return np.abs(np.fft.ifft(y * h, axis=1))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def envelope(samples: pd.Series) -> pd.Series:
    """SIG22: signal envelope."""
    return _rows_fft(samples, _envelope)


# ------------------------------------------------------- array reductions --

def arr_sum(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))


def arr_mean(a: Column, f=lambda x: x) -> Column:
    return arr_sum(a, f) / F.size(a)


def arr_quantile(a: Column, p: float) -> Column:
    """Linear-interpolated quantile of an array (NumPy's default)."""
    s = F.array_sort(a)
    pos = (F.size(a) - 1) * p
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    vlo = F.get(s, lo)
    vhi = F.get(s, hi)
    return vlo + (vhi - vlo) * (pos - lo)


def positive_freqs(mag: Column, n: Column, rate: float) -> Column:
    """Frequencies (Hz) of the bins returned by fft_magnitude."""
    return F.transform(mag, lambda x, i: (i + 1) * F.lit(float(rate)) / n)
