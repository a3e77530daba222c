"""Healthy-baseline fitting (SRC13, CLN5, ANO1, HLT1, EW1, PIP3).

One grouped aggregate per (E, M) produces every statistic the detectors,
the health scorer and the early-warning model need, so fitting is a single
shuffle no matter how many operators consume it. The fitted table has one row
per (machine, metric); it is joined back without a broadcast hint so that
adaptive execution broadcasts it only when its measured size is small and
falls back to a shuffle join (with skew splitting) otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import M, V, series_window, to_long
from . import quantiles

# Quantiles every fit computes; linear interpolation as NumPy's default.
QUANTILES = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}
PARAM_COLS = ["n", "mean", "std", "std_samp", "min", "max", *QUANTILES, "iqr", "warn", "crit"]


def head_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """SRC13: the first n rows of every series (a partial top-n runs before
    the shuffle, so a hot machine ships at most n rows per map task)."""
    rn = F.row_number().over(series_window(key, order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def tail_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of every series (SRC5, EW2, FCT1)."""
    desc = [F.col(c).desc() for c in order]
    rn = F.row_number().over(series_window(key, desc))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def fit_long(long: DataFrame, key: Sequence[str], pct: float = 95.0,
             m: str = M, v: str = V, rows: int | None = None) -> DataFrame:
    """Statistics per (key, metric) of a long table; nulls are dropped.

    `rows` is the most rows a group can have, if known. Quantiles of groups that
    one task can sort come with the other statistics, else by exact selection.
    """
    probs = list(QUANTILES.values()) + [pct / 100.0]
    there = long.filter(F.col(v).isNotNull())
    if rows is None:
        rows = quantiles.largest_group(there, [*key, m])
    stats = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
             F.stddev_samp(v).alias("std_samp"), F.min(v).alias("min"), F.max(v).alias("max")]
    if rows <= quantiles.LIMIT:
        g = there.groupBy(*key, m).agg(*stats, F.percentile(v, probs).alias("_q"))
    else:
        q = quantiles.exact_quantiles(there, [*key, m], v, probs).select(
            *[F.col(c).alias(f"_k_{c}") for c in (*key, m)], F.col("q").alias("_q"))
        on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*key, m)]
        g = there.groupBy(*key, m).agg(*stats).join(q, reduce(lambda a, b: a & b, on))
    sel = [F.col("_q")[i].alias(name) for i, name in enumerate(QUANTILES)]
    g = g.select(*key, m, "n", "mean", "std", "std_samp", "min", "max", *sel,
                 F.col("_q")[len(QUANTILES)].alias("warn"))
    return (g.withColumn("iqr", F.col("q3") - F.col("q1"))
             .withColumn("crit", F.col("p99")))


def fit_baseline(df: DataFrame, key: Sequence[str], order: Sequence[str],
                 metrics: Sequence[str], n: int | None = 100, pct: float = 95.0) -> DataFrame:
    """PIP3/ANO1/HLT1/EW1: fit on the first n rows of each machine (all rows
    when n is None). Output: (key..., M, n, mean, std, ..., warn, crit)."""
    src = head_rows(df, key, order, n) if n else df
    return fit_long(to_long(src, list(key), metrics), key, pct, rows=n)


def fit_stats(df: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """CLN5: mean, std(pop), min, max per (key, metric) over all rows."""
    long = to_long(df, list(key), metrics)
    return (long.groupBy(*key, M)
                .agg(F.avg(V).alias("mean"), F.stddev_pop(V).alias("std"),
                     F.min(V).alias("min"), F.max(V).alias("max")))


def params_wide(params: DataFrame, key: Sequence[str], metrics: Sequence[str],
                stats: Sequence[str] = ("mean", "std", "q1", "q3", "iqr")) -> DataFrame:
    """One row per machine with `<metric>_<stat>` columns, for shuffle-free
    wide scoring after a single join on the key."""
    aggs = [F.max(F.when(F.col(M) == m, F.col(s))).alias(f"{m}_{s}")
            for m in metrics for s in stats]
    return params.groupBy(*key).agg(*aggs)
