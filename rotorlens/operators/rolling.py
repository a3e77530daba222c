"""Rolling (window) features per series (ROL1-ROL8).

All columns share one `rowsBetween(-(w-1), 0)` frame over the same
(key, order) window, so Spark evaluates them in a single Window operator
after a single sort. A statistic is null until the frame holds w non-null
values, as with a full-window rolling mean.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import rows_frame, series_window
from ..session import written
from .series import carry, chunked, join_on, resolve_chunk_rows, tasks_for

ROLLING_WINDOW = 10  # fixed value: default window (snapshots)
EMA_CUTOFF = 1e-17   # weights below this share of the newest are dropped


def ema_frame_length(span: int) -> int:
    """Rows needed so that the oldest EMA weight is below EMA_CUTOFF."""
    decay = 1.0 - 2.0 / (span + 1.0)
    return int(math.ceil(math.log(EMA_CUTOFF) / math.log(decay))) if decay > 0 else 1


def _block(span: int) -> int:
    """Rows of an EMA block: a power of two that is no shorter than the rows whose weights count."""
    return 1 << (ema_frame_length(span) - 1).bit_length()


def _ema_at_readings(df: DataFrame, col: str, key, order, at: str, out: str, span: int) -> DataFrame:
    """`out`: the bias-adjusted exponential mean with alpha = 2/(span+1) at the readings (neither null nor NaN) of `col`,
    null elsewhere. `at` counts rows along the series.

    A weight is decay^(rows back). In a block of rows, sums of value * decay^-(place in the block), times
    decay^place, are the weighted sums of the block's rows so far; the whole block before adds its sum with
    another factor decay^block, and what lies further back is below EMA_CUTOFF of the reading's own weight."""
    decay = 1.0 - 2.0 / (span + 1.0)
    v, there = F.col(col).cast("double"), F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))
    if decay == 0.0:
        return df.withColumn(out, F.when(there, v))
    B = _block(span)
    df = _weighted(df, [col], at, span)
    here = Window.partitionBy(*key, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_blk").rangeBetween(-1, -1)
    num, den = (F.sum(c).over(here) + F.coalesce(F.sum(c).over(before), F.lit(0.0)) * decay ** B for c in ("_x0", "_o0"))
    return df.withColumn(out, F.when(there, num / den)).drop("_blk", "_x0", "_o0")


def _weighted(df: DataFrame, metrics: Sequence[str], at: str, span: int) -> DataFrame:
    """Adds the row's block and, for the i-th metric, its reading (`_x{i}`) and 1 (`_o{i}`) times decay^-(place in the
    block), null where there is no reading."""
    decay, B = 1.0 - 2.0 / (span + 1.0), _block(span)
    up = F.pow(F.lit(decay), -(F.col(at) % B).cast("double"))
    df = df.withColumn("_blk", F.floor(F.col(at) / B).cast("long"))
    for i, m in enumerate(metrics):
        v = F.col(m).cast("double")
        there = F.col(m).isNotNull() & ~F.isnan(v)
        df = df.withColumns({f"_x{i}": F.when(there, v * up), f"_o{i}": F.when(there, up)})
    return df


def _ema_cut(df: DataFrame, rows: DataFrame, key: Sequence[str], metrics: Sequence[str], span: int, tasks: int) -> DataFrame:
    """`{m}_ema` on `df`, the owned rows of a chunked frame; `rows` are the same rows, in a form that is cheap to read again.

    The sums are those of `_ema_at_readings`. A piece is what a chunk holds of a block: one row per piece goes to its own
    block and the next one, where the sums of the pieces before are taken, so rows are not copied for their long frames."""
    decay, B, n = 1.0 - 2.0 / (span + 1.0), _block(span), range(len(metrics))
    sums = [f"_{s}{i}" for i in n for s in "xo"]
    if decay == 0.0:
        newest = {f"_mean_{m}": F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")) for m in metrics}
        return carry(df.withColumns(newest), key, {f"_mean_{m}": f"{m}_ema" for m in metrics}, of=rows.withColumns(newest), tasks=tasks)
    per = _weighted(rows, metrics, "_g", span).groupBy(*key, "_chunk", "_blk").agg(
        F.max("_g").alias("_g"), *[F.sum(c).alias(c) for c in sums])
    sent = per.withColumn("_ago", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_to", F.col("_blk") + F.col("_ago"))
    earlier = Window.partitionBy(*key, "_to").orderBy(F.desc("_ago"), "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shrunk = F.when(F.col("_ago") == 1, F.lit(decay ** B)).otherwise(1.0)
    sent = sent.withColumns({f"_b{c}": F.coalesce(F.sum(F.col(c) * shrunk).over(earlier), F.lit(0.0)) for c in sums})
    # read twice: for the rows' sums and for the mean as of a chunk's last reading
    pieces = written(sent.filter("_ago = 0").drop("_ago", "_to"), "pieces")
    j = join_on(_weighted(df, metrics, "_g", span), pieces.select(*key, "_chunk", "_blk", *[f"_b{c}" for c in sums]), [*key, "_chunk", "_blk"], "left") \
        .repartition(tasks, *key, "_chunk")
    here = Window.partitionBy(*key, "_chunk", "_blk").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumns({f"_mean_{m}": F.when(F.col(f"_o{i}").isNotNull(), (F.sum(f"_x{i}").over(here) + F.col(f"_b_x{i}")) /
                                            (F.sum(f"_o{i}").over(here) + F.col(f"_b_o{i}"))) for i, m in enumerate(metrics)})
    ends = pieces.withColumns({f"_mean_{m}": (F.col(f"_x{i}") + F.col(f"_b_x{i}")) / (F.col(f"_o{i}") + F.col(f"_b_o{i}")) for i, m in enumerate(metrics)})
    return carry(j.drop(*sums, *[f"_b{c}" for c in sums], "_blk"), key, {f"_mean_{m}": f"{m}_ema" for m in metrics}, of=ends, tasks=tasks)


def rolling_features(df: DataFrame, key: Sequence[str], order: Sequence[str],
                     metrics: Sequence[str], window: int = ROLLING_WINDOW,
                     with_ema: bool = True, chunk_rows="auto") -> DataFrame:
    """ROL1-ROL8 for every metric: rolling mean/std(sample)/min/max, diff,
    pct_change (on the forward-filled series; a zero predecessor gives
    null), ema and rolling z-score.

    ROL7: a null or NaN adds no weight to the exponential mean and repeats the mean before it, however long the gap.
    Series that are cut (operators.series) get the halo of the rolling frame; the forward fill, the sums of the exponential
    mean and the mean before a gap are carried across chunks, so the values are the same (the exponential mean to rounding)."""
    chunk_rows = resolve_chunk_rows(df, key, chunk_rows)
    if not chunk_rows:
        w = series_window(key, order)
        out = _rolling(df.withColumn("_row", F.row_number().over(w)), key, order, metrics, window, with_ema, "_row")
        if with_ema:
            past = w.rowsBetween(Window.unboundedPreceding, 0)
            out = out.withColumns({f"{m}_ema": F.last(f"_mean_{m}", ignorenulls=True).over(past) for m in metrics})
        drop = ["_row"]
    else:
        c = chunked(df, key, order, max(window - 1, 1), 0, chunk_rows)
        tasks = tasks_for(c.count(), df.sparkSession)
        filled = carry(c, key, {m: f"_ff_{m}" for m in metrics}, tasks=tasks)
        out = _rolling(filled, [*key, "_chunk"], ["_g"], metrics, window, False, "_g", fill_prefix="_ff_").filter("_own")
        if with_ema:
            out = _ema_cut(out, c.filter("_own"), key, metrics, window, tasks)
        drop = ["_own", "_chunk", "_g", *[f"_ff_{m}" for m in metrics]]
    named = [f"{m}_{s}" for m in metrics for s in
             ("rolling_mean", "rolling_std", "rolling_min", "rolling_max", "diff", "pct_change", *(["ema"] if with_ema else []), "zscore")]
    return out.drop(*drop).select(*df.columns, *named)


def _rolling(df, key, order, metrics, window, with_ema, at, fill_prefix=None):
    w = series_window(key, order)
    fr = rows_frame(key, order, -(window - 1), 0)
    out = df
    for m in metrics:
        full = F.count(m).over(fr) == window
        mean = F.avg(m).over(fr)
        std = F.stddev_samp(m).over(fr)
        out = (out.withColumn(f"{m}_rolling_mean", F.when(full, mean))
                  .withColumn(f"{m}_rolling_std", F.when(full, std))
                  .withColumn(f"{m}_rolling_min", F.when(full, F.min(m).over(fr)))
                  .withColumn(f"{m}_rolling_max", F.when(full, F.max(m).over(fr)))
                  .withColumn(f"{m}_diff", F.col(m) - F.lag(m, 1).over(w)))
        filled = (F.col(f"{fill_prefix}{m}") if fill_prefix else
                  F.last(m, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("_f", filled)
        prev = F.lag("_f", 1).over(w)
        out = out.withColumn(f"{m}_pct_change",
                             F.when(prev != 0, F.col("_f") / prev - 1.0)).drop("_f")
        if with_ema:
            out = _ema_at_readings(out, m, key, order, at, f"_mean_{m}", window)
        out = out.withColumn(
            f"{m}_zscore",
            (F.col(m) - F.col(f"{m}_rolling_mean")) / (F.col(f"{m}_rolling_std") + 1e-10))
    return out
