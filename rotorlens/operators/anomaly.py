"""Anomaly detection against a fitted baseline (ANO2-ANO3, ANO5-ANO7,
ANO9-ANO11, ANO13).

Scoring is row-local once each row carries its machine's parameters: one join
of the wide data with `params_wide` (one row per machine), then plain column
arithmetic inside whole-stage codegen. Votes are 1 = normal, -1 = anomaly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, nonzero, reading
from ..model import series_window
from .baseline import head_rows, params_wide
from .series import on_chunks, series_index

# Default z-score threshold, IQR fence factor, monitor levels.
ZSCORE_THRESHOLD = 3.0
IQR_FACTOR = 1.5
MONITOR_LEVELS = [(0.8, "critical"), (0.5, "warning"), (0.2, "info")]
MONITOR_FLOOR = "normal"


def attach_params(df: DataFrame, params: DataFrame, key: Sequence[str],
                  metrics: Sequence[str],
                  stats: Sequence[str] = ("mean", "std", "q1", "q3", "iqr")) -> DataFrame:
    """Join each row with its machine's fitted parameters (wide)."""
    return df.join(params_wide(params, key, metrics, stats), on=list(key), how="left")


def _reading(metric: str, prefix: str | None) -> Column:
    """The metric's reading; with a prefix, it is a column already."""
    return reading(metric) if prefix is None else F.col(prefix + metric)


def abs_z(metric: str, prefix: str | None = None) -> Column:
    """|x - mean| / std with a zero std replaced by 1."""
    return F.abs((_reading(metric, prefix) - F.col(f"{metric}_mean")) / nonzero(f"{metric}_std"))


def max_abs_z(metrics: Sequence[str], prefix: str | None = None) -> Column:
    zs = [abs_z(m, prefix) for m in metrics]
    return zs[0] if len(zs) == 1 else F.greatest(*zs)


def zscore_vote(metrics: Sequence[str], threshold: float = ZSCORE_THRESHOLD) -> Column:
    """ANO2: -1 when the largest |z| over the metrics exceeds the threshold."""
    return F.when(max_abs_z(metrics) > threshold, F.lit(-1)).otherwise(F.lit(1))


def zscore_score(metrics: Sequence[str]) -> Column:
    """ANO7: -max|z| (lower is worse)."""
    return -max_abs_z(metrics)


def iqr_vote(metrics: Sequence[str], factor: float = IQR_FACTOR, prefix: str | None = None) -> Column:
    """ANO3: -1 when any metric leaves [q1 - k*iqr, q3 + k*iqr]."""
    outs = [F.coalesce((_reading(m, prefix) < F.col(f"{m}_q1") - factor * F.col(f"{m}_iqr")) |
                       (_reading(m, prefix) > F.col(f"{m}_q3") + factor * F.col(f"{m}_iqr")), F.lit(False)) for m in metrics]
    # Over an array, as it ends the compiled stage there: the votes and the health score in one method are more than the JVM's
    # compiler takes (8000 bytes), and then all of it runs uncompiled.
    return F.when(F.exists(F.array(*outs), lambda out: out), F.lit(-1)).otherwise(F.lit(1))


def ensemble_vote(votes: Sequence) -> Column:
    """ANO6: sign of the vote sum; a tie counts as normal."""
    total = None
    for v in votes:
        c = F.col(v) if isinstance(v, str) else v
        total = c if total is None else total + c
    return F.when(total < 0, F.lit(-1)).otherwise(F.lit(1))


def detect(df: DataFrame, params: DataFrame, key: Sequence[str], metrics: Sequence[str],
           methods: Sequence[str] = ("zscore", "iqr"), z_threshold: float = ZSCORE_THRESHOLD,
           iqr_factor: float = IQR_FACTOR, attached: bool = False) -> DataFrame:
    """ANO2/3/6/7 in one projection: `<method>_prediction` per method,
    `zscore_score`, `ensemble_prediction`, `is_anomaly`.

    Model-based methods ("kernel", "isolation_forest") vote through a
    `<method>_prediction` column already on the rows. With `attached=True` the rows already
    carry the `<metric>_<stat>` columns (one join shared by several scorers).
    """
    out = df if attached else attach_params(df, params, key, metrics)
    out = out.select("*", *[reading(m).alias(f"_r_{m}") for m in metrics])
    out = out.withColumn("_max_abs_z", max_abs_z(metrics, "_r_"))
    votes = []
    for m in methods:
        name = f"{m}_prediction"
        if m == "zscore":
            out = out.withColumn(name, F.when(F.col("_max_abs_z") > z_threshold, F.lit(-1)).otherwise(F.lit(1)))
        elif m == "iqr":
            out = out.withColumn(name, iqr_vote(metrics, iqr_factor, "_r_"))
        elif m in ("kernel", "isolation_forest"):
            if name not in out.columns:
                raise ValueError(f"method '{m}' needs a `{name}` column on the rows")
        else:
            raise ValueError(f"Unknown method: {m}")
        votes.append(name)
    out = out.withColumn("zscore_score", -F.col("_max_abs_z")).drop("_max_abs_z", *[f"_r_{m}" for m in metrics])
    out = out.withColumn("ensemble_prediction", ensemble_vote(votes))
    out = out.withColumn("is_anomaly", F.col("ensemble_prediction") == -1)
    drop = [c for c in out.columns if any(c.startswith(f"{m}_") for m in metrics)
            and c not in df.columns]
    return out.drop(*drop)


def anomaly_report(df: DataFrame, params: DataFrame, key: Sequence[str], order: Sequence[str],
                   metrics: Sequence[str], methods: Sequence[str] = ("zscore", "iqr"),
                   chunk_rows="auto", **kw) -> DataFrame:
    """ANO9: per row index (0-based within the machine), votes, score,
    ensemble and flag."""
    d = detect(df, params, key, metrics, methods, **kw)
    return series_index(d, key, order, "index", chunk_rows)


def monitor(report: DataFrame, key: Sequence[str], order: Sequence[str],
            window: int = 10, alert_threshold: float = 0.5,
            vote_col: str = "ensemble_prediction", score_col: str | None = None,
            chunk_rows="auto") -> DataFrame:
    """ANO10: rolling anomaly rate and mean score over the last `window` rows
    (fewer at the start), alert flag and level.

    Without a forest the score is 0; pass `score_col` to average a real score instead.
    """
    return on_chunks(report, key, order, window - 1, 0, lambda d, k, o: _monitor(
        d, k, o, window, alert_threshold, vote_col, score_col), chunk_rows)


def _monitor(report, key, order, window, alert_threshold, vote_col, score_col) -> DataFrame:
    w = series_window(key, order).rowsBetween(-(window - 1), 0)
    score = F.col(score_col) if score_col else F.lit(0.0)
    rate = F.avg(F.when(F.col(vote_col) == -1, 1.0).otherwise(0.0)).over(w)
    out = (report.withColumn("window_anomaly_rate", rate)
                 .withColumn("anomaly_score", score.cast("double"))
                 .withColumn("window_avg_score", F.avg("anomaly_score").over(w)))
    level = None
    for bound, name in MONITOR_LEVELS:
        c = F.col("window_anomaly_rate") >= bound
        level = F.when(c, name) if level is None else level.when(c, name)
    return (out.withColumn("alert", F.col("window_anomaly_rate") >= alert_threshold)
               .withColumn("alert_level", level.otherwise(MONITOR_FLOOR)))


# ------------------------------------------------ reconstruction detectors --

def standardised_sq_error(metrics: Sequence[str]) -> Column:
    """Mean over metrics of the squared z (zero std replaced by 1)."""
    terms = [((F.col(m) - F.col(f"{m}_mean")) / nonzero(f"{m}_std")) ** 2 for m in metrics]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / float(len(metrics))


def reconstruction_mean(df: DataFrame, params: DataFrame, key: Sequence[str],
                        order: Sequence[str], metrics: Sequence[str], n: int = 100,
                        pct: float = 95.0) -> DataFrame:
    """ANO11 + ANO13: error = mean squared standardised value; threshold =
    pct-th percentile of the errors of the first n rows (the fit rows);
    prediction -1 above it; score = clip(err / (2 * threshold), 0, 1)."""
    scored = attach_params(df, params, key, metrics, ("mean", "std"))
    scored = scored.withColumn("reconstruction_error", standardised_sq_error(metrics))
    thr = (head_rows(scored, key, order, n)
           .groupBy(*key).agg(F.percentile("reconstruction_error", pct / 100.0).alias("threshold")))
    out = scored.join(thr, on=list(key), how="left")
    out = out.withColumn("prediction", F.when(F.col("reconstruction_error") > F.col("threshold"), -1)
                         .otherwise(1))
    out = out.withColumn("reconstruction_score",
                         clamp(F.col("reconstruction_error") / (F.col("threshold") * 2.0), 0.0, 1.0))
    drop = [c for c in out.columns if any(c.startswith(f"{m}_") for m in metrics)
            and c not in df.columns]
    return out.drop(*drop)
