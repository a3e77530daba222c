"""Health scoring (HLT2-HLT11, EW13).

Wide form: every metric's component score is a column expression on the row
joined with its machine's baseline, so the score needs no extra shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, fmt_fixed, health_status, reading
from ..model import series_window
from .anomaly import attach_params
from .series import on_chunks, series_index

# Default component weights (normalised by their sum) and the
# weight of a feature missing from the table.
DEFAULT_WEIGHTS = {"rms": 0.3, "kurtosis": 0.25, "peak_to_peak": 0.2, "fft_energy": 0.25}
UNKNOWN_WEIGHT = 0.1
UNKNOWN_SCORE = 75.0
# Recommendation texts by status, and per weak component by name match.
STATUS_ADVICE = {
    "critical": ["Immediate maintenance inspection required",
                 "Consider shutting down equipment to prevent damage"],
    "warning": ["Schedule maintenance within 24-48 hours", "Monitor equipment closely"],
    "fair": ["Plan maintenance within the next week"],
}
COMPONENT_ADVICE = [
    (("vibration", "rms"), "Check %s: possible bearing or alignment issue"),
    (("temperature",), "Check %s: possible cooling or lubrication issue"),
    (("kurtosis",), "Check %s: signal indicates potential impact events"),
]


def normalise_weights(weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """HLT2: weight / sum of weights (a plan-time constant)."""
    w = dict(weights or DEFAULT_WEIGHTS)
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def weight_of(metric: str, weights: Mapping[str, float]) -> float:
    return weights.get(metric, UNKNOWN_WEIGHT)


def with_deviations(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The readings `_r_<m>`, and what `statistical_component` clamps: `_dev_<m>` = 100 - 12.5 z^2 (null for a zero std). Each is
    a column once, as the compiled method gets too large for the JVM's compiler (8000 bytes) where they are repeated."""
    df = df.select("*", *[reading(m).alias(f"_r_{m}") for m in metrics])
    z = [F.when(F.col(f"{m}_std") != 0, F.abs(F.col(f"_r_{m}") - F.col(f"{m}_mean")) / F.col(f"{m}_std")) for m in metrics]
    df = df.select("*", *[c.alias(f"_z_{m}") for m, c in zip(metrics, z)])
    return df.select("*", *[(100.0 - F.col(f"_z_{m}") * F.col(f"_z_{m}") * 12.5).alias(f"_dev_{m}") for m in metrics]) \
        .drop(*[f"_z_{m}" for m in metrics])


def statistical_component(metric: str) -> Column:
    """HLT3: clamp(100 - 12.5 z^2, 0, 100); zero std: 100 if equal else 50. For rows of `with_deviations` that have a reading."""
    x, mu, sd = F.col(f"_r_{metric}"), F.col(f"{metric}_mean"), F.col(f"{metric}_std")
    return F.when(sd == 0, F.when(x == mu, F.lit(100.0)).otherwise(F.lit(50.0))).otherwise(clamp(F.col(f"_dev_{metric}"), 0.0, 100.0))


def heuristic_component(metric: str, value=None) -> Column:
    """HLT4: name-based rules used before any calibration."""
    v = F.col(metric) if value is None else value
    name = metric.lower()
    if "rms" in name:
        return (F.when(v < 0.05, 100.0).when(v < 0.1, 80.0).when(v < 0.2, 50.0)
                 .otherwise(F.greatest(F.lit(0.0), 100.0 - v * 100.0)))
    if "kurtosis" in name:
        return F.greatest(F.lit(0.0), 100.0 - F.abs(v) * 20.0)
    if "temperature" in name:
        return (F.when((v >= 40) & (v <= 60), 100.0).when((v >= 30) & (v <= 70), 80.0)
                 .when((v >= 20) & (v <= 80), 60.0)
                 .otherwise(F.greatest(F.lit(0.0), 100.0 - F.abs(v - 50.0))))
    return F.lit(UNKNOWN_SCORE)


def component(metric: str, calibrated: bool) -> Column:
    """HLT5 routing: baseline -> statistical; uncalibrated -> heuristic;
    calibrated but unknown metric -> 75."""
    if not calibrated:
        return F.when(reading(metric).isNotNull(), heuristic_component(metric))
    return F.when(F.col(f"_r_{metric}").isNotNull(), F.when(F.col(f"{metric}_mean").isNull(), F.lit(UNKNOWN_SCORE))
                  .otherwise(statistical_component(metric)))


def with_score(df: DataFrame, metrics: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """HLT6: `health_score`, the weighted mean of the component columns `comp_<m>` that aren't null, clamped; null without any."""
    num, den = F.lit(0.0), F.lit(0.0)
    for m in metrics:
        w = weight_of(m, weights)
        c = F.col(f"comp_{m}")
        num = num + F.coalesce(c * w, F.lit(0.0))
        den = den + F.when(c.isNotNull(), w).otherwise(0.0)
    # over an array, as in `anomaly.iqr_vote`: the compiled stage ends there
    there = F.exists(F.array(*[F.col(f"comp_{m}") for m in metrics]), lambda c: c.isNotNull())
    df = df.select("*", num.alias("_num"), den.alias("_den"), there.alias("_there"))
    df = df.select("*", F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(F.col("_num")).alias("_mean"))
    return df.withColumn("health_score", F.when(F.col("_there"), clamp(F.col("_mean"), 0.0, 100.0))).drop("_num", "_den", "_there", "_mean")


def health_score(df: DataFrame, params: DataFrame | None, key: Sequence[str],
                 metrics: Sequence[str], weights: Mapping[str, float] | None = None,
                 keep_components: bool = True, attached: bool = False) -> DataFrame:
    """HLT5 + HLT6 + FN7: `comp_<m>` columns, `health_score`, `status`.
    `params=None` scores uncalibrated (heuristics); `attached=True` means the
    rows already carry `<metric>_mean/std`."""
    weights = normalise_weights(weights)
    calibrated = params is not None or attached
    out = df if attached or params is None else attach_params(df, params, key, metrics,
                                                               ("mean", "std"))
    if calibrated:
        out = with_deviations(out, metrics)
    out = out.withColumns({f"comp_{m}": component(m, calibrated) for m in metrics}).drop(
        *[f"{t}_{m}" for t in ("_r", "_dev") for m in metrics])
    out = with_score(out, metrics, weights)
    out = out.withColumn("status", F.when(F.col("health_score").isNotNull(), health_status("health_score")))
    drop = [c for c in out.columns if c not in df.columns and
            any(c == f"{m}_mean" or c == f"{m}_std" for m in metrics)]
    if not keep_components:
        drop += [f"comp_{m}" for m in metrics]
    return out.drop(*drop)


def health_trend(df: DataFrame, key: Sequence[str], order: Sequence[str],
                 window: int = 10, score_col: str = "health_score",
                 chunk_rows="auto") -> DataFrame:
    """HLT7: (last - first) / count over the last `window` scores:
    > 1 improving, < -1 degrading, else stable (stable with < 2 scores)."""
    def trend(d, k, o):
        w = series_window(k, o).rowsBetween(-(window - 1), 0)
        cnt = F.count(score_col).over(w)
        slope = (F.col(score_col) - F.first(score_col).over(w)) / cnt
        return d.withColumn("trend", F.when(cnt < 2, "stable").when(slope > 1, "improving")
                            .when(slope < -1, "degrading").otherwise("stable"))

    return on_chunks(df, key, order, window - 1, 0, trend, chunk_rows)


def recommendations(metrics: Sequence[str], status_col: str = "status") -> Column:
    """HLT9: advice by status, then one line per component below 50."""
    st = F.col(status_col)
    by_status = F.when(st == "critical", F.array(*[F.lit(s) for s in STATUS_ADVICE["critical"]]))
    for s in ("warning", "fair"):
        by_status = by_status.when(st == s, F.array(*[F.lit(x) for x in STATUS_ADVICE[s]]))
    by_status = by_status.otherwise(F.array().cast("array<string>"))
    per_comp = []
    for m in metrics:
        text = None
        for needles, fmt in COMPONENT_ADVICE:
            if any(n in m.lower() for n in needles):
                text = fmt % m
                break
        if text is not None:
            per_comp.append(F.when(F.col(f"comp_{m}") < 50, F.lit(text)))
    if not per_comp:
        return by_status
    return F.concat(by_status, F.filter(F.array(*per_comp), lambda x: x.isNotNull()))


def alert_struct(kind, severity, message) -> Column:
    return F.struct(F.lit(kind).alias("type"), severity.alias("severity"), message.alias("message"))


def health_alerts(metrics: Sequence[str], score_col: str = "health_score",
                  status_col: str = "status") -> Column:
    """HLT10: a status alert for warning/critical, then one per component
    below 30 (critical) or 50 (warning)."""
    st = F.col(status_col)
    items = [F.when(st.isin("critical", "warning"),
                    alert_struct("health_score", st,
                                 F.format_string("Health score is %s%%", fmt_fixed(score_col, 1))))]
    for m in metrics:
        c = F.col(f"comp_{m}")
        items.append(F.when(c < 30, alert_struct(
            "component", F.lit("critical"),
            F.format_string(f"{m} score is critically low: %s%%", fmt_fixed(c, 1))))
            .when(c < 50, alert_struct(
                "component", F.lit("warning"),
                F.format_string(f"{m} score is concerning: %s%%", fmt_fixed(c, 1)))))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def health_report(df: DataFrame, params: DataFrame | None, key: Sequence[str],
                  order: Sequence[str], metrics: Sequence[str],
                  weights: Mapping[str, float] | None = None, trend_window: int = 10) -> DataFrame:
    """HLT8: score, status, components map, trend, recommendations, alerts."""
    scored = health_score(df, params, key, metrics, weights)
    scored = health_trend(scored, key, order, trend_window)
    comps = F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]),
                              F.array(*[F.col(f"comp_{m}") for m in metrics]))
    return (scored.withColumn("components", comps)
                  .withColumn("recommendations", recommendations(metrics))
                  .withColumn("alerts", health_alerts(metrics)))


def health_history(df: DataFrame, params: DataFrame | None, key: Sequence[str],
                   metrics: Sequence[str], weights=None) -> DataFrame:
    """HLT11: machine, score and one column per component."""
    scored = health_score(df, params, key, metrics, weights)
    return scored.select(*key, "health_score", *[F.col(f"comp_{m}").alias(m) for m in metrics])


def remaining_steps(df: DataFrame, key: Sequence[str], order: Sequence[str],
                    score_col: str = "health_score", failure: float = 30.0,
                    min_samples: int = 10, chunk_rows="auto") -> DataFrame:
    """EW13: per series, steps until the fitted health line reaches
    `failure`; null with < min_samples, when not degrading (last >= first)
    or with a non-negative slope. The fit itself is a grouped aggregate
    (partial aggregation splits a hot machine)."""
    s = series_index(df, key, order, "_x", chunk_rows).withColumn("_x", F.col("_x").cast("double"))
    first_last = [F.min_by(score_col, "_x").alias("first"), F.max_by(score_col, "_x").alias("last")]
    g = s.groupBy(*key).agg(F.count(score_col).alias("n"),
                            F.regr_slope(score_col, "_x").alias("slope"),
                            F.regr_intercept(score_col, "_x").alias("intercept"), *first_last)
    steps = (F.lit(failure) - F.col("intercept")) / F.col("slope") - (F.col("n") - 1)
    ok = (F.col("n") >= min_samples) & (F.col("last") < F.col("first")) & (F.col("slope") < 0)
    return g.select(*key, "n", F.when(ok, F.greatest(F.lit(0.0), steps)).alias("remaining_steps"))
