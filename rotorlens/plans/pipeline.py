"""End-to-end plans (PIP1, PIP3-PIP5): the per-sample pipeline composed of
the operators, as one lazy DataFrame plan.

Fit once (one grouped aggregate, PIP3), join the fitted parameters to the
rows once, then every score is a column of the same row; the early-warning
columns reuse the rows' (machine, order) window. Only the cooldown and the
per-machine summaries shuffle again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import health_status
from ..operators import alerts as al
from ..operators import anomaly as ano
from ..operators import baseline as bl
from ..operators import health as hl
from ..operators import signals as sg
from ..operators import warning as ew
from ..operators.series import join_on, resolve_chunk_rows
from ..session import written


def fit_all(df: DataFrame, key: Sequence[str], order: Sequence[str], metrics: Sequence[str],
            n: int = 100, pct: float = 95.0) -> DataFrame:
    """PIP3: detector, health and early-warning parameters from one
    baseline aggregate."""
    return bl.fit_baseline(df, key, order, metrics, n=n, pct=pct)


def process_samples(df: DataFrame, params: DataFrame, key: Sequence[str], order: Sequence[str],
                    metrics: Sequence[str], weights: Mapping[str, float] | None = None,
                    history: int = ew.HISTORY, with_warning: bool = True,
                    chunk_rows="auto") -> DataFrame:
    """PIP1: one result row per sample - anomaly votes and score, health
    score and status, and the early-warning result as of that sample.
    `chunk_rows` is that of the per-sample early warning (operators.series)."""
    if with_warning:  # counted before the rows are joined and scored
        chunk_rows = resolve_chunk_rows(df, key, chunk_rows)
    j = ano.attach_params(df, params, key, metrics)
    d = ano.detect(j, None, key, metrics, attached=True)
    d = d.withColumn("anomaly_score", F.col("zscore_score"))
    h = hl.health_score(d, None, key, metrics, weights, attached=True, keep_components=False)
    h = h.drop(*[c for c in h.columns if any(c == f"{m}_{s}" for m in metrics
                                              for s in ("mean", "std", "q1", "q3", "iqr"))])
    if not with_warning:
        return h
    return ew.warning_rolling(h, params, key, order, metrics, history=history,
                              chunk_rows=chunk_rows)


def pipeline_alerts(samples: DataFrame, key: Sequence[str], order: Sequence[str],
                    metrics: Sequence[str], thresholds: DataFrame,
                    cooldown_minutes: int = al.COOLDOWN_MINUTES, time_col: str = "T",
                    chunk_rows="auto") -> DataFrame:
    """ALR6 + ALR7 + ALR8 on PIP1 output: candidates in per-sample order
    (health, anomaly, thresholds, early warnings), cooled down, numbered."""
    cands = al.candidates_one_pass(samples, key, order, metrics, thresholds,
                                   preds_col="predictions")
    seq = [c for c in order if c != time_col] + ["ord"]
    kept = al.cooldown(cands, cooldown_minutes, time_col, seq, chunk_rows=chunk_rows)
    return al.assign_ids(kept, [time_col, *seq])


def batch_analysis(signals: DataFrame, key: Sequence[str], order: Sequence[str], thresholds: DataFrame, n: int = 100,
                   samples: str = "samples", rate: float = sg.SAMPLING_RATE, alert_metrics: Sequence[str] | None = None,
                   chunk_rows="auto") -> DataFrame:
    """PIP2: the whole flow over stored snapshots: all features of each, the baseline of each machine's first `n`, then per
    snapshot what `process_samples` gives, and `n_alerts`, the candidates it raises. Early warnings and thresholds
    are those of `alert_metrics`, by default all features."""
    features = written(sg.all_features(signals, samples, rate).drop(samples), "features")
    known = set(signals.columns)
    metrics = [f.name for f in features.schema.fields if f.name not in known]
    features = features.withColumns({m: F.col(m).cast("double") for m in metrics})
    params = fit_all(features, key, order, metrics, n=n)
    scored = written(process_samples(features, params, key, order, metrics, with_warning=False), "scores")
    scored = written(ew.warning_rolling(scored, params, key, order, alert_metrics or metrics, chunk_rows=chunk_rows), "samples")
    raised = al.candidates_one_pass(scored, key, order, alert_metrics or metrics, thresholds).groupBy(*key, *order).agg(F.count(F.lit(1)).alias("n_alerts"))
    out = join_on(scored, raised, [*key, *order], "left")
    return out.withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0)).cast("bigint"))


def latest_state(samples: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """PIP4: the newest sample's health, status and flags per machine
    (max_by over the order struct: a partial aggregate, no sort)."""
    o = F.struct(*order)
    cols = ["health_score", "status", "is_anomaly", "anomaly_score"]
    present = [c for c in cols if c in samples.columns]
    best = F.max_by(F.struct(*present, *[F.col(c) for c in order]), o)
    return samples.groupBy(*key).agg(best.alias("_s")).select(*key, "_s.*")


def fleet_summary(latest: DataFrame, alerts: DataFrame | None) -> DataFrame:
    """PIP5: machine count, status counts and alert totals in one row."""
    eq = latest.agg(F.count(F.lit(1)).alias("total_equipment"),
                    *[F.count_if(F.col("status") == s).alias(f"n_{s}")
                      for s in ("excellent", "good", "fair", "warning", "critical")])
    if alerts is None:
        return eq
    if "resolved" not in alerts.columns:
        alerts = alerts.withColumn("resolved", F.lit(False)).withColumn("acknowledged", F.lit(False))
    return eq.crossJoin(al.alert_summary(alerts))  # two one-row aggregates


def status_of(score_col: str = "health_score"):
    return health_status(score_col)
