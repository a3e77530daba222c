"""Early warning on the reference's fixture shapes: calibration, too few
samples, stable history, degrading history; batch and rolling agree."""

import numpy as np
import pandas as pd

from rotorlens.operators import baseline as bl
from rotorlens.operators import warning as ew

RNG = np.random.default_rng(42)
METRICS = ["rms", "kurtosis", "temperature"]


def baseline(n=100):
    return pd.DataFrame({"rms": RNG.normal(0.05, 0.01, n), "kurtosis": RNG.normal(0.5, 0.1, n),
                         "temperature": RNG.normal(45, 2, n)})


def series(spark, hist):
    pdf = pd.concat([baseline(), hist], ignore_index=True)
    pdf.insert(0, "E", 1)
    pdf.insert(1, "i", np.arange(len(pdf)))
    return spark.createDataFrame(pdf)


def stable(n=50):
    return pd.DataFrame({"rms": RNG.normal(0.05, 0.005, n), "kurtosis": RNG.normal(0.5, 0.05, n),
                         "temperature": RNG.normal(45, 1, n)})


def degrading(n=50):
    i = np.arange(n)
    return pd.DataFrame({"rms": 0.05 + 0.003 * i, "kurtosis": 0.5 + 0.04 * i,
                         "temperature": 45 + 0.3 * i})


def run(spark, hist, history=50):
    df = series(spark, hist)
    p = bl.fit_baseline(df, ["E"], ["i"], METRICS, n=100)
    tail = bl.tail_rows(df, ["E"], ["i"], history)
    return ew.early_warning(tail, p, ["E"], ["i"], METRICS, history=history).toPandas().iloc[0], p


def test_calibration_thresholds(spark):
    df = series(spark, stable())
    p = bl.fit_baseline(df, ["E"], ["i"], METRICS, n=100).toPandas().set_index("M")
    assert (p["warn"] < p["crit"]).all()
    assert abs(p.loc["temperature", "mean"] - 45) < 1


def test_too_few_samples(spark):
    out, _ = run(spark, stable(10), history=10)
    assert not out.has_warning and out.overall_risk_score == 0.0


def test_stable_low_risk(spark):
    out, _ = run(spark, stable())
    assert out.overall_risk_score < 50


def test_degrading_raises_risk(spark):
    out, _ = run(spark, degrading())
    assert out.overall_risk_score > 0
    assert out.degradation_rate > 0
    assert out.remaining_useful_life_hours is not None


def test_rolling_equals_batch_at_each_row(spark):
    df = series(spark, degrading())
    p = bl.fit_baseline(df, ["E"], ["i"], METRICS, n=100)
    roll = ew.warning_rolling(df, p, ["E"], ["i"], METRICS, history=50).orderBy("i").toPandas()
    for end in (60, 120, 149):
        sub = df.filter(f"i <= {end}")
        b = ew.early_warning(sub, p, ["E"], ["i"], METRICS, history=50).toPandas().iloc[0]
        r = roll.iloc[end]
        assert abs(b.overall_risk_score - r.overall_risk_score) < 1e-6
        assert bool(b.has_warning) == bool(r.has_warning)


def test_pipeline_chunked_equals_plain(spark):
    from conftest import SF_SMALL
    from rotorlens.model import LINEITEM_METRICS, LINEITEM_ORDER, lineitem_features
    from rotorlens.operators import alerts as al
    from rotorlens.plans import pipeline as pl
    f = lineitem_features(spark, SF_SMALL)
    p = pl.fit_all(f, ["E"], LINEITEM_ORDER, LINEITEM_METRICS)
    cols = ["E", "T", "l_orderkey", "l_linenumber", "l_partkey", "overall_risk_score", "has_warning"]
    a = pl.process_samples(f, p, ["E"], LINEITEM_ORDER, LINEITEM_METRICS).select(*cols)
    b = pl.process_samples(f, p, ["E"], LINEITEM_ORDER, LINEITEM_METRICS, chunk_rows=500).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    th = al.thresholds_table(spark, [("l_quantity", 40.0, 48.0, False)])
    s = pl.process_samples(f, p, ["E"], LINEITEM_ORDER, LINEITEM_METRICS)
    x = pl.pipeline_alerts(s, ["E"], LINEITEM_ORDER, LINEITEM_METRICS, th, 2880)
    y = pl.pipeline_alerts(s, ["E"], LINEITEM_ORDER, LINEITEM_METRICS, th, 2880, chunk_rows=50)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0

