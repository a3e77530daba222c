"""Units, gaps, NaN and large micro-batches: results must not depend on the fixtures' kindness."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotorlens.operators import anomaly, baseline, health, warning
from rotorlens.operators.rolling import rolling_features
from rotorlens.streaming import streams


def series(spark, values):
    return spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(values)],
                                 "E bigint, T bigint, a double")


@pytest.mark.parametrize("size,gaps", [(1.0, False), (1e-9, False), (1e13, False), (1.0, True)])
def test_per_sample_warning_ends_as_the_whole_series(spark, size, gaps):
    rng = np.random.default_rng(3)
    v = [(10 + max(0, i - 100) * 0.05 + rng.normal() * 0.01) * size for i in range(200)]
    if gaps:
        v = [None if i % 5 == 2 else x for i, x in enumerate(v)]
    df = series(spark, v)
    params = baseline.fit_baseline(df, ["E"], ["T"], ["a"], n=100)
    whole = warning.early_warning(df, params, ["E"], ["T"], ["a"]).first()
    last = warning.warning_rolling(df, params, ["E"], ["T"], ["a"]).orderBy(F.desc("T")).first()
    assert whole["degradation_rate"] > 0
    for c in ("degradation_rate", "remaining_useful_life_hours", "overall_risk_score", "earliest_anomaly_hours"):
        assert last[c] == pytest.approx(whole[c], rel=1e-6) if whole[c] is not None else last[c] is None
    assert last["has_warning"] == whole["has_warning"]


def test_ema_over_a_long_gap(spark):
    rng = np.random.default_rng(1)
    v = [None if 20 <= i < 230 else float(x) for i, x in enumerate(rng.normal(15, 3, 400))]
    got = rolling_features(series(spark, v), ["E"], ["T"], ["a"]).orderBy("T").toPandas()["a_ema"]
    want = pd.Series(v, dtype=float).ewm(span=10).mean()
    assert np.allclose(got, want, rtol=1e-9)


def test_missing_readings_are_no_faults(spark):
    rows = [(1, i, 10.0 + i % 3, 5.0 + i % 2) for i in range(50)] + [(1, 50, None, 5.0), (1, 51, float("nan"), 5.0), (1, 52, None, None)]
    df = spark.createDataFrame(rows, "E bigint, T bigint, a double, b double")
    params = baseline.fit_baseline(df.filter("T < 50"), ["E"], ["T"], ["a", "b"], n=50)
    got = {r["T"]: r for r in health.health_score(anomaly.detect(df, params, ["E"], ["a", "b"]), params, ["E"], ["a", "b"]).collect()}
    for t in (50, 51):
        assert got[t]["ensemble_prediction"] == 1 and got[t]["health_score"] > 80
    assert got[52]["health_score"] is None and got[52]["status"] is None


def test_stream_rows_of_a_key_are_ordered_across_frames():
    n = 25_000
    t = np.random.default_rng(0).permutation(n)
    df = pd.DataFrame({"T": pd.to_datetime(t, unit="s"), "seq": t, "op": "put"})
    df.loc[df["seq"] == 12_000, "op"] = "reset"
    parts = list(streams._segments([df[:10_000], df[10_000:20_000], df[20_000:]], ["T", "seq"], "op"))
    assert [r for r, _ in parts] == [False, True]
    assert [len(p) for _, p in parts] == [12_000, n - 12_001]
    assert all(p["seq"].is_monotonic_increasing for _, p in parts)


def test_stream_lines_equal_polyfit():
    rng = np.random.default_rng(2)
    v = np.where(rng.random(90) < 0.2, np.nan, rng.normal(size=90))
    got = streams._lines(v, 60, 40)
    for i in range(60):
        w = v[max(0, 30 + i - 39):30 + i + 1]
        w = w[~np.isnan(w)]
        b, a = np.polyfit(np.arange(len(w)), w, 1)
        assert np.allclose([got["n"][i], got["slope"][i], got["intercept"][i], got["current"][i]], [len(w), b, a, w[-1]])
