"""Cleaning and feature operators on seeded fixtures (the intent of the
reference's processing tests), checked against NumPy / pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rotorlens.functions.filters import butter_lowpass, filtfilt
from rotorlens.operators import cleaning as cl
from rotorlens.operators import rolling as rl
from rotorlens.operators import signals as sg

RNG = np.random.default_rng(42)


def frame(spark, arr, cols):
    pdf = pd.DataFrame(arr, columns=cols)
    pdf.insert(0, "E", 1)
    pdf.insert(1, "i", np.arange(len(pdf)))
    return spark.createDataFrame(pdf)


def test_standard_scaler_and_inverse(spark):
    cols = ["ch1", "ch2", "ch3", "ch4"]
    x = RNG.normal(size=(100, 4))
    df = frame(spark, x, cols)
    p = cl.fit_scaler(df, ["E"], cols)
    s = cl.scale(df, p, ["E"], cols).orderBy("i").toPandas()[cols].to_numpy()
    assert np.allclose(s.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(s.std(axis=0), 1, atol=1e-9)
    back = cl.inverse_scale(cl.scale(df, p, ["E"], cols), p, ["E"], cols).orderBy("i").toPandas()
    assert np.allclose(back[cols].to_numpy(), x)


def test_impute_all_methods_fill_gaps(spark):
    cols = ["ch1", "ch2", "ch3", "ch4"]
    x = RNG.normal(size=(100, 4))
    x[10:15, 0] = np.nan
    x[50, 2] = np.nan
    pdf = pd.DataFrame(x, columns=cols)
    df = frame(spark, x, cols).replace(float("nan"), None)
    for m in cl.IMPUTERS:
        out = cl.impute(df, ["E"], ["i"], cols, m).orderBy("i").toPandas()
        assert out[cols].isna().sum().sum() == 0, m
    lin = cl.impute(df, ["E"], ["i"], cols, "interpolate").orderBy("i").toPandas()
    assert np.allclose(lin["ch1"], pdf["ch1"].interpolate().bfill().ffill())
    ff = cl.impute(df, ["E"], ["i"], cols, "forward_fill", 2).orderBy("i").toPandas()
    assert np.allclose(ff["ch1"].fillna(-1), pdf["ch1"].ffill(limit=2).bfill(limit=2).fillna(-1))
    cnt = cl.imputed_count(df, cl.impute(df, ["E"], ["i"], cols, "mean"), cols).first()
    assert cnt["imputed"] == 6


def test_outliers_replaced_by_median(spark):
    cols = ["ch1", "ch2", "ch3", "ch4"]
    x = RNG.normal(size=(100, 4))
    x[50, 0], x[75, 2] = 100.0, -50.0
    out = cl.remove_outliers(frame(spark, x, cols), ["E"], cols, "zscore", 3.0).orderBy("i").toPandas()
    assert out.loc[50, "ch1_outlier"] and out.loc[75, "ch3_outlier"]
    assert out.loc[50, "ch1"] == np.median(x[:, 0])
    iq = cl.remove_outliers(frame(spark, x, cols), ["E"], cols, "iqr", 1.5).toPandas()
    assert iq["ch1_outlier"].sum() >= 1


def test_filters_smooth(spark):
    t = np.arange(512) / 20000.0
    sig = np.sin(2 * np.pi * 100 * t) + 0.1 * RNG.normal(size=t.size)
    df = frame(spark, sig[:, None], ["v"])
    ma = cl.filter_moving_average(df, ["E"], ["i"], ["v"], 5).orderBy("i").toPandas()["v"]
    assert np.allclose(ma, np.convolve(sig, np.ones(5) / 5, mode="same"))
    ma4 = cl.filter_moving_average(df, ["E"], ["i"], ["v"], 4).orderBy("i").toPandas()["v"]
    assert np.allclose(ma4, np.convolve(sig, np.ones(4) / 4, mode="same"))
    sg_ = cl.filter_savgol(df, ["E"], ["i"], ["v"], 11, 3).orderBy("i").toPandas()["v"].to_numpy()
    assert np.std(np.diff(sg_)) < np.std(np.diff(sig))
    # the first point equals the cubic fitted to the first 11 samples
    c = np.polyfit(np.arange(11), sig[:11], 3)
    assert abs(np.polyval(c, 0) - sg_[0]) < 1e-9
    med = cl.filter_median(df, ["E"], ["i"], ["v"], 5).orderBy("i").toPandas()["v"].to_numpy()
    ext = np.r_[sig[1::-1], sig, sig[:-3:-1]]
    ref = np.array([np.median(ext[k:k + 5]) for k in range(sig.size)])
    assert np.allclose(med, ref)


def test_butterworth_design_and_filter():
    b, a = butter_lowpass(4, 0.1)
    assert np.allclose(a, [1.0, -3.18063855, 3.86119435, -2.11215536, 0.43826514], atol=1e-7)
    assert np.allclose(b, [0.0004166, 0.0016664, 0.0024996, 0.0016664, 0.0004166], atol=1e-7)
    x = np.ones((1, 200))
    assert np.allclose(filtfilt(b, a, x), 1.0)


def test_time_and_frequency_features(spark):
    n = 2048
    t = np.arange(n) / 20000.0
    sig = np.sin(2 * np.pi * 1000 * t) + 0.1 * RNG.normal(size=n)
    df = spark.createDataFrame([(1, 0, sig.tolist())], "E long, snapshot long, samples array<double>")
    f = sg.all_features(df).toPandas().iloc[0]
    assert abs(f["rms"] - np.sqrt(np.mean(sig ** 2))) < 1e-9
    m, s = sig.mean(), sig.std()
    assert abs(f["kurtosis"] - (np.mean(((sig - m) / s) ** 4) - 3)) < 1e-9
    assert abs(f["p75"] - np.percentile(sig, 75)) < 1e-12
    assert abs(f["zero_crossing_rate"] - len(np.where(np.diff(np.signbit(sig)))[0]) / n) < 1e-12
    assert abs(f["dominant_freq"] - 1000.0) < 20
    yf = np.abs(np.fft.fft(sig))[1:n // 2] / n
    assert abs(f["total_power"] - np.sum(yf ** 2)) < 1e-9
    # envelope of an analytic signal computed directly with NumPy
    Y = np.fft.fft(sig)
    h = np.zeros(n)
    h[0] = h[n // 2] = 1
    h[1:n // 2] = 2
    env = np.abs(np.fft.ifft(Y * h))
    assert abs(f["envelope_mean"] - env.mean()) < 1e-9
    assert abs(f["envelope_total_power"] - np.sum(np.abs(np.fft.fft(env))[1:n // 2] ** 2)) < 1e-6
    for k in sg.TIME_FEATURES + sg.FREQ_FEATURES + sg.ENVELOPE_FEATURES:
        assert np.isfinite(f[k]), k


def test_rolling_features_match_pandas(spark):
    x = RNG.normal(size=(60, 1)) + 5
    df = frame(spark, x, ["v"])
    out = rl.rolling_features(df, ["E"], ["i"], ["v"], 10).orderBy("i").toPandas()
    s = pd.Series(x[:, 0])
    assert np.allclose(out["v_rolling_mean"].fillna(-1), s.rolling(10).mean().fillna(-1))
    assert np.allclose(out["v_rolling_std"].fillna(-1), s.rolling(10).std().fillna(-1))
    assert np.allclose(out["v_ema"], s.ewm(span=10).mean(), atol=1e-10)
    assert np.allclose(out["v_pct_change"].fillna(-9), s.pct_change().fillna(-9))
    assert len([c for c in out.columns if c.startswith("v_")]) == 8


def test_resample_fills_empty_bins(spark):
    pdf = pd.DataFrame({"E": [1] * 4, "T": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:20",
                                                           "2024-01-01 03:05", "2024-01-01 03:50"]),
                        "v": [1.0, 3.0, 5.0, 7.0]})
    df = spark.createDataFrame(pdf).withColumn("T", F.col("T").cast("timestamp_ntz"))
    m = cl.resample(df, ["E"], "T", ["v"], "1 hour", "mean").orderBy("T").toPandas()
    assert list(m["v"].fillna(-1)) == [2.0, -1, -1, 6.0]
    s = cl.resample(df, ["E"], "T", ["v"], "1 hour", "sum").orderBy("T").toPandas()
    assert list(s["v"]) == [4.0, 0.0, 0.0, 12.0]


def test_rolling_chunked_equals_plain(spark):
    """Chunked (skew-safe) windows give the same values as one window per
    machine, including forward fills across chunk cuts."""
    rows = []
    for e, n in ((1, 700), (2, 40)):  # one hot machine, one small
        v = RNG.normal(size=n) + 5
        v[100:260] = np.nan  # a null run longer than the halo
        rows += [(e, i, None if np.isnan(x) else float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "E long, i long, v double")
    plain = rl.rolling_features(df, ["E"], ["i"], ["v"], 10).orderBy("E", "i").toPandas()
    chunk = rl.rolling_features(df, ["E"], ["i"], ["v"], 10, chunk_rows=250).orderBy("E", "i").toPandas()
    assert list(plain.columns) == list(chunk.columns) and len(plain) == len(chunk)
    for c in plain.columns:
        a, b = plain[c].astype(float).fillna(-999), chunk[c].astype(float).fillna(-999)
        assert np.allclose(a, b, atol=1e-9), c


def test_chunked_operators_equal_plain(spark):
    from rotorlens.operators import anomaly as ano
    from rotorlens.operators import health as hl
    rows = []
    for e, n in ((1, 300), (2, 30)):
        v = RNG.normal(size=n) * 20 + 50
        v[30:47] = np.nan    # crosses a chunk cut
        v[100:160] = np.nan  # covers whole chunks
        v[-3:] = np.nan      # trailing gap
        rows += [(e, i, None if np.isnan(x) else float(x), -1 if (x > 60) else 1)
                 for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "E long, i long, v double, ensemble_prediction int")
    key, order = ["E"], ["i"]

    def same(a, b):
        a = a.orderBy("E", "i").toPandas()
        b = b.orderBy("E", "i").toPandas()
        assert list(a.columns) == list(b.columns) and len(a) == len(b)
        for c in a.columns:
            if a[c].dtype.kind in "fi":
                assert np.allclose(a[c].astype(float).fillna(-999), b[c].astype(float).fillna(-999))
            else:
                assert (a[c].astype(str) == b[c].astype(str)).all(), c

    same(ano.monitor(df, key, order, 10), ano.monitor(df, key, order, 10, chunk_rows=37))
    h = df.withColumn("health_score", F.coalesce("v", F.lit(0.0)))
    same(hl.health_trend(h, key, order, 10), hl.health_trend(h, key, order, 10, chunk_rows=23))
    for m in ("forward_fill", "backward_fill", "interpolate"):
        for gap in (2, None):
            same(cl.impute(df, key, order, ["v"], m, gap),
                 cl.impute(df, key, order, ["v"], m, gap, chunk_rows=19))
    same(cl.filter_moving_average(df.fillna(0.0), key, order, ["v"], 5),
         cl.filter_moving_average(df.fillna(0.0), key, order, ["v"], 5, chunk_rows=17))


def test_skew_safe_indexes_equal_plain(spark):
    from rotorlens.operators import health as hl
    from rotorlens.operators import monitor as mo
    rows = [(e, i, float(RNG.normal() * 10 + 60 - 0.05 * i)) for e, n in ((1, 400), (2, 50))
            for i in range(n)]
    df = spark.createDataFrame(rows, "E long, i long, rms double")
    a = hl.remaining_steps(df.withColumnRenamed("rms", "health_score"), ["E"], ["i"]).orderBy("E")
    b = hl.remaining_steps(df.withColumnRenamed("rms", "health_score"), ["E"], ["i"],
                           chunk_rows=37).orderBy("E")
    # same positions; the regression sums may merge in another order (1e-15)
    for ra, rb in zip(a.collect(), b.collect()):
        assert ra.E == rb.E and ra.n == rb.n
        assert (ra.remaining_steps is None) == (rb.remaining_steps is None)
        if ra.remaining_steps is not None:
            assert abs(ra.remaining_steps - rb.remaining_steps) < 1e-9
    st = mo.upload_stats(df, ["E"], ["i"])
    x = mo.monitor_scores(df, st, ["E"], ["i"]).select("E", "i", "idx").orderBy("E", "i").collect()
    y = mo.monitor_scores(df, st, ["E"], ["i"], chunk_rows=37).select("E", "i", "idx") \
        .orderBy("E", "i").collect()
    assert x == y


def test_chunked_edge_filters_equal_plain(spark):
    rows = [(e, i, float(RNG.normal() * 5 + i * 0.1)) for e, n in ((1, 250), (2, 30), (3, 3))
            for i in range(n)]
    df = spark.createDataFrame(rows, "E long, i long, v double")
    big = df.filter("E < 3")  # Savitzky-Golay needs >= 11 rows per series

    def same(a, b):
        a = a.orderBy("E", "i").toPandas()
        b = b.orderBy("E", "i").toPandas()
        assert list(a.columns) == list(b.columns) and len(a) == len(b)
        for c in a.columns:
            assert np.allclose(a[c].astype(float).fillna(-999), b[c].astype(float).fillna(-999)), c

    same(cl.filter_savgol(big, ["E"], ["i"], ["v"]),
         cl.filter_savgol(big, ["E"], ["i"], ["v"], chunk_rows=13))
    same(cl.moving_average_valid(df, ["E"], ["i"], "v", 5),
         cl.moving_average_valid(df, ["E"], ["i"], "v", 5, chunk_rows=7))


def test_chunked_median_equals_plain(spark):
    rows = [(e, i, float(RNG.normal())) for e, n in ((1, 120), (2, 9), (3, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "E long, i long, v double")
    a = cl.filter_median(df, ["E"], ["i"], ["v"], 5).orderBy("E", "i").toPandas()
    for c in (7, 3):
        b = cl.filter_median(df, ["E"], ["i"], ["v"], 5, chunk_rows=c).orderBy("E", "i").toPandas()
        assert len(a) == len(b) and np.allclose(a["v"], b["v"])


def test_forecast_spacing_check(spark):
    from datetime import datetime, timedelta
    from rotorlens.operators.forecast import _step_seconds
    t0 = datetime(2024, 1, 1)
    rows = [("daily", t0 + timedelta(days=i)) for i in range(10)]
    rows += [("tenmin", t0 + timedelta(minutes=10 * i)) for i in range(40)]
    rows += [("irregular", t0 + timedelta(minutes=m)) for m in (0, 10, 25, 40, 200)]
    rows += [("two", t0), ("two", t0 + timedelta(hours=5))]
    df = spark.createDataFrame(rows, "E string, T timestamp").withColumn("T", F.col("T").cast("timestamp_ntz"))
    got = {r.E: r.step_s for r in _step_seconds(df, ["E"], "T").collect()}
    assert got == {"daily": 86400.0, "tenmin": 600.0, "irregular": 3600.0, "two": 3600.0}
