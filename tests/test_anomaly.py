"""Detectors on seeded normal / anomalous features (the reference's
statistical floors: > 80 % of normal rows normal, > 50 % of anomalies
flagged)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rotorlens.operators import anomaly as ano
from rotorlens.operators import baseline as bl
from rotorlens.operators import models as md

RNG = np.random.default_rng(42)
COLS = [f"f{i}" for i in range(5)]


def data(spark):
    normal = RNG.normal(size=(100, 5)) * 0.5 + 2
    anomal = RNG.normal(size=(20, 5)) * 2 + 5
    pdf = pd.DataFrame(np.vstack([normal, anomal]), columns=COLS)
    pdf.insert(0, "E", 1)
    pdf.insert(1, "i", np.arange(len(pdf)))
    pdf["truth"] = [0] * 100 + [1] * 20
    return spark.createDataFrame(pdf)


def test_statistical_detectors_floor(spark):
    df = data(spark)
    p = bl.fit_baseline(df, ["E"], ["i"], COLS, n=100)
    out = ano.detect(df, p, ["E"], COLS).toPandas()
    normal_ok = (out[out.truth == 0].ensemble_prediction == 1).mean()
    anomal_hit = (out[out.truth == 1].zscore_prediction == -1).mean()
    assert normal_ok > 0.8 and anomal_hit > 0.5
    # score: lower is worse
    assert out[out.truth == 1].zscore_score.mean() < out[out.truth == 0].zscore_score.mean()


def test_isolation_forest_floor(spark):
    df = data(spark)
    p = bl.fit_baseline(df, ["E"], ["i"], COLS, n=100)
    out = md.detect_isolation_forest(df, p, "E", ["i"], ["E", "i"], COLS, n=100,
                                     contamination=0.1, n_trees=50)
    pdf = out.join(df.select("i", "truth"), "i").toPandas()
    assert (pdf[pdf.truth == 0].isolation_forest_prediction == 1).mean() > 0.8
    assert (pdf[pdf.truth == 1].isolation_forest_prediction == -1).mean() > 0.5
    assert pdf.forest_score.between(-1, 0).all()


def test_kernel_and_reconstruction(spark):
    df = data(spark)
    p = bl.fit_baseline(df, ["E"], ["i"], COLS, n=100)
    k = md.kernel_scores(df, p, "E", ["i"], ["E", "i"], COLS, n=100).toPandas()
    assert (k[k.truth == 1].kernel_prediction == -1).mean() > 0.5
    r = ano.reconstruction_mean(df, p, ["E"], ["i"], COLS, n=100).toPandas()
    assert (r.reconstruction_error >= 0).all()
    assert r[r.truth == 1].reconstruction_score.mean() > r[r.truth == 0].reconstruction_score.mean()


def test_pca_matches_numpy(spark):
    X = RNG.normal(size=(100, 10)) * 0.5 + 2
    A = RNG.normal(size=(10, 10)) * 3 + 10
    rows = [(1, i, X[i].tolist()) for i in range(100)] + [(1, 100 + i, A[i].tolist())
                                                          for i in range(10)]
    df = spark.createDataFrame(rows, "E long, snapshot long, v array<double>")
    m = md.fit_pca(df, "E", ["snapshot"], "v", n=100, k=3)
    out = md.pca_scores(df, m, "E", "v").orderBy("snapshot").toPandas()
    mu = X.mean(axis=0)
    _, _, vt = np.linalg.svd(X - mu, full_matrices=False)
    V = vt[:3]
    allx = np.vstack([X, A]) - mu
    err = ((allx - allx @ V.T @ V) ** 2).mean(axis=1)
    assert np.allclose(out.reconstruction_error, err, atol=1e-9)
    assert (out.pca_prediction.iloc[100:] == -1).mean() > 0.5


def test_monitor_window_rate(spark):
    votes = [1, -1, -1, 1, -1, -1, -1, -1, -1, -1, 1, 1]
    pdf = pd.DataFrame({"E": 1, "i": range(len(votes)), "ensemble_prediction": votes})
    m = ano.monitor(spark.createDataFrame(pdf), ["E"], ["i"], window=4).orderBy("i").toPandas()
    ref = pd.Series([1.0 if v == -1 else 0.0 for v in votes]).rolling(4, min_periods=1).mean()
    assert np.allclose(m.window_anomaly_rate, ref)
    assert m.alert_level.iloc[9] == "critical"
