"""Paths for machines that hold too many rows for one task: the same values as brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotorlens.operators import alerts as al
from rotorlens.operators import baseline as bl
from rotorlens.operators import cleaning as cl
from rotorlens.operators import monitor as mo
from rotorlens.operators import positions, quantiles, rolling, series

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]


def groups():
    rng = np.random.default_rng(3)
    one = np.concatenate([rng.normal(size=900), np.full(1500, 7.25), [1e300, -1e300, 0.0, -0.0]])  # one value is most of it
    return {"hot": one, "wide": np.exp(rng.normal(size=1200) * 30), "few": rng.normal(size=30), "same": np.full(700, 2.5),
            "steps": rng.integers(0, 3, 800).astype(float), None: rng.normal(size=400)}


@pytest.mark.parametrize("limit", [50, 100_000])
def test_exact_quantiles(spark, limit):
    data = groups()
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "E string, v double").repartition(5)
    got = {r["E"]: r for r in quantiles.exact_quantiles(df, ["E"], "v", PROBS, limit=limit).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        assert got[k]["n"] == len(v) and np.allclose(got[k]["q"], np.quantile(v, PROBS), rtol=1e-12, atol=0), k
    every = quantiles.exact_quantiles(df, [], "v", [0.5], limit=limit).first()
    assert every["q"][0] == np.median(np.concatenate(list(data.values())))
    assert quantiles.exact_quantiles(df.limit(0), ["E"], "v", PROBS, limit=limit).count() == 0


def test_fits_of_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(e, i, float(a), float(b)) for e, n in ((1, 400), (2, 20)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows + [(1, 1000, None, 50.0)], "E long, i long, a double, b double")
    small = [cl.fit_scaler(df, ["E"], ["a", "b"]), bl.fit_baseline(df, ["E"], ["i"], ["a", "b"], n=None),
             cl.impute(df, ["E"], ["i"], ["a"], "median"), cl.remove_outliers(df, ["E"], ["b"], "iqr", 1.5)]
    want = [d.orderBy(*d.columns[:2]).toPandas() for d in small]
    monkeypatch.setattr(quantiles, "LIMIT", 30)
    large = [cl.fit_scaler(df, ["E"], ["a", "b"]), bl.fit_baseline(df, ["E"], ["i"], ["a", "b"], n=None),
             cl.impute(df, ["E"], ["i"], ["a"], "median"), cl.remove_outliers(df, ["E"], ["b"], "iqr", 1.5)]
    for w, d in zip(want, large):
        pd.testing.assert_frame_equal(d.select(*w.columns).orderBy(*w.columns[:2]).toPandas(), w, rtol=1e-12)


def test_ema_over_long_gaps(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e, n in ((1, 2300), (2, 430), (None, 40)):
        v = rng.normal(size=n) + 5
        v[20:min(n, 420)] = np.nan
        if n > 2000:
            v[900:1900] = np.nan  # longer than two blocks, and over several chunks
        rows += [(e, i, None if np.isnan(x) else float(x)) for i, x in enumerate(v)]
    rows = [(e, i, float("nan") if i == 600 else x) for e, i, x in rows]
    df = spark.createDataFrame(rows, "E long, i long, v double")
    for span, chunks in ((1, [700]), (10, [None, 50]), (40, [700])):
        want = {}
        for e, g in pd.DataFrame(rows, columns=["E", "i", "v"]).groupby("E", dropna=False):
            want[None if pd.isna(e) else int(e)] = g["v"].astype(float).ewm(span=span).mean().to_numpy()
        for chunk in chunks:
            out = rolling.rolling_features(df, ["E"], ["i"], ["v"], span, chunk_rows=chunk).orderBy("E", "i").select("E", "v_ema").collect()
            for e, w in want.items():
                got = np.array([np.nan if r["v_ema"] is None else r["v_ema"] for r in out if r["E"] == e])
                assert np.allclose(got, w, rtol=1e-10, equal_nan=True), (span, chunk, e)


def fill(v, method, gap):
    s = pd.Series(v)
    if method == "interpolate":
        s = s.interpolate(limit=gap)
        return s.bfill(limit=gap).ffill(limit=gap)
    return s.ffill(limit=gap).bfill(limit=gap) if method == "forward_fill" else s.bfill(limit=gap).ffill(limit=gap)


def test_fills_match_pandas(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 120))
    for v in (a, b):
        v[rng.random(120) < 0.7] = np.nan
    a[:9], a[-11:], b[40:80] = np.nan, np.nan, np.nan
    none = lambda x: None if np.isnan(x) else float(x)
    df = spark.createDataFrame([(1, i, none(x), none(y)) for i, (x, y) in enumerate(zip(a, b))] + [(2, 0, None, 1.0)],
                               "E long, i long, a double, b double")
    for method in ("forward_fill", "backward_fill", "interpolate"):
        for gap in (None, 3):
            for chunk in ("auto", 7):
                out = cl.impute(df, ["E"], ["i"], ["a", "b"], method, gap, chunk_rows=chunk).filter("E = 1").orderBy("i").toPandas()
                for m, v in (("a", a), ("b", b)):
                    assert np.allclose(out[m].astype(float), fill(v, method, gap), equal_nan=True), (method, gap, chunk)


def kept(ps, gap):
    out, ready = [], -np.inf
    for p in ps:
        if p >= ready:
            out.append(p)
            ready = p + gap
    return out


@pytest.mark.parametrize("gap,step", [(25, 1), (900, 1), (0, 1)])
def test_cooldown_of_a_machine_that_never_rests(spark, gap, step):
    rng = np.random.default_rng(gap + step)
    # every row alarms; times tie; quiet stretches lie between
    hot = np.sort(rng.integers(0, 700 * step, 2000) + np.where(rng.random(2000) < 0.3, 5000, 0))
    rows = [(1, int(p), i) for i, p in enumerate(hot)] + [(2, int(p), i) for i, p in enumerate(hot[:30])] + [(None, 5, 0), (3, None, 0)]
    df = spark.createDataFrame(rows, "E long, p long, i long").repartition(3)
    want = {1: kept(hot, gap), 2: kept(hot[:30], gap), None: [5]}
    for chunk in ("auto", 200):
        got = al.greedy_keep(df, ["E"], ["p", "i"], F.col("p"), gap, chunk_rows=chunk).collect()
        for e, w in want.items():
            assert sorted(r["p"] for r in got if r["E"] == e) == w, (chunk, e)
        assert len(got) == sum(map(len, want.values()))
    late = al.greedy_keep(df, ["E"], ["p", "i"], F.col("p"), gap, start=int(hot[5]), chunk_rows=500).filter("E = 1").collect()
    assert sorted(r["p"] for r in late) == kept([p for p in hot if p >= hot[5] + gap], gap)


def test_positions(spark):
    rows = [(e, i % 50, i) for e, n in (("a", 500), ("b", 3), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(7)
    t = positions.sorted_table(df, ["k", "o", "i"], "test", rows=543, range_rows=40)
    assert t.select("_part").distinct().count() > 8  # the hot key lies in many files
    got = positions.with_position(t, "p", ["k"]).collect()
    for k in ("a", "b", None):
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: (r["o"], r["i"]))
        assert [r["p"] for r in mine] == list(range(len(mine)))
    assert sorted(r["g"] for r in positions.with_global_position(t, "g").collect()) == list(range(543))


def test_a_hot_machine_is_cut_unasked(spark, monkeypatch):
    monkeypatch.setattr(series, "CHUNK_ROWS", 100)
    df = spark.range(450).select(F.when(F.col("id") < 400, 1).otherwise(2).alias("E"), F.col("id").alias("i"),
                                 (F.col("id") % 7).cast("double").alias("v"))
    assert series.resolve_chunk_rows(df, ["E"], "auto") == 100 and series.resolve_chunk_rows(df.filter("E = 2"), ["E"], "auto") is None
    out = rolling.rolling_features(df, ["E"], ["i"], ["v"], 10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan
    assert out.count() == 450


def test_short_series_are_smoothed(spark):
    rng = np.random.default_rng(8)
    data = {n: rng.normal(size=n) for n in (1, 2, 4, 5, 10, 11, 30)}
    df = spark.createDataFrame([(n, i, float(x)) for n, v in data.items() for i, x in enumerate(v)], "E long, i long, v double")
    for chunk in ("auto", 8):
        out = cl.filter_savgol(df, ["E"], ["i"], ["v"], 11, 3, chunk_rows=chunk).orderBy("E", "i").collect()
        for n, v in data.items():
            got = [r["v"] for r in out if r["E"] == n]
            if n < 11:
                want = np.polyval(np.polyfit(np.arange(n), v, min(3, n - 1)), np.arange(n))
                assert np.allclose(got, want, atol=1e-9), n
            assert all(x is not None for x in got)


def test_running_median_and_page_history(spark):
    rng = np.random.default_rng(9)
    data = {n: rng.normal(size=n) for n in (1, 2, 3, 4, 40)}
    rows = [(n, i, None if (n, i) == (40, 17) else float(x)) for n, v in data.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "E long, i long, v double")
    for chunk in ("auto", 6):
        out = cl.filter_median(df, ["E"], ["i"], ["v"], 5, chunk_rows=chunk).orderBy("E", "i").collect()
        for n in data:
            v = [x for e, _, x in rows if e == n]
            pad = v[:2][::-1] + v + v[-2:][::-1] if n > 1 else v + v + v
            at = min(2, n)
            for i, r in enumerate([r["v"] for r in out if r["E"] == n]):
                near = [x for x in pad[max(0, i + at - 2):i + at + 3] if x is not None]
                assert abs(r - np.median(near)) < 1e-12, (chunk, n, i)
    z = rng.random(95) * 6
    scores = spark.createDataFrame([(1, i, float(x), bool(x > 3), float(100 - 12 * x)) for i, x in enumerate(z)],
                                   "E long, idx long, z_score double, is_anomaly boolean, health double")
    for chunk in ("auto", 13):
        for r in mo.monitor_history(scores, ["E"], rows=10, chunk_rows=chunk).collect():
            part = z[max(0, r["idx"] - 9):r["idx"] + 1]
            assert r["window_max_z"] == part.max() and r["window_anomalies"] == (part > 3).sum()
            assert abs(r["window_avg_health"] - (100 - 12 * part).mean()) < 1e-9


@pytest.mark.parametrize("window, chunk_rows", [(10, 25), (4, 300)])
def test_cut_series_copy_rows_for_the_rolling_frame_only(spark, monkeypatch, window, chunk_rows):
    seen = []

    def spy(*args, **kw):
        seen.append(series.chunked(*args, **kw))
        return seen[-1]

    monkeypatch.setattr(rolling, "chunked", spy)
    n = 2000
    rng = np.random.default_rng(2)
    rows = [(None if i % 3 == 0 else i % 3, i, None if i % 1300 > 300 or i % 7 == 0 else float("nan") if i % 11 == 0 else float(rng.normal(5)),
             float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "E long, T long, a double, b double")
    got = rolling.rolling_features(df, ["E"], ["T"], ["a", "b"], window, chunk_rows=chunk_rows).orderBy("T").toPandas()
    want = rolling.rolling_features(df, ["E"], ["T"], ["a", "b"], window, chunk_rows=None).orderBy("T").toPandas()
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9)
    assert n <= seen[0].count() <= n * (1 + (window + 1) / chunk_rows) + 1


def test_cut_series_are_dealt_to_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(series, "RANGE_ROWS", 800)
    df = spark.createDataFrame([(i % 2, i, 1.0 * i if i % 90 < 6 else None) for i in range(3000)], "E long, T long, v double")
    out = rolling.rolling_features(df, ["E"], ["T"], ["v"], 10, chunk_rows=50)
    per = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]  # long null runs: few bytes, but not few partitions
    assert per.sum() == 3000 and len(per) >= 8 and per.max() <= 800


def test_gaps_are_numbered_without_a_window_over_a_long_series(spark, monkeypatch):
    from rotorlens.plans import q_cleaning
    n = 4000
    ev = spark.createDataFrame([(i, i % 20 * 10, 1.0 * i) for i in range(n)], "event_id long, E long, V double") \
        .withColumn("T", F.timestamp_seconds(F.col("event_id") % 7))
    monkeypatch.setattr(q_cleaning, "events_readings", lambda spark, sf: ev)
    want = {r["event_id"]: r["V"] for r in q_cleaning._gappy(spark, None).collect()}
    monkeypatch.setattr(series, "CHUNK_ROWS", 500)
    cut = q_cleaning._gappy(spark, None)
    assert "row_number" not in cut._jdf.queryExecution().toString()
    assert {r["event_id"]: r["V"] for r in cut.collect()} == want and len(want) == n
    at = sorted(range(n), key=lambda i: (i % 7, i))
    assert want == {i: 1.0 * i if (k + 1) % 900 < 60 else None for k, i in enumerate(at)}
