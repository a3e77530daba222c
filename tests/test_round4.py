"""Early warning of every row over arrays, scores in methods that the JVM compiles, cooldown over Arrow batches, models that meet rows without copies."""

import math
import re
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from rotorlens.operators import alerts as al
from rotorlens.operators import baseline as bl
from rotorlens.operators import models as md
from rotorlens.operators import warning as ew
from rotorlens.session import written

ROWS = 60


def odd_series(spark):
    """Three machines: readings with nulls and NaN, a flat one in tiny units, one without a baseline."""
    rows = []
    for e in (1, 2, None):
        for i in range(ROWS):
            a = None if i % 7 == 3 else float("nan") if i % 11 == 5 else 3.0 + 0.25 * i + (i * i % 5)
            rows.append((e, i, a if e != 2 else 1.7e-13, 1e15 - 3.0 * i if e == 1 else 0.5 * (i % 4)))
    return spark.createDataFrame(rows, "E long, i long, a double, b double")


def rates_by_hand(rows, history):
    out = []
    for i in range(len(rows)):
        rates = []
        for m in ("a", "b"):
            y = [Fraction(repr(r[m])) for r in rows[max(0, i - history + 1):i + 1] if r[m] is not None and not math.isnan(r[m])]
            n = len(y)
            if n >= 6:
                slope = sum((2 * x - (n - 1)) * v for x, v in enumerate(y)) * 6 / Fraction(n * (n * n - 1))
                mean = sum(y) / n
                rates.append(float(slope / abs(mean) * 100) if mean else float(slope))
        out.append(sum(rates) / len(rates) if rates else None)
    return out


@pytest.mark.parametrize("history,chunk", [(9, None), (9, 4), (9, 25), (70, 7)])
def test_rolling_warning_by_hand(spark, history, chunk, monkeypatch):
    monkeypatch.setattr(ew, "BLOCK_ROWS", 30)
    df = odd_series(spark)
    p = bl.fit_baseline(df.filter("E IS NOT NULL"), ["E"], ["i"], ["a", "b"], n=20)
    got = ew.warning_rolling(df, p, ["E"], ["i"], ["a", "b"], history=history, min_samples=6, chunk_rows=chunk).collect()
    assert len(got) == 3 * ROWS
    for e in (1, 2, None):
        own = sorted((r for r in got if r.E == e), key=lambda r: r.i)
        want = rates_by_hand(own, history)
        for r, w in zip(own, want):
            assert (r.degradation_rate is None) == (w is None)
            # ten decimals of the baseline's size; without a baseline of the reading itself
            assert w is None or abs(r.degradation_rate - w) <= 1e-7 * max(1.0, abs(w))
            assert r.has_warning == (len(r.predictions) > 0) and (e is not None or not r.has_warning)


def test_a_flat_series_has_no_slope_in_any_unit(spark):
    df = spark.createDataFrame([(1, i, 1.7e-13, 3.3e12) for i in range(40)], "E long, i long, a double, b double")
    p = bl.fit_baseline(df, ["E"], ["i"], ["a", "b"], n=20)
    for chunk in (None, 8):
        got = ew.warning_rolling(df, p, ["E"], ["i"], ["a", "b"], history=30, chunk_rows=chunk).collect()
        assert {r.degradation_rate for r in got if r.i >= 19} == {0.0}


def test_long_history_is_exact(spark):
    df = spark.createDataFrame([(1, i, 1e9 + (i % 2)) for i in range(50)], "E long, i long, a double")
    p = bl.fit_baseline(df, ["E"], ["i"], ["a"], n=20)
    short = ew.warning_rolling(df, p, ["E"], ["i"], ["a"], history=50).orderBy("i").collect()
    assert short == ew.warning_rolling(df, p, ["E"], ["i"], ["a"], history=50_000).orderBy("i").collect()


def test_cut_series_copy_rows_once_a_block(spark):
    """neighbouring chunks of 500 rows travel together, without what their machine was fitted."""
    df = spark.range(4000).selectExpr("1L AS E", "id AS i", "CAST(id % 7 AS DOUBLE) AS a")
    p = written(bl.fit_baseline(df, ["E"], ["i"], ["a"], n=20), "params")
    out = ew.warning_rolling(df, p, ["E"], ["i"], ["a"], history=500, chunk_rows=500)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan
    sides = [line for line in plan.split("\n") if "Generate explode(sequence(FLOOR" in line]
    assert len(sides) == 2 and all("/ 20000" in line for line in sides)
    assert out.count() == 4000


def test_scores_and_warnings_compile(spark):
    """no generated method of the per-sample flow is larger than what the JVM compiles (8000 bytes)."""
    from conftest import SF_SMALL
    from rotorlens.model import LINEITEM_METRICS, LINEITEM_ORDER, lineitem_features
    from rotorlens.plans import pipeline as pl
    f = lineitem_features(spark, SF_SMALL)
    p = written(pl.fit_all(f, ["E"], LINEITEM_ORDER, LINEITEM_METRICS), "params")
    for warning in (False, True):
        out = pl.process_samples(f, p, ["E"], LINEITEM_ORDER, LINEITEM_METRICS, with_warning=warning)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = out.select("*")._jdf.queryExecution().executedPlan()
            debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
            sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert sizes and max(sizes) < 8000, sizes


def test_cooldown_over_small_batches(spark):
    """alerts pass the cooldown as Arrow batches; a key goes on in the next batch."""
    t0 = datetime(2024, 1, 1)
    rows = [(e, t0 + timedelta(minutes=i), i, "anomaly", "warning") for e in (1, None, 2) for i in range(70)]
    df = spark.createDataFrame(rows, "E long, T timestamp, ord long, alert_type string, severity string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        kept = al.cooldown(df, 15)
        assert "MapInPandas" not in kept._jdf.queryExecution().toString()
        assert sorted((r.E or 0, r.ord) for r in kept.collect()) == [(e, i) for e in (0, 1, 2) for i in range(0, 70, 15)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_models_travel_packed_and_rows_unsalted(spark):
    """F1: a machine whose rows fit one chunk is met without salts, a tree travels as one compressed cell; the scores are the same."""
    g = np.random.default_rng(5)
    rows = [(e, i, *map(float, g.normal(size=2)), 1.5) for e, n in ((1, 50), (2, 9), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "E long, i long, a double, b double, c double")
    cols = ["a", "b", "c"]
    p = bl.fit_baseline(df, ["E"], ["i"], cols, n=20)
    model = written(md.fit_isolation_forest(df, p, "E", ["i"], cols, n=20, n_trees=7), "forest")
    for r in md._packed(model, "E").join(model, ["E", "tree"]).collect():
        tree = md._unpacked(bytes(r.tree_), r.nodes_)
        assert all(list(tree[c]) == list(getattr(r, c)) for c in (*md.PARTS, "threshold"))
    salted = md.score_isolation_forest(df, p, model, "E", ["E", "i"], cols, chunk_rows=8)
    plain = md.score_isolation_forest(df, p, model, "E", ["E", "i"], cols, counted=df)
    assert "_salt" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in md.score_isolation_forest(df, p, model, "E", ["E", "i"], cols, chunk_rows=8, counted=df)._jdf.queryExecution().optimizedPlan().toString()
    got = plain.orderBy("E", "i").collect()
    assert got == salted.orderBy("E", "i").collect() and len(got) == 59


def test_saved_models_brings_no_rows_together_again(spark):
    """F1: both scores of a row are compared where the second is computed, and the fits read the written first rows."""
    from conftest import SF_SMALL
    from rotorlens.plans.q_models import q_saved_models
    out = q_saved_models(spark, SF_SMALL)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 2 and plan.split("FlatMapCoGroupsInArrow")[0].count("Aggregate [E#") == 1
    assert all(r.n == r.n_same > 0 for r in out.collect())
