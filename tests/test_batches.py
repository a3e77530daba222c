"""Stateful micro-batches against their batch twins: resets, late rows, replays, cut series, idle machines, empty batches."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotorlens.model import LINEITEM_METRICS as LM
from rotorlens.operators import alerts as al
from rotorlens.operators import baseline as bl
from rotorlens.plans import pipeline as pl
from rotorlens.streaming import batches as sb

ORDER = ["T", "seq"]
SCHEMA = "E long, T timestamp_ntz, seq long, ensemble_prediction int, op string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def votes(n, machines=2, seed=1, reset_every=None):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        op = "reset" if reset_every and i % reset_every == reset_every - 1 else None
        rows.append((int(i % machines), pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(minutes=i // 3).to_pytimedelta(), i,
                     int(r.choice([-1, 1])), op))
    return rows


def play(spark, out, step, parts, **kw):
    write = sb.stateful_writer(spark, out, step, **kw)
    for i, p in enumerate(parts):
        write(p, i)


def monitor_by_hand(rows, window=10):
    last, got = {}, {}
    for e, t, seq, vote, op in sorted(rows, key=lambda r: (r[1], r[2])):
        if op == "reset":
            last[e] = []
            continue
        last[e] = (last.get(e, []) + [vote])[-window:]
        got[(e, seq)] = round(sum(v == -1 for v in last[e]) / len(last[e]), 9)
    return got


def rates(df):
    return {(r["E"], r["seq"]): round(r["window_anomaly_rate"], 9) for r in df.collect()}


@pytest.mark.parametrize("chunk_rows", [None, 16])
def test_monitor_over_batches_with_resets_and_replay(spark, scratch, chunk_rows):
    rows = votes(180, reset_every=37)
    out = os.path.join(scratch, "out")
    step = sb.monitor_step(order=ORDER, chunk_rows=chunk_rows)
    parts = [frame(spark, rows[:70]), frame(spark, []), frame(spark, rows[70:75]), frame(spark, rows[75:])]
    write = sb.stateful_writer(spark, out, step)
    for i, p in enumerate(parts):
        write(p, i)
        if i in (0, 2):
            write(p, i)  # a replay writes the same again
    assert rates(sb.read_results(spark, out, "monitor")) == monitor_by_hand(rows)
    left = sorted(os.listdir(os.path.join(out, "state", "readings")))
    assert left == ["epoch=2", "epoch=3"]


def test_late_rows_are_put_aside_whole(spark, scratch):
    rows = votes(90)
    late = [(0, pd.Timestamp("2024-01-01 00:01").to_pydatetime(), 1000, -1, None), (1, None, 1001, -1, None)]
    out = os.path.join(scratch, "out")
    play(spark, out, sb.monitor_step(order=ORDER), [frame(spark, rows[:60]), frame(spark, rows[60:] + late)], delay="5 minutes")
    assert [r["seq"] for r in sb.read_results(spark, out, "late").collect()] == [1000]
    got = rates(sb.read_results(spark, out, "monitor"))
    assert got.pop((1, 1001)) >= 0  # no time: never late
    assert set(got) == {(r[0], r[2]) for r in rows}


def test_idle_machines_leave_the_state(spark, scratch):
    t = pd.Timestamp("2024-01-01")
    row = lambda e, hours, seq: (e, (t + pd.Timedelta(hours=hours)).to_pydatetime(), seq, -1, None)
    out = os.path.join(scratch, "out")
    play(spark, out, sb.monitor_step(order=ORDER, idle="12 hours"),
         [frame(spark, [row(1, 0, 0), row(2, 0, 1)]), frame(spark, [row(2, 20, 2)]), frame(spark, [row(1, 21, 3)])])
    state = spark.read.parquet(os.path.join(out, "state", "readings", "epoch=1"))
    assert [r["E"] for r in state.select("E").distinct().collect()] == [2]
    assert len(sb.read_results(spark, out, "monitor").collect()) == 4


def readings(spark, n=400):
    r = np.random.default_rng(5)
    rows = []
    for i in range(n):
        # one machine has three quarters of the rows, and wears
        e = 1 if i % 4 else 2
        t = pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=5 * i)
        v = [float(x) for x in np.round(10 + r.normal(0, 0.02, 4) + (0.05 * max(0, i - 100) if e == 1 else 0), 4)]
        rows.append((e, t.to_pydatetime(), i, *v))
    return spark.createDataFrame(rows, "E long, T timestamp_ntz, seq long, " + ", ".join(f"{m} double" for m in LM))


@pytest.mark.parametrize("chunk_rows", ["auto", 40])
def test_live_flow_equals_batch_flow(spark, scratch, chunk_rows):
    f = readings(spark)
    p = bl.fit_baseline(f, ["E"], ORDER, LM, n=50)
    th = al.thresholds_table(spark, [(LM[0], 12.0, 14.0, False)])
    scored = pl.process_samples(f, p, ["E"], ORDER, LM, history=60)
    want = pl.pipeline_alerts(scored, ["E"], ORDER, LM, th, cooldown_minutes=45)
    seen = []
    step = sb.live_step(p, LM, th, history=60, minutes=45, order=ORDER, op_col=None, chunk_rows=chunk_rows,
                        callbacks=[lambda batch, epoch: 1 / 0, lambda batch, epoch: seen.append((epoch, batch.count()))])
    out = os.path.join(scratch, "out")
    play(spark, out, step, [f.filter(F.col("seq").between(a, b)) for a, b in ((0, 149), (150, 155), (156, 999))])
    cols = ["alert_id", "E", "T", "seq", "ord", "alert_type", "severity", "message"]
    got = sorted(map(tuple, sb.read_results(spark, out, "alerts").select(*cols).collect()))
    expected = sorted(map(tuple, want.select(*cols).collect()))
    assert got == expected
    assert any(r[5] == "early_warning" for r in got)
    assert [e for e, _ in seen] == [0, 1, 2] and sum(n for _, n in seen) == len(got)
    cols = ["E", "seq", "health_score", "has_warning", "overall_risk_score"]
    rounded = lambda df: sorted((r[0], r[1], round(r[2], 6), r[3], round(r[4], 6)) for r in df.select(*cols).collect())
    assert rounded(sb.read_results(spark, out, "samples")) == rounded(scored)


def test_cooldown_over_batches(spark, scratch):
    r = np.random.default_rng(9)
    t0, gap = pd.Timestamp("2024-01-01"), pd.Timedelta(minutes=10)
    minutes = np.sort(r.integers(0, 400, 150))
    rows = [(int(r.integers(0, 2)), (t0 + pd.Timedelta(minutes=int(m))).to_pydatetime(), i, 0, "anomaly", "warning", "x") for i, m in enumerate(minutes)]
    last, count, want = {}, {}, []
    for e, t, seq, *_ in rows:
        if e not in last or t >= last[e] + gap:
            last[e], count[e] = t, count.get(e, 0) + 1
            want.append((f"alert_{e}_{count[e]:06d}", seq))
    schema = "E long, T timestamp_ntz, seq long, ord int, alert_type string, severity string, message string"
    out = os.path.join(scratch, "out")
    play(spark, out, sb.cooldown_step(10, ORDER), [frame(spark, rows[a:b], schema) for a, b in ((0, 40), (40, 41), (41, 41), (41, 150))])
    assert sorted(map(tuple, sb.read_results(spark, out, "alerts").select("alert_id", "seq").collect())) == sorted(want)
