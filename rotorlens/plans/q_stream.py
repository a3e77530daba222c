"""Streaming queries (STR2-STR8, SNK6, PIP6): each runs a Structured Streaming job over
the events table (file source, trigger availableNow) into a Parquet table in
the shared scratch folder, and returns that table. Oracles are the batch
twins in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..model import E, EVENTS_ORDER as EO, LINEITEM_METRICS as LM, LINEITEM_ORDER as LO, events_readings, lineitem_features, rnd
from ..operators import alerts as al
from ..operators import baseline as bl
from ..session import scratch_path, written
from ..sinks.messages import to_alert_messages
from ..streaming import batches as sb
from ..streaming import streams as st
from . import pipeline as pl, q_io  # noqa: F401 (registers alert_messages)
from .q_alerts import CANDS_SQL, EV_THRESHOLDS, KEPT_SQL, SCORED_SQL, WEAR_SQL, wear_events
from .q_monitor import PIPE_THRESHOLDS
from .registry import ORACLES, register
from .sql import EV_ORDER, ev_src, fit_cte, iqr_out, max_abs_z, wide_cte

K = [E]


def events_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = st.stream_table(spark, sf, schema, glob="events.parquet")
    return s.select(F.col("user_id").alias("E"), F.col("ts").cast("timestamp").alias("T"),
                    F.col("event_id").alias("seq"), F.col("event_type").alias("channel"),
                    F.col("value").alias("V"))


def run(spark, stream, name):
    out = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    st.run_to_table(stream, out + "/data", out + "/_checkpoint")
    return spark.read.parquet(out + "/data")


def _ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def q_stream_resample(spark, sf):
    """STR2: hourly mean value per event type, watermark 1 hour, the windows that are still open at the end included."""
    s = events_stream(spark, sf).withWatermark("T", "1 hour")
    agg = st.stream_resample(s, ["channel"], ["V"], "1 hour")
    at = scratch_path(spark, f"resample-{uuid.uuid4().hex}")
    out = st.run_updates(agg, ["channel", "window_start", "window_end"], at + "/data", at + "/_checkpoint")
    return _ntz(out, "window_start", "window_end").select(
        "channel", "window_start", "window_end", rnd("V").alias("V"))


register("stream_resample",
         "WITH g AS (SELECT event_type AS channel, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, avg(value) AS V FROM events "
         "GROUP BY 1, 2) SELECT channel, window_start, window_start + INTERVAL 1 HOUR AS window_end, round(V, 6) AS "
         "V FROM g")(q_stream_resample)


def q_stream_resample_sliding(spark, sf):
    """STR2: sums over two hours, every half hour."""
    s = events_stream(spark, sf).withWatermark("T", "1 hour")
    agg = st.stream_resample(s, ["channel"], ["V"], "2 hours", "30 minutes", "sum")
    at = scratch_path(spark, f"sliding-{uuid.uuid4().hex}")
    out = st.run_updates(agg, ["channel", "window_start", "window_end"], at + "/data", at + "/_checkpoint")
    return _ntz(out, "window_start", "window_end").select("channel", "window_start", "window_end", rnd("V").alias("V"))


register("stream_resample_sliding",
         "WITH g AS (SELECT event_type AS channel, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS window_start, "
         "sum(value) AS V FROM events, range(4) r(k) GROUP BY 1, 2) SELECT channel, window_start, window_start + INTERVAL 2 HOUR "
         "AS window_end, round(V, 6) AS V FROM g")(q_stream_resample_sliding)

# The part of the month in which an event arrives: every third one is a part late.
ARRIVAL = "CAST(floor((dayofmonth(ts) - 1) * 4 / 31) AS INT) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END"


def q_late_rows(spark, sf):
    """STR7: events that arrive in five files, some of them late; the query is stopped after two files and restarted."""
    ev = events_readings(spark, sf).selectExpr("E", "T", "event_id", "V", ARRIVAL.replace("ts", "T") + " AS part")
    at = scratch_path(spark, f"late-{uuid.uuid4().hex}")
    schema = ev.schema
    write = st.late_data_writer(at + "/out", "6 hours")
    for parts in ((0, 1), (2, 3, 4)):
        for p in parts:
            ev.filter(F.col("part") == p).coalesce(1).write.mode("append").parquet(at + "/in")
        st.run_batches(st.stream_table(spark, at + "/in", schema, files_per_trigger=1), write, at + "/_checkpoint")
    sides = [(st.read_on_time, False), (st.read_late, True)]
    out = [f(spark, at + "/out").select("E", "T", "event_id", F.lit(late).alias("late")) for f, late in sides]
    return out[0].unionByName(out[1])


register("late_rows",
         f"WITH a AS (SELECT user_id AS E, ts AS T, event_id, {ARRIVAL} AS part FROM events), n AS (SELECT part, max(T) AS newest "
         "FROM a GROUP BY part), s AS (SELECT part, max(newest) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
         "PRECEDING) AS seen FROM n) SELECT E, T, event_id, coalesce(T < seen - INTERVAL 6 HOUR, false) AS late FROM a JOIN s "
         "USING (part)")(q_late_rows)


def flags(spark, sf):
    ev = events_readings(spark, sf)
    p = bl.fit_baseline(ev, K, EO, ["V"], n=30)
    return st.stream_anomaly_flags(events_stream(spark, sf), p, K, ["V"])


def q_stream_anomaly_flags(spark, sf):
    """STR3: stateless z-score / IQR / ensemble votes on the stream."""
    out = run(spark, flags(spark, sf), "flags")
    return _ntz(out, "T").select("E", "T", F.col("seq").alias("event_id"),
                                 F.col("zscore_prediction").cast("int"),
                                 F.col("iqr_prediction").cast("int"),
                                 F.col("ensemble_prediction").cast("int"))


FLAGS_SQL = (f"{ev_src()}, {fit_cte('src', 'E', EV_ORDER, ['V'], 30)}, {wide_cte('pw', 'E', ['V'])}, "
             "j AS (SELECT s.*, pw.* EXCLUDE (E) FROM src s LEFT JOIN pw USING (E)), "
             f"fl AS (SELECT E, T, event_id, CASE WHEN {max_abs_z(['V'])} > 3.0 THEN -1 ELSE 1 END AS zv, "
             f"CASE WHEN {iqr_out(['V'])} THEN -1 ELSE 1 END AS iv FROM j)")

register("stream_anomaly_flags",
         f"WITH {FLAGS_SQL} SELECT E, T, event_id, CAST(zv AS INTEGER) AS zscore_prediction, CAST(iv AS "
         "INTEGER) AS iqr_prediction, CAST(CASE WHEN zv + iv < 0 THEN -1 ELSE 1 END AS INTEGER) AS "
         "ensemble_prediction FROM fl")(q_stream_anomaly_flags)


def q_stream_monitor(spark, sf):
    """STR4: rolling anomaly rate of the last 10 votes held in keyed state."""
    m = st.stream_monitor(flags(spark, sf), window=10, op_col=None)
    out = run(spark, m, "monitor")
    return _ntz(out, "T").select("E", "T", F.col("seq").alias("event_id"), F.col("vote").cast("int"),
                                 rnd("window_anomaly_rate").alias("window_anomaly_rate"),
                                 "alert", "alert_level")


register("stream_monitor",
         f"WITH {FLAGS_SQL}, v AS (SELECT *, CASE WHEN zv + iv < 0 THEN -1 ELSE 1 END AS vote FROM fl), "
         f"w AS (SELECT *, avg(CASE WHEN vote = -1 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY E ORDER BY T, "
         "event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rate FROM v) SELECT E, T, event_id, "
         "CAST(vote AS INTEGER) AS vote, round(rate, 6) AS window_anomaly_rate, rate >= 0.5 AS alert, "
         "CASE WHEN rate >= 0.8 THEN 'critical' WHEN rate >= 0.5 THEN 'warning' WHEN rate >= 0.2 THEN "
         "'info' ELSE 'normal' END AS alert_level FROM w")(q_stream_monitor)


def q_stream_cooldown(spark, sf):
    """STR5: candidate alerts of the stream, 15-minute cooldown in keyed
    state with an event-time timeout."""
    from ..operators import anomaly as ano
    from ..operators import health as hl
    ev = events_readings(spark, sf)
    p = bl.fit_baseline(ev, K, EO, ["V"], n=30)
    s = events_stream(spark, sf).withWatermark("T", "1 hour")
    j = ano.attach_params(s, p, K, ["V"])
    d = ano.detect(j, None, K, ["V"], attached=True).withColumn("anomaly_score", F.col("zscore_score"))
    h = hl.health_score(d, None, K, ["V"], attached=True, keep_components=False)
    th = al.thresholds_table(spark, EV_THRESHOLDS)
    keys, order = ["E"], ["T", "seq"]
    cands = al.candidate_alerts([al.check_health(h, keys, order, ord_=0),
                                 al.check_anomaly(h, keys, order, ord_=1),
                                 al.check_thresholds(h, keys, order, ["V"], th, ord_base=2)])
    kept = st.stream_cooldown(cands, 15)
    out = run(spark, kept, "cooldown")
    return _ntz(out, "T").select("E", "T", F.col("seq").alias("event_id"), F.col("ord").cast("int"),
                                 "alert_type", "severity", "message")


register("stream_cooldown",
         f"WITH RECURSIVE {SCORED_SQL}, {CANDS_SQL}, {KEPT_SQL} SELECT E, T, event_id, CAST(ord AS INTEGER) "
         "AS ord, alert_type, severity, message FROM kept")(q_stream_cooldown)


def q_stream_early_warning(spark, sf):
    """STR6: early warning as of every reading of the degrading series, the
    last 500 values per machine in keyed state."""
    ev = wear_events(spark, sf)
    p = bl.fit_baseline(ev, K, EO, ["V"], n=30)
    s = events_stream(spark, sf)
    # the wear term needs each reading's position in its series: taken from
    # the static table by a stream-static join on (machine, event id)
    pos = ev.select("E", F.col("event_id").alias("seq"), F.col("V").alias("_w"))
    s = s.join(pos, on=["E", "seq"]).withColumn("V", F.col("_w")).drop("_w")
    w = st.stream_early_warning(s, p, ["V"], op_col=None)
    out = run(spark, w, "early_warning")
    return _ntz(out, "T").select(
        "E", "T", F.col("seq").alias("event_id"), "n_samples", "has_warning",
        rnd("earliest_anomaly_hours").alias("earliest_anomaly_hours"),
        rnd("overall_risk_score").alias("overall_risk_score"), "prediction_metrics")


def _stream_ew_sql():
    w = f"PARTITION BY E ORDER BY {EV_ORDER} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW"
    return (
        f"WITH {WEAR_SQL}, {fit_cte('src', 'E', EV_ORDER, ['V'], 30)}, "
        f"x AS (SELECT *, row_number() OVER (PARTITION BY E ORDER BY {EV_ORDER}) - 1 AS g FROM src), "
        f"f AS (SELECT x.*, count(V) OVER ({w}) AS n, regr_slope(V, g) OVER ({w}) AS b, "
        f"regr_intercept(V, g) OVER ({w}) AS a0, avg(V) OVER ({w}) AS mh FROM x), "
        "j AS (SELECT f.E, f.T, f.event_id, f.V AS cur, f.n, f.b, f.a0 + f.b * (f.g - f.n + 1) AS a, f.mh, "
        "fit.mean AS bm, fit.std AS bs, fit.warn AS wt, fit.crit AS c FROM f LEFT JOIN fit USING (E)), "
        "hz AS (SELECT j.*, hh.h, a + b * (n + CAST(trunc(hh.h * greatest(1.0, n / 24.0)) AS BIGINT)) "
        "AS pred FROM j, (VALUES (2), (6), (12), (24), (48)) hh(h)), "
        "hc AS (SELECT *, least(1.0, abs(b) / (bs + 0.001) * 0.5 + (1.0 / (abs(cur - wt) / (abs(pred - "
        "cur) + 0.001) + 1.0)) * 0.5) AS conf, cur > bm AS higher FROM hz), "
        "hit AS (SELECT E, event_id, min(h) AS hh FROM hc WHERE n >= 20 AND ((higher AND b > 0) OR (NOT "
        "higher AND b <= 0)) AND (CASE WHEN higher THEN pred > wt ELSE pred < -wt END) AND conf >= 0.7 "
        "GROUP BY E, event_id), "
        "p AS (SELECT hc.E, hc.event_id, hc.h, CASE WHEN hc.h <= 6 THEN 40.0 WHEN hc.h <= 24 THEN 25.0 "
        "ELSE 10.0 END * hc.conf AS s FROM hc JOIN hit ON hc.E = hit.E AND hc.event_id = hit.event_id AND "
        "hc.h = hit.hh), "
        "q AS (SELECT j.*, CASE WHEN n >= 20 THEN (CASE WHEN mh <> 0 THEN b / abs(mh) * 100.0 ELSE b END) "
        "END AS deg, CASE WHEN n < 20 OR c IS NULL THEN NULL WHEN cur >= c THEN 0.0 WHEN b <= 0 THEN NULL "
        "WHEN (c - a) / b - (n - 1) <= 0 THEN 0.0 ELSE greatest(0.0, ((c - a) / b - (n - 1)) / greatest("
        "1.0, n / 24.0)) END AS rul FROM j) "
        "SELECT q.E, q.T, q.event_id, CAST(q.n AS BIGINT) AS n_samples, p.h IS NOT NULL AS has_warning, "
        "round(CAST(p.h AS DOUBLE), 6) AS earliest_anomaly_hours, round(CASE WHEN n < 20 THEN 0.0 WHEN "
        "p.h IS NULL AND coalesce(deg, 0) = 0 THEN 0.0 ELSE least(100.0, coalesce(p.s, 0.0) + CASE WHEN "
        "deg > 0 THEN least(20.0, deg * 10.0) ELSE 0.0 END + CASE WHEN rul < 6 THEN 30.0 WHEN rul < 24 "
        "THEN 15.0 WHEN rul < 48 THEN 5.0 ELSE 0.0 END) END, 6) AS overall_risk_score, CASE WHEN p.h IS "
        "NULL THEN '' ELSE 'V' END AS prediction_metrics FROM q LEFT JOIN p ON q.E = p.E AND q.event_id = "
        "p.event_id")


register("stream_early_warning", _stream_ew_sql())(q_stream_early_warning)


# ------------------------------------------- stateful micro-batches (batches.py) --

def in_parts(spark, rows, part, parts, step, name, **kw):
    """Rows that arrive part after part (`part` says when); after each part the query is stopped, and restarted for the
    next. Returns the folder of the results."""
    at = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    write = sb.stateful_writer(spark, at + "/out", step, **kw)
    for p in range(parts):
        rows.filter(part == p).write.mode("append").parquet(at + "/in")
        st.run_batches(st.stream_table(spark, at + "/in", rows.schema), write, at + "/_checkpoint")
    return at + "/out"


QUARTER = "CAST(floor((dayofmonth(T) - 1) * 4 / 31) AS INT)"  # the part of the month


def q_live_monitor(spark, sf):
    """STR4, STR8: the rolling anomaly rate over four micro-batches with a restart before each; every 50th event is a reset
    row instead of a reading."""
    ev = events_readings(spark, sf)
    p = bl.fit_baseline(ev, K, EO, ["V"], n=30)
    voted = st.stream_anomaly_flags(ev, p, K, ["V"]).select("E", "T", "event_id", "ensemble_prediction").withColumn(
        "op", F.expr("CASE WHEN event_id % 50 = 7 THEN 'reset' END"))
    out = in_parts(spark, voted, F.expr(QUARTER), 4, sb.monitor_step(order=EO), "live-monitor")
    return sb.read_results(spark, out, "monitor").select(
        "E", "T", "event_id", rnd("window_anomaly_rate").alias("window_anomaly_rate"), "alert", "alert_level")


register("live_monitor",
         f"WITH {FLAGS_SQL}, s AS (SELECT *, sum(CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY E ORDER BY T, "
         "event_id ROWS UNBOUNDED PRECEDING) AS seg FROM fl), w AS (SELECT *, avg(CASE WHEN zv + iv < 0 THEN 1.0 ELSE 0.0 END) "
         "OVER (PARTITION BY E, seg ORDER BY T, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rate FROM s WHERE "
         "event_id % 50 <> 7) SELECT E, T, event_id, round(rate, 6) AS window_anomaly_rate, rate >= 0.5 AS alert, CASE WHEN "
         "rate >= 0.8 THEN 'critical' WHEN rate >= 0.5 THEN 'warning' WHEN rate >= 0.2 THEN 'info' ELSE 'normal' END AS "
         "alert_level FROM w")(q_live_monitor)


def q_live_early_warning(spark, sf):
    """STR6: early warning as of every reading of the degrading series over four micro-batches with a restart before each."""
    ev = wear_events(spark, sf).select("E", "T", "event_id", "V")
    p = written(bl.fit_baseline(ev, K, EO, ["V"], n=30), "params")
    out = in_parts(spark, written(ev, "wear"), F.expr(QUARTER), 4, sb.early_warning_step(p, ["V"], order=EO), "live-warning")
    return sb.read_results(spark, out, "warnings").select(
        "E", "T", "event_id", "has_warning", rnd("earliest_anomaly_hours").alias("earliest_anomaly_hours"),
        rnd("overall_risk_score").alias("overall_risk_score"))


register("live_early_warning",
         f"SELECT E, T, event_id, has_warning, earliest_anomaly_hours, overall_risk_score FROM ({_stream_ew_sql()})")(
    q_live_early_warning)

YEAR_PART = "greatest(0, least(2, CAST(floor((year(T) - 1992) / 3) AS INT)))"


def live_alerts_folder(spark, sf, callbacks=()):
    f = lineitem_features(spark, sf)
    p = written(bl.fit_baseline(f, K, LO, LM, n=100), "params")
    th = al.thresholds_table(spark, [(m, w, c, False) for m, w, c in PIPE_THRESHOLDS])
    step = sb.live_step(p, LM, th, minutes=2 * 24 * 60, order=LO, callbacks=callbacks)
    return in_parts(spark, f, F.expr(YEAR_PART), 3, step, "live-alerts")


def q_live_alerts(spark, sf):
    """PIP6 with STR5 and STR6: the whole live flow over three micro-batches with a restart before each, early warnings
    included; gives what `pipeline_alerts` gives."""
    return sb.read_results(spark, live_alerts_folder(spark, sf), "alerts").select(
        "alert_id", "E", "T", "alert_type", "severity", "message")


register("live_alerts", ORACLES["pipeline_alerts"])(q_live_alerts)


def q_notified_alerts(spark, sf):
    """SNK6: each batch of kept alerts goes to two callbacks; the first one fails every time, the second still writes its
    messages, under the batch's number."""
    box = scratch_path(spark, f"outbox-{uuid.uuid4().hex}")

    def broken(batch, epoch):
        raise ValueError("no such receiver")

    def outbox(batch, epoch):
        to_alert_messages(batch).write.mode("overwrite").parquet(f"{box}/epoch={epoch}")

    ev = events_readings(spark, sf)
    p = bl.fit_baseline(ev, K, EO, ["V"], n=30)
    scored = pl.process_samples(ev, p, K, EO, ["V"], with_warning=False)
    cands = written(al.candidates_one_pass(scored, K, EO, ["V"], al.thresholds_table(spark, EV_THRESHOLDS), preds_col=None), "cands")
    in_parts(spark, cands, F.expr(QUARTER), 4, sb.cooldown_step(order=EO, callbacks=[broken, outbox]), "notified")
    return spark.read.parquet(box).select("topic", "payload")


register("notified_alerts", ORACLES["alert_messages"])(q_notified_alerts)
