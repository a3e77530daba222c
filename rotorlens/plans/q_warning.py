"""Early-warning queries (EW1-EW12) on lineitem (history eviction at 500)
and events (short series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import (E, EVENTS_ORDER as EO, LINEITEM_METRICS as LM, LINEITEM_ORDER as LO,
                     events_readings, lineitem_features, rnd, round_doubles)
from ..operators import baseline as bl
from ..operators import warning as ew
from .registry import register
from .sql import EV_ORDER, LI_METRICS, LI_ORDER, ev_src, fit_cte, li_src, r, unpivot

K = [E]


def _flat(out):
    """Flatten the nested prediction list for scalar comparison."""
    return out.select(
        "E", "n_samples", "has_warning", rnd("earliest_anomaly_hours").alias("earliest_anomaly_hours"),
        rnd("degradation_rate").alias("degradation_rate"),
        rnd("remaining_useful_life_hours").alias("remaining_useful_life_hours"),
        rnd("overall_risk_score").alias("overall_risk_score"),
        F.array_join(F.transform("predictions", lambda p: F.concat_ws(
            "/", p["metric"], p["severity"], p["predicted_time_hours"].cast("int").cast("string"))),
            ",").alias("predictions"),
        rnd(F.array_max(F.transform("predictions", lambda p: p["confidence"]))).alias("max_confidence"),
        F.array_join(F.flatten(F.transform("predictions", lambda p: p["recommendations"])), " | ")
        .alias("recommendations"))


def q_early_warning(spark, sf):
    """EW2-EW10 per supplier: last 500 readings, 4 metrics, calibrated on the
    first 100."""
    f = lineitem_features(spark, sf)
    p = bl.fit_baseline(f, K, LO, LM, n=100, pct=95.0)
    return _flat(ew.early_warning(f, p, K, LO, LM, history=500))


def q_early_warning_events(spark, sf):
    """EW2-EW10 per user on event values, calibrated on the first 30."""
    ev = events_readings(spark, sf)
    p = bl.fit_baseline(ev, K, EO, ["V"], n=30, pct=95.0)
    return _flat(ew.early_warning(ev, p, K, EO, ["V"], history=500))


def _ew_sql(src_cte, order, metrics, n_fit, ids):
    mpos = "CASE M " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(metrics)) + " END"
    sev = "CASE WHEN h <= 6 THEN 'critical' WHEN h <= 24 THEN 'warning' ELSE 'info' END"
    recs = ("CASE WHEN h <= 6 THEN 'URGENT: Schedule immediate inspection within ' || h || ' hours | "
            "Prepare backup equipment if available | Monitor ' || M || ' closely for rapid degradation' "
            "WHEN h <= 24 THEN 'Schedule maintenance within ' || h || ' hours | Investigate root cause "
            "of ' || M || ' degradation' ELSE 'Plan maintenance check within ' || h || ' hours | Add ' "
            "|| M || ' to watch list' END")
    desc = ", ".join(f"{c} DESC" for c in order.split(", "))
    return (
        f"WITH {src_cte}, {fit_cte('src', 'E', order, metrics, n_fit)}, "
        f"tl AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY E ORDER BY {desc}) <= 500), "
        f"lg AS ({unpivot('tl', ids, metrics)}), "
        f"lx AS (SELECT *, row_number() OVER (PARTITION BY E, M ORDER BY {order}) - 1 AS x FROM lg), "
        "tr AS (SELECT E, M, count(V) AS n, regr_slope(V, x) AS b, regr_intercept(V, x) AS a, "
        "avg(V) AS mh, arg_max(V, x) AS cur FROM lx GROUP BY E, M), "
        "j AS (SELECT tr.*, fit.mean AS bm, fit.std AS bs, fit.warn AS w, fit.crit AS c FROM tr "
        "LEFT JOIN fit USING (E, M)), "
        "hz AS (SELECT j.*, hh.h, a + b * (n + CAST(trunc(hh.h * greatest(1.0, n / 24.0)) AS BIGINT)) "
        "AS pred FROM j, (VALUES (2), (6), (12), (24), (48)) hh(h)), "
        "hc AS (SELECT *, least(1.0, abs(b) / (bs + 0.001) * 0.5 + (1.0 / (abs(cur - w) / "
        "(abs(pred - cur) + 0.001) + 1.0)) * 0.5) AS conf, cur > bm AS higher FROM hz), "
        "hit AS (SELECT E, M, min(h) AS hh FROM hc WHERE n >= 20 AND w IS NOT NULL AND ((higher AND "
        "b > 0) OR (NOT higher AND b <= 0)) AND (CASE WHEN higher THEN pred > w ELSE pred < -w END) "
        "AND conf >= 0.7 GROUP BY E, M), "
        f"p AS (SELECT E, M, h, conf, {sev} AS sev, {recs} AS recs, {mpos} AS mp FROM (SELECT hc.* "
        "FROM hc JOIN hit ON hc.E = hit.E AND hc.M = hit.M AND hc.h = hit.hh)), "
        "per AS (SELECT E, M, n, CASE WHEN n >= 20 AND n >= 5 THEN (CASE WHEN mh <> 0 THEN b / abs(mh) "
        "* 100.0 ELSE b END) END AS deg, CASE WHEN n < 20 OR c IS NULL THEN NULL WHEN cur >= c THEN "
        "0.0 WHEN b <= 0 THEN NULL WHEN (c - a) / b - (n - 1) <= 0 THEN 0.0 ELSE greatest(0.0, "
        "((c - a) / b - (n - 1)) / greatest(1.0, n / 24.0)) END AS rul FROM j), "
        "g AS (SELECT E, max(n) AS ns, avg(deg) AS deg, min(rul) AS rul FROM per GROUP BY E), "
        "pe AS (SELECT E, count(*) AS np, min(h) AS earliest, max(conf) AS maxc, "
        "string_agg(M || '/' || sev || '/' || h, ',' ORDER BY mp) AS preds, "
        "string_agg(recs, ' | ' ORDER BY mp) AS recs, sum(CASE sev WHEN 'critical' THEN 40.0 WHEN "
        "'warning' THEN 25.0 ELSE 10.0 END * conf) AS ss FROM p GROUP BY E) "
        "SELECT g.E, CAST(ns AS BIGINT) AS n_samples, coalesce(np, 0) > 0 AS has_warning, "
        f"{r('earliest')} AS earliest_anomaly_hours, {r('CASE WHEN ns >= 20 THEN deg END')} AS "
        f"degradation_rate, {r('CASE WHEN ns >= 20 THEN rul END')} AS remaining_useful_life_hours, "
        f"{r('CASE WHEN ns < 20 THEN 0.0 WHEN coalesce(np, 0) = 0 AND coalesce(deg, 0) = 0 THEN 0.0 ELSE least(100.0, coalesce(ss, 0.0) + CASE WHEN deg > 0 THEN least(20.0, deg * 10.0) ELSE 0.0 END + CASE WHEN rul < 6 THEN 30.0 WHEN rul < 24 THEN 15.0 WHEN rul < 48 THEN 5.0 ELSE 0.0 END) END')}"
        " AS overall_risk_score, coalesce(preds, '') AS predictions, "
        f"{r('maxc')} AS max_confidence, coalesce(recs, '') AS recommendations "
        "FROM g LEFT JOIN pe USING (E)")


register("early_warning", _ew_sql(li_src(), LI_ORDER, LI_METRICS, 100,
                                  "E, T, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS _xp")
         .replace("ORDER BY T, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS x",
                  "ORDER BY T, l_orderkey, l_linenumber, l_partkey, _xp) - 1 AS x"))(q_early_warning)
register("early_warning_events", _ew_sql(ev_src(), EV_ORDER, ["V"], 30, "E, T, event_id"))(
    q_early_warning_events)


def q_warning_rolling(spark, sf):
    """EW11: the early-warning result as of every reading (last 500)."""
    f = lineitem_features(spark, sf)
    p = bl.fit_baseline(f, K, LO, LM, n=100, pct=95.0)
    out = ew.warning_rolling(f, p, K, LO, LM, history=500)
    return out.select(
        "E", "T", "l_orderkey", "l_linenumber", "l_partkey", "has_warning",
        rnd("earliest_anomaly_hours").alias("earliest_anomaly_hours"),
        rnd("degradation_rate").alias("degradation_rate"),
        rnd("remaining_useful_life_hours").alias("remaining_useful_life_hours"),
        rnd("overall_risk_score").alias("overall_risk_score"),
        F.size("predictions").cast("bigint").alias("n_predictions"))


def _rolling_sql():
    ids = "E, T, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS _xp"
    ordl = "T, l_orderkey, l_linenumber, l_partkey, _xp"
    fr = f"OVER (PARTITION BY E, M ORDER BY {ordl} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)"
    return (
        f"WITH {li_src()}, {fit_cte('src', 'E', LI_ORDER, LI_METRICS, 100)}, "
        f"lg AS ({unpivot('src', ids, LI_METRICS)}), "
        f"lx AS (SELECT *, row_number() OVER (PARTITION BY E, M ORDER BY {ordl}) - 1 AS g FROM lg), "
        # exact frame sums on 8-decimal scaled integers, slope numerator exact
        f"w0 AS (SELECT *, count(V) {fr} AS n, sum(CAST(round(V * 100000000) AS HUGEINT)) {fr} AS fy, "
        f"sum(CAST(round(V * 100000000) AS HUGEINT) * g) {fr} AS fgy FROM lx), "
        "w1 AS (SELECT *, n * (fgy - (g - n + 1) * fy) - (n * (n - 1) // 2) * fy AS num, "
        "CAST(fy AS DOUBLE) / 100000000.0 AS sy FROM w0), "
        "w AS (SELECT *, CASE WHEN n > 1 THEN CAST(num AS DOUBLE) / 100000000.0 / (n * n * (n * n - "
        "1.0) / 12.0) ELSE 0.0 END AS b FROM w1), "
        "j AS (SELECT w.*, V AS cur, (sy - b * (w.n * (w.n - 1) // 2)) / w.n AS a, sy / w.n AS mh, "
        "fit.mean AS bm, fit.std AS bs, fit.warn AS wt, fit.crit AS c FROM w LEFT JOIN fit USING (E, M)), "
        "hz AS (SELECT j.*, hh.h, a + b * (n + CAST(trunc(hh.h * greatest(1.0, n / 24.0)) AS BIGINT)) "
        "AS pred FROM j, (VALUES (2), (6), (12), (24), (48)) hh(h)), "
        "hc AS (SELECT *, least(1.0, abs(b) / (bs + 0.001) * 0.5 + (1.0 / (abs(cur - wt) / "
        "(abs(pred - cur) + 0.001) + 1.0)) * 0.5) AS conf, cur > bm AS higher FROM hz), "
        f"hit AS (SELECT E, {ordl}, M, min(h) AS hh FROM hc WHERE n >= 20 AND ((higher AND b > 0) OR "
        "(NOT higher AND b <= 0)) AND (CASE WHEN higher THEN pred > wt ELSE pred < -wt END) AND "
        f"conf >= 0.7 GROUP BY ALL), "
        "p AS (SELECT hc.E, hc.T, hc.l_orderkey, hc.l_linenumber, hc.l_partkey, hc._xp, hc.M, hc.h, "
        "hc.conf, CASE WHEN hc.h <= 6 THEN 40.0 WHEN hc.h <= 24 THEN 25.0 ELSE 10.0 END * hc.conf AS s "
        "FROM hc JOIN hit ON hc.E = hit.E AND hc.T = hit.T AND hc.l_orderkey = hit.l_orderkey AND "
        "hc.l_linenumber = hit.l_linenumber AND hc.l_partkey = hit.l_partkey AND hc._xp = hit._xp "
        "AND hc.M = hit.M AND hc.h = hit.hh), "
        "per AS (SELECT *, CASE WHEN n >= 20 THEN (CASE WHEN mh <> 0 THEN b / abs(mh) * 100.0 ELSE b "
        "END) END AS deg, CASE WHEN n < 20 OR c IS NULL THEN NULL WHEN cur >= c THEN 0.0 WHEN b <= 0 "
        "THEN NULL WHEN (c - a) / b - (n - 1) <= 0 THEN 0.0 ELSE greatest(0.0, ((c - a) / b - (n - 1)) "
        "/ greatest(1.0, n / 24.0)) END AS rul FROM j), "
        f"gs AS (SELECT E, {ordl}, max(n) AS n, avg(deg) AS deg, min(rul) AS rul FROM per GROUP BY ALL), "
        f"pe AS (SELECT E, {ordl}, count(*) AS np, min(h) AS earliest, sum(s) AS ss FROM p GROUP BY ALL) "
        "SELECT gs.E, gs.T, gs.l_orderkey, gs.l_linenumber, gs.l_partkey, coalesce(np, 0) > 0 AS "
        f"has_warning, {r('earliest')} AS earliest_anomaly_hours, {r('deg')} AS degradation_rate, "
        f"{r('rul')} AS remaining_useful_life_hours, "
        f"{r('CASE WHEN n < 20 THEN 0.0 WHEN coalesce(np, 0) = 0 AND coalesce(deg, 0) = 0 THEN 0.0 ELSE least(100.0, coalesce(ss, 0.0) + CASE WHEN deg > 0 THEN least(20.0, deg * 10.0) ELSE 0.0 END + CASE WHEN rul < 6 THEN 30.0 WHEN rul < 24 THEN 15.0 WHEN rul < 48 THEN 5.0 ELSE 0.0 END) END')}"
        " AS overall_risk_score, CAST(coalesce(np, 0) AS BIGINT) AS n_predictions FROM gs LEFT JOIN pe "
        "ON gs.E = pe.E AND gs.T = pe.T AND gs.l_orderkey = pe.l_orderkey AND gs.l_linenumber = "
        "pe.l_linenumber AND gs.l_partkey = pe.l_partkey AND gs._xp = pe._xp")


register("warning_rolling", _rolling_sql())(q_warning_rolling)


def q_ew_calibrate(spark, sf):
    """EW1: calibration statistics and thresholds (p95 warning, p99 critical)."""
    ev = events_readings(spark, sf)
    p = bl.fit_baseline(ev, K, EO, ["V"], n=30, pct=95.0)
    return round_doubles(p.select("E", "M", "mean", "std", "min", "max",
                                  F.col("warn").alias("warning"), F.col("crit").alias("critical")))


register("ew_calibrate",
         f"WITH {ev_src()}, {fit_cte('src', 'E', EV_ORDER, ['V'], 30)} SELECT E, M, {r('mean')} AS mean, "
         f"{r('std')} AS std, {r('min')} AS min, {r('max')} AS max, {r('warn')} AS warning, "
         f"{r('crit')} AS critical FROM fit")(q_ew_calibrate)


def q_series_trends(spark, sf):
    """EW2-EW4, EW8 per (machine, metric): history size, slope, intercept,
    degradation rate and remaining life."""
    f = lineitem_features(spark, sf)
    p = bl.fit_baseline(f, K, LO, LM, n=100)
    tr = ew.series_trends(f, K, LO, LM, 500).join(
        p.select("E", "M", "crit"), ["E", "M"], "left")
    n = F.col("n").cast("double")
    return tr.select("E", "M", F.col("n").cast("bigint"), rnd("slope", 8).alias("slope"),
                     rnd("intercept", 6).alias("intercept"),
                     rnd(ew.degradation_rate(n, F.col("slope"), F.col("mean_hist"))).alias("degradation_rate"),
                     rnd(ew.remaining_life(n, F.col("slope"), F.col("intercept"), F.col("current"),
                                           F.col("crit"))).alias("remaining_life_hours"))


register("series_trends",
         f"WITH {li_src()}, {fit_cte('src', 'E', LI_ORDER, LI_METRICS, 100)}, "
         "tl AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY E ORDER BY T DESC, l_orderkey "
         "DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) <= 500), "
         f"lg AS ({unpivot('tl', 'E, T, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS _xp', LI_METRICS)}), "
         "lx AS (SELECT *, row_number() OVER (PARTITION BY E, M ORDER BY T, l_orderkey, l_linenumber, "
         "l_partkey, _xp) - 1 AS x FROM lg), tr AS (SELECT E, M, count(V) AS n, regr_slope(V, x) AS b, "
         "regr_intercept(V, x) AS a, avg(V) AS mh, arg_max(V, x) AS cur FROM lx GROUP BY E, M) "
         f"SELECT tr.E, tr.M, CAST(tr.n AS BIGINT) AS n, {r('b', 8)} AS slope, {r('a')} AS intercept, "
         f"{r('CASE WHEN tr.n >= 5 THEN (CASE WHEN mh <> 0 THEN b / abs(mh) * 100.0 ELSE b END) END')} "
         "AS degradation_rate, "
         f"{r('CASE WHEN crit IS NULL THEN NULL WHEN cur >= crit THEN 0.0 WHEN b <= 0 THEN NULL WHEN (crit - a) / b - (tr.n - 1) <= 0 THEN 0.0 ELSE greatest(0.0, ((crit - a) / b - (tr.n - 1)) / greatest(1.0, tr.n / 24.0)) END')}"
         " AS remaining_life_hours FROM tr LEFT JOIN fit ON tr.E = fit.E AND tr.M = fit.M")(
    q_series_trends)


def q_history_summary(spark, sf):
    """EW12: samples held, oldest, newest and feature names per machine."""
    f = lineitem_features(spark, sf)
    h = ew.history_summary(f, K, LO, "T", LM, 500)
    return h.select("E", "samples", "oldest", "newest", F.array_join("features", ",").alias("features"))


register("history_summary",
         "WITH " + li_src() + ", tl AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY E ORDER "
         "BY T DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) <= 500) "
         "SELECT E, count(*) AS samples, min(T) AS oldest, max(T) AS newest, "
         f"'{','.join(LI_METRICS)}' AS features FROM tl GROUP BY E")(q_history_summary)


def q_warning_rolling_chunked(spark, sf):
    """EW11 through the skew-safe path (chunks of 500 rows carrying a
    500-row halo); same values as warning_rolling."""
    f = lineitem_features(spark, sf)
    p = bl.fit_baseline(f, K, LO, LM, n=100, pct=95.0)
    out = ew.warning_rolling(f, p, K, LO, LM, history=500, chunk_rows=500)
    return out.select(
        "E", "T", "l_orderkey", "l_linenumber", "l_partkey", "has_warning",
        rnd("earliest_anomaly_hours").alias("earliest_anomaly_hours"),
        rnd("degradation_rate").alias("degradation_rate"),
        rnd("remaining_useful_life_hours").alias("remaining_useful_life_hours"),
        rnd("overall_risk_score").alias("overall_risk_score"),
        F.size("predictions").cast("bigint").alias("n_predictions"))


register("warning_rolling_chunked", _rolling_sql())(q_warning_rolling_chunked)
