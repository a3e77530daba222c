"""Alert queries (ALR1-ALR15) over per-reading scores of the events table,
and over early-warning results of lineitem."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..model import (E, EVENTS_ORDER as EO, LINEITEM_METRICS as LM, LINEITEM_ORDER as LO,
                     events_readings, lineitem_features, rnd)
from ..operators import alerts as al
from ..operators import anomaly as ano
from ..operators import baseline as bl
from ..operators import health as hl
from ..operators import warning as ew
from ..operators.quantiles import exact_quantiles
from ..session import scratch_path, written
from ..sinks import files as fs
from .registry import ORACLES, register
from .sql import EV_ORDER, ev_src, fit_cte, iqr_out, max_abs_z, r, stat_component, wide_cte

K = [E]
# Thresholds on the event value, chosen from its range (0 .. ~500).
EV_THRESHOLDS = [("V", 150.0, 250.0, False)]
COOLDOWN = 15


def scored_events(spark, sf):
    """Per reading: health score, anomaly flag and z-score score (the
    per-sample part of the pipeline)."""
    ev = events_readings(spark, sf).select("E", "T", "event_id", "V")
    p = bl.fit_baseline(ev, K, EO, ["V"], n=30)
    j = ano.attach_params(ev, p, K, ["V"])
    d = ano.detect(j, None, K, ["V"], attached=True)
    h = hl.health_score(d, None, K, ["V"], attached=True, keep_components=False)
    return h.withColumn("anomaly_score", F.col("zscore_score")).select(
        "E", "T", "event_id", "V", "health_score", "is_anomaly", "anomaly_score")


def candidates(spark, sf):
    s = scored_events(spark, sf)
    th = al.thresholds_table(spark, EV_THRESHOLDS)
    keys, order = ["E"], ["T", "event_id"]
    return al.candidate_alerts([
        al.check_health(s, keys, order, ord_=0),
        al.check_anomaly(s, keys, order, ord_=1),
        al.check_thresholds(s, keys, order, ["V"], th, ord_base=2)])


SCORED_SQL = (
    f"{ev_src()}, {fit_cte('src', 'E', EV_ORDER, ['V'], 30)}, {wide_cte('pw', 'E', ['V'])}, "
    "j AS (SELECT s.*, pw.* EXCLUDE (E) FROM src s LEFT JOIN pw USING (E)), "
    f"sc AS (SELECT E, T, event_id, V, least(greatest({stat_component('V')} * 0.1 / 0.1, 0.0), 100.0) "
    f"AS hs, (CASE WHEN (CASE WHEN {max_abs_z(['V'])} > 3.0 THEN -1 ELSE 1 END) + (CASE WHEN "
    f"{iqr_out(['V'])} THEN -1 ELSE 1 END) < 0 THEN -1 ELSE 1 END) = -1 AS anom, "
    f"-{max_abs_z(['V'])} AS score FROM j)")

CANDS_SQL = (
    "cands AS ("
    "SELECT E, T, event_id, 0 AS ord, 'health_score' AS alert_type, CASE WHEN hs < 30 THEN 'critical' "
    "ELSE 'warning' END AS severity, CASE WHEN hs < 30 THEN 'Equipment health critically low: ' || "
    "printf('%.1f', hs) || '%' ELSE 'Equipment health warning: ' || printf('%.1f', hs) || '%' END AS "
    "message, CAST(hs AS DOUBLE) AS source_value, CAST(CASE WHEN hs < 30 THEN 30.0 ELSE 50.0 END AS DOUBLE) AS threshold, "
    "CAST(NULL AS VARCHAR) AS metric FROM sc WHERE hs < 50 "
    "UNION ALL SELECT E, T, event_id, 1, 'anomaly', CASE WHEN score < -1 THEN 'critical' ELSE "
    "'warning' END, 'Anomaly detected in sensor readings', score, NULL, NULL FROM sc WHERE anom "
    "UNION ALL SELECT E, T, event_id, 2, 'threshold', CASE WHEN V > 250.0 THEN 'critical' ELSE "
    "'warning' END, CASE WHEN V > 250.0 THEN 'V is at critical level: ' || printf('%.2f', V) ELSE "
    "'V is elevated: ' || printf('%.2f', V) END, V, CASE WHEN V > 250.0 THEN 250.0 ELSE 150.0 END, "
    "'V' FROM sc WHERE V > 150.0)")


def _cands_out(df, *more):
    return df.select(*more, "E", "T", "event_id", F.col("ord").cast("int"), "alert_type", "severity",
                     "message", rnd("source_value").alias("source_value"),
                     rnd("threshold").alias("threshold"), "metric")


CANDS_COLS = (f"E, T, event_id, CAST(ord AS INTEGER) AS ord, alert_type, severity, message, "
              f"{r('source_value')} AS source_value, {r('threshold')} AS threshold, metric")

register("alert_candidates", f"WITH {SCORED_SQL}, {CANDS_SQL} SELECT {CANDS_COLS} FROM cands")(
    lambda spark, sf: _cands_out(candidates(spark, sf)))


def q_saved_thresholds(spark, sf):
    """SNK5: the thresholds saved and loaded, then the candidates they raise."""
    path = scratch_path(spark, f"thresholds-{uuid.uuid4().hex}")
    fs.save_params({"thresholds": al.thresholds_table(spark, EV_THRESHOLDS)}, {"cooldown_minutes": 15}, path)
    loaded, _ = fs.load_params(spark, path, ["thresholds"])
    return _cands_out(al.candidates_one_pass(scored_events(spark, sf), ["E"], ["T", "event_id"], ["V"], loaded["thresholds"]))


register("saved_thresholds", ORACLES["alert_candidates"])(q_saved_thresholds)


def kept_alerts(spark, sf):
    """ALR7 + ALR8: cooldown of 15 minutes, then per-machine ids; written once for all that reads them."""
    s = scored_events(spark, sf)
    cands = al.candidates_one_pass(s, ["E"], ["T", "event_id"], ["V"], al.thresholds_table(spark, EV_THRESHOLDS))
    kept = written(al.cooldown(written(cands, "candidates"), COOLDOWN, "T", ["event_id", "ord"]), "kept")
    return written(al.assign_ids(kept, ["T", "event_id", "ord"]), "alerts")


KEPT_SQL = (
    "x AS (SELECT *, row_number() OVER (PARTITION BY E, alert_type, severity ORDER BY T, event_id, "
    "ord) AS rn FROM cands), "
    "rc AS (SELECT E, alert_type, severity, rn, T, true AS kept, T AS last FROM x WHERE rn = 1 "
    "UNION ALL SELECT x.E, x.alert_type, x.severity, x.rn, x.T, x.T >= rc.last + INTERVAL 15 MINUTE, "
    "CASE WHEN x.T >= rc.last + INTERVAL 15 MINUTE THEN x.T ELSE rc.last END FROM rc JOIN x ON "
    "x.E = rc.E AND x.alert_type = rc.alert_type AND x.severity = rc.severity AND x.rn = rc.rn + 1), "
    "kept AS (SELECT x.* FROM x JOIN rc USING (E, alert_type, severity, rn) WHERE rc.kept), "
    "ids AS (SELECT *, printf('alert_%s_%06d', CAST(E AS VARCHAR), row_number() OVER (PARTITION BY E "
    "ORDER BY T, event_id, ord)) AS alert_id FROM kept)")

def q_cooldown_long(spark, sf):
    """ALR7 with a 3-day cooldown, so the greedy rule drops alerts."""
    kept = al.cooldown(candidates(spark, sf), 3 * 24 * 60, "T", ["event_id", "ord"])
    return kept.select("E", "T", "event_id", F.col("ord").cast("int"), "alert_type", "severity")


register("alert_cooldown_3d",
         f"WITH RECURSIVE {SCORED_SQL}, {CANDS_SQL}, " +
         KEPT_SQL.replace("INTERVAL 15 MINUTE", "INTERVAL 4320 MINUTE") +
         " SELECT E, T, event_id, CAST(ord AS INTEGER) AS ord, alert_type, severity FROM kept")(
    q_cooldown_long)

register("alert_cooldown",
         f"WITH RECURSIVE {SCORED_SQL}, {CANDS_SQL}, {KEPT_SQL} SELECT alert_id, {CANDS_COLS} FROM ids")(
    lambda spark, sf: _cands_out(kept_alerts(spark, sf), "alert_id"))


def actions_for(alerts):
    """Actions derived from the alerts themselves: acknowledge every third
    alert of a machine, resolve every fourth."""
    n = F.regexp_extract("alert_id", r"_(\d+)$", 1).cast("int")
    ack = alerts.filter(n % 3 == 0).select("alert_id", F.lit("acknowledge").alias("action"))
    res = alerts.filter(n % 4 == 0).select("alert_id", F.lit("resolve").alias("action"))
    return ack.unionByName(res)


def managed_alerts(spark, sf):
    a = kept_alerts(spark, sf)
    return al.apply_actions(a, actions_for(a)), actions_for(a)


ACT_SQL = ("acts AS (SELECT *, CAST(regexp_extract(alert_id, '_(\\d+)$', 1) AS INTEGER) AS n FROM ids), "
           "flagged AS (SELECT *, n % 3 = 0 AS acknowledged, n % 4 = 0 AS resolved FROM acts)")
BASE_ALERTS = f"WITH RECURSIVE {SCORED_SQL}, {CANDS_SQL}, {KEPT_SQL}, {ACT_SQL}"


def q_alert_actions(spark, sf):
    """ALR9: acknowledged / resolved flags from actions."""
    m, _ = managed_alerts(spark, sf)
    return m.select("alert_id", "E", "alert_type", "severity", "acknowledged", "resolved")


register("alert_actions", f"{BASE_ALERTS} SELECT alert_id, E, alert_type, severity, acknowledged, "
         "resolved FROM flagged")(q_alert_actions)


def q_active_alerts(spark, sf):
    """ALR10: unresolved critical alerts, newest first (anti join)."""
    a = kept_alerts(spark, sf)
    act = al.active_alerts(a, actions_for(a), severity="critical")
    return act.select("alert_id", "E", "T", "alert_type", "message")


register("active_alerts", f"{BASE_ALERTS} SELECT alert_id, E, T, alert_type, message FROM flagged "
         "WHERE NOT resolved AND severity = 'critical'")(q_active_alerts)


def q_alert_summary(spark, sf):
    """ALR11."""
    m, _ = managed_alerts(spark, sf)
    return al.alert_summary(m)


register("alert_summary", f"{BASE_ALERTS} SELECT count(*) AS total_alerts, CAST(count_if(NOT resolved) AS BIGINT) AS "
         "active_alerts, CAST(count_if(NOT resolved AND severity = 'critical') AS BIGINT) AS critical_active, "
         "CAST(count_if(NOT resolved AND severity = 'warning') AS BIGINT) AS warning_active, CAST(count_if(NOT resolved AND "
         "acknowledged) AS BIGINT) AS acknowledged FROM flagged")(q_alert_summary)


def q_alert_counts(spark, sf):
    """ALR12: alerts raised per severity."""
    return al.alert_counts(kept_alerts(spark, sf))


register("alert_counts", f"WITH RECURSIVE {SCORED_SQL}, {CANDS_SQL}, {KEPT_SQL} SELECT severity, "
         "count(*) AS n FROM ids GROUP BY severity")(q_alert_counts)


def q_expire_alerts(spark, sf):
    """ALR14: resolved alerts older than 7 days before the newest alert are
    dropped; report kept and removed counts per machine."""
    m, _ = managed_alerts(spark, sf)
    as_of = m.agg(F.max("T").alias("_asof"))  # one row
    gone = al.expired(F.col("_asof"), 7)
    return m.crossJoin(F.broadcast(as_of)).groupBy("E").agg(
        F.count_if(~gone).cast("bigint").alias("kept"), F.count_if(gone).cast("bigint").alias("removed"))


register("expire_alerts", f"{BASE_ALERTS}, mx AS (SELECT max(T) AS as_of_t FROM flagged) SELECT E, "
         "CAST(count_if(NOT resolved OR T > as_of_t - INTERVAL 7 DAY) AS BIGINT) AS kept, "
         "CAST(count_if(resolved AND T <= as_of_t - INTERVAL 7 DAY) AS BIGINT) AS removed FROM flagged, mx "
         "GROUP BY E")(q_expire_alerts)


def q_recent_alerts(spark, sf):
    """ALR15: the newest 100 alerts (a top-k is the feature here)."""
    return al.recent_alerts(kept_alerts(spark, sf), 100).select("alert_id", "E", "T", "severity")


register("recent_alerts", f"WITH RECURSIVE {SCORED_SQL}, {CANDS_SQL}, {KEPT_SQL} SELECT alert_id, E, T, "
         "severity FROM ids ORDER BY T DESC, alert_id DESC LIMIT 100")(q_recent_alerts)


def q_update_thresholds(spark, sf):
    """ALR13: replace defaults by thresholds measured on the data (p90 and
    p99 of event values under the name 'rms', a new 'value' row)."""
    ev = events_readings(spark, sf)
    measured = exact_quantiles(ev, [], "V", [0.9, 0.99]).select(
        F.col("q")[0].alias("warning"), F.col("q")[1].alias("critical"))
    upd = measured.select(F.explode(F.array(
        F.struct(F.lit("rms").alias("M"), "warning", "critical", F.lit(False).alias("lower_is_bad")),
        F.struct(F.lit("value").alias("M"), "warning", "critical",
                 F.lit(False).alias("lower_is_bad")))).alias("u")).select("u.*")
    out = al.update_thresholds(al.thresholds_table(spark), upd)
    return out.select("M", rnd("warning").alias("warning"), rnd("critical").alias("critical"),
                      "lower_is_bad")


register("update_thresholds",
         "WITH m AS (SELECT quantile_cont(value, 0.9) AS w, quantile_cont(value, 0.99) AS c FROM events) "
         "SELECT * FROM (VALUES ('health_score', 50.0, 30.0, true), ('anomaly_rate', 0.3, 0.5, false), "
         "('kurtosis', 2.0, 4.0, false), ('temperature', 70.0, 85.0, false)) t(M, warning, critical, "
         "lower_is_bad) UNION ALL SELECT 'rms', round(w, 6), round(c, 6), false FROM m UNION ALL "
         "SELECT 'value', round(w, 6), round(c, 6), false FROM m")(q_update_thresholds)


# --------------------------------------------- prediction / early warning ---

def q_prediction_alerts(spark, sf):
    """ALR4: remaining-life hours of each (supplier, metric) trend as a
    predicted failure; within 6 h critical, within 24 h warning."""
    f = lineitem_features(spark, sf)
    p = bl.fit_baseline(f, K, LO, LM, n=100)
    tr = ew.series_trends(f, K, LO, LM, 500).join(p.select("E", "M", "crit"), ["E", "M"], "left")
    n = F.col("n").cast("double")
    tr = tr.withColumn("rul", ew.remaining_life(n, F.col("slope"), F.col("intercept"),
                                                F.col("current"), F.col("crit")))
    c = al.check_prediction(tr, ["E"], ["M"], "rul")
    return c.select("E", "M", "severity", "message", rnd("source_value").alias("source_value"))


register("prediction_alerts",
         "WITH src AS (SELECT l_suppkey AS E, l_shipdate AS T, l_orderkey, l_linenumber, l_partkey, "
         "l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem), " +
         fit_cte('src', 'E', 'T, l_orderkey, l_linenumber, l_partkey, l_extendedprice',
                 LM, 100) +
         ", tl AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY E ORDER BY T DESC, "
         "l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) <= 500), lg AS (" +
         " UNION ALL ".join(f"SELECT E, T, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS _xp, "
                            f"'{m}' AS M, {m} AS V FROM tl" for m in LM) +
         "), lx AS (SELECT *, row_number() OVER (PARTITION BY E, M ORDER BY T, l_orderkey, l_linenumber, "
         "l_partkey, _xp) - 1 AS x FROM lg), tr AS (SELECT E, M, count(V) AS n, regr_slope(V, x) AS b, "
         "regr_intercept(V, x) AS a, arg_max(V, x) AS cur FROM lx GROUP BY E, M), "
         "rl AS (SELECT tr.E, tr.M, CASE WHEN crit IS NULL THEN NULL WHEN cur >= crit THEN 0.0 WHEN b <= 0 "
         "THEN NULL WHEN (crit - a) / b - (tr.n - 1) <= 0 THEN 0.0 ELSE greatest(0.0, ((crit - a) / b - "
         "(tr.n - 1)) / greatest(1.0, tr.n / 24.0)) END AS rul FROM tr LEFT JOIN fit ON tr.E = fit.E AND "
         "tr.M = fit.M) SELECT E, M, CASE WHEN rul <= 6 THEN 'critical' ELSE 'warning' END AS severity, "
         "'Failure predicted within ' || printf('%.1f', rul) || ' hours' AS message, round(rul, 6) AS "
         "source_value FROM rl WHERE rul <= 24")(q_prediction_alerts)


WEAR_RATE = 0.5  # per reading after the 30-reading baseline


def wear_events(spark, sf):
    """A degrading series derived from events: value / 100 plus wear that
    grows by WEAR_RATE per reading after the baseline (the reference's
    'degrading history' test shape), so early warnings have something to
    find."""
    ev = events_readings(spark, sf).select("E", "T", "event_id", "V")
    rn = F.row_number().over(__import__("rotorlens.model", fromlist=["x"]).series_window(K, EO))
    return ev.withColumn("V", F.col("V") / 100.0 + WEAR_RATE * F.greatest(rn - 30, F.lit(0)))


WEAR_SQL = ("src AS (SELECT user_id AS E, ts AS T, event_id, value / 100.0 + 0.5 * greatest("
            "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 30, 0) AS V FROM events)")


def q_early_warning_alerts(spark, sf):
    """ALR5: one alert per early-warning prediction of each machine."""
    f = wear_events(spark, sf)
    p = bl.fit_baseline(f, K, EO, ["V"], n=30)
    w = ew.early_warning(f, p, K, EO, ["V"], history=500)
    c = al.check_early_warning(w, ["E"], [], "predictions")
    return c.select("E", F.col("ord").cast("int"), "severity", "message", "metric",
                    rnd("source_value").alias("source_value"), rnd("threshold").alias("threshold"))


def _ew_alert_sql():
    from .q_warning import _ew_sql  # the early-warning oracle, reused as a CTE source
    base = _ew_sql(WEAR_SQL, EV_ORDER, ["V"], 30, "E, T, event_id")
    head, _, _ = base.partition(" SELECT g.E,")
    return (head + ", pr AS (SELECT E, M, h, conf, row_number() OVER (PARTITION BY E ORDER BY mp) - 1 AS "
            "i FROM p) SELECT E, CAST(i + 100 AS INTEGER) AS ord, CASE WHEN h <= 6 THEN 'critical' WHEN "
            "h <= 24 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN h <= 6 THEN 'EARLY WARNING: "
            "Anomaly predicted in ' WHEN h <= 24 THEN 'Early Warning: Anomaly predicted in ' ELSE "
            "'Advisory: Potential anomaly in ' END || printf('%.1f', CAST(h AS DOUBLE)) || ' hours "
            "(Affected: ' || M || "
            "', Confidence: ' || printf('%.0f', conf * 100) || '%)' AS message, M AS metric, "
            "round(CAST(h AS DOUBLE), 6) AS source_value, round(conf, 6) AS threshold FROM pr "
            "WHERE conf >= 0.5 AND h <= 48")


register("early_warning_alerts", _ew_alert_sql())(q_early_warning_alerts)


def q_alert_candidates_one_pass(spark, sf):
    """ALR1-ALR6 in one scan (array of checks, one explode); same rows as
    alert_candidates."""
    s = scored_events(spark, sf)
    th = al.thresholds_table(spark, EV_THRESHOLDS)
    c = al.candidates_one_pass(s, ["E"], ["T", "event_id"], ["V"], th, preds_col=None)
    return _cands_out(c)


register("alert_candidates_one_pass", f"WITH {SCORED_SQL}, {CANDS_SQL} SELECT {CANDS_COLS} FROM cands")(
    q_alert_candidates_one_pass)
