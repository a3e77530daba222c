"""Monitor-page analytics (MON1-MON11) and pipeline queries (PIP1, PIP4,
PIP5). Feature file stand-in: lineitem per supplier with rms =
extendedprice / 1e5, kurtosis = quantity / 10, mean = discount."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import E, LINEITEM_METRICS as LM, LINEITEM_ORDER as LO, lineitem_features, rnd
from ..operators import alerts as al
from ..operators import monitor as mo
from ..session import written
from . import pipeline as pl
from .registry import ORACLES, register
from .sql import r, status

K = [E]
ORD = "T, l_orderkey, l_linenumber, l_partkey, l_extendedprice"


def features_file(spark, sf):
    f = lineitem_features(spark, sf)
    return f.select("E", "T", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                    (F.col("l_extendedprice") / 100000.0).alias("rms"),
                    (F.col("l_quantity") / 10.0).alias("kurtosis"),
                    F.col("l_discount").alias("mean"))


# The page's z threshold is a user setting (default 2.5); prices are uniform,
# so 1.5 is chosen from this data's range to make anomalies occur.
THRESHOLD = 1.5


def scores(spark, sf):
    f = features_file(spark, sf)
    st = mo.upload_stats(f, K, LO, "rms")
    return mo.monitor_scores(f, st, K, LO, "rms", THRESHOLD)


SRC = ("src AS (SELECT l_suppkey AS E, l_shipdate AS T, l_orderkey, l_linenumber, l_partkey, "
       "l_extendedprice, l_extendedprice / 100000.0 AS rms, l_quantity / 10.0 AS kurtosis, l_discount "
       "AS mean FROM lineitem)")
BASE = (f"b AS (SELECT E, avg(rms) AS bm, stddev_samp(rms) AS bs FROM (SELECT * FROM src QUALIFY "
        f"row_number() OVER (PARTITION BY E ORDER BY {ORD}) <= 100) GROUP BY E)")
SCORES = (f"sc0 AS (SELECT src.*, row_number() OVER (PARTITION BY E ORDER BY {ORD}) - 1 AS idx, "
          "abs(rms - bm) / greatest(bs, 1e-9) AS z FROM src JOIN b USING (E)), "
          f"sc AS (SELECT *, z > {THRESHOLD} AS anom, "
          "least(greatest(100.0 - z * 12.0, 0.0), 100.0) AS health, "
          "least(greatest((z - 1.0) * 25.0, 0.0), 100.0) AS fp FROM sc0)")
HEAD = f"WITH {SRC}, {BASE}, {SCORES}"


def q_upload_stats(spark, sf):
    """MON1."""
    st = mo.upload_stats(features_file(spark, sf), K, LO, "rms")
    return st.select("E", *[rnd(c).alias(c) for c in st.columns if c != "E"])


register("upload_stats",
         f"WITH {SRC}, {BASE} SELECT E, {r('avg(rms)')} AS rms_mean, {r('stddev_samp(rms)')} AS rms_std, "
         f"{r('min(rms)')} AS rms_min, {r('max(rms)')} AS rms_max, {r('any_value(bm)')} AS baseline_mean, "
         f"{r('any_value(bs)')} AS baseline_std FROM src JOIN b USING (E) GROUP BY E")(q_upload_stats)


def q_monitor_scores(spark, sf):
    """MON2 + MON3 per sample."""
    s = scores(spark, sf)
    return s.select("E", "idx", rnd("z_score").alias("z_score"), "is_anomaly",
                    rnd("health").alias("health"), rnd("failure_probability").alias("failure_probability"),
                    "remaining_samples")


register("monitor_scores",
         f"{HEAD} SELECT E, idx, {r('z')} AS z_score, anom AS is_anomaly, {r('health')} AS health, "
         f"{r('fp')} AS failure_probability, CASE WHEN health > 30 THEN CAST(trunc((health - 30.0) / "
         "(z * 0.5 + 0.1) * 10.0) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS remaining_samples FROM sc")(
    q_monitor_scores)


def q_monitor_history(spark, sf):
    """MON4: rolling page statistics over the last 300 samples."""
    h = mo.monitor_history(scores(spark, sf), K, 300)
    return h.select("E", "idx", "window_anomalies", rnd("window_avg_health").alias("window_avg_health"),
                    rnd("window_max_z").alias("window_max_z"))


register("monitor_history",
         f"{HEAD} SELECT E, idx, CAST(sum(CAST(anom AS INTEGER)) OVER w AS BIGINT) AS window_anomalies, "
         f"{r('avg(health) OVER w')} AS window_avg_health, {r('max(z) OVER w')} AS window_max_z FROM sc "
         "WINDOW w AS (PARTITION BY E ORDER BY idx ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)")(
    q_monitor_history)


def q_monitor_alerts(spark, sf):
    """MON5: newest 20 anomaly alerts per machine."""
    return mo.monitor_alerts(scores(spark, sf), K, 20)


register("monitor_alerts",
         f"{HEAD}, a AS (SELECT E, idx, '#' || idx || ': Z=' || printf('%.2f', z) || ', H=' || "
         "printf('%.0f', health) || '%' AS msg, CASE WHEN health < 30 THEN 'critical' ELSE 'warning' END "
         "AS sev FROM sc WHERE anom) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY E ORDER BY "
         "idx DESC) <= 20")(q_monitor_alerts)


def q_monitor_early_warning(spark, sf):
    """MON6: trend of the last 10 z-scores, hours and confidence."""
    w = mo.monitor_early_warning(scores(spark, sf), K, THRESHOLD)
    return w.select("E", "idx", "ew_hours", "ew_confidence")


register("monitor_early_warning",
         f"{HEAD}, t AS (SELECT *, CASE WHEN idx >= 10 THEN (z - lag(z, 9) OVER (PARTITION BY E ORDER "
         "BY idx)) / 10.0 END AS tr FROM sc) SELECT E, idx, CASE WHEN tr > 0.05 THEN CAST(least(48, "
         f"greatest(2, trunc(({THRESHOLD} - z) / (tr + 0.01)))) AS INTEGER) END AS ew_hours, "
         "CAST(CASE WHEN tr > "
         "0.05 THEN least(95, trunc(50.0 + tr * 200.0)) ELSE 0 END AS INTEGER) AS ew_confidence FROM t")(
    q_monitor_early_warning)


def notifications(spark, sf):
    return mo.notification_select(scores(spark, sf), K, 50, -100)


NOTIFY = ("an AS (SELECT *, row_number() OVER (PARTITION BY E ORDER BY idx) AS rn FROM sc WHERE anom "
          "AND idx >= -50), "
          "rc AS (SELECT E, rn, idx, true AS kept, idx AS last FROM an WHERE rn = 1 UNION ALL SELECT an.E, "
          "an.rn, an.idx, an.idx >= rc.last + 50, CASE WHEN an.idx >= rc.last + 50 THEN an.idx ELSE "
          "rc.last END FROM rc JOIN an ON an.E = rc.E AND an.rn = rc.rn + 1), "
          "nt AS (SELECT an.* FROM an JOIN rc USING (E, rn) WHERE rc.kept)")


def q_notification_select(spark, sf):
    """MON7: anomaly notifications at least 50 samples apart."""
    return notifications(spark, sf).select("E", "idx", rnd("z_score").alias("z_score"))


register("notification_select", f"WITH RECURSIVE {SRC}, {BASE}, {SCORES}, {NOTIFY} SELECT E, idx, "
         f"{r('z')} AS z_score FROM nt")(q_notification_select)


def q_notification_rate_limit(spark, sf):
    """MON8: notifications at least 60 s of event time apart."""
    n = mo.notification_rate_limit(notifications(spark, sf), K, "T", 60)
    return n.select("E", "idx", "T")


register("notification_rate_limit",
         f"WITH RECURSIVE {SRC}, {BASE}, {SCORES}, {NOTIFY}, "
         "n2 AS (SELECT *, row_number() OVER (PARTITION BY E ORDER BY T, idx) AS rn2 FROM nt), "
         "rc2 AS (SELECT E, rn2, T, true AS kept, T AS last FROM n2 WHERE rn2 = 1 UNION ALL SELECT n2.E, "
         "n2.rn2, n2.T, n2.T >= rc2.last + INTERVAL 60 SECOND, CASE WHEN n2.T >= rc2.last + INTERVAL 60 "
         "SECOND THEN n2.T ELSE rc2.last END FROM rc2 JOIN n2 ON n2.E = rc2.E AND n2.rn2 = rc2.rn2 + 1) "
         "SELECT n2.E, n2.idx, n2.T FROM n2 JOIN rc2 USING (E, rn2) WHERE rc2.kept")(
    q_notification_rate_limit)


def q_notification_payload(spark, sf):
    """MON9: subject, status and recommendation of each notification (the
    JSON document is checked in the tests)."""
    p = mo.notification_payload(notifications(spark, sf))
    return p.select("E", "idx", "subject", "status", "recommendation")


register("notification_payload",
         f"WITH RECURSIVE {SRC}, {BASE}, {SCORES}, {NOTIFY} SELECT E, idx, 'ANOMALY DETECTED - Sample #' "
         "|| idx || ' - Health: ' || printf('%.0f', health) || '%' AS subject, CASE WHEN health < 30 THEN "
         "'CRITICAL' ELSE 'WARNING' END AS status, CASE WHEN health < 30 THEN 'Immediate maintenance "
         "required!' ELSE 'Schedule maintenance soon.' END AS recommendation FROM nt")(
    q_notification_payload)


def q_histogram(spark, sf):
    """MON10: z-score histogram, 20 bins on [0, 10], per machine."""
    return mo.histogram(scores(spark, sf), "z_score", 0.0, 10.0, 20, K)


register("histogram",
         f"{HEAD} SELECT E, CAST(CASE WHEN z = 10.0 THEN 20 WHEN z < 0.0 THEN 0 WHEN z >= 10.0 THEN 21 "
         "ELSE floor((z - 0.0) / (10.0 - 0.0) * 20) + 1 END AS BIGINT) AS bin, count(*) AS n FROM sc "
         "GROUP BY ALL")(q_histogram)


def q_anomaly_timeline(spark, sf):
    """MON11."""
    return mo.anomaly_timeline(scores(spark, sf), K)


register("anomaly_timeline", f"{HEAD} SELECT E, idx, CAST(anom AS INTEGER) AS flag FROM sc")(
    q_anomaly_timeline)


# -------------------------------------------------------------- pipeline ---

def samples(spark, sf):
    f = lineitem_features(spark, sf)
    p = written(pl.fit_all(f, K, LO, LM, n=100), "params")  # read by the scores and by the warnings
    return pl.process_samples(f, p, K, LO, LM)


def q_process_samples(spark, sf):
    """PIP1: per sample anomaly, health and early warning in one plan."""
    s = samples(spark, sf)
    return s.select("E", "T", "l_orderkey", "l_linenumber", "l_partkey", "is_anomaly",
                    rnd("anomaly_score").alias("anomaly_score"), rnd("health_score").alias("health_score"),
                    "status", "has_warning", rnd("overall_risk_score").alias("overall_risk_score"))


def _pip1_sql():
    from .q_core import FLAGSHIP_SQL
    from .q_warning import _rolling_sql
    return ("SELECT a.E, a.T, a.l_orderkey, a.l_linenumber, a.l_partkey, a.is_anomaly, a.zscore_score "
            "AS anomaly_score, a.health_score, a.status, b.has_warning, b.overall_risk_score FROM "
            f"({FLAGSHIP_SQL}) a JOIN ({_rolling_sql()}) b ON a.E = b.E AND a.T = b.T AND a.l_orderkey = "
            "b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey")


register("process_samples", _pip1_sql())(q_process_samples)


def q_latest_state(spark, sf):
    """PIP4: newest health, status and anomaly flag per supplier."""
    s = samples(spark, sf)
    st = pl.latest_state(s, K, LO)
    return st.select("E", "T", rnd("health_score").alias("health_score"), "status", "is_anomaly")


def _pip4_sql():
    from .q_core import FLAGSHIP_SQL
    return (f"SELECT E, T, health_score, status, is_anomaly FROM ({FLAGSHIP_SQL}) a JOIN (SELECT "
            "l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice FROM lineitem) li ON "
            "a.l_orderkey = li.l_orderkey AND a.l_linenumber = li.l_linenumber AND a.l_partkey = "
            "li.l_partkey AND a.T = li.l_shipdate QUALIFY row_number() OVER (PARTITION BY E ORDER BY T "
            "DESC, a.l_orderkey DESC, a.l_linenumber DESC, a.l_partkey DESC, li.l_extendedprice DESC) = 1")


register("latest_state", _pip4_sql())(q_latest_state)


def q_fleet_summary(spark, sf):
    """PIP5: machines by status and the alert summary, on the events flow."""
    from .q_alerts import managed_alerts, scored_events
    from ..operators.health import health_status
    ev = scored_events(spark, sf).withColumn("status", health_status("health_score"))
    latest = pl.latest_state(ev, K, ["T", "event_id"])
    m, _ = managed_alerts(spark, sf)
    out = pl.fleet_summary(latest, m)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


def _pip5_sql():
    from .q_alerts import BASE_ALERTS
    return (f"{BASE_ALERTS}, lt AS (SELECT *, {status('hs')} AS st FROM sc QUALIFY row_number() OVER "
            "(PARTITION BY E ORDER BY T DESC, event_id DESC) = 1), eq AS (SELECT count(*) AS "
            "total_equipment, " + ", ".join(f"CAST(count_if(st = '{s}') AS BIGINT) AS n_{s}" for s in
                                            ("excellent", "good", "fair", "warning", "critical")) +
            " FROM lt), su AS (SELECT count(*) AS total_alerts, CAST(count_if(NOT resolved) AS BIGINT) AS "
            "active_alerts, CAST(count_if(NOT resolved AND severity = 'critical') AS BIGINT) AS "
            "critical_active, CAST(count_if(NOT resolved AND severity = 'warning') AS BIGINT) AS "
            "warning_active, CAST(count_if(NOT resolved AND acknowledged) AS BIGINT) AS acknowledged FROM "
            "flagged) SELECT * FROM eq, su")


register("fleet_summary", _pip5_sql())(q_fleet_summary)


def q_pipeline_alerts(spark, sf):
    """PIP1 + ALR6-ALR8: alerts of the full pipeline on lineitem with
    thresholds from the data range (rows-only check; parts are checked
    one by one above)."""
    s = samples(spark, sf)
    th = al.thresholds_table(spark, [("l_quantity", 40.0, 48.0, False),
                                     ("l_discount", 0.08, 0.095, False),
                                     ("l_tax", 0.06, 0.075, False)])
    a = pl.pipeline_alerts(s, K, LO, LM, th, cooldown_minutes=2 * 24 * 60)
    return a.select("alert_id", "E", "T", "alert_type", "severity", "message")


register("pipeline_alerts")(q_pipeline_alerts)


PIPE_THRESHOLDS = [("l_quantity", 40.0, 48.0), ("l_discount", 0.08, 0.095), ("l_tax", 0.06, 0.075)]


def _pipeline_alerts_sql():
    """Oracle of pipeline_alerts: the flagship scores, the per-sample
    early-warning hits, the four candidate kinds, the greedy 2-day cooldown
    (recursive CTE) and per-machine ids."""
    from .q_core import _ensemble_sql, _health_sql, _li_base_sql
    from .q_warning import _rolling_sql
    from .sql import LI_METRICS, max_abs_z
    rs = _rolling_sql()
    ew_q = rs[:rs.index(" SELECT gs.E")] + \
        " SELECT E, T, l_orderkey, l_linenumber, l_partkey, _xp, M, h, conf FROM p"
    mpos = "CASE M " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(LI_METRICS)) + " END"
    ordc = "T, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
    keys = "E, T, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
    thr = " UNION ALL ".join(
        f"SELECT {keys}, {2 + LI_METRICS.index(m)} AS ord, 'threshold', CASE WHEN {m} > {c} THEN "
        f"'critical' ELSE 'warning' END, CASE WHEN {m} > {c} THEN '{m} is at critical level: ' || "
        f"printf('%.2f', {m}) ELSE '{m} is elevated: ' || printf('%.2f', {m}) END FROM h0 WHERE {m} > {w}"
        for m, w, c in PIPE_THRESHOLDS)
    base = _li_base_sql().replace("WITH ", "WITH RECURSIVE ", 1)
    return (
        f"{base}, h0 AS (SELECT *, {_health_sql()} AS hs, {_ensemble_sql()} = -1 AS anom, "
        f"-{max_abs_z(LI_METRICS)} AS score FROM j), ew AS ({ew_q}), "
        f"ewr AS (SELECT *, row_number() OVER (PARTITION BY E, T, l_orderkey, l_linenumber, l_partkey, "
        f"_xp ORDER BY {mpos}) - 1 AS i FROM ew), "
        f"cands AS (SELECT {keys}, 0 AS ord, 'health_score' AS alert_type, CASE WHEN hs < 30 THEN "
        "'critical' ELSE 'warning' END AS severity, CASE WHEN hs < 30 THEN 'Equipment health critically "
        "low: ' || printf('%.1f', hs) || '%' ELSE 'Equipment health warning: ' || printf('%.1f', hs) || "
        f"'%' END AS message FROM h0 WHERE hs < 50 UNION ALL SELECT {keys}, 1, 'anomaly', CASE WHEN "
        "score < -1 THEN 'critical' ELSE 'warning' END, 'Anomaly detected in sensor readings' FROM h0 "
        f"WHERE anom UNION ALL {thr} UNION ALL SELECT E, T, l_orderkey, l_linenumber, l_partkey, _xp, "
        f"{2 + len(LI_METRICS)} + i, 'early_warning', CASE WHEN h <= 6 THEN 'critical' WHEN h <= 24 THEN "
        "'warning' ELSE 'info' END, CASE WHEN h <= 6 THEN 'EARLY WARNING: Anomaly predicted in ' WHEN h "
        "<= 24 THEN 'Early Warning: Anomaly predicted in ' ELSE 'Advisory: Potential anomaly in ' END || "
        "printf('%.1f', CAST(h AS DOUBLE)) || ' hours (Affected: ' || M || ', Confidence: ' || "
        "printf('%.0f', conf * 100) || '%)' FROM ewr WHERE conf >= 0.5 AND h <= 48), "
        f"x AS (SELECT *, row_number() OVER (PARTITION BY E, alert_type, severity ORDER BY {ordc}, ord) "
        "AS rn FROM cands), "
        "rc AS (SELECT E, alert_type, severity, rn, T, true AS kept, T AS last FROM x WHERE rn = 1 "
        "UNION ALL SELECT x.E, x.alert_type, x.severity, x.rn, x.T, x.T >= rc.last + INTERVAL 2880 MINUTE, "
        "CASE WHEN x.T >= rc.last + INTERVAL 2880 MINUTE THEN x.T ELSE rc.last END FROM rc JOIN x ON "
        "x.E = rc.E AND x.alert_type = rc.alert_type AND x.severity = rc.severity AND x.rn = rc.rn + 1), "
        "kept AS (SELECT x.* FROM x JOIN rc USING (E, alert_type, severity, rn) WHERE rc.kept), "
        "ids AS (SELECT *, printf('alert_%s_%06d', CAST(E AS VARCHAR), row_number() OVER (PARTITION BY E "
        f"ORDER BY {ordc}, ord)) AS alert_id FROM kept) "
        "SELECT alert_id, E, T, alert_type, severity, message FROM ids")


ORACLES["pipeline_alerts"] = _pipeline_alerts_sql()  # registered above without SQL
