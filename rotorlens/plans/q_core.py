"""Core queries: baseline, detection, health and scalar functions on the
driver tables (lineitem = multi-metric machines, events = single metric)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..model import (E, LINEITEM_METRICS as LM, LINEITEM_ORDER as LO, EVENTS_ORDER as EO,
                     events_readings, lineitem_features, rnd, round_doubles, to_long, to_wide)
from ..operators import anomaly as ano
from ..operators import baseline as bl
from ..operators import health as hl
from .registry import ORACLES, register
from .sql import (LI_KEYS, EV_ORDER, LI_METRICS, LI_ORDER, ev_src, fit_cte, iqr_out, li_src,
                  max_abs_z, nz, r, stat_component, status, unpivot, wide_cte)

K = [E]
ALL_STATS = ("mean", "std", "q1", "q3", "iqr")
LI_ID = ["E", "T", "l_orderkey", "l_linenumber", "l_partkey"]


def li_attached(spark, sf, n=100, stats=ALL_STATS):
    f = lineitem_features(spark, sf)
    p = bl.fit_baseline(f, K, LO, LM, n=n)
    return f, p, ano.attach_params(f, p, K, LM, stats)


def _li_base_sql(n=100, stats=ALL_STATS):
    return (f"WITH {li_src()}, {fit_cte('src', 'E', LI_ORDER, LI_METRICS, n)}, "
            f"{wide_cte('pw', 'E', LI_METRICS, stats)}, "
            f"j AS (SELECT s.*, pw.* EXCLUDE (E) FROM src s LEFT JOIN pw USING (E))")


def _ensemble_sql():
    return (f"(CASE WHEN (CASE WHEN {max_abs_z(LI_METRICS)} > 3.0 THEN -1 ELSE 1 END) + "
            f"(CASE WHEN {iqr_out(LI_METRICS)} THEN -1 ELSE 1 END) < 0 THEN -1 ELSE 1 END)")


def _health_sql():
    comps = " + ".join(f"{stat_component(m)} * 0.1" for m in LI_METRICS)
    return f"least(greatest(({comps}) / {0.1 * len(LI_METRICS)}, 0.0), 100.0)"


# ------------------------------------------------------------ flagship ---

def flagship(spark, sf):
    """Anomalous readings of each machine against its own first 100 rows,
    and the health of every reading (SRC13 -> ANO1 -> ANO2/3/6/7 -> HLT3/5/6
    -> FN7). One fit shuffle, one join, then row-local expressions."""
    f, p, j = li_attached(spark, sf)
    d = ano.detect(j, None, K, LM, attached=True)
    h = hl.health_score(d, None, K, LM, attached=True, keep_components=False)
    return h.select(*LI_ID, F.col("zscore_prediction").cast("int"),
                    F.col("iqr_prediction").cast("int"), rnd("zscore_score").alias("zscore_score"),
                    F.col("ensemble_prediction").cast("int"), "is_anomaly",
                    rnd("health_score").alias("health_score"), "status")


FLAGSHIP_SQL = (
    _li_base_sql() +
    ", h AS (SELECT *, " + _health_sql() + " AS hs FROM j) "
    f"SELECT {LI_KEYS}, CAST(CASE WHEN {max_abs_z(LI_METRICS)} > 3.0 THEN -1 ELSE 1 END AS INTEGER) "
    f"AS zscore_prediction, CAST(CASE WHEN {iqr_out(LI_METRICS)} THEN -1 ELSE 1 END AS INTEGER) "
    f"AS iqr_prediction, {r('-' + max_abs_z(LI_METRICS))} AS zscore_score, "
    f"CAST({_ensemble_sql()} AS INTEGER) AS ensemble_prediction, "
    f"({_ensemble_sql()} = -1) AS is_anomaly, {r('hs')} AS health_score, {status('hs')} AS status "
    "FROM h")

register("anomaly_health", FLAGSHIP_SQL)(flagship)


# ------------------------------------------------------------ baseline ---

def q_fit_baseline(spark, sf):
    """PIP3 / ANO1 / HLT1 / EW1: one aggregate of all baseline statistics."""
    p = bl.fit_baseline(lineitem_features(spark, sf), K, LO, LM, n=100)
    return round_doubles(p.withColumn("n", F.col("n").cast("bigint")))


register("fit_baseline",
         f"WITH {li_src()}, {fit_cte('src', 'E', LI_ORDER, LI_METRICS, 100)} "
         "SELECT E, M, n, " + ", ".join(r(c) + f" AS {c}" for c in
                                       ["mean", "std", "std_samp", "min", "max", "p5", "q1",
                                        "median", "q3", "p95", "p99", "warn", "iqr", "crit"]) +
         " FROM fit")(q_fit_baseline)


def q_fit_stats(spark, sf):
    """CLN5: mean, std(pop), min, max over whole series."""
    return round_doubles(bl.fit_stats(lineitem_features(spark, sf), K, LM))


register("fit_stats",
         f"WITH {li_src()}, l AS ({unpivot('src', 'E', LI_METRICS)}) SELECT E, M, "
         f"{r('avg(V)')} AS mean, {r('stddev_pop(V)')} AS std, {r('min(V)')} AS min, "
         f"{r('max(V)')} AS max FROM l GROUP BY E, M")(q_fit_stats)


def q_head_baseline(spark, sf):
    """SRC13: first 30 readings of every events series."""
    ev = events_readings(spark, sf)
    return bl.head_rows(ev, K, EO, 30).select("E", "T", "event_id", "V")


register("head_baseline",
         f"WITH {ev_src()} SELECT E, T, event_id, V FROM src "
         f"QUALIFY row_number() OVER (PARTITION BY E ORDER BY {EV_ORDER}) <= 30")(q_head_baseline)


def q_to_long(spark, sf):
    """SRC12 wide -> long."""
    return to_long(lineitem_features(spark, sf), LI_ID, LM)


register("to_long", f"WITH {li_src()} {unpivot('src', LI_KEYS, LI_METRICS)}")(q_to_long)


def q_to_wide(spark, sf):
    """SRC12 long -> wide round trip."""
    lng = to_long(lineitem_features(spark, sf), LI_ID, LM)
    return to_wide(lng, LI_ID, LM)


register("to_wide", f"WITH {li_src()} SELECT {LI_KEYS}, " +
         ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in LI_METRICS) + " FROM src")(q_to_wide)


# ------------------------------------------------------------ detection ---

def q_detect_zscore(spark, sf):
    """ANO2 + ANO7 on single-metric events (baseline = first 30 readings)."""
    ev = events_readings(spark, sf)
    p = bl.fit_baseline(ev, K, EO, ["V"], n=30)
    d = ano.detect(ev, p, K, ["V"], methods=("zscore",))
    return d.select("E", "T", "event_id", F.col("zscore_prediction").cast("int"),
                    rnd("zscore_score").alias("zscore_score"))


register("detect_zscore",
         f"WITH {ev_src()}, {fit_cte('src', 'E', EV_ORDER, ['V'], 30)}, "
         f"{wide_cte('pw', 'E', ['V'])}, j AS (SELECT s.*, pw.* EXCLUDE (E) FROM src s "
         f"LEFT JOIN pw USING (E)) SELECT E, T, event_id, CAST(CASE WHEN {max_abs_z(['V'])} > 3.0 "
         f"THEN -1 ELSE 1 END AS INTEGER) AS zscore_prediction, {r('-' + max_abs_z(['V']))} "
         "AS zscore_score FROM j")(q_detect_zscore)


def q_detect_iqr(spark, sf):
    """ANO3 on lineitem."""
    f, p, j = li_attached(spark, sf)
    d = ano.detect(j, None, K, LM, methods=("iqr",), attached=True)
    return d.select(*LI_ID, F.col("iqr_prediction").cast("int"))


register("detect_iqr", _li_base_sql() +
         f" SELECT {LI_KEYS}, CAST(CASE WHEN {iqr_out(LI_METRICS)} THEN -1 ELSE 1 END AS INTEGER) "
         "AS iqr_prediction FROM j")(q_detect_iqr)


def q_anomaly_report(spark, sf):
    """ANO9: index, votes, score, ensemble, flag per reading."""
    f, p, j = li_attached(spark, sf)
    rep = ano.anomaly_report(j, None, K, LO, LM, attached=True)
    return rep.select("E", "index", "T", F.col("zscore_prediction").cast("int"),
                      F.col("iqr_prediction").cast("int"), rnd("zscore_score").alias("anomaly_score"),
                      F.col("ensemble_prediction").cast("int"), "is_anomaly")


register("anomaly_report", _li_base_sql() +
         f" SELECT E, row_number() OVER (PARTITION BY E ORDER BY {LI_ORDER}) - 1 AS index, T, "
         f"CAST(CASE WHEN {max_abs_z(LI_METRICS)} > 3.0 THEN -1 ELSE 1 END AS INTEGER) AS zscore_prediction, "
         f"CAST(CASE WHEN {iqr_out(LI_METRICS)} THEN -1 ELSE 1 END AS INTEGER) AS iqr_prediction, "
         f"{r('-' + max_abs_z(LI_METRICS))} AS anomaly_score, "
         f"CAST({_ensemble_sql()} AS INTEGER) AS ensemble_prediction, ({_ensemble_sql()} = -1) "
         "AS is_anomaly FROM j")(q_anomaly_report)


def q_monitor(spark, sf):
    """ANO10: rolling anomaly rate over the last 10 readings, alert level."""
    f, p, j = li_attached(spark, sf)
    d = ano.detect(j, None, K, LM, attached=True)
    m = ano.monitor(d, K, LO, window=10, alert_threshold=0.5)
    return m.select(*LI_ID, F.col("ensemble_prediction").cast("int"),
                    rnd("window_anomaly_rate").alias("window_anomaly_rate"),
                    rnd("window_avg_score").alias("window_avg_score"), "alert", "alert_level")


_RATE = (f"avg(CASE WHEN {_ensemble_sql()} = -1 THEN 1.0 ELSE 0.0 END) OVER "
         f"(PARTITION BY E ORDER BY {LI_ORDER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
register("monitor", _li_base_sql() +
         f", m AS (SELECT *, {_ensemble_sql()} AS ens, {_RATE} AS rate FROM j) "
         f"SELECT {LI_KEYS}, CAST(ens AS INTEGER) AS ensemble_prediction, {r('rate')} AS "
         "window_anomaly_rate, CAST(0.0 AS DOUBLE) AS window_avg_score, rate >= 0.5 AS alert, CASE WHEN rate >= 0.8 "
         "THEN 'critical' WHEN rate >= 0.5 THEN 'warning' WHEN rate >= 0.2 THEN 'info' ELSE "
         "'normal' END AS alert_level FROM m")(q_monitor)


def q_reconstruction(spark, sf):
    """ANO11 + ANO13: mean squared standardised error vs the 95th
    percentile of the fit rows' errors."""
    f = lineitem_features(spark, sf)
    p = bl.fit_baseline(f, K, LO, LM, n=100)
    out = ano.reconstruction_mean(f, p, K, LO, LM, n=100, pct=95.0)
    return out.select(*LI_ID, rnd("reconstruction_error").alias("reconstruction_error"),
                      rnd("threshold").alias("threshold"), F.col("prediction").cast("int"),
                      rnd("reconstruction_score").alias("reconstruction_score"))


_ERR = "(" + " + ".join(f"pow(({m} - {m}_mean) / {nz(m + '_std')}, 2)" for m in LI_METRICS) + \
    f") / {len(LI_METRICS)}.0"
register("reconstruction_mean", _li_base_sql(stats=("mean", "std")) +
         f", e AS (SELECT *, {_ERR} AS err, row_number() OVER (PARTITION BY E ORDER BY {LI_ORDER}) "
         "AS rn FROM j), t AS (SELECT E, quantile_cont(err, 0.95) AS thr FROM e WHERE rn <= 100 "
         f"GROUP BY E) SELECT {LI_KEYS}, {r('err')} AS reconstruction_error, {r('thr')} AS threshold, "
         "CAST(CASE WHEN err > thr THEN -1 ELSE 1 END AS INTEGER) AS prediction, "
         f"{r('least(greatest(err / (thr * 2.0), 0.0), 1.0)')} AS reconstruction_score "
         "FROM e JOIN t USING (E)")(q_reconstruction)


# ------------------------------------------------------------ health ---

def q_health_components(spark, sf):
    """HLT3 + HLT5 + HLT6 + FN7 with component columns."""
    f, p, j = li_attached(spark, sf, stats=("mean", "std"))
    h = hl.health_score(j, None, K, LM, attached=True)
    return h.select(*LI_ID, *[rnd(f"comp_{m}").alias(f"comp_{m}") for m in LM],
                    rnd("health_score").alias("health_score"), "status")


register("health_components", _li_base_sql(stats=("mean", "std")) +
         f" SELECT {LI_KEYS}, " + ", ".join(f"{r(stat_component(m))} AS comp_{m}" for m in LI_METRICS) +
         f", {r(_health_sql())} AS health_score, {status(_health_sql())} AS status FROM j")(
    q_health_components)


def q_health_heuristic(spark, sf):
    """HLT4: uncalibrated scoring of events values renamed to the reference's
    metric families (value as rms, value/10 as kurtosis, value as temperature)."""
    ev = events_readings(spark, sf).select(
        "E", "T", "event_id", F.col("V").alias("rms"), (F.col("V") / 10).alias("kurtosis"),
        F.col("V").alias("temperature"), F.col("V").alias("pressure"))
    mets = ["rms", "kurtosis", "temperature", "pressure"]
    h = hl.health_score(ev, None, K, mets)
    return h.select("E", "T", "event_id", *[rnd(f"comp_{m}").alias(f"comp_{m}") for m in mets],
                    rnd("health_score").alias("health_score"), "status")


_HEUR = {
    "rms": "CASE WHEN rms < 0.05 THEN 100.0 WHEN rms < 0.1 THEN 80.0 WHEN rms < 0.2 THEN 50.0 "
           "ELSE greatest(0.0, 100.0 - rms * 100.0) END",
    "kurtosis": "greatest(0.0, 100.0 - abs(kurtosis) * 20.0)",
    "temperature": "CASE WHEN temperature >= 40 AND temperature <= 60 THEN 100.0 WHEN temperature "
                   ">= 30 AND temperature <= 70 THEN 80.0 WHEN temperature >= 20 AND temperature <= 80 "
                   "THEN 60.0 ELSE greatest(0.0, 100.0 - abs(temperature - 50.0)) END",
    "pressure": "75.0",
}
_HEUR_SCORE = ("least(greatest((c_rms * 0.3 + c_kurtosis * 0.25 + c_temperature * 0.1 + "
               "c_pressure * 0.1) / 0.75, 0.0), 100.0)")
register("health_heuristic",
         f"WITH {ev_src()}, x AS (SELECT E, T, event_id, V AS rms, V / 10 AS kurtosis, V AS "
         "temperature, V AS pressure FROM src), c AS (SELECT *, " +
         ", ".join(f"{v} AS c_{k}" for k, v in _HEUR.items()) + " FROM x) SELECT E, T, event_id, " +
         ", ".join(f"{r('c_' + k)} AS comp_{k}" for k in _HEUR) +
         f", {r(_HEUR_SCORE)} AS health_score, {status(_HEUR_SCORE)} AS status FROM c")(
    q_health_heuristic)


def q_health_weights(spark, sf):
    """HLT2: normalised default weights and the weight of an unknown name."""
    ev = events_readings(spark, sf).select("channel").distinct()
    w = hl.normalise_weights()
    m = F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(v))])
    return ev.select(F.col("channel").alias("feature"),
                     rnd(F.coalesce(m[F.col("channel")], F.lit(hl.UNKNOWN_WEIGHT))).alias("weight"))


register("health_weights", "SELECT DISTINCT event_type AS feature, CAST(0.1 AS DOUBLE) AS weight FROM events")(
    q_health_weights)


def q_health_trend(spark, sf):
    """HLT7: trend of the last 10 health scores per machine."""
    f, p, j = li_attached(spark, sf, stats=("mean", "std"))
    h = hl.health_score(j, None, K, LM, attached=True, keep_components=False)
    t = hl.health_trend(h, K, LO, 10)
    return t.select(*LI_ID, rnd("health_score").alias("health_score"), "trend")


register("health_trend", _li_base_sql(stats=("mean", "std")) +
         f", h AS (SELECT *, {_health_sql()} AS hs FROM j), t AS (SELECT *, (hs - first_value(hs) "
         f"OVER w) / count(hs) OVER w AS slope, count(hs) OVER w AS cnt FROM h WINDOW w AS "
         f"(PARTITION BY E ORDER BY {LI_ORDER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) "
         f"SELECT {LI_KEYS}, {r('hs')} AS health_score, CASE WHEN cnt < 2 THEN 'stable' WHEN slope > 1 "
         "THEN 'improving' WHEN slope < -1 THEN 'degrading' ELSE 'stable' END AS trend FROM t")(
    q_health_trend)


def q_health_report(spark, sf):
    """HLT8-HLT10: report with recommendations and alerts, flattened to text
    so it compares as scalars."""
    ev = events_readings(spark, sf).select("E", "T", "event_id",
                                          (F.col("V") / 1000).alias("rms_vibration"),
                                          (F.col("V") / 5).alias("temperature"))
    mets = ["rms_vibration", "temperature"]
    p = bl.fit_baseline(ev, K, EO, mets, n=30)
    rep = hl.health_report(ev, p, K, EO, mets)
    alerts = F.transform("alerts", lambda a: F.concat_ws(":", a["type"], a["severity"], a["message"]))
    return rep.select("E", "T", "event_id", rnd("health_score").alias("health_score"), "status",
                      "trend", F.array_join("recommendations", " | ").alias("recommendations"),
                      F.array_join(alerts, " | ").alias("alerts"),
                      rnd(F.col("components")["temperature"]).alias("temperature_component"))


def _report_sql():
    mets = ["rms_vibration", "temperature"]
    hs = ("least(greatest((" + " + ".join(f"c_{m} * 0.1" for m in mets) + ") / 0.2, 0.0), 100.0)")
    recs = ("list_concat(CASE WHEN st = 'critical' THEN ['Immediate maintenance inspection required', "
            "'Consider shutting down equipment to prevent damage'] WHEN st = 'warning' THEN "
            "['Schedule maintenance within 24-48 hours', 'Monitor equipment closely'] WHEN st = 'fair' "
            "THEN ['Plan maintenance within the next week'] ELSE []::VARCHAR[] END, "
            "list_filter([CASE WHEN c_rms_vibration < 50 THEN 'Check rms_vibration: possible bearing "
            "or alignment issue' END, CASE WHEN c_temperature < 50 THEN 'Check temperature: possible "
            "cooling or lubrication issue' END], lambda x: x IS NOT NULL))")
    comp_alert = " , ".join(
        f"CASE WHEN c_{m} < 30 THEN 'component:critical:{m} score is critically low: ' || "
        f"printf('%.1f', c_{m}) || '%' WHEN c_{m} < 50 THEN 'component:warning:{m} score is "
        f"concerning: ' || printf('%.1f', c_{m}) || '%' END" for m in mets)
    alerts = (f"list_filter([CASE WHEN st IN ('critical', 'warning') THEN 'health_score:' || st || "
              f"':Health score is ' || printf('%.1f', hs) || '%' END, {comp_alert}], "
              "lambda x: x IS NOT NULL)")
    return (f"WITH {ev_src()}, x AS (SELECT E, T, event_id, V / 1000 AS rms_vibration, V / 5 AS "
            f"temperature FROM src), {fit_cte('x', 'E', EV_ORDER, mets, 30)}, "
            f"{wide_cte('pw', 'E', mets, ('mean', 'std'))}, j AS (SELECT x.*, pw.* EXCLUDE (E) "
            "FROM x LEFT JOIN pw USING (E)), c AS (SELECT *, " +
            ", ".join(f"{stat_component(m)} AS c_{m}" for m in mets) + " FROM j), "
            f"h AS (SELECT *, {hs} AS hs FROM c), s AS (SELECT *, {status('hs')} AS st, "
            "(hs - first_value(hs) OVER w) / count(hs) OVER w AS slope, count(hs) OVER w AS cnt "
            f"FROM h WINDOW w AS (PARTITION BY E ORDER BY {EV_ORDER} ROWS BETWEEN 9 PRECEDING AND "
            f"CURRENT ROW)) SELECT E, T, event_id, {r('hs')} AS health_score, st AS status, "
            "CASE WHEN cnt < 2 THEN 'stable' WHEN slope > 1 THEN 'improving' WHEN slope < -1 THEN "
            f"'degrading' ELSE 'stable' END AS trend, array_to_string({recs}, ' | ') AS "
            f"recommendations, array_to_string({alerts}, ' | ') AS alerts, {r('c_temperature')} AS "
            "temperature_component FROM s")


register("health_report", _report_sql())(q_health_report)


def q_health_history(spark, sf):
    """HLT11: machine, score and component columns."""
    f, p, j = li_attached(spark, sf, stats=("mean", "std"))
    h = hl.health_score(j, None, K, LM, attached=True)
    return round_doubles(h.select("E", "T", "l_orderkey", "l_linenumber", "l_partkey",
                                  "health_score", *[F.col(f"comp_{m}").alias(m) for m in LM]))


register("health_history", _li_base_sql(stats=("mean", "std")) +
         f" SELECT {LI_KEYS}, {r(_health_sql())} AS health_score, " +
         ", ".join(f"{r(stat_component(m))} AS {m}" for m in LI_METRICS) + " FROM j")(
    q_health_history)


def q_remaining_steps(spark, sf):
    """EW13: steps until the health line of each machine reaches 30."""
    f, p, j = li_attached(spark, sf, stats=("mean", "std"))
    h = hl.health_score(j, None, K, LM, attached=True, keep_components=False)
    out = hl.remaining_steps(h, K, LO, failure=30.0, min_samples=10)
    return out.select("E", F.col("n").cast("bigint"), rnd("remaining_steps", 4).alias("remaining_steps"))


register("remaining_steps", _li_base_sql(stats=("mean", "std")) +
         f", h AS (SELECT E, {_health_sql()} AS hs, row_number() OVER (PARTITION BY E ORDER BY "
         f"{LI_ORDER}) - 1 AS x FROM j), g AS (SELECT E, count(hs) AS n, regr_slope(hs, x) AS b, "
         "regr_intercept(hs, x) AS a, arg_min(hs, x) AS first, arg_max(hs, x) AS last FROM h "
         "GROUP BY E) SELECT E, n, CASE WHEN n >= 10 AND last < first AND b < 0 THEN "
         f"{r('greatest(0.0, (30.0 - a) / b - (n - 1))', 4)} END AS remaining_steps FROM g")(
    q_remaining_steps)


# ------------------------------------------------------------ scalars ---

def q_scalar_functions(spark, sf):
    """FN1-FN8 over every events reading (value used as a health score)."""
    ev = events_readings(spark, sf)
    h = F.col("V") / 4
    return ev.select(
        "event_id",
        rnd(fn.safe_divide(F.col("V"), F.col("V") - F.floor("V"))).alias("safe_div"),
        fn.severity_level(h).alias("severity"), fn.format_health(h).alias("health_text"),
        fn.health_status(h).alias("status"),
        fn.format_snapshot_ts("T").alias("snapshot_name"),
        (fn.parse_snapshot_ts(fn.format_snapshot_ts("T")) ==
         F.date_trunc("second", "T").cast("timestamp_ntz")).alias("ts_roundtrip"),
        fn.display_health_band(h).alias("health_band"),
        fn.display_failure_band(F.col("V") / 3).alias("failure_band"),
        fn.display_remaining_band(F.col("V")).alias("remaining_band"))


register("scalar_functions",
         "SELECT event_id, round(CASE WHEN value - floor(value) = 0 THEN 0.0 ELSE value / "
         "(value - floor(value)) END, 6) AS safe_div, CASE WHEN value / 4 >= 70 THEN 'info' WHEN "
         "value / 4 >= 40 THEN 'warning' ELSE 'critical' END AS severity, printf('%.1f%% (%s)', "
         "value / 4, CASE WHEN value / 4 >= 70 THEN 'Good' WHEN value / 4 >= 40 THEN 'Warning' ELSE "
         f"'Critical' END) AS health_text, {status('value / 4')} AS status, strftime(ts, "
         "'%Y.%m.%d.%H.%M.%S') AS snapshot_name, true AS ts_roundtrip, CASE WHEN value / 4 >= 70 "
         "THEN 'success' WHEN value / 4 >= 40 THEN 'warning' ELSE 'danger' END AS health_band, "
         "CASE WHEN value / 3 < 30 THEN 'success' WHEN value / 3 < 60 THEN 'warning' ELSE 'danger' "
         "END AS failure_band, CASE WHEN value > 100 THEN 'success' WHEN value > 30 THEN 'warning' "
         "ELSE 'danger' END AS remaining_band FROM events")(q_scalar_functions)


def q_zscore_series(spark, sf):
    """FN2: z-score of each reading within its whole series (all equal -> 0)."""
    ev = events_readings(spark, sf)
    st = ev.groupBy("E").agg(F.avg("V").alias("mu"), F.stddev_pop("V").alias("sd"))
    z = F.when(F.col("sd") == 0, 0.0).otherwise((F.col("V") - F.col("mu")) / F.col("sd"))
    return ev.join(st, "E").select("E", "event_id", rnd(z).alias("z"))


register("zscore_series",
         "WITH s AS (SELECT user_id AS E, avg(value) AS mu, stddev_pop(value) AS sd FROM events "
         "GROUP BY 1) SELECT user_id AS E, event_id, round(CASE WHEN sd = 0 THEN 0.0 ELSE (value - mu) "
         "/ sd END, 6) AS z FROM events JOIN s ON user_id = E")(q_zscore_series)


def q_moving_average_valid(spark, sf):
    """FN3: 'valid' moving average (full windows only, w = 5); a series
    shorter than w is returned unchanged."""
    from ..operators.cleaning import moving_average_valid
    ev = events_readings(spark, sf)
    out = moving_average_valid(ev, K, EO, "V", 5)
    return out.select("E", "event_id", rnd("ma").alias("ma"))


register("moving_average_valid",
         f"WITH {ev_src()}, w AS (SELECT E, event_id, avg(V) OVER (PARTITION BY E ORDER BY "
         f"{EV_ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma, row_number() OVER "
         f"(PARTITION BY E ORDER BY {EV_ORDER}) AS rn, count(*) OVER (PARTITION BY E) AS n, V FROM src) "
         "SELECT E, event_id, round(CASE WHEN n < 5 THEN V ELSE ma END, 6) AS ma FROM w "
         "WHERE n < 5 OR rn >= 5")(q_moving_average_valid)


def q_anomaly_report_skew_safe(spark, sf):
    """ANO9 with the bucketed (skew-safe) row index; same rows as
    anomaly_report."""
    f, p, j = li_attached(spark, sf)
    rep = ano.anomaly_report(j, None, K, LO, LM, attached=True, chunk_rows=100)
    return rep.select("E", "index", "T", F.col("zscore_prediction").cast("int"),
                      F.col("iqr_prediction").cast("int"), rnd("zscore_score").alias("anomaly_score"),
                      F.col("ensemble_prediction").cast("int"), "is_anomaly")


register("anomaly_report_skew_safe", ORACLES["anomaly_report"])(q_anomaly_report_skew_safe)
