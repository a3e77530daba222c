"""Cleaning and rolling-feature queries (CLN1-CLN19, ROL1-ROL8)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..model import (E, EVENTS_ORDER as EO, LINEITEM_METRICS as LM, events_readings,
                     lineitem_features, rnd, round_doubles)
from ..operators import cleaning as cl
from ..operators.rolling import ema_frame_length, rolling_features
from ..operators.series import series_index
from .registry import register
from .sql import EV_ORDER, LI_KEYS, LI_METRICS, ev_src, li_src, nz, r

K = [E]
LI_ID = ["E", "T", "l_orderkey", "l_linenumber", "l_partkey"]
# Deterministic holes for the imputation queries (the tables hold no nulls).
HOLE = "(event_id % 3 = 0 OR event_id % 5 = 0)"


def ev_holes(spark, sf):
    ev = events_readings(spark, sf)
    return ev.withColumn("V", F.when(F.expr(HOLE), F.lit(None)).otherwise(F.col("V")))


EV_HOLES_SQL = (f"src AS (SELECT user_id AS E, ts AS T, event_id, CASE WHEN {HOLE} THEN NULL "
                "ELSE value END AS V FROM events)")


# ------------------------------------------------------------- scaling ---

def _scale_query(method):
    def q(spark, sf):
        f = lineitem_features(spark, sf)
        p = cl.fit_scaler(f, K, LM)
        return round_doubles(cl.scale(f, p, K, LM, method).select(*LI_ID, *LM))
    return q


def _scale_sql(method):
    parts = []
    for m in LI_METRICS:
        if method == "standard":
            c, s = f"avg({m}) OVER w", nz(f"stddev_pop({m}) OVER w")
        elif method == "minmax":
            c, s = f"min({m}) OVER w", nz(f"(max({m}) OVER w - min({m}) OVER w)")
        else:
            c = f"quantile_cont({m}, 0.5) OVER w"
            s = nz(f"(quantile_cont({m}, 0.75) OVER w - quantile_cont({m}, 0.25) OVER w)")
        parts.append(f"{r(f'({m} - {c}) / {s}')} AS {m}")
    return (f"WITH {li_src()} SELECT {LI_KEYS}, " + ", ".join(parts) +
            " FROM src WINDOW w AS (PARTITION BY E)")


for _m in ("standard", "minmax", "robust"):
    register(f"scale_{_m}", _scale_sql(_m))(_scale_query(_m))


def q_inverse_scale(spark, sf):
    """CLN4: robust scaling followed by its inverse restores the values."""
    f = lineitem_features(spark, sf)
    p = cl.fit_scaler(f, K, LM)
    back = cl.inverse_scale(cl.scale(f, p, K, LM, "robust"), p, K, LM, "robust")
    return round_doubles(back.select(*LI_ID, *LM))


register("inverse_scale", f"WITH {li_src()} SELECT {LI_KEYS}, " +
         ", ".join(f"{r(m)} AS {m}" for m in LI_METRICS) + " FROM src")(q_inverse_scale)


# ----------------------------------------------------------- imputation ---

def _impute_query(method, gap):
    def q(spark, sf):
        out = cl.impute(ev_holes(spark, sf), K, EO, ["V"], method, gap)
        return out.select("E", "event_id", rnd("V").alias("V"))
    return q


def _ff(col, gap):
    lo = "UNBOUNDED" if gap is None else str(gap)
    return (f"last_value({col} IGNORE NULLS) OVER (PARTITION BY E ORDER BY {EV_ORDER} "
            f"ROWS BETWEEN {lo} PRECEDING AND CURRENT ROW)")


def _bf(col, gap):
    hi = "UNBOUNDED" if gap is None else str(gap)
    return (f"first_value({col} IGNORE NULLS) OVER (PARTITION BY E ORDER BY {EV_ORDER} "
            f"ROWS BETWEEN CURRENT ROW AND {hi} FOLLOWING)")


def _impute_sql(method, gap):
    if method == "forward_fill":
        body = (f"a AS (SELECT *, {_ff('V', gap)} AS V1 FROM src), "
                f"b AS (SELECT *, {_bf('V1', gap)} AS V2 FROM a)")
    elif method == "backward_fill":
        body = (f"a AS (SELECT *, {_bf('V', gap)} AS V1 FROM src), "
                f"b AS (SELECT *, {_ff('V1', gap)} AS V2 FROM a)")
    elif method == "interpolate":
        w = f"PARTITION BY E ORDER BY {EV_ORDER}"
        lim = "" if gap is None else f" AND pos - pp <= {gap}"
        body = (f"p AS (SELECT *, row_number() OVER ({w}) AS pos FROM src), "
                f"q AS (SELECT *, last_value(CASE WHEN V IS NOT NULL THEN pos END IGNORE NULLS) OVER "
                f"({w} ROWS UNBOUNDED PRECEDING) AS pp, last_value(V IGNORE NULLS) OVER ({w} ROWS "
                f"UNBOUNDED PRECEDING) AS pv, first_value(CASE WHEN V IS NOT NULL THEN pos END IGNORE "
                f"NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np, "
                f"first_value(V IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED "
                f"FOLLOWING) AS nv FROM p), "
                f"i AS (SELECT E, T, event_id, CASE WHEN V IS NOT NULL THEN V WHEN pp IS NOT NULL{lim} "
                f"THEN (CASE WHEN np IS NULL THEN pv ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END) "
                f"END AS V0 FROM q), "
                f"a AS (SELECT *, {_bf('V0', gap)} AS V1 FROM i), "
                f"b AS (SELECT *, {_ff('V1', gap)} AS V2 FROM a)")
    else:
        agg = "avg(V)" if method == "mean" else "quantile_cont(V, 0.5)"
        body = (f"s AS (SELECT E, {agg} AS fillv FROM src GROUP BY E), "
                "b AS (SELECT src.*, coalesce(V, fillv) AS V2 FROM src JOIN s USING (E))")
    return f"WITH {EV_HOLES_SQL}, {body} SELECT E, event_id, {r('V2')} AS V FROM b"


for _name, _meth, _gap in [("impute_ffill", "forward_fill", 1), ("impute_bfill", "backward_fill", 1),
                           ("impute_linear", "interpolate", 2), ("impute_mean", "mean", None),
                           ("impute_median", "median", None)]:
    register(_name, _impute_sql(_meth, _gap))(_impute_query(_meth, _gap))


def q_imputed_count(spark, sf):
    """CLN11: nulls before and after a limited forward fill."""
    before = ev_holes(spark, sf)
    after = cl.impute(before, K, EO, ["V"], "forward_fill", 1)
    return cl.imputed_count(before, after, ["V"])


register("imputed_count",
         f"WITH {EV_HOLES_SQL}, a AS (SELECT *, {_ff('V', 1)} AS V1 FROM src), "
         f"b AS (SELECT *, {_bf('V1', 1)} AS V2 FROM a) SELECT CAST(count_if(V IS NULL) AS BIGINT) AS "
         "before, CAST(count_if(V2 IS NULL) AS BIGINT) AS after, CAST(count_if(V IS NULL) - "
         "count_if(V2 IS NULL) AS BIGINT) AS imputed FROM b")(
    q_imputed_count)


# -------------------------------------------------------------- outliers ---

def _outlier_query(method, thr):
    def q(spark, sf):
        ev = events_readings(spark, sf).select("E", "T", "event_id", "V")
        out = cl.remove_outliers(ev, K, ["V"], method, thr)
        return out.select("E", "event_id", rnd("V").alias("V"), "V_outlier")
    return q


def _outlier_sql(method, thr):
    if method == "zscore":
        mask = f"abs((V - mu) / {nz('sd')}) > {thr}"
    else:
        mask = f"(V < q1 - {thr} * (q3 - q1) OR V > q3 + {thr} * (q3 - q1))"
    return (f"WITH {ev_src()}, s AS (SELECT E, avg(V) AS mu, stddev_pop(V) AS sd, "
            "quantile_cont(V, 0.25) AS q1, quantile_cont(V, 0.75) AS q3, quantile_cont(V, 0.5) AS med "
            f"FROM src GROUP BY E), j AS (SELECT src.*, s.* EXCLUDE (E), coalesce({mask}, false) AS o "
            f"FROM src JOIN s USING (E)) SELECT E, event_id, {r('CASE WHEN o THEN med ELSE V END')} "
            "AS V, o AS V_outlier FROM j")


register("outliers_zscore", _outlier_sql("zscore", 2.5))(_outlier_query("zscore", 2.5))
register("outliers_iqr", _outlier_sql("iqr", 1.5))(_outlier_query("iqr", 1.5))


# --------------------------------------------------------------- filters ---

def q_filter_moving_average(spark, sf):
    """CLN14: centred zero-padded moving average, w = 5 and w = 4."""
    ev = events_readings(spark, sf).select("E", "T", "event_id", "V", F.col("V").alias("V4"))
    a = cl.filter_moving_average(ev, K, EO, ["V"], 5)
    b = cl.filter_moving_average(a, K, EO, ["V4"], 4)
    return b.select("E", "event_id", rnd("V").alias("ma5"), rnd("V4").alias("ma4"))


register("filter_moving_average",
         f"WITH {ev_src()} SELECT E, event_id, {r('coalesce(sum(V) OVER w5, 0) / 5.0')} AS ma5, "
         f"{r('coalesce(sum(V) OVER w4, 0) / 4.0')} AS ma4 FROM src WINDOW w5 AS (PARTITION BY E "
         f"ORDER BY {EV_ORDER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), w4 AS (PARTITION BY E "
         f"ORDER BY {EV_ORDER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")(q_filter_moving_average)


def q_filter_median(spark, sf):
    """CLN15: running median of 5 with mirrored edges."""
    ev = events_readings(spark, sf).select("E", "T", "event_id", "V")
    return cl.filter_median(ev, K, EO, ["V"], 5).select("E", "event_id", rnd("V").alias("V"))


register("filter_median",
         f"WITH {ev_src()}, p AS (SELECT E, event_id, V, row_number() OVER (PARTITION BY E ORDER BY "
         f"{EV_ORDER}) - 1 AS pos, count(*) OVER (PARTITION BY E) AS n FROM src), "
         "x AS (SELECT E, event_id, V, pos, true AS orig FROM p UNION ALL SELECT E, NULL, V, -pos - 1, "
         "false FROM p WHERE pos < 2 UNION ALL SELECT E, NULL, V, 2 * n - 1 - pos, false FROM p "
         "WHERE pos >= n - 2), m AS (SELECT E, event_id, orig, quantile_cont(V, 0.5) OVER (PARTITION "
         "BY E ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med FROM x) "
         f"SELECT E, event_id, {r('med')} AS V FROM m WHERE orig")(q_filter_median)


def q_filter_savgol(spark, sf):
    """CLN16: Savitzky-Golay smoothing, length 11, order 3."""
    ev = events_readings(spark, sf).select("E", "T", "event_id", "V")
    return cl.filter_savgol(ev, K, EO, ["V"], 11, 3).select("E", "event_id", rnd("V").alias("V"))


def _savgol_sql(length=11, order=3):
    centre, edge = cl.savgol_weights(length, order)
    h = length // 2
    w = f"OVER (PARTITION BY E ORDER BY {EV_ORDER})"

    def at(off):
        if off == 0:
            return "V"
        return f"lead(V, {off}) {w}" if off > 0 else f"lag(V, {-off}) {w}"

    def combo(weights, offs):
        return " + ".join(f"{at(o)} * {float(c)!r}" for c, o in zip(weights, offs) if c != 0.0)

    few = []  # series shorter than the window: the polynomial through all rows
    for n in range(1, length):
        A = np.vander(np.arange(n, dtype=float), min(order, n - 1) + 1)
        few.append((A @ np.linalg.pinv(A)).tolist())
    few = f"list_sum(list_transform(range(1, n + 1), lambda i: vs[i] * {few!r}[n][pos + 1][i]))"
    cases = [f"WHEN n < {length} THEN {few}", f"WHEN pos >= {h} AND pos < n - {h} THEN {combo(centre, range(-h, h + 1))}"]
    for t in range(h):
        cases.append(f"WHEN pos = {t} THEN {combo(edge[t], [j - t for j in range(length)])}")
    for t in range(h):
        row = length - h + t
        cases.append(f"WHEN pos = n - {h} + {t} THEN "
                     f"{combo(edge[row], [j - row for j in range(length)])}")
    return (f"WITH {ev_src()}, p AS (SELECT *, row_number() {w} - 1 AS pos, count(*) OVER "
            f"(PARTITION BY E) AS n, list(V ORDER BY {EV_ORDER}) OVER (PARTITION BY E) AS vs FROM src) SELECT E, event_id, "
            f"{r('CASE ' + ' '.join(cases) + ' END')} AS V FROM p")


register("filter_savgol", _savgol_sql())(q_filter_savgol)


# ------------------------------------------------------------- resample ---

def _resample_query(how):
    def q(spark, sf):
        ev = events_readings(spark, sf).select("E", "T", "V")
        out = cl.resample(ev, K, "T", ["V"], "1 hour", how)
        return out.select("E", "T", rnd("V").alias("V"))
    return q


def _resample_sql(how):
    agg = {"mean": "avg", "sum": "sum", "max": "max", "min": "min"}[how]
    fill = "coalesce(g.V, 0.0)" if how == "sum" else "g.V"
    return (f"WITH {ev_src()}, g AS (SELECT E, time_bucket(INTERVAL 1 HOUR, T) AS B, {agg}(V) AS V "
            "FROM src GROUP BY 1, 2), s AS (SELECT E, unnest(generate_series(min(B), max(B), "
            "INTERVAL 1 HOUR)) AS B FROM g GROUP BY E) "
            f"SELECT s.E, s.B AS T, {r(fill)} AS V FROM s LEFT JOIN g ON s.E = g.E AND s.B = g.B")


register("resample_mean", _resample_sql("mean"))(_resample_query("mean"))
register("resample_sum", _resample_sql("sum"))(_resample_query("sum"))


def q_clean_pipeline(spark, sf):
    """CLN19: linear impute -> z outliers at 4 -> standard scaling."""
    out = cl.clean_pipeline(ev_holes(spark, sf).select("E", "T", "event_id", "V"), K, EO, ["V"],
                            scaling=True, impute_missing=True, outliers=True)
    return out.select("E", "event_id", rnd("V").alias("V"))


def _pipeline_sql():
    w = f"PARTITION BY E ORDER BY {EV_ORDER}"
    return (f"WITH {EV_HOLES_SQL}, p AS (SELECT *, row_number() OVER ({w}) AS pos FROM src), "
            f"q AS (SELECT *, last_value(CASE WHEN V IS NOT NULL THEN pos END IGNORE NULLS) OVER "
            f"({w} ROWS UNBOUNDED PRECEDING) AS pp, last_value(V IGNORE NULLS) OVER ({w} ROWS "
            f"UNBOUNDED PRECEDING) AS pv, first_value(CASE WHEN V IS NOT NULL THEN pos END IGNORE "
            f"NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np, "
            f"first_value(V IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED "
            f"FOLLOWING) AS nv FROM p), "
            "i AS (SELECT E, T, event_id, CASE WHEN V IS NOT NULL THEN V WHEN pp IS NOT NULL "
            "THEN (CASE WHEN np IS NULL THEN pv ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END) "
            f"END AS V0 FROM q), a AS (SELECT *, {_bf('V0', None)} AS V1 FROM i), "
            f"b AS (SELECT *, {_ff('V1', None)} AS V2 FROM a), "
            "s AS (SELECT E, avg(V2) AS mu, stddev_pop(V2) AS sd, quantile_cont(V2, 0.5) AS med "
            f"FROM b GROUP BY E), o AS (SELECT b.E, event_id, CASE WHEN coalesce(abs((V2 - mu) / "
            f"{nz('sd')}) > 4.0, false) THEN med ELSE V2 END AS V3 FROM b JOIN s USING (E)), "
            "t AS (SELECT E, avg(V3) AS mu, stddev_pop(V3) AS sd FROM o GROUP BY E) "
            f"SELECT o.E, event_id, {r('(V3 - mu) / ' + nz('sd'))} AS V FROM o JOIN t USING (E)")


register("clean_pipeline", _pipeline_sql())(q_clean_pipeline)


# -------------------------------------------------------------- rolling ---

RHOLE = "event_id % 11 = 0"


def q_rolling_features(spark, sf):
    """ROL1-ROL8 on events values with a few holes, window 10."""
    ev = events_readings(spark, sf).select(
        "E", "T", "event_id", F.when(F.expr(RHOLE), F.lit(None)).otherwise(F.col("V")).alias("V"))
    out = rolling_features(ev, K, EO, ["V"], 10)
    return round_doubles(out.drop("T"))


def _rolling_sql():
    L = ema_frame_length(10)
    d = 1.0 - 2.0 / 11.0
    w = f"PARTITION BY E ORDER BY {EV_ORDER}"
    fr = f"({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    full = f"count(V) OVER {fr} = 10"
    ema = (f"list(struct_pack(p := pos, v := V)) OVER ({w} ROWS BETWEEN {L - 1} PRECEDING AND "
           "CURRENT ROW)")
    return (f"WITH src0 AS (SELECT user_id AS E, ts AS T, event_id, CASE WHEN {RHOLE} THEN NULL ELSE "
            f"value END AS V FROM events), src AS (SELECT *, row_number() OVER ({w}) AS pos FROM src0), "
            f"a AS (SELECT *, CASE WHEN {full} THEN avg(V) OVER {fr} END AS rm, CASE WHEN {full} THEN "
            f"stddev_samp(V) OVER {fr} END AS rs, CASE WHEN {full} THEN min(V) OVER {fr} END AS rmin, "
            f"CASE WHEN {full} THEN max(V) OVER {fr} END AS rmax, V - lag(V) OVER ({w}) AS dv, "
            f"last_value(V IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING) AS f, {ema} AS el "
            "FROM src), b AS (SELECT *, lag(f) OVER (" + w + ") AS pf, "
            f"list_sum(list_transform(el, lambda s: CASE WHEN s.v IS NULL THEN 0.0 ELSE "
            f"pow({d!r}, pos - s.p) * s.v END)) AS num, list_sum(list_transform(el, lambda s: CASE "
            f"WHEN s.v IS NULL THEN 0.0 ELSE pow({d!r}, pos - s.p) END)) AS den FROM a) "
            f"SELECT E, event_id, {r('V')} AS V, {r('rm')} AS V_rolling_mean, {r('rs')} AS "
            f"V_rolling_std, {r('rmin')} AS V_rolling_min, {r('rmax')} AS V_rolling_max, {r('dv')} AS "
            f"V_diff, {r('CASE WHEN pf <> 0 THEN f / pf - 1.0 END')} AS V_pct_change, "
            f"{r('CASE WHEN den > 0 THEN num / den END')} AS V_ema, "
            f"{r('(V - rm) / (rs + 1e-10)')} AS V_zscore FROM b")


register("rolling_features", _rolling_sql())(q_rolling_features)


def q_rolling_features_gaps(spark, sf):
    """ROL1-ROL8 over gaps that are longer than any frame: of 900 rows of a machine only 60 have a reading. The machines are
    ten, so that they have many rows, and series are cut every 150."""
    return round_doubles(rolling_features(_gappy(spark, sf), K, EO, ["V"], 10, chunk_rows=150).drop("T"))


def _gappy(spark, sf):
    ev = events_readings(spark, sf).select((F.col("E") % 10).alias("E"), "T", "event_id", "V")
    at = series_index(ev, K, EO, "_at")
    return at.withColumn("V", F.when((F.col("_at") + 1) % 900 < 60, F.col("V"))).drop("_at")


def _gaps_sql():
    """The exponential mean as of the last reading, from the readings at most as many rows back as count."""
    L, d = ema_frame_length(10), 1.0 - 2.0 / 11.0
    w = f"PARTITION BY E ORDER BY {EV_ORDER}"
    fr = f"({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    full = f"count(V) OVER {fr} = 10"
    el = f"list(struct_pack(p := pos, v := V)) OVER ({w} ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW)"
    part = lambda v: (f"list_sum(list_transform(list_filter(el, lambda s: s.v IS NOT NULL), lambda s: pow({d!r}, pos - s.p) * {v}))")
    return (f"WITH src0 AS (SELECT user_id % 10 AS E, ts AS T, event_id, value AS V FROM events), src1 AS (SELECT *, row_number() OVER ({w}) "
            "AS pos FROM src0), src AS (SELECT E, T, event_id, pos, CASE WHEN pos % 900 < 60 THEN V END AS V FROM src1), "
            f"a AS (SELECT *, CASE WHEN {full} THEN avg(V) OVER {fr} END AS rm, CASE WHEN {full} THEN stddev_samp(V) OVER {fr} END AS rs, "
            f"CASE WHEN {full} THEN min(V) OVER {fr} END AS rmin, CASE WHEN {full} THEN max(V) OVER {fr} END AS rmax, V - lag(V) OVER ({w}) "
            f"AS dv, last_value(V IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING) AS f, {el} AS el FROM src), "
            f"b AS (SELECT *, lag(f) OVER ({w}) AS pf, CASE WHEN V IS NOT NULL THEN {part('s.v')} / {part('1.0')} END AS mean FROM a) "
            f"SELECT E, event_id, {r('V')} AS V, {r('rm')} AS V_rolling_mean, {r('rs')} AS V_rolling_std, {r('rmin')} AS V_rolling_min, "
            f"{r('rmax')} AS V_rolling_max, {r('dv')} AS V_diff, {r('CASE WHEN pf <> 0 THEN f / pf - 1.0 END')} AS V_pct_change, "
            f"{r(f'last_value(mean IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING)')} AS V_ema, {r('(V - rm) / (rs + 1e-10)')} AS V_zscore FROM b")


register("rolling_features_gaps", _gaps_sql())(q_rolling_features_gaps)


def q_rolling_features_chunked(spark, sf):
    """ROL1-ROL8 through the skew-safe path: series cut into chunks of 25
    rows with a frame-long halo (tiny chunks so every series is cut many
    times here); same values as rolling_features."""
    ev = events_readings(spark, sf).select(
        "E", "T", "event_id", F.when(F.expr(RHOLE), F.lit(None)).otherwise(F.col("V")).alias("V"))
    out = rolling_features(ev, K, EO, ["V"], 10, chunk_rows=25)
    return round_doubles(out.drop("T"))


register("rolling_features_chunked", _rolling_sql())(q_rolling_features_chunked)


def q_impute_linear_chunked(spark, sf):
    """CLN8 through the skew-safe path (chunks of 7 rows, carries across
    cuts); same values as impute_linear."""
    out = cl.impute(ev_holes(spark, sf), K, EO, ["V"], "interpolate", 2, chunk_rows=7)
    return out.select("E", "event_id", rnd("V").alias("V"))


register("impute_linear_chunked", _impute_sql("interpolate", 2))(q_impute_linear_chunked)
