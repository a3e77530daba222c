"""Forecast queries (FCT1-FCT6): daily revenue per order priority (F4) and
hourly event means per event type (F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import E, HOURLY_SQL, ORDERS_SQL, hourly_events, order_series, rnd
from ..operators import forecast as fc
from .registry import register
from .sql import r

K = [E]

STEP_SQL = ("g0 AS (SELECT E, epoch_us(T) - epoch_us(lag(T) OVER (PARTITION BY E ORDER BY T)) AS gap "
            "FROM s), st AS (SELECT E, CASE WHEN min(gap) = max(gap) AND count(gap) >= 2 THEN "
            "min(gap) / 1e6 ELSE 3600.0 END AS step_s FROM g0 GROUP BY E)")


def _ft(last, k, step="step_s"):
    return f"make_timestamp(epoch_us({last}) + CAST(trunc({k} * {step} * 1e6) AS BIGINT))"


def _out(df, scale=6):
    return df.select("E", "step", "T", rnd("forecast", scale).alias("forecast"),
                     rnd("lower", scale).alias("lower"), rnd("upper", scale).alias("upper"))


def q_forecast_rolling(spark, sf):
    """FCT1 + FCT2: 48 steps ahead from the last 24 days of each priority."""
    return _out(fc.forecast_rolling(order_series(spark, sf), K, "T", "V", 48))


def _rolling_sql(h, src=ORDERS_SQL, extra=""):
    return (f"WITH s AS ({src}), {STEP_SQL}, t AS (SELECT * FROM s QUALIFY row_number() OVER "
            "(PARTITION BY E ORDER BY T DESC) <= 24), g AS (SELECT E, count(V) AS w, avg(V) AS m, "
            "stddev_samp(V) AS sd, arg_max(V, T) AS lastv, arg_min(V, T) AS firstv, max(T) AS lt FROM t "
            f"GROUP BY E), f AS (SELECT g.*, st.step_s, k FROM g JOIN st USING (E), range(1, {h + 1}) "
            f"r(k)), fc AS (SELECT E, CAST(k AS INTEGER) AS step, {_ft('lt', 'k')} AS T, m + (lastv - "
            "firstv) / w * k AS forecast, sd FROM f)" + extra)


register("forecast_rolling", _rolling_sql(48) +
         f" SELECT E, step, T, {r('forecast')} AS forecast, {r('forecast - 2 * sd')} AS lower, "
         f"{r('forecast + 2 * sd')} AS upper FROM fc")(q_forecast_rolling)


def q_forecast_rolling_monthly(spark, sf):
    """FCT1 + FCT2 on monthly revenue per priority: the times ahead are the beginnings of the next months."""
    days = order_series(spark, sf)
    m = days.groupBy("E", F.date_trunc("month", "T").cast("timestamp_ntz").alias("T")).agg(F.sum("V").alias("V"))
    return _out(fc.forecast_rolling(m, K, "T", "V", 18, window=12), 3)


register("forecast_rolling_monthly",
         f"WITH d AS ({ORDERS_SQL}), s AS (SELECT E, date_trunc('month', T) AS T, sum(V) AS V FROM d GROUP BY 1, 2), t AS (SELECT * FROM s "
         "QUALIFY row_number() OVER (PARTITION BY E ORDER BY T DESC) <= 12), g AS (SELECT E, count(V) AS w, avg(V) AS m, stddev_samp(V) AS "
         "sd, arg_max(V, T) AS lastv, arg_min(V, T) AS firstv, max(T) AS lt FROM t GROUP BY E), mg AS (SELECT E, datediff('month', lag(T) OVER "
         "(PARTITION BY E ORDER BY T), T) AS gap FROM s), mo AS (SELECT E, CASE WHEN min(gap) = max(gap) THEN min(gap) END AS months FROM mg "
         "GROUP BY E), fc AS (SELECT E, CAST(k AS INTEGER) AS step, CAST(CASE WHEN months IS NULL THEN lt + to_hours(k) ELSE lt + "
         "to_months(CAST(k * months AS INTEGER)) END AS TIMESTAMP) AS T, m + (lastv - firstv) / w * k AS forecast, sd FROM g JOIN mo "
         "USING (E), range(1, 19) r(k)) "
         f"SELECT E, step, T, {r('forecast', 3)} AS forecast, {r('forecast - 2 * sd', 3)} AS lower, {r('forecast + 2 * sd', 3)} AS upper FROM fc"
         )(q_forecast_rolling_monthly)


def q_forecast_arima(spark, sf):
    """FCT3: ARIMA(1,1,1) by two-stage least squares, 12 steps."""
    return _out(fc.forecast_arima(order_series(spark, sf), K, "T", "V", 12), 3)


def _arima_sql(h=12):
    z = 1.959963984540054
    return (
        f"WITH s AS ({ORDERS_SQL}), {STEP_SQL}, "
        "a AS (SELECT E, T, V AS y, V - lag(V) OVER (PARTITION BY E ORDER BY T) AS d FROM s), "
        "b AS (SELECT *, lag(d) OVER (PARTITION BY E ORDER BY T) AS d1 FROM a), "
        "p0 AS (SELECT E, sum(d * d1) / sum(d1 * d1) AS phi0 FROM b GROUP BY E), "
        "c AS (SELECT b.*, d - phi0 * d1 AS res0 FROM b JOIN p0 USING (E)), "
        "c1 AS (SELECT *, lag(res0) OVER (PARTITION BY E ORDER BY T) AS e1, (d IS NOT NULL AND d1 IS NOT "
        "NULL AND lag(res0) OVER (PARTITION BY E ORDER BY T) IS NOT NULL) AS ok FROM c), "
        "ns AS (SELECT E, sum(CASE WHEN ok THEN d1 * d1 END) AS sxx, sum(CASE WHEN ok THEN d1 * e1 END) "
        "AS sxz, sum(CASE WHEN ok THEN e1 * e1 END) AS szz, sum(CASE WHEN ok THEN d * d1 END) AS syx, "
        "sum(CASE WHEN ok THEN d * e1 END) AS syz FROM c1 GROUP BY E), "
        "pt AS (SELECT E, CASE WHEN sxx * szz - sxz * sxz <> 0 THEN (syx * szz - syz * sxz) / (sxx * szz "
        "- sxz * sxz) END AS phi, CASE WHEN sxx * szz - sxz * sxz <> 0 THEN (syz * sxx - syx * sxz) / "
        "(sxx * szz - sxz * sxz) END AS theta FROM ns), "
        "ep AS (SELECT c1.*, phi, theta, CASE WHEN ok THEN d - phi * d1 - theta * e1 END AS eps FROM c1 "
        "JOIN pt USING (E)), "
        "l AS (SELECT E, avg(eps * eps) AS sigma2, arg_max(y, T) AS ly, arg_max(d, T) AS ld, "
        "arg_max(eps, T) AS leps, max(T) AS lt, max(phi) AS phi, max(theta) AS theta FROM ep GROUP BY E), "
        f"f AS (SELECT l.*, st.step_s, k FROM l JOIN st USING (E), range(1, {h + 1}) r(k)), "
        "g AS (SELECT *, ly + (phi * ld + theta * coalesce(leps, 0.0)) * (CASE WHEN phi = 1.0 THEN k "
        "ELSE (1.0 - pow(phi, k)) / (1.0 - phi) END) AS fc, CASE WHEN k = 1 THEN 1.0 ELSE 1.0 + "
        "(phi + theta) * (CASE WHEN phi = 1.0 THEN k - 1 ELSE (1.0 - pow(phi, k - 1)) / (1.0 - phi) END) "
        "END AS psi FROM f), "
        "v AS (SELECT *, sum(psi * psi) OVER (PARTITION BY E ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum "
        f"FROM g) SELECT E, CAST(k AS INTEGER) AS step, {_ft('lt', 'k')} AS T, {r('fc', 3)} AS forecast, "
        f"{r(f'fc - {z!r} * sqrt(sigma2 * cum)', 3)} AS lower, "
        f"{r(f'fc + {z!r} * sqrt(sigma2 * cum)', 3)} AS upper FROM v")


register("forecast_arima", _arima_sql())(q_forecast_arima)


def q_forecast_seasonal(spark, sf):
    """FCT4: trend + hour-of-day profile, 24 hourly steps."""
    return _out(fc.forecast_seasonal(hourly_events(spark, sf), K, "T", "V", 24), 4)


def _seasonal_sql(h=24):
    z = 1.959963984540054
    return (f"WITH hs AS ({HOURLY_SQL}), s AS (SELECT *, epoch_us(T) / 3.6e9 AS x FROM hs), "
            "g AS (SELECT E, regr_slope(V, x) AS b, regr_intercept(V, x) AS a, max(T) AS lt FROM s GROUP "
            "BY E), rr AS (SELECT s.*, V - a - b * x AS res, hour(T) AS hod FROM s JOIN g USING (E)), "
            "se AS (SELECT E, hod, avg(res) AS season FROM rr GROUP BY E, hod), "
            "sd AS (SELECT rr.E, stddev_samp(res - season) AS rsd FROM rr JOIN se USING (E, hod) GROUP BY "
            f"rr.E), f AS (SELECT g.*, sd.rsd, k, {_ft('lt', 'k', '3600.0')} AS FT FROM g JOIN sd USING "
            f"(E), range(1, {h + 1}) t(k)), o AS (SELECT f.*, a + b * epoch_us(FT) / 3.6e9 + "
            "coalesce(se.season, 0.0) AS fc FROM f LEFT JOIN se ON f.E = se.E AND hour(f.FT) = se.hod) "
            f"SELECT E, CAST(k AS INTEGER) AS step, FT AS T, {r('fc', 4)} AS forecast, "
            f"{r(f'fc - {z!r} * rsd', 4)} AS lower, {r(f'fc + {z!r} * rsd', 4)} AS upper FROM o")


register("forecast_seasonal", _seasonal_sql())(q_forecast_seasonal)


def q_forecast_multi(spark, sf):
    """FCT5: forecasts at horizons 2, 6, 12, 24, 48 from one 48-step run."""
    m = fc.forecast_multi(fc.forecast_rolling(order_series(spark, sf), K, "T", "V", 48), K)
    return m.select("E", "horizon", "step", rnd("forecast").alias("forecast"))


register("forecast_multi", _rolling_sql(48) +
         f" SELECT E, CAST(h AS INTEGER) AS horizon, step, {r('forecast')} AS forecast FROM fc, "
         "(VALUES (2), (6), (12), (24), (48)) hz(h) WHERE step <= h")(q_forecast_multi)


def q_forecast_evaluate(spark, sf):
    """FCT6: hold out the last 24 days, forecast them, score the errors."""
    train, test = fc.split_holdout(order_series(spark, sf), K, "T", 24)
    f = fc.forecast_rolling(train, K, "T", "V", 24)
    ev = fc.evaluate(test, f, K, "V")
    return ev.select("E", *[rnd(c).alias(c) for c in ("mae", "rmse", "mape", "r2")])


register("forecast_evaluate",
         f"WITH s0 AS ({ORDERS_SQL}), rk AS (SELECT *, row_number() OVER (PARTITION BY E ORDER BY T DESC) "
         "AS rd FROM s0), s AS (SELECT E, T, V FROM rk WHERE rd > 24), test AS (SELECT E, CAST(25 - rd AS "
         "INTEGER) AS step, V FROM rk WHERE rd <= 24), " +
         _rolling_sql(24, "SELECT * FROM s").split("WITH s AS (SELECT * FROM s), ", 1)[1] +
         ", j AS (SELECT test.E, test.V AS a, fc.forecast AS f FROM test JOIN fc ON test.E = fc.E AND "
         "test.step = fc.step), m AS (SELECT E, avg(abs(a - f)) AS mae, sqrt(avg((a - f) * (a - f))) AS "
         "rmse, avg(CASE WHEN a <> 0 THEN abs((a - f) / a) END) * 100.0 AS mape, sum((a - f) * (a - f)) AS "
         "ssr, avg(a) AS am FROM j GROUP BY E), tt AS (SELECT j.E, sum((a - am) * (a - am)) AS sst FROM j "
         f"JOIN m USING (E) GROUP BY j.E) SELECT E, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('mape')} "
         f"AS mape, {r('CASE WHEN sst > 0 THEN 1.0 - ssr / sst ELSE 0.0 END')} AS r2 FROM m JOIN tt USING (E)")(
    q_forecast_evaluate)


def q_forecast_arima_chunked(spark, sf):
    """FCT3 through the skew-safe path (chunks of 50 days, 3-row halo);
    same values as forecast_arima."""
    return _out(fc.forecast_arima(order_series(spark, sf), K, "T", "V", 12, chunk_rows=50), 3)


register("forecast_arima_chunked", _arima_sql())(q_forecast_arima_chunked)
