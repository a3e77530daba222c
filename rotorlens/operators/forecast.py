"""Forecasting many series at once (FCT1-FCT6).

Every model is a grouped aggregate over each series (closed-form fits), one
small row per series, then `explode(sequence(1, h))` to emit the horizon
rows. Nothing is collected: a series is summarised by sums, so a hot series
only costs a bigger partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import series_window
from .baseline import tail_rows
from .series import chunked, on_chunks, resolve_chunk_rows

ROLLING_WINDOW = 24      # fixed value: rows of the rolling forecaster
CONFIDENCE_LEVEL = 0.95
MULTI_HORIZONS = [2, 6, 12, 24, 48]


def _pace(df: DataFrame, key, time_col, chunk_rows="auto") -> DataFrame:
    """FCT2: how the times of a series go on, as `pace`: (months, at_end) if all lie on the first or all on the last day of
    their month, equally many months apart; else `seconds` if equally far apart; else `business` if they are the working days (Monday to
    Friday) in turn; else, and for fewer than three times, an hour."""
    def with_previous(d, k, o):
        return d.withColumn("_prev", F.lag("_t").over(series_window(k, o)))

    s = df.select(*key, F.col(time_col).cast("timestamp_ntz").alias("_t"))
    s = on_chunks(s, key, ["_t"], 1, 0, with_previous, chunk_rows)
    t, prev, there = F.col("_t"), F.col("_prev"), F.col("_prev").isNotNull()
    micros = F.unix_micros(t.cast("timestamp"))
    gap = micros - F.unix_micros(prev.cast("timestamp"))
    month = F.year("_t") * 12 + F.month("_t")
    months = F.when(there, month - (F.year("_prev") * 12 + F.month("_prev")))
    day = F.weekday("_prev")
    working = (day < 5) & (F.datediff("_t", "_prev") == F.when(day == 4, 3).otherwise(1))
    clock = F.pmod(micros, F.lit(86_400_000_000))
    g = s.groupBy(*key).agg(
        F.count("_prev").alias("n"), F.min(gap).alias("lo"), F.max(gap).alias("hi"), F.min(months).alias("m_lo"), F.max(months).alias("m_hi"),
        F.bool_and(F.dayofmonth("_t") == 1).alias("first"), F.bool_and(t.cast("date") == F.last_day("_t")).alias("last"),
        F.bool_and(F.when(there, working)).alias("working"), (F.min(clock) == F.max(clock)).alias("clock"))
    enough = F.col("n") >= 2
    monthly = enough & F.col("clock") & (F.col("m_lo") == F.col("m_hi")) & (F.col("m_lo") > 0) & (F.col("first") | F.col("last"))
    even = enough & (F.col("lo") == F.col("hi")) & (F.col("lo") > 0)
    business = enough & F.col("clock") & F.col("working") & ~even
    return g.select(*key, F.struct(
        F.when(monthly, F.col("m_lo")).otherwise(0).alias("months"), (monthly & F.col("last")).alias("at_end"),
        (business & ~monthly).alias("business"), F.when(even, F.col("lo") / 1e6).otherwise(3600.0).alias("seconds")).alias("pace"))


def _step_seconds(df: DataFrame, key, time_col) -> DataFrame:
    """Seconds between the times of an even series, else an hour, as `step_s`."""
    return _pace(df, key, time_col).select(*key, F.col("pace")["seconds"].alias("step_s"))


def _hourly() -> Column:
    """The pace of a series with a value every hour."""
    return F.struct(F.lit(0).alias("months"), F.lit(False).alias("at_end"), F.lit(False).alias("business"), F.lit(3600.0).alias("seconds"))


def future_times(last: Column, pace: Column, k: Column) -> Column:
    """FCT2: the k-th time behind the last one at the series' pace (see `_pace`)."""
    t = last.cast("timestamp_ntz")
    on_day = F.add_months(t, (pace["months"] * k).cast("int"))
    day = F.when(pace["at_end"], F.last_day(on_day)).otherwise(on_day)
    days = (k + 2 * F.floor((F.weekday(t) + k) / 5)).cast("int")
    day = F.when(pace["months"] > 0, day).otherwise(F.date_add(t, days))
    micros = F.unix_micros(last.cast("timestamp"))
    calendar = F.unix_micros(day.cast("timestamp")) + F.pmod(micros, F.lit(86_400_000_000))
    even = micros + (k * pace["seconds"] * 1e6).cast("long")
    return F.timestamp_micros(F.when((pace["months"] > 0) | pace["business"], calendar).otherwise(even)).cast("timestamp_ntz")


def forecast_rolling(df: DataFrame, key: Sequence[str], time_col: str, value: str,
                     horizon: int, window: int = ROLLING_WINDOW) -> DataFrame:
    """FCT1: mean of the last min(window, n) values plus trend * step, trend =
    (last - first) / window; bounds +- 2 sample std."""
    t = tail_rows(df, key, [time_col], window)
    g = t.groupBy(*key).agg(
        F.count(value).alias("_w"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"),
        F.max_by(value, time_col).alias("_last"), F.min_by(value, time_col).alias("_first"),
        F.max(time_col).alias("_t"))
    g = g.join(_pace(df, key, time_col), on=list(key), how="left")
    trend = (F.col("_last") - F.col("_first")) / F.col("_w")
    g = g.withColumn("_trend", trend)
    out = g.select(*key, "_mean", "_std", "_trend", "_t", "pace",
                   F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    fc = F.col("_mean") + F.col("_trend") * F.col("step")
    return out.select(*key, F.col("step").cast("int").alias("step"),
                      future_times(F.col("_t"), F.col("pace"), F.col("step")).alias(time_col),
                      fc.alias("forecast"), (fc - 2 * F.col("_std")).alias("lower"),
                      (fc + 2 * F.col("_std")).alias("upper"))


def forecast_arima(df: DataFrame, key: Sequence[str], time_col: str, value: str, horizon: int,
                   confidence: float = CONFIDENCE_LEVEL, chunk_rows="auto") -> DataFrame:
    """FCT3, re-aimed: ARIMA(1,1,1) without constant fitted by two-stage
    least squares on the differences d_t = y_t - y_{t-1}:
      1. AR(1): phi0 = sum(d_t d_{t-1}) / sum(d_{t-1}^2), e_t = d_t - phi0 d_{t-1};
      2. d_t on (d_{t-1}, e_{t-1}) by the 2x2 normal equations -> phi, theta;
         eps = stage-2 residuals, sigma^2 = mean(eps^2).
    Forecast: A = phi d_T + theta eps_T, d_{T+k} = phi^(k-1) A, y_{T+k} =
    y_T + A (1 - phi^k)/(1 - phi); variance sigma^2 sum_{j<k} psi*_j^2 with
    psi*_j = 1 + (phi + theta)(1 - phi^j)/(1 - phi). Not maximum likelihood.

    The lags need 3 rows of history, so cut series have a halo of 3 rows; sums and the last
    state use owned rows only."""
    s = df.select(*key, time_col, F.col(value).cast("double").alias("y"))
    cr = resolve_chunk_rows(s, key, chunk_rows)
    if cr:
        s = chunked(s, key, [time_col], 3, 0, cr)
        w = series_window([*key, "_chunk"], ["_g"])
    else:
        s = s.withColumn("_own", F.lit(True))
        w = series_window(key, [time_col])
    s = s.withColumn("d", F.col("y") - F.lag("y").over(w))
    s = s.withColumn("d1", F.lag("d").over(w))
    st1 = s.filter("_own").groupBy(*key).agg(
        (F.sum(F.col("d") * F.col("d1")) / F.sum(F.col("d1") * F.col("d1"))).alias("phi0"))
    # (column names avoid "e": Spark resolves names case-insensitively)
    s = s.join(st1, on=list(key)).withColumn("res0", F.col("d") - F.col("phi0") * F.col("d1"))
    s = s.withColumn("e1", F.lag("res0").over(w))
    ok = (F.col("_own") & F.col("d").isNotNull() & F.col("d1").isNotNull()
          & F.col("e1").isNotNull())

    def ssum(c):
        return F.sum(F.when(ok, c))

    g = s.groupBy(*key).agg(
        ssum(F.col("d1") * F.col("d1")).alias("sxx"), ssum(F.col("d1") * F.col("e1")).alias("sxz"),
        ssum(F.col("e1") * F.col("e1")).alias("szz"), ssum(F.col("d") * F.col("d1")).alias("syx"),
        ssum(F.col("d") * F.col("e1")).alias("syz"))
    det = F.col("sxx") * F.col("szz") - F.col("sxz") * F.col("sxz")
    g = g.select(*key, F.when(det != 0, (F.col("syx") * F.col("szz") - F.col("syz") * F.col("sxz"))
                              / det).alias("phi"),
                 F.when(det != 0, (F.col("syz") * F.col("sxx") - F.col("syx") * F.col("sxz"))
                        / det).alias("theta"))
    s = s.join(g, on=list(key))
    s = s.withColumn("eps", F.when(ok, F.col("d") - F.col("phi") * F.col("d1")
                                   - F.col("theta") * F.col("e1")))
    last = s.filter("_own").groupBy(*key).agg(
        F.avg(F.col("eps") * F.col("eps")).alias("sigma2"),
        F.max_by(F.struct("y", "d", "eps"), time_col).alias("_l"), F.max(time_col).alias("_t"),
        F.max("phi").alias("phi"), F.max("theta").alias("theta"))  # constant per series
    last = last.join(_pace(df, key, time_col), on=list(key), how="left")
    out = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    phi, theta, k = F.col("phi"), F.col("theta"), F.col("step").cast("double")
    A = phi * F.col("_l.d") + theta * F.coalesce(F.col("_l.eps"), F.lit(0.0))
    geo = F.when(phi == 1.0, k).otherwise((1.0 - F.pow(phi, k)) / (1.0 - phi))
    fc = F.col("_l.y") + A * geo
    # psi*_{k-1}, then the running sum of squares over steps (h rows per series)
    km1 = k - 1.0
    psi = F.when(km1 == 0, 1.0).otherwise(
        1.0 + (phi + theta) * F.when(phi == 1.0, km1).otherwise((1.0 - F.pow(phi, km1)) / (1.0 - phi)))
    out = out.withColumn("_psi2", psi * psi).withColumn("_fc", fc)
    cum = F.sum("_psi2").over(Window.partitionBy(*key).orderBy("step")
                              .rowsBetween(Window.unboundedPreceding, 0))
    z = NormalDist().inv_cdf(0.5 + confidence / 2.0)
    half = F.lit(z) * F.sqrt(F.col("sigma2") * cum)
    return out.select(*key, F.col("step").cast("int").alias("step"),
                      future_times(F.col("_t"), F.col("pace"), F.col("step")).alias(time_col),
                      F.col("_fc").alias("forecast"), (F.col("_fc") - half).alias("lower"),
                      (F.col("_fc") + half).alias("upper"))


def forecast_seasonal(df: DataFrame, key: Sequence[str], time_col: str, value: str, horizon: int,
                      confidence: float = CONFIDENCE_LEVEL) -> DataFrame:
    """FCT4, re-aimed: linear trend in hours + mean residual by hour of day,
    interval +- z * residual std (sample); hourly steps after the last time."""
    hrs = (F.unix_micros(F.col(time_col).cast("timestamp")) / 3.6e9)
    s = df.select(*key, time_col, F.col(value).cast("double").alias("y"), hrs.alias("x"))
    g = s.groupBy(*key).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"),
                            F.max(time_col).alias("_t"))
    s = s.join(g.select(*key, "a", "b"), on=list(key))
    s = s.withColumn("r", F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    s = s.withColumn("hod", F.hour(F.col(time_col).cast("timestamp")))
    season = s.groupBy(*key, "hod").agg(F.avg("r").alias("season"))
    s = s.join(season, on=[*key, "hod"])
    sd = s.groupBy(*key).agg(F.stddev_samp(F.col("r") - F.col("season")).alias("rsd"))
    out = g.join(sd, on=list(key)).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    ft = future_times(F.col("_t"), _hourly(), F.col("step"))
    out = out.withColumn(time_col, ft).withColumn("hod", F.hour(F.col(time_col).cast("timestamp")))
    out = out.join(season, on=[*key, "hod"], how="left")
    fx = F.unix_micros(F.col(time_col).cast("timestamp")) / 3.6e9
    fc = F.col("a") + F.col("b") * fx + F.coalesce(F.col("season"), F.lit(0.0))
    z = NormalDist().inv_cdf(0.5 + confidence / 2.0)
    return out.select(*key, F.col("step").cast("int").alias("step"), time_col, fc.alias("forecast"),
                      (fc - z * F.col("rsd")).alias("lower"), (fc + z * F.col("rsd")).alias("upper"))


def forecast_multi(forecasts: DataFrame, key: Sequence[str],
                   horizons: Sequence[int] = MULTI_HORIZONS) -> DataFrame:
    """FCT5: the forecast of the largest horizon serves every horizon: a
    range join with the (fixed, tiny) horizons table on step <= horizon."""
    spark = forecasts.sparkSession
    hz = spark.createDataFrame([(int(h),) for h in horizons], "horizon int")
    return forecasts.join(F.broadcast(hz), F.col("step") <= F.col("horizon"))


def evaluate(actual: DataFrame, forecast: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """FCT6: mae, rmse, mape (%, zero actuals skipped, null if none) and r2
    (0 when the actuals do not vary), joining actuals and forecasts on
    (key, step)."""
    j = actual.select(*key, "step", F.col(value).alias("_a")).join(
        forecast.select(*key, "step", F.col("forecast").alias("_f")), on=[*key, "step"])
    err = F.col("_a") - F.col("_f")
    g = j.groupBy(*key).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(F.col("_a") != 0, F.abs(err / F.col("_a")))) * 100.0).alias("mape"),
        F.sum(err * err).alias("_ssr"), F.avg("_a").alias("_am"))
    tot = j.join(g.select(*key, "_am"), on=list(key)).groupBy(*key).agg(
        F.sum((F.col("_a") - F.col("_am")) * (F.col("_a") - F.col("_am"))).alias("_sst"))
    g = g.join(tot, on=list(key))
    r2 = F.when(F.col("_sst") > 0, 1.0 - F.col("_ssr") / F.col("_sst")).otherwise(0.0)
    return g.select(*key, "mae", "rmse", "mape", r2.alias("r2"))


def split_holdout(df: DataFrame, key: Sequence[str], time_col: str, h: int):
    """Train = all but the last h rows of each series; test = those rows
    with step = 1..h."""
    desc = F.row_number().over(series_window(key, [F.col(time_col).desc()]))
    t = df.withColumn("_rd", desc)
    train = t.filter(F.col("_rd") > h).drop("_rd")
    test = t.filter(F.col("_rd") <= h).withColumn("step", (F.lit(h) + 1 - F.col("_rd")).cast("int"))
    return train, test.drop("_rd")
