"""Condition monitor over a feature table (MON1-MON11): the analytics of the
reference's playback page, as one batch plan over every machine's whole
series. Rows are samples in file order (`idx` = 0-based position)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, fmt_fixed
from ..model import series_window
from .alerts import greedy_keep
from .baseline import head_rows
from .series import on_chunks, series_index

# Fixed values of the monitor.
Z_THRESHOLD = 2.5
BASELINE_ROWS = 100
HISTORY_ROWS = 300
ALERT_ROWS = 20
NOTIFY_EVERY = 50      # samples between notifications
NOTIFY_START = -100    # index of the notional last notification
RATE_LIMIT_SECONDS = 60
EW_WINDOW = 10
# exact running sums, so that a mean of equal readings is that reading
HEALTH_SUM = "decimal(34,12)"


def upload_stats(df: DataFrame, key: Sequence[str], order: Sequence[str], col: str = "rms",
                 baseline_rows: int = BASELINE_ROWS) -> DataFrame:
    """MON1: mean, std(sample), min, max of the column, and mean/std(sample)
    of its first `baseline_rows` rows, per machine."""
    whole = df.groupBy(*key).agg(
        F.avg(col).alias(f"{col}_mean"), F.stddev_samp(col).alias(f"{col}_std"),
        F.min(col).alias(f"{col}_min"), F.max(col).alias(f"{col}_max"))
    base = head_rows(df, key, order, baseline_rows).groupBy(*key).agg(
        F.avg(col).alias("baseline_mean"), F.stddev_samp(col).alias("baseline_std"))
    return whole.join(base, on=list(key))


def monitor_scores(df: DataFrame, stats: DataFrame, key: Sequence[str], order: Sequence[str],
                   col: str = "rms", threshold: float = Z_THRESHOLD,
                   chunk_rows="auto") -> DataFrame:
    """MON2 + MON3: z against the baseline, anomaly flag, health, failure
    probability and remaining samples, plus the 0-based index."""
    j = df.join(stats.select(*key, "baseline_mean", "baseline_std"), on=list(key), how="left")
    z = F.abs(F.col(col) - F.col("baseline_mean")) / F.greatest(F.col("baseline_std"), F.lit(1e-9))
    j = series_index(j, key, order, "idx", chunk_rows)
    j = j.withColumn("z_score", z)
    h = clamp(100.0 - F.col("z_score") * 12.0, 0.0, 100.0)
    j = (j.withColumn("is_anomaly", F.col("z_score") > threshold)
          .withColumn("health", h)
          .withColumn("failure_probability", clamp((F.col("z_score") - 1.0) * 25.0, 0.0, 100.0)))
    rul = ((F.col("health") - 30.0) / (F.col("z_score") * 0.5 + 0.1) * 10.0).cast("bigint")
    return j.withColumn("remaining_samples",
                        F.when(F.col("health") > 30, rul).otherwise(F.lit(0).cast("bigint")))


def monitor_history(scores: DataFrame, key: Sequence[str], rows: int = HISTORY_ROWS,
                    chunk_rows="auto") -> DataFrame:
    """MON4: anomaly count, average health and max z over the last `rows`
    samples (as the page shows them after each tick). Cut series have a halo of `rows` samples.

    The maximum comes from blocks of `rows` samples: a frame is the end of one block and the beginning of the next, so it
    is the larger of the running maximum from the first block's end and the one from the second block's
    beginning. Counts and means are running sums less those `rows` samples back. No frame is read again per row."""
    def page(d, k, o):
        w = Window.partitionBy(*k).orderBy("idx")
        past = w.rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_blk", F.floor(F.col("idx") / rows).cast("long"))
        blk = Window.partitionBy(*k, "_blk")
        d = d.withColumns({"_up": F.max("z_score").over(blk.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)),
                           "_down": F.max("z_score").over(blk.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)),
                           "_a": F.sum(F.col("is_anomaly").cast("bigint")).over(past),
                           "_h": F.sum(F.nanvl("health", F.lit(None)).cast("decimal(18,12)")).over(past).cast(HEALTH_SUM),
                           "_c": F.count(F.nanvl("health", F.lit(None))).over(past)})

        def less(c):  # the running sum less the one in front of the frame
            return F.col(c) - F.coalesce(F.lag(c, rows).over(w), F.lit(0))

        # a frame that begins where a block begins lies in that block alone
        first = F.when(F.col("idx") % rows != rows - 1, F.lag("_down", rows - 1).over(w))
        return d.withColumns({"window_anomalies": less("_a"),
                              "window_avg_health": F.when(less("_c") > 0, less("_h").cast("double") / less("_c")),
                              "window_max_z": F.greatest("_up", first)}).drop("_blk", "_up", "_down", "_a", "_h", "_c")

    return on_chunks(scores, key, ["idx"], rows, 0, page, chunk_rows)


def monitor_alerts(scores: DataFrame, key: Sequence[str], keep: int = ALERT_ROWS) -> DataFrame:
    """MON5: one alert per anomalous sample, newest `keep` per machine."""
    a = scores.filter("is_anomaly").select(
        *key, "idx", F.concat(F.lit("#"), F.col("idx").cast("string"), F.lit(": Z="),
                              fmt_fixed("z_score", 2), F.lit(", H="), fmt_fixed("health", 0),
                              F.lit("%")).alias("msg"),
        F.when(F.col("health") < 30, "critical").otherwise("warning").alias("sev"))
    w = Window.partitionBy(*key).orderBy(F.col("idx").desc())
    return a.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def monitor_early_warning(scores: DataFrame, key: Sequence[str], threshold: float = Z_THRESHOLD,
                          window: int = EW_WINDOW, chunk_rows="auto") -> DataFrame:
    """MON6: with more than `window` samples seen, trend = (z_t - z_{t-9}) /
    10; a trend above 0.05 gives hours = clamp(int((thr - z)/(trend + .01)),
    2, 48) and confidence = min(95, int(50 + 200 * trend)). Cut series have a halo of window-1 samples."""
    return on_chunks(scores, key, ["idx"], window - 1, 0,
                     lambda d, k, o: _early_warning(d, k, threshold, window), chunk_rows)


def _early_warning(scores: DataFrame, key: Sequence[str], threshold: float, window: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("idx")
    trend = (F.col("z_score") - F.lag("z_score", window - 1).over(w)) / float(window)
    t = scores.withColumn("_trend", F.when(F.col("idx") >= window, trend))
    warn = F.col("_trend") > 0.05
    hours = F.least(F.lit(48), F.greatest(F.lit(2), ((F.lit(threshold) - F.col("z_score")) /
                                                      (F.col("_trend") + 0.01)).cast("int")))
    conf = F.least(F.lit(95), (50.0 + F.col("_trend") * 200.0).cast("int"))
    return (t.withColumn("ew_hours", F.when(warn, hours))
             .withColumn("ew_confidence", F.when(warn, conf).otherwise(F.lit(0)))
             .drop("_trend"))


def notification_select(scores: DataFrame, key: Sequence[str], every: int = NOTIFY_EVERY,
                        start: int = NOTIFY_START) -> DataFrame:
    """MON7: anomalies thinned to one per `every` samples since the last one
    sent (the first may go at index start + every)."""
    anom = scores.filter("is_anomaly")
    return greedy_keep(anom, key, ["idx"], F.col("idx"), every, start=start)


def notification_rate_limit(notes: DataFrame, key: Sequence[str], time_col: str,
                            seconds: int = RATE_LIMIT_SECONDS) -> DataFrame:
    """MON8: at most one notification per `seconds` of event time."""
    return greedy_keep(notes, key, [time_col, "idx"], F.col(time_col), f"{int(seconds)} seconds")


def notification_payload(notes: DataFrame, ts_col: str = "T") -> DataFrame:
    """MON9: subject line, status, recommendation and a JSON document."""
    crit = F.col("health") < 30
    status = F.when(crit, "CRITICAL").otherwise("WARNING")
    rec = F.when(crit, "Immediate maintenance required!").otherwise("Schedule maintenance soon.")
    subject = F.concat(F.lit("ANOMALY DETECTED - Sample #"), F.col("idx").cast("string"),
                       F.lit(" - Health: "), fmt_fixed("health", 0), F.lit("%"))
    payload = F.to_json(F.struct(
        F.date_format(ts_col, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("idx").alias("sample_number"),
        F.struct("rms", "kurtosis", "mean").alias("sensor_readings"),
        F.struct(F.col("z_score"), F.col("health").alias("health_score"),
                 status.alias("status")).alias("analysis")))
    return notes.select("*", subject.alias("subject"), status.alias("status"),
                        rec.alias("recommendation"), payload.alias("payload"))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int,
              key: Sequence[str] = ()) -> DataFrame:
    """MON10: counts per equal-width bin on [lo, hi] (values at hi go to the
    last bin; outside values to bins 0 and bins+1)."""
    b = F.when(F.col(col) == hi, F.lit(bins)).otherwise(
        F.expr(f"width_bucket({col}, {float(lo)!r}, {float(hi)!r}, {int(bins)})"))
    return (df.withColumn("bin", b.cast("bigint")).groupBy(*key, "bin")
              .agg(F.count(F.lit(1)).alias("n")))


def anomaly_timeline(scores: DataFrame, key: Sequence[str]) -> DataFrame:
    """MON11: ordered 0/1 flags."""
    return scores.select(*key, "idx", F.col("is_anomaly").cast("int").alias("flag"))
