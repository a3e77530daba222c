"""Alerts: candidate generation, cooldown, ids, actions, summaries
(ALR1-ALR15; the greedy thinning also serves MON7/MON8).

Candidates are row-local projections unioned by name. The cooldown is the
only sequential step: an alert is kept when at least `gap` has passed since
the last *kept* alert of the same (machine, type, severity). Series that are too long for one
task are cut into chunks, whose effect on the cooldown is composed by doubling (`greedy_keep`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fmt_fixed
from ..session import written
from .series import chunked, resolve_chunk_rows, series_index

# Default thresholds per metric (lower is bad only for the
# health score) and the default cooldown.
DEFAULT_THRESHOLDS = [
    ("health_score", 50.0, 30.0, True),
    ("anomaly_rate", 0.3, 0.5, False),
    ("rms", 0.15, 0.25, False),
    ("kurtosis", 2.0, 4.0, False),
    ("temperature", 70.0, 85.0, False),
]
COOLDOWN_MINUTES = 15
ALERT_COLUMNS = ["E", "T", "ord", "alert_type", "severity", "message", "source_value",
                 "threshold", "metric", "metadata"]


def thresholds_table(spark: SparkSession, rows=None) -> DataFrame:
    """(M, warning, critical, lower_is_bad): small and fixed in size."""
    rows = rows or DEFAULT_THRESHOLDS
    return spark.createDataFrame(
        [(m, float(w) if w is not None else None, float(c) if c is not None else None, bool(lb))
         for m, w, c, lb in rows],
        "M string, warning double, critical double, lower_is_bad boolean")


def update_thresholds(thresholds: DataFrame, updates: DataFrame) -> DataFrame:
    """ALR13: replace the rows of updated metrics (anti join + union)."""
    keep = thresholds.join(updates.select("M"), on="M", how="left_anti")
    return keep.unionByName(updates.select(*thresholds.columns))


def _cand(df, key_cols, order_cols, ord_: int, kind: str, severity: Column, message: Column,
          source: Column, threshold: Column, metric: Column, cond: Column) -> DataFrame:
    return df.filter(cond).select(
        *key_cols, *order_cols, F.lit(ord_).alias("ord"), F.lit(kind).alias("alert_type"),
        severity.alias("severity"), message.alias("message"),
        source.cast("double").alias("source_value"), threshold.cast("double").alias("threshold"),
        metric.cast("string").alias("metric"), _no_metadata())


def check_health(df: DataFrame, key_cols, order_cols, score_col: str = "health_score",
                 warning: float = 50.0, critical: float = 30.0, ord_: int = 0) -> DataFrame:
    """ALR2: < critical -> critical, < warning -> warning."""
    h = F.col(score_col)
    sev = F.when(h < critical, "critical").otherwise("warning")
    msg = F.when(h < critical, F.concat(F.lit("Equipment health critically low: "), fmt_fixed(h, 1),
                                        F.lit("%"))) \
        .otherwise(F.concat(F.lit("Equipment health warning: "), fmt_fixed(h, 1), F.lit("%")))
    thr = F.when(h < critical, F.lit(critical)).otherwise(F.lit(warning))
    return _cand(df, key_cols, order_cols, ord_, "health_score", sev, msg, h, thr,
                 F.lit(None), h < warning)


def check_anomaly(df: DataFrame, key_cols, order_cols, flag_col: str = "is_anomaly",
                  score_col: str | None = "anomaly_score", ord_: int = 1) -> DataFrame:
    """ALR3: only anomalies; critical when the score is below -1."""
    s = F.col(score_col) if score_col else F.lit(None).cast("double")
    sev = F.when(s < -1, "critical").otherwise("warning")
    return _cand(df, key_cols, order_cols, ord_, "anomaly", sev,
                 F.lit("Anomaly detected in sensor readings"), s, F.lit(None), F.lit(None),
                 F.col(flag_col))


def check_thresholds(df: DataFrame, key_cols, order_cols, metrics: Sequence[str],
                     thresholds: DataFrame, ord_base: int = 2) -> DataFrame:
    """ALR1: per metric (in the given order), critical first, else warning.
    Readings are unpivoted and joined with the thresholds table on the exact
    metric name; that table has one row per metric (bounded), so it is
    broadcast."""
    mi = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("M"))
    # Order columns travel in one struct: a metric may also be an order key.
    long = df.select(*key_cols, F.struct(*order_cols).alias("_o"),
                     *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [*key_cols, "_o"], list(metrics), "M", "_v")
    order_cols = [F.col(f"_o.{c}").alias(c) for c in order_cols]
    j = long.join(F.broadcast(thresholds), on="M", how="inner")
    v, w, c, lb = F.col("_v"), F.col("warning"), F.col("critical"), F.col("lower_is_bad")
    is_crit = c.isNotNull() & F.when(lb, v < c).otherwise(v > c)
    is_warn = w.isNotNull() & F.when(lb, v < w).otherwise(v > w)
    sev = F.when(is_crit, "critical").otherwise("warning")
    msg = F.when(is_crit, F.concat(F.col("M"), F.lit(" is at critical level: "), fmt_fixed(v, 2))) \
        .otherwise(F.concat(F.col("M"), F.lit(" is elevated: "), fmt_fixed(v, 2)))
    j = j.withColumn("_ord", mi + (ord_base - 1))
    return j.filter(is_crit | is_warn).select(
        *key_cols, *order_cols, F.col("_ord").alias("ord"), F.lit("threshold").alias("alert_type"),
        sev.alias("severity"), msg.alias("message"), v.alias("source_value"),
        F.when(is_crit, c).otherwise(w).alias("threshold"), F.col("M").alias("metric"), _no_metadata())


def check_prediction(df: DataFrame, key_cols, order_cols, hours_col: str,
                     ord_: int = 90) -> DataFrame:
    """ALR4: predicted failure within 6 h critical, 24 h warning."""
    h = F.col(hours_col)
    sev = F.when(h <= 6, "critical").otherwise("warning")
    msg = F.concat(F.lit("Failure predicted within "), fmt_fixed(h, 1), F.lit(" hours"))
    return _cand(df, key_cols, order_cols, ord_, "prediction", sev, msg, h, F.lit(None),
                 F.lit(None), h <= 24)


def check_early_warning(df: DataFrame, key_cols, order_cols, preds_col: str = "predictions",
                        ord_base: int = 100) -> DataFrame:
    """ALR5: one alert per prediction with confidence >= 0.5 and hours <= 48
    (critical <= 6, warning <= 24, info <= 48). `metadata` is a JSON object of the hours, the confidence, the
    affected metrics and the sample's risk score (if `df` has one)."""
    ex = df.select(*key_cols, *order_cols, _risk(df).alias("_risk"), F.posexplode(preds_col).alias("_i", "_p"))
    p = F.col("_p")
    h, conf = p["predicted_time_hours"], p["confidence"]
    sev = F.when(h <= 6, "critical").when(h <= 24, "warning").otherwise("info")
    head = (F.when(h <= 6, F.lit("EARLY WARNING: Anomaly predicted in "))
             .when(h <= 24, F.lit("Early Warning: Anomaly predicted in "))
             .otherwise(F.lit("Advisory: Potential anomaly in ")))
    mid = F.when(h <= 24, F.lit(" hours")).otherwise(F.lit(" hours"))
    msg = F.concat(head, fmt_fixed(h, 1), mid, F.lit(" (Affected: "), p["metric"],
                   F.lit(", Confidence: "), fmt_fixed(conf * 100.0, 0), F.lit("%)"))
    ok = h.isNotNull() & (conf >= 0.5) & (h <= 48)
    return ex.filter(ok).select(
        *key_cols, *order_cols, (F.col("_i") + ord_base).alias("ord"),
        F.lit("early_warning").alias("alert_type"), sev.alias("severity"), msg.alias("message"),
        h.alias("source_value"), conf.alias("threshold"), p["metric"].alias("metric"),
        _metadata(p, F.col("_risk")).alias("metadata"))


def _no_metadata() -> Column:
    return F.lit(None).cast("string").alias("metadata")


def _risk(df: DataFrame) -> Column:
    return F.col("overall_risk_score") if "overall_risk_score" in df.columns else F.lit(None).cast("double")


def _metadata(p: Column, risk: Column) -> Column:
    """What an early warning says of itself, as JSON."""
    return F.to_json(F.struct(p["predicted_time_hours"].cast("double").alias("predicted_hours"), p["confidence"].alias("confidence"),
                              F.array(p["metric"]).alias("affected_metrics"), risk.cast("double").alias("risk_score")))


def candidate_alerts(parts: Sequence[DataFrame]) -> DataFrame:
    """ALR6: union of candidate sets; `ord` keeps the per-sample order
    (health, anomaly, thresholds in metric order, early warnings)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def greedy_keep(df: DataFrame, key: Sequence[str], order: Sequence[str], pos: Column,
                gap, start=None, chunk_rows="auto") -> DataFrame:
    """Keep a row when `pos - last kept pos >= gap` (the first row is kept
    unless `start` is given, then it needs `pos - start >= gap`).

    `pos` is a timestamp (gap: interval string such as '15 minutes') or a
    number (gap: number) and must not fall along the order; rows without it are never kept. Returns the kept rows only.

    Series that need no cut (operators.series) are folded as their task reads them in order. Others go through
    `_entry_times`: what a chunk does to the time from which a row may be kept is a step function of that time; the
    chunks' functions are composed by doubling, so each chunk learns its entry time in log2(chunks) steps and all chunks
    are folded at once."""
    numeric = not isinstance(gap, str)
    gnum = float(gap) if numeric else float(_interval_micros(gap))
    # positions as plain numbers: doubles, or epoch microseconds
    pnum = pos.cast("double") if numeric else F.unix_micros(pos.cast("timestamp")).cast("double")
    p = df.select(*df.columns, pnum.alias("_pn"), F.to_json(F.struct(*key)).alias("_key")).filter("_pn IS NOT NULL")
    if start is not None:
        # `start` acts as a kept row: nothing closer to it than `gap` can be
        # kept, and such rows never influence later decisions.
        st = F.lit(float(start)) if numeric else F.unix_micros(F.lit(start).cast("timestamp")).cast("double")
        p = p.filter(F.col("_pn") >= st + gnum)
    names = df.columns
    if chunk_rows == "auto":  # what leads to the rows runs once, for the count and the fold
        p = written(p, "greedy")
    cr = resolve_chunk_rows(p, ["_key"], chunk_rows)
    if not cr:
        def fold(batches):
            last_key, ready = None, -np.inf
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = batch["_key"]
                new = np.ones(batch.num_rows, bool)
                new[0] = key[0].as_py() != last_key
                new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
                last_key = key[-1].as_py()
                keep = []
                for n, v in zip(new.tolist(), batch["_pn"].to_numpy().tolist()):
                    if n:
                        ready = -np.inf
                    keep.append(v >= ready)
                    if keep[-1]:
                        ready = v + gnum
                yield batch.select(names).filter(pa.array(keep, pa.bool_()))

        return p.repartition("_key").sortWithinPartitions("_key", *order).mapInArrow(fold, df.schema)

    c = chunked(p, ["_key"], order, 0, 0, min(cr, FOLD_ROWS))
    first = c.groupBy("_key").agg(F.min("_chunk").alias("_c0"))
    c = written(c.join(first, "_key").withColumn("_k", F.col("_chunk") - F.col("_c0")).drop("_own", "_chunk", "_c0"), "cooldown")
    entry = _entry_times(c, gnum)

    def fold_chunk(pdf, entries):
        ready, keep = entries["t"].iloc[0], []
        pdf = pdf.sort_values("_g")
        for v in pdf["_pn"]:
            keep.append(v >= ready)
            if keep[-1]:
                ready = v + gnum
        return pdf.loc[keep, names]

    return c.groupBy("_key", "_k").cogroup(entry.groupBy("_key", "_k")).applyInPandas(fold_chunk, df.schema)


#: rows of a chunk that the cooldown folds; its step function has at most as many steps
FOLD_ROWS = 50_000


def _entry_times(chunks: DataFrame, gap: float) -> DataFrame:
    """_key, _k, t: from which time on a row of the key's k-th chunk may be kept, given the chunks before it.

    A chunk maps that time t to the one behind it: if t lies beyond the chunk's last row it stays; else the first row
    at or after t is kept, and the result is the last row kept from there plus the gap. The map is held as (breaks,
    values): values[i] for breaks[i-1] < t <= breaks[i]. `step` holds the maps of `span` chunks from each
    chunk on; entries of the first `span` chunks give those of the next `span`, then the maps are composed in pairs."""
    def step_of(pdf):
        p = np.sort(pdf["_pn"].to_numpy())
        ready = np.full(len(p), p[-1] + gap)
        if gap > 0:
            nxt = np.searchsorted(p, p + gap)
            for i in range(len(p) - 1, -1, -1):
                ready[i] = ready[nxt[i]] if nxt[i] < len(p) else p[i] + gap
        return pd.DataFrame([(pdf["_key"].iloc[0], pdf["_k"].iloc[0], *_squeezed(p, ready))], columns=STEP_COLUMNS)

    def advance(entries, steps):
        if not len(entries):
            return pd.DataFrame(columns=["_key", "_k", "t"]).astype({"_k": "int64", "t": "float64"})
        s, e = steps.iloc[0], entries.iloc[0]
        return pd.DataFrame([(e["_key"], e["_k"], _apply(s["breaks"], s["values"], np.array([e["t"]]))[0])], columns=["_key", "_k", "t"])

    def compose(first, then):
        if not len(first):
            return pd.DataFrame(columns=STEP_COLUMNS).astype({"_k": "int64"})
        f = first.iloc[0]
        if not len(then):
            return pd.DataFrame([tuple(f[STEP_COLUMNS])], columns=STEP_COLUMNS)
        g = then.iloc[0]
        # beyond the first map's breaks the time stays, so the second map's own breaks hold there
        later = g["breaks"] > (f["breaks"][-1] if len(f["breaks"]) else -np.inf)
        breaks = np.concatenate([f["breaks"], g["breaks"][later]])
        values = np.concatenate([_apply(g["breaks"], g["values"], f["values"]), g["values"][later]])
        return pd.DataFrame([(f["_key"], f["_k"], *_squeezed(breaks, values))], columns=STEP_COLUMNS)

    on = ("_key", "_k")
    step = written(chunks.groupBy(*on).applyInPandas(step_of, STEP), "cooldown-steps")
    count = step.agg(F.max("_k")).first()[0]
    entry = step.filter("_k = 0").select("_key", "_k", F.lit(float("-inf")).alias("t"))
    span = 1
    while count is not None and span <= count:
        there = step.select("_key", (F.col("_k") + span).alias("_k"))
        known = entry.groupBy(*on).cogroup(step.groupBy(*on)).applyInPandas(advance, "_key string, _k bigint, t double") \
            .withColumn("_k", F.col("_k") + span)
        entry = written(entry.unionByName(known.join(step.select(*on), list(on), "left_semi")), "cooldown-entries")
        if 2 * span <= count:
            then = step.withColumn("_k", F.col("_k") - span)
            step = written(step.groupBy(*on).cogroup(then.groupBy(*on)).applyInPandas(compose, STEP), "cooldown-steps")
        span *= 2
    return entry


STEP_COLUMNS = ["_key", "_k", "breaks", "values"]
STEP = "_key string, _k bigint, breaks array<double>, values array<double>"


def _squeezed(breaks: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A step function without breaks between equal values, and one break of equal ones (the first counts)."""
    first = np.concatenate([[True], breaks[1:] != breaks[:-1]]) if len(breaks) else np.zeros(0, bool)
    breaks, values = breaks[first], values[first]
    last = np.concatenate([values[1:] != values[:-1], [True]]) if len(breaks) else np.zeros(0, bool)
    return breaks[last], values[last]


def _apply(breaks: np.ndarray, values: np.ndarray, t: np.ndarray) -> np.ndarray:
    at = np.searchsorted(breaks, t)
    out = np.array(t, float)
    out[at < len(breaks)] = np.asarray(values)[at[at < len(breaks)]]
    return out


def _interval_micros(gap: str) -> int:
    n, unit = gap.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}[unit.lower()]
    return int(n) * mult * 1_000_000


def cooldown(cands: DataFrame, minutes: int = COOLDOWN_MINUTES, time_col: str = "T",
             seq: Sequence[str] = ("ord",), chunk_rows="auto") -> DataFrame:
    """ALR7: per (E, alert_type, severity) keep an alert only when at least
    `minutes` passed since the last kept one; same-time order by `seq`."""
    return greedy_keep(cands, ["E", "alert_type", "severity"], [time_col, *seq],
                       F.col(time_col), f"{int(minutes)} minutes", chunk_rows=chunk_rows)


def assign_ids(alerts: DataFrame, order: Sequence[str] = ("T", "ord"),
               chunk_rows="auto") -> DataFrame:
    """ALR8: `alert_<E>_<n:06d>`, a running number per machine (a global
    counter would need one task)."""
    if chunk_rows == "auto":  # the cooldown runs once, for the count and the numbers
        alerts = written(alerts, "numbered")
    t = series_index(alerts, ["E"], list(order), "_n", chunk_rows)
    return t.withColumn("alert_id", F.format_string(
        "alert_%s_%06d", F.col("E").cast("string"), F.col("_n") + 1)).drop("_n")


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """ALR9: acknowledged / resolved flags from (alert_id, action) rows."""
    flags = actions.groupBy("alert_id").agg(
        F.bool_or(F.col("action") == "acknowledge").alias("acknowledged"),
        F.bool_or(F.col("action") == "resolve").alias("resolved"))
    out = alerts.drop("acknowledged", "resolved").join(flags, on="alert_id", how="left")
    return (out.withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))
               .withColumn("resolved", F.coalesce("resolved", F.lit(False))))


def active_alerts(alerts: DataFrame, actions: DataFrame | None = None, equipment=None,
                  severity: str | None = None) -> DataFrame:
    """ALR10: unresolved alerts (anti join with resolve actions), optional
    filters, newest first."""
    out = alerts
    if actions is not None:
        res = actions.filter(F.col("action") == "resolve").select("alert_id")
        out = out.join(res, on="alert_id", how="left_anti")
    elif "resolved" in alerts.columns:
        out = out.filter(~F.col("resolved"))
    if equipment is not None:
        out = out.filter(F.col("E") == equipment)
    if severity is not None:
        out = out.filter(F.col("severity") == severity)
    return out.orderBy(F.col("T").desc(), F.col("alert_id").desc())


def alert_summary(alerts: DataFrame) -> DataFrame:
    """ALR11: total, active, critical/warning active, acknowledged among active."""
    act = ~F.col("resolved")
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"), F.count_if(act).alias("active_alerts"),
        F.count_if(act & (F.col("severity") == "critical")).alias("critical_active"),
        F.count_if(act & (F.col("severity") == "warning")).alias("warning_active"),
        F.count_if(act & F.col("acknowledged")).alias("acknowledged"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """ALR12."""
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def expired(as_of: Column, days: int = 7) -> Column:
    """True for resolved alerts that are older than `as_of - days`."""
    return F.col("resolved") & (F.col("T") <= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def expire_alerts(alerts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """ALR14: drop resolved alerts older than `as_of - days`."""
    return alerts.filter(~expired(as_of, days))


def recent_alerts(alerts: DataFrame, n: int = 100) -> DataFrame:
    """ALR15: newest n (a top-k: TakeOrderedAndProject)."""
    return alerts.orderBy(F.col("T").desc(), F.col("alert_id").desc()).limit(n)


def candidates_one_pass(df: DataFrame, key_cols, order_cols, metrics: Sequence[str],
                        thresholds: DataFrame, score_col: str = "health_score",
                        flag_col: str = "is_anomaly", anomaly_score: str = "anomaly_score",
                        preds_col: str | None = "predictions", health_warning: float = 50.0,
                        health_critical: float = 30.0) -> DataFrame:
    """ALR1-ALR6 in a single scan of the scored rows: every check becomes a
    nullable struct of one array, exploded once - the same rows, columns and
    per-sample order as the union of the check_* functions, without reading
    the input four times. The thresholds (one row per metric) come as a map in one row."""
    th = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("M", F.struct("warning", "critical", "lower_is_bad")))).alias("_th"))
    columns = df.columns
    df = df.crossJoin(F.broadcast(th))  # one row

    def item(ord_, kind, sev, msg, src, thr, metric, cond, metadata=None):
        return F.when(cond, F.struct(
            ord_.cast("int").alias("ord") if isinstance(ord_, Column) else F.lit(ord_).alias("ord"),
            F.lit(kind).alias("alert_type"), sev.alias("severity"), msg.alias("message"),
            src.cast("double").alias("source_value"), thr.cast("double").alias("threshold"),
            metric.cast("string").alias("metric"), _no_metadata() if metadata is None else metadata.alias("metadata")))

    h = F.col(score_col)
    crit_h = h < health_critical
    items = [item(0, "health_score", F.when(crit_h, "critical").otherwise("warning"),
                  F.when(crit_h, F.concat(F.lit("Equipment health critically low: "),
                                          fmt_fixed(h, 1), F.lit("%")))
                  .otherwise(F.concat(F.lit("Equipment health warning: "), fmt_fixed(h, 1), F.lit("%"))),
                  h, F.when(crit_h, F.lit(health_critical)).otherwise(F.lit(health_warning)),
                  F.lit(None), h < health_warning)]
    s = F.col(anomaly_score) if anomaly_score else F.lit(None).cast("double")
    items.append(item(1, "anomaly", F.when(s < -1, "critical").otherwise("warning"),
                      F.lit("Anomaly detected in sensor readings"), s, F.lit(None), F.lit(None),
                      F.col(flag_col)))
    for i, m in enumerate(metrics):
        r = F.element_at("_th", F.lit(m))  # null for a metric without thresholds
        v = F.col(m).cast("double")
        w, c = r["warning"], r["critical"]

        def bad(x):
            return F.coalesce(F.when(r["lower_is_bad"], v < x).otherwise(v > x), F.lit(False))

        is_c, is_w = bad(c), bad(w)
        items.append(item(2 + i, "threshold", F.when(is_c, "critical").otherwise("warning"),
                          F.when(is_c, F.concat(F.lit(f"{m} is at critical level: "), fmt_fixed(v, 2)))
                          .otherwise(F.concat(F.lit(f"{m} is elevated: "), fmt_fixed(v, 2))), v,
                          F.when(is_c, c).otherwise(w), F.lit(m), is_c | is_w))
    arr = F.array(*items)
    if preds_col and preds_col in columns:
        base = 2 + len(metrics)
        risk = F.col("overall_risk_score") if "overall_risk_score" in columns else F.lit(None).cast("double")

        def ew_item(p, i):
            hrs, conf = p["predicted_time_hours"], p["confidence"]
            sev = F.when(hrs <= 6, "critical").when(hrs <= 24, "warning").otherwise("info")
            head = (F.when(hrs <= 6, F.lit("EARLY WARNING: Anomaly predicted in "))
                     .when(hrs <= 24, F.lit("Early Warning: Anomaly predicted in "))
                     .otherwise(F.lit("Advisory: Potential anomaly in ")))
            msg = F.concat(head, fmt_fixed(hrs, 1), F.lit(" hours (Affected: "), p["metric"],
                           F.lit(", Confidence: "), fmt_fixed(conf * 100.0, 0), F.lit("%)"))
            return item(i + base, "early_warning", sev, msg, hrs, conf, p["metric"],
                        hrs.isNotNull() & (conf >= 0.5) & (hrs <= 48), _metadata(p, risk))

        arr = F.concat(arr, F.transform(preds_col, ew_item))
    return (df.select(*key_cols, *order_cols, F.explode(F.filter(arr, lambda x: x.isNotNull()))
                      .alias("_c"))
              .select(*key_cols, *order_cols, "_c.*"))
