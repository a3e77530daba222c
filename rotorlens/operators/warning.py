"""Early warning and remaining life (EW1-EW12).

The trend model is a least-squares line over the last `history` samples of
each (machine, metric) series. The same column builders serve two plans:

* `early_warning` - as of the end of each series: one grouped aggregate per
  (E, M) over the tail (a partial top-n keeps the shuffle at `history` rows
  per map task and machine), then one small aggregate per machine.
* `warning_rolling` - as of every sample, in wide form: running sums over
  Arrow batches of the series in order minus the same sums `history` rows back, so the
  cost is O(rows), not O(rows x history), and all metrics of one sample are
  combined in the same row without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalar import reading
from ..model import M, V, series_window, to_long
from .baseline import tail_rows
from .positions import sorted_table, with_global_position
from .series import resolve_chunk_rows

# Fixed values of the model.
HORIZONS = [2, 6, 12, 24, 48]          # hours ahead
CONFIDENCE_THRESHOLD = 0.7
MIN_SAMPLES = 20
HISTORY = 500
SEVERITY_WEIGHTS = {"critical": 40.0, "warning": 25.0, "info": 10.0}
# Recommendation texts by severity ({h} = hours, {f} = feature).
RECOMMENDATIONS = {
    "critical": ["URGENT: Schedule immediate inspection within {h} hours",
                 "Prepare backup equipment if available",
                 "Monitor {f} closely for rapid degradation"],
    "warning": ["Schedule maintenance within {h} hours",
                "Investigate root cause of {f} degradation"],
    "info": ["Plan maintenance check within {h} hours", "Add {f} to watch list"],
}


def severity_of(hours: Column) -> Column:
    """EW6: <= 6 h critical, <= 24 h warning, else info."""
    return F.when(hours <= 6, "critical").when(hours <= 24, "warning").otherwise("info")


def recommendations(severity: Column, hours: Column, feature: Column) -> Column:
    """EW7."""
    # hours are whole horizons: the text is the integer part
    h = hours.cast("bigint").cast("string")

    def render(texts):
        items = []
        for t in texts:
            parts = t.split("{")
            cols = [F.lit(parts[0])]
            for p in parts[1:]:
                var, rest = p.split("}", 1)
                cols += [h if var == "h" else feature, F.lit(rest)]
            items.append(F.concat(*cols))
        return F.array(*items)

    return (F.when(severity == "critical", render(RECOMMENDATIONS["critical"]))
             .when(severity == "warning", render(RECOMMENDATIONS["warning"]))
             .otherwise(render(RECOMMENDATIONS["info"])))


def add_prediction(df: DataFrame, out: str, *args, **kw) -> DataFrame:
    """EW5: add column `out` = the first horizon whose projected value
    crosses the warning threshold with enough confidence, as a struct (null
    when none). Arguments as `prediction_spec`."""
    return add_predictions(df, [prediction_spec(out, *args, **kw)])


def prediction_spec(out: str, n: Column, slope: Column, intercept: Column, current: Column,
                    base_mean: Column, base_std: Column, warn: Column, feature: Column,
                    ok: Column | None = None, horizons: Sequence[int] = HORIZONS,
                    confidence_threshold: float = CONFIDENCE_THRESHOLD) -> dict:
    """Direction gate: the value is above its baseline mean and rising, or
    at or below it and not rising. Lower-is-bad compares with -threshold
    (kept as the reference does)."""
    higher = current > base_mean
    gate = (higher & (slope > 0)) | (~higher & (slope <= 0))
    cond = gate & warn.isNotNull()
    if ok is not None:
        cond = cond & ok
    return {"out": out, "n": n, "slope": slope, "intercept": intercept, "current": current, "higher": higher, "warn": warn,
            "strength": F.abs(slope) / (base_std + 0.001), "feature": feature, "cond": cond, "horizons": list(horizons),
            "confidence_threshold": confidence_threshold}


def add_predictions(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Finish several EW5 predictions in a few projections: the line at every horizon, the confidences there, the first
    horizon that hits, then its struct. A column for each horizon, as expressions over arrays aren't compiled."""
    each = [(s, i, f"{i}_{s['out']}") for s in specs for i in range(len(s["horizons"]))]

    def line(s, h):
        spp = F.greatest(F.lit(1.0), s["n"] / 24.0)
        return F.when(s["cond"], s["intercept"] + s["slope"] * (s["n"] + (F.lit(int(h)) * spp).cast("int")))

    def confidence(s, at):
        prox = F.abs(s["current"] - s["warn"]) / (F.abs(F.col(f"_l_{at}") - s["current"]) + 0.001)
        return F.least(F.lit(1.0), s["strength"] * 0.5 + (1.0 / (prox + 1.0)) * 0.5)

    def hit(s, at):
        there = F.col(f"_l_{at}")
        exceed = F.when(s["higher"], there > s["warn"]).otherwise(there < -s["warn"])
        return exceed & (F.col(f"_c_{at}") >= s["confidence_threshold"])

    def at_first(s, value):
        out = F
        for i in range(len(s["horizons"])):
            out = out.when(F.col(f"_f_{s['out']}") == i, value(i))
        return out

    t = df.select("*", *[line(s, s["horizons"][i]).alias(f"_l_{at}") for s, i, at in each])
    t = t.select("*", *[confidence(s, at).alias(f"_c_{at}") for s, _, at in each])
    t = t.select("*", *[F.coalesce(*[F.when(hit(s, f"{i}_{s['out']}"), i) for i in range(len(s["horizons"]))]).alias(f"_f_{s['out']}")
                        for s in specs])
    t = t.select("*", *[c for s in specs for c in (
        at_first(s, lambda i: F.lit(float(s["horizons"][i]))).alias(f"_h_{s['out']}"),
        at_first(s, lambda i: F.col(f"_c_{i}_{s['out']}")).alias(f"_k_{s['out']}"),
        at_first(s, lambda i: F.col(f"_l_{i}_{s['out']}")).alias(f"_v_{s['out']}"))])
    outs = []
    for s in specs:
        h = F.col(f"_h_{s['out']}")
        sev = severity_of(h)
        pred = F.struct(
            s["feature"].alias("metric"), h.alias("predicted_time_hours"),
            F.col(f"_k_{s['out']}").alias("confidence"), sev.alias("severity"),
            s["current"].alias("current_value"), F.col(f"_v_{s['out']}").alias("predicted_value"),
            s["warn"].alias("threshold"),
            recommendations(sev, h, s["feature"]).alias("recommendations"))
        outs.append(F.when(h.isNotNull(), pred).alias(s["out"]))
    t = t.select("*", *outs)
    return t.drop(*[f"_{x}_{s['out']}" for s in specs for x in ("h", "f", "k", "v")], *[f"_{x}_{at}" for _, _, at in each for x in ("l", "c")])


def degradation_rate(n: Column, slope: Column, mean_hist: Column) -> Column:
    """EW4: slope as % of |mean| per sample (raw slope for a zero mean);
    null below 5 samples."""
    return F.when(n >= 5, F.when(mean_hist != 0, slope / F.abs(mean_hist) * 100.0).otherwise(slope))


def remaining_life(n: Column, slope: Column, intercept: Column, current: Column,
                   crit: Column) -> Column:
    """EW8: hours until the line reaches the critical threshold."""
    steps = (crit - intercept) / slope - (n - 1)
    hours = steps / F.greatest(F.lit(1.0), n / 24.0)
    return (F.when(crit.isNull(), F.lit(None)).when(current >= crit, 0.0)
             .when(slope <= 0, F.lit(None)).when(steps <= 0, 0.0)
             .otherwise(F.greatest(F.lit(0.0), hours)))


def risk_score(preds: Column, avg_deg: Column, min_rul: Column) -> Column:
    """EW10: severity-weighted confidences + degradation + life bands,
    capped at 100; 0 with no prediction and no (or zero) degradation."""
    sev = F.aggregate(preds, F.lit(0.0), lambda acc, p: acc + F.when(
        p["severity"] == "critical", SEVERITY_WEIGHTS["critical"] * p["confidence"]).when(
        p["severity"] == "warning", SEVERITY_WEIGHTS["warning"] * p["confidence"]).otherwise(
        SEVERITY_WEIGHTS["info"] * p["confidence"]))
    deg = F.when(avg_deg > 0, F.least(F.lit(20.0), avg_deg * 10.0)).otherwise(0.0)
    life = (F.when(min_rul < 6, 30.0).when(min_rul < 24, 15.0).when(min_rul < 48, 5.0)
             .otherwise(0.0))
    total = sev + deg + F.coalesce(life, F.lit(0.0))
    none = (F.size(preds) == 0) & (F.coalesce(avg_deg, F.lit(0.0)) == 0)
    return F.when(none, 0.0).otherwise(F.least(F.lit(100.0), total))


def _thresholds(params: DataFrame, key: Sequence[str]) -> DataFrame:
    return params.select(*key, M, F.col("mean").alias("_bmean"), F.col("std").alias("_bstd"),
                         F.col("warn").alias("_warn"), F.col("crit").alias("_crit"))


def series_trends(df: DataFrame, key: Sequence[str], order: Sequence[str],
                  metrics: Sequence[str], history: int = HISTORY) -> DataFrame:
    """EW2 + EW3: per (key, metric) over the last `history` samples: n,
    slope, intercept on x = 0..n-1, history mean and current value."""
    t = tail_rows(df, key, order, history).withColumn("_o", F.struct(*order))
    long = to_long(t, [*key, "_o"], metrics)
    x = (F.row_number().over(series_window([*key, M], ["_o"])) - 1).cast("double")
    long = long.withColumn(V, reading(V)).filter(F.col(V).isNotNull()).withColumn("_x", x)
    return long.groupBy(*key, M).agg(
        F.count(V).alias("n"), F.regr_slope(V, "_x").alias("slope"),
        F.regr_intercept(V, "_x").alias("intercept"), F.avg(V).alias("mean_hist"),
        F.max_by(V, "_x").alias("current"))


def early_warning(df: DataFrame, params: DataFrame, key: Sequence[str], order: Sequence[str],
                  metrics: Sequence[str], history: int = HISTORY, min_samples: int = MIN_SAMPLES,
                  horizons: Sequence[int] = HORIZONS,
                  confidence_threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """EW2-EW10 as of the end of each machine's history. One row per machine:
    n_samples, has_warning, earliest_anomaly_hours, degradation_rate,
    remaining_useful_life_hours, overall_risk_score, predictions."""
    tr = series_trends(df, key, order, metrics, history)
    tr = tr.join(_thresholds(params, key), on=[*key, M], how="left")
    n, b, a = F.col("n").cast("double"), F.col("slope"), F.col("intercept")
    ok = F.col("n") >= min_samples
    pos = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col(M))
    tr = add_prediction(tr, "pred", n, b, a, F.col("current"), F.col("_bmean"), F.col("_bstd"),
                        F.col("_warn"), F.col(M), ok, horizons, confidence_threshold)
    per = tr.select(
        *key, M, F.col("n"), pos.alias("_pos"), "pred",
        F.when(ok, degradation_rate(n, b, F.col("mean_hist"))).alias("deg"),
        F.when(ok, remaining_life(n, b, a, F.col("current"), F.col("_crit"))).alias("rul"))
    g = per.groupBy(*key).agg(
        F.max("n").alias("n_samples"),
        F.sort_array(F.collect_list(F.when(F.col("pred").isNotNull(),
                                           F.struct(F.col("_pos"), F.col("pred"))))).alias("_preds"),
        F.avg("deg").alias("degradation_rate"), F.min("rul").alias("remaining_useful_life_hours"))
    # collect_list gathers at most one entry per metric: bounded by len(metrics)
    preds = F.transform("_preds", lambda s: s["pred"])
    enough = F.col("n_samples") >= min_samples
    out = g.select(
        *key, F.col("n_samples").cast("bigint").alias("n_samples"), preds.alias("predictions"),
        F.when(enough, F.col("degradation_rate")).alias("degradation_rate"),
        F.when(enough, F.col("remaining_useful_life_hours")).alias("remaining_useful_life_hours"))
    out = out.withColumn("has_warning", F.size("predictions") > 0)
    out = out.withColumn("earliest_anomaly_hours",
                         F.array_min(F.transform("predictions", lambda p: p["predicted_time_hours"])))
    return out.withColumn("overall_risk_score", F.when(enough, risk_score(
        F.col("predictions"), F.col("degradation_rate"), F.col("remaining_useful_life_hours")))
        .otherwise(0.0))


def history_summary(df: DataFrame, key: Sequence[str], order: Sequence[str], time_col: str,
                    metrics: Sequence[str], history: int = HISTORY) -> DataFrame:
    """EW12: samples held (<= history), oldest and newest time, feature names."""
    t = tail_rows(df, key, order, history)
    return t.groupBy(*key).agg(
        F.count(F.lit(1)).cast("bigint").alias("samples"), F.min(time_col).alias("oldest"),
        F.max(time_col).alias("newest")).withColumn(
        "features", F.array(*[F.lit(m) for m in metrics]))


# ------------------------------------------------------ rolling (EW11) ---

Y_LIMIT = 9.0e9  # scaled readings stop here: ten billion times the baseline's size
BLOCK_ROWS = 20_000  # rows of a cut series that travel together, with one halo; a multiple of the chunk
STATS = ["mean", "std", "warn", "crit"]


def _scale(m: str) -> Column:
    """The power of ten of a metric's baseline (1 if that is 0), so that any unit fits the whole numbers."""
    size = F.greatest(F.abs(F.col(f"{m}__mean")), F.col(f"{m}__std"))
    return F.coalesce(F.when(size > 0, F.pow(F.lit(10.0), F.floor(F.log10(size)).cast("double"))), F.lit(1.0))


def _above(a, b):
    """a > b in Spark's order, in which NaN is the largest value."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _frame_sums(x: np.ndarray, unit: np.ndarray, first: np.ndarray, at: int, history: int):
    """For the rows from `at` on of buffered readings x (metrics, rows; NaN: none), over the frame from row `first` to the row:
    the readings there are (n), sum(y), sum((2 * rank - (n - 1)) * y) and the newest reading. y is the reading in units of
    `unit` with ten decimals, as whole numbers in limbs (highest first), whose sums wrap at 2^64 but whose
    differences over a frame don't: they are exact, and joined to doubles at last."""
    there = ~np.isnan(x)
    y = np.where(there, np.fmin(np.maximum(x / unit, -Y_LIMIT), Y_LIMIT), 0.0)
    high = np.floor(y)
    limbs, base = [high.astype(np.int64), np.rint((y - high) * 1e10).astype(np.int64)], 10 ** 10
    if history > 40_000:  # smaller limbs, as history^2 / 2 of them must fit
        base = 10 ** 5
        limbs = [part for limb in limbs for part in (limb // base, limb % base)]

    def running(v):
        out = np.zeros((v.shape[0], v.shape[1] + 1), np.int64)
        np.cumsum(v, axis=1, out=out[:, 1:])
        return out

    def framed(total):
        return total[:, at + 1:] - total[:, first]

    count = running(there)
    n, before = framed(count), count[:, first]
    sums, ranked = [], []
    for limb in limbs:
        total = framed(running(limb))
        sums.append(total)
        ranked.append(2 * (framed(running(limb * count[:, :-1])) - before * total) - (n - 1) * total)

    def joined(parts):
        for i in range(len(parts) - 1, 0, -1):
            over = parts[i] // base
            parts[i - 1] += over
            parts[i] -= over * base
        value = parts[0].astype(float)
        for part in parts[1:]:
            value = value * base + part
        return value / 1e10 if base == 10 ** 5 else parts[0] + parts[1] / 1e10

    newest = np.maximum.accumulate(np.where(there, np.arange(x.shape[1]), 0), axis=1)[:, at:]
    current = np.where(n > 0, np.take_along_axis(x, newest, axis=1), np.nan)
    return n.astype(float), joined(sums), joined(ranked), current


def _first_hits(n, slope, intercept, current, fit, ok, horizons, least_confidence):
    """EW5 of `prediction_spec` and `add_predictions` over arrays: hours (NaN: none), confidence and projected value."""
    shape = n.shape
    known = ok & (n > 0) & ~fit["mean_null"] & ~fit["warn_null"]
    higher = _above(current, fit["mean"])
    cond = np.flatnonzero(known & (higher == _above(slope, 0.0)))
    n, slope, intercept, current, higher = (v.ravel()[cond] for v in (n, slope, intercept, current, higher))
    warn, std = fit["warn"].ravel()[cond], fit["std"].ravel()[cond]
    strength = np.abs(slope) / (std + 0.001)
    per_hour = np.maximum(1.0, n / 24.0)
    gap = np.abs(current - warn)
    hours, confidence, value = (np.full(shape, np.nan) for _ in range(3))
    open_ = np.ones(len(cond), bool)
    for h in horizons:
        there = intercept + slope * (n + np.trunc(int(h) * per_hour))
        c = strength * 0.5 + (1.0 / (gap / (np.abs(there - current) + 0.001) + 1.0)) * 0.5
        c = np.where(c < 1.0, c, 1.0)  # as least(): what is no number counts as 1
        hit = open_ & np.where(higher, _above(there, warn), _above(-warn, there)) & (c >= least_confidence)
        open_ &= ~hit
        hours.ravel()[cond[hit]], confidence.ravel()[cond[hit]], value.ravel()[cond[hit]] = h, c[hit], there[hit]
    return hours, confidence, value


def _warned(x, unit, first, at: int, fit: dict, history: int, min_samples: int, horizons, least_confidence: float) -> dict:
    """EW2-EW10 of the rows from `at` on (see `_frame_sums`). `fit` holds the machine's mean, std, warn and crit of every row and
    metric, with `<stat>_null`. Arrays by output name; a masked value is null."""
    with np.errstate(all="ignore"):
        n, total, ranked, current = _frame_sums(x, unit, first, at, history)
        u = unit[:, at:]
        slope = np.where(n > 1, ranked * n / 2.0 / ((n * n * (n * n - 1.0)) / 12.0) * u, 0.0)
        total = total * u
        intercept = (total - slope * n * (n - 1) / 2) / n
        mean = total / n
        ok = n >= min_samples
        hours, confidence, value = _first_hits(n, slope, intercept, current, fit, ok, horizons, least_confidence)
        hit = ~np.isnan(hours)

        # EW4 and its mean over the metrics that have one
        rates, rated = np.where(mean != 0, slope / np.abs(mean) * 100.0, slope), ok & (n >= 5)
        sum_rates, n_rates = np.zeros(n.shape[1]), rated.sum(axis=0)
        # EW8, the least of those that are there
        steps = (fit["crit"] - intercept) / slope - (n - 1)
        left = steps / np.maximum(1.0, n / 24.0)
        over = ~_above(fit["crit"], current)
        life = np.where(over | ~_above(steps, 0.0), 0.0, np.where(left > 0, left, np.where(np.isnan(left), left, 0.0)))
        lives = ok & (n > 0) & ~fit["crit_null"] & (over | _above(slope, 0.0))
        least = np.full(n.shape[1], np.inf)
        severity = np.zeros(n.shape[1])
        weight = np.where(hours <= 6, SEVERITY_WEIGHTS["critical"], np.where(hours <= 24, SEVERITY_WEIGHTS["warning"], SEVERITY_WEIGHTS["info"]))
        for i in range(len(n)):
            sum_rates = np.where(rated[i], sum_rates + rates[i], sum_rates)
            least = np.where(lives[i], np.fmin(least, life[i]), least)
            severity = np.where(hit[i], severity + weight[i] * confidence[i], severity)
        any_life = lives.any(axis=0)
        least = np.where((lives & ~np.isnan(life)).any(axis=0), least, np.nan)
        rate = sum_rates / n_rates

        # EW10
        worse = (n_rates > 0) & _above(rate, 0.0)
        by_rate = np.where(worse, np.where(rate * 10.0 < 20.0, rate * 10.0, 20.0), 0.0)
        by_life = np.where(any_life, np.where(least < 6, 30.0, np.where(least < 24, 15.0, np.where(least < 48, 5.0, 0.0))), 0.0)
        risk = severity + by_rate + by_life
        calm = ~hit.any(axis=0) & ((n_rates == 0) | (rate == 0))
        risk = np.where((n.max(axis=0) >= min_samples) & ~calm, np.where(risk < 100.0, risk, 100.0), 0.0)
    out = {"degradation_rate": (rate, n_rates == 0), "remaining_useful_life_hours": (least, ~any_life), "overall_risk_score": (risk, None),
           "earliest_anomaly_hours": (np.fmin.reduce(hours, axis=0), ~hit.any(axis=0))}
    for i in range(len(n)):
        for name, v in (("h", hours), ("k", confidence), ("v", value), ("c", current), ("w", fit["warn"])):
            out[f"_{name}_{i}"] = (v[i], ~hit[i])
    return out


def _doubles(table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Columns as one matrix with a row each, and where they are null."""
    columns = [table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c] for c in names]
    columns = [c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], pa.float64()) for c in columns]
    return (np.stack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in columns]),
            np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns]))


def _fit_of(table, metrics: Sequence[str]) -> dict:
    unit, no_unit = _doubles(table, [f"{m}__unit" for m in metrics])
    fit = {"unit": np.where(no_unit, 1.0, unit)}
    for s in STATS:
        fit[s], fit[f"{s}_null"] = _doubles(table, [f"{m}__{s}" for m in metrics])
    return fit


def _in_arrow(table, columns: Sequence[str], out: dict) -> pa.Table:
    arrays = [pa.array(v, pa.float64(), mask=null) for v, null in out.values()]
    return pa.Table.from_arrays([*(table[c] for c in columns), *arrays], names=[*columns, *out])


def _over_series(df: DataFrame, pw: DataFrame, key, order, metrics, columns, schema, history, model) -> DataFrame:
    """Series by series as their task reads them in order: batches of rows, after the rows that their frames reach back to."""
    rank = F.row_number().over(series_window(key, order)).alias("_rn")
    j = df.join(pw, on=list(key), how="left")
    names = [f"_r{i}" for i in range(len(metrics))]
    j = j.select(*columns, rank, *[reading(m).alias(c) for m, c in zip(metrics, names)],
                 *[f"{m}__{s}" for m in metrics for s in (*STATS, "unit")])

    def run(batches):
        tail_x = tail_u = np.empty((len(metrics), 0))
        held, rows = [], 0

        def flush():
            nonlocal tail_x, tail_u, held, rows
            table, at = pa.Table.from_batches(held), tail_x.shape[1]
            fit = _fit_of(table, metrics)
            x = np.concatenate([tail_x, _doubles(table, names)[0]], axis=1)
            unit = np.concatenate([tail_u, fit["unit"]], axis=1)
            rn = table["_rn"].to_numpy()
            first = at + np.arange(len(rn)) - np.minimum(rn - 1, history - 1)
            out = _warned(x, unit, first, at, fit, history, *model)
            back = max(0, x.shape[1] - (history - 1))
            tail_x, tail_u, held, rows = x[:, back:], unit[:, back:], [], 0
            return _in_arrow(table, columns, out).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= history:  # a long halo isn't gone through again for few rows
                yield from flush()
        if held:
            yield from flush()

    return j.mapInArrow(run, schema)


def _over_chunks(df: DataFrame, pw: DataFrame, key, order, metrics, columns, schema, history, model, chunk_rows: int) -> DataFrame:
    """Chunks of the sorted rows, each with the `history` rows before it. Neighbouring chunks are dealt to one task as a block, so that only a
    block's halo is copied, and what a machine has been fitted goes once to each block that holds rows of it."""
    block = chunk_rows * max(1, BLOCK_ROWS // chunk_rows) if chunk_rows <= BLOCK_ROWS else min(chunk_rows, max(BLOCK_ROWS, history))
    g = with_global_position(sorted_table(df, [*key, *order], "chunks"), "_g")
    spans = g.groupBy(*key).agg(F.min("_g").alias("_first"), F.max("_g").alias("_last"))
    fitted = spans.join(pw, on=list(key), how="left").select(
        "_first", *[f"{m}__{s}" for m in metrics for s in (*STATS, "unit")],
        F.explode(F.sequence(F.floor(F.col("_first") / block), F.floor(F.col("_last") / block))).alias("_block"))
    names = [f"_r{i}" for i in range(len(metrics))]
    rows = g.select(*columns, "_g", *[reading(m).alias(c) for m, c in zip(metrics, names)],
                    F.explode(F.sequence(F.floor(F.col("_g") / block), F.floor((F.col("_g") + history - 1) / block))).alias("_block"))
    chunk = min(chunk_rows, block)

    def run(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        if not fitted.num_rows:  # rows that another block's frames would reach back to, if it had any
            return to_arrow_schema(schema).empty_table()
        rows = rows.take(np.argsort(rows["_g"].to_numpy()))
        firsts = fitted["_first"].to_numpy()
        fitted = fitted.take(np.argsort(firsts))
        firsts, fit = np.sort(firsts), _fit_of(fitted, metrics)
        g = rows["_g"].to_numpy()
        x = _doubles(rows, names)[0]
        at, done = int(np.searchsorted(g, rows["_block"][0].as_py() * block)), []
        own = rows.slice(at)
        for begin in range(at, len(g), chunk):
            lo, hi = max(0, begin - (history - 1)), min(begin + chunk, len(g))
            series = np.maximum(np.searchsorted(firsts, g[lo:hi], "right") - 1, 0)
            mine = series[begin - lo:]
            first = np.maximum(firsts[mine], g[begin:hi] - (history - 1)) - g[lo]
            done.append(_warned(x[:, lo:hi], fit["unit"][:, series], first, begin - lo, {k: v[:, mine] for k, v in fit.items()}, history, *model))
        out = {k: (np.concatenate([d[k][0] for d in done]), None if done[0][k][1] is None else np.concatenate([d[k][1] for d in done]))
               for k in done[0]}
        return _in_arrow(own, columns, out)

    return rows.groupBy("_block").cogroup(fitted.groupBy("_block")).applyInArrow(run, schema)


def warning_rolling(df: DataFrame, params: DataFrame, key: Sequence[str], order: Sequence[str],
                    metrics: Sequence[str], history: int = HISTORY, min_samples: int = MIN_SAMPLES,
                    horizons: Sequence[int] = HORIZONS,
                    confidence_threshold: float = CONFIDENCE_THRESHOLD,
                    chunk_rows="auto") -> DataFrame:
    """EW11: EW2-EW10 as of every sample (the live loop's view), wide form.

    For the n readings in the frame of the last `history` rows (nulls and NaN aren't readings),
    with x = 0..n-1: n*Sxx - Sx^2 = n^2(n^2-1)/12, and the slope numerator n*Sxy - Sx*Sy is n/2 times
    S((2x - (n-1)) * y), formed in whole numbers of the metric's own scale, so a flat frame gives a slope of exactly 0 in any unit.
    Running sums over arrays less the sums before the frame: O(1) per row.

    Cut series carry the previous `history` rows as a halo (operators.series); running sums restart
    at each chunk's halo."""
    if history >= 10 ** 6:
        raise ValueError("history must stay below 10^6 rows")
    pw = params.groupBy(*key).agg(*[F.max(F.when(F.col(M) == m, F.col(s))).alias(f"{m}__{s}")
                                    for m in metrics for s in STATS]).select("*", *[_scale(m).alias(f"{m}__unit") for m in metrics])
    columns = [c for c in df.columns if not (c.startswith("_") or "__" in c)]
    doubles = ["degradation_rate", "remaining_useful_life_hours", "overall_risk_score", "earliest_anomaly_hours",
               *[f"_{x}_{i}" for i in range(len(metrics)) for x in "hkvcw"]]
    schema = T.StructType([*(df.schema[c] for c in columns), *(T.StructField(c, T.DoubleType()) for c in doubles)])
    model = (min_samples, list(horizons), confidence_threshold)
    chunk_rows = resolve_chunk_rows(df, key, chunk_rows)
    if chunk_rows:
        j = _over_chunks(df, pw, key, order, metrics, columns, schema, history, model, chunk_rows)
    else:
        j = _over_series(df, pw, key, order, metrics, columns, schema, history, model)
    preds = []
    for i, m in enumerate(metrics):
        h, feature = F.col(f"_h_{i}"), F.lit(m)
        sev = severity_of(h)
        preds.append(F.when(h.isNotNull(), F.struct(
            feature.alias("metric"), h.alias("predicted_time_hours"), F.col(f"_k_{i}").alias("confidence"), sev.alias("severity"),
            F.col(f"_c_{i}").alias("current_value"), F.col(f"_v_{i}").alias("predicted_value"), F.col(f"_w_{i}").alias("threshold"),
            recommendations(sev, h, feature).alias("recommendations"))))
    plist = F.filter(F.array(*preds), lambda p: p.isNotNull())
    warned = F.col("earliest_anomaly_hours").isNotNull()
    none = F.array().cast(j.select(plist.alias("p")).schema["p"].dataType)
    return j.select(*columns, F.when(warned, plist).otherwise(none).alias("predictions"), "degradation_rate", "remaining_useful_life_hours",
                    warned.alias("has_warning"), "earliest_anomaly_hours", "overall_risk_score")
