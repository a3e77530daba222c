"""Signal features per snapshot array (SIG1-SIG27, SRC7).

Input: `signals(E, T|snapshot, channel, samples array<double>)`, one row per
channel snapshot. Every feature is computed inside the row (no shuffle); only
the multi-channel assembly groups the few channel rows of one snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import (arr_mean, arr_quantile, arr_sum, envelope, fft_magnitude,
                                  positive_freqs)

SAMPLING_RATE = 20000  # fixed value: Hz per channel
N_BANDS = 5

TIME_FEATURES = ["mean", "std", "var", "min", "max", "median", "rms", "peak_to_peak",
                 "crest_factor", "shape_factor", "impulse_factor", "skewness", "kurtosis",
                 "p25", "p75", "iqr", "zero_crossing_rate", "mad", "energy"]
FREQ_FEATURES = ["total_power", "dominant_freq", "dominant_amplitude", "spectral_centroid",
                 "spectral_spread", "spectral_entropy", "spectral_flatness",
                 *[f"band_{i + 1}_power" for i in range(N_BANDS)], "n_spectral_peaks"]
ENVELOPE_FEATURES = ["envelope_mean", "envelope_std", "envelope_max", "envelope_rms",
                     "envelope_dominant_freq", "envelope_total_power"]


def _guard(num: Column, den: Column, default=0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def time_domain(df: DataFrame, samples: str = "samples", prefix: str = "") -> DataFrame:
    """SIG1-SIG12 (population moments, linear percentiles)."""
    a = F.col(samples)
    t = (df.withColumn("_n", F.size(a))
           .withColumn("_mean", arr_mean(a))
           .withColumn("_sq", arr_sum(a, lambda x: x * x))
           .withColumn("_abs", arr_mean(a, F.abs)))
    mu = F.col("_mean")
    mom = F.aggregate(
        a, F.struct(*[F.lit(0.0).alias(k) for k in ("m2", "m3", "m4", "mad")]),
        lambda acc, x: F.struct(
            (acc["m2"] + (x - mu) * (x - mu)).alias("m2"),
            (acc["m3"] + (x - mu) * (x - mu) * (x - mu)).alias("m3"),
            (acc["m4"] + (x - mu) * (x - mu) * (x - mu) * (x - mu)).alias("m4"),
            (acc["mad"] + F.abs(x - mu)).alias("mad")))
    t = t.withColumn("_mom", mom)
    n = F.col("_n")
    m2, m3, m4 = (F.col("_mom")[k] / n for k in ("m2", "m3", "m4"))
    rms = F.sqrt(F.col("_sq") / n)
    mx, mn = F.array_max(a), F.array_min(a)
    sign_changes = F.size(F.filter(
        F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1),
                   lambda p, q: (p < 0) != (q < 0)), lambda b: b))
    feats = {
        "mean": mu, "std": F.sqrt(m2), "var": m2, "min": mn, "max": mx,
        "median": arr_quantile(a, 0.5), "rms": rms, "peak_to_peak": mx - mn,
        "crest_factor": _guard(mx, rms), "shape_factor": _guard(rms, F.col("_abs")),
        "impulse_factor": _guard(mx, F.col("_abs")),
        "skewness": F.when(m2 > 0, m3 / F.pow(m2, 1.5)),
        "kurtosis": F.when(m2 > 0, m4 / (m2 * m2) - 3.0).otherwise(0.0),
        "p25": arr_quantile(a, 0.25), "p75": arr_quantile(a, 0.75),
        "iqr": arr_quantile(a, 0.75) - arr_quantile(a, 0.25),
        "zero_crossing_rate": sign_changes / n, "mad": F.col("_mom")["mad"] / n,
        "energy": F.col("_sq"),
    }
    return t.select(*df.columns, *[v.alias(prefix + k) for k, v in feats.items()])


def band_edges(rate: float = SAMPLING_RATE, n_bands: int = N_BANDS) -> list[float]:
    return [float(x) for x in np.linspace(0, rate / 2, n_bands + 1)]


def frequency_domain(df: DataFrame, samples: str = "samples", rate: float = SAMPLING_RATE,
                     n_bands: int = N_BANDS, prefix: str = "", mag_col: str | None = None
                     ) -> DataFrame:
    """SIG13-SIG21 from the positive-frequency spectrum.

    `mag_col` names a precomputed magnitude array (e.g. from an SQL DFT);
    otherwise the FFT pandas UDF produces it."""
    n = F.size(samples)
    t = df.withColumn("_mag", F.col(mag_col) if mag_col else fft_magnitude(samples))
    t = t.withColumn("_f", positive_freqs(F.col("_mag"), n, rate))
    t = t.withColumn("_P", F.transform("_mag", lambda x: (x / n) * (x / n)))
    t = t.withColumn("_tot", arr_sum(F.col("_P")))
    fp = F.zip_with("_f", "_P", lambda f, p: F.struct(f.alias("f"), p.alias("p")))
    tot = F.col("_tot")
    centroid = F.when(tot > 0, F.aggregate(fp, F.lit(0.0), lambda acc, s: acc + s["f"] * s["p"]) / tot) \
        .otherwise(0.0)
    t = t.withColumn("_c", centroid)
    spread = F.when(tot > 0, F.sqrt(F.aggregate(
        fp, F.lit(0.0), lambda acc, s: acc + (s["f"] - F.col("_c")) * (s["f"] - F.col("_c")) * s["p"])
        / tot)).otherwise(0.0)
    pn = F.transform("_P", lambda p: p / (tot + 1e-10))
    entropy = -F.aggregate(pn, F.lit(0.0), lambda acc, p: acc + p * F.log2(p + 1e-10))
    flat = F.exp(arr_mean(F.col("_P"), lambda p: F.log(p + 1e-10))) / (arr_mean(F.col("_P")) + 1e-10)
    mx = F.array_max("_mag")
    dom_idx = F.array_position("_mag", mx)  # first maximum, 1-based
    edges = band_edges(rate, n_bands)
    def band_step(lo, hi):
        return lambda acc, s: acc + F.when((s["f"] >= lo) & (s["f"] < hi), s["p"]).otherwise(0.0)

    bands = {f"band_{i + 1}_power": F.aggregate(fp, F.lit(0.0), band_step(edges[i], edges[i + 1]))
             for i in range(n_bands)}
    # Peaks: compress runs of equal magnitudes, count interior strict maxima
    # reaching 10 % of the largest magnitude.
    comp = F.filter("_mag", lambda x, i: (i == 0) | (x != F.get(F.col("_mag"), i - 1)))
    t = t.withColumn("_comp", comp)
    cm = F.col("_comp")
    peaks = F.size(F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(cm) - 2, F.lit(1))),
        lambda i: (i <= F.size(cm) - 2) & (F.get(cm, i) > F.get(cm, i - 1)) &
        (F.get(cm, i) > F.get(cm, i + 1)) & (F.get(cm, i) >= mx * 0.1)))
    nonempty = F.size("_mag") > 0
    feats = {
        "total_power": tot,
        "dominant_freq": dom_idx * F.lit(float(rate)) / n,
        "dominant_amplitude": mx / n,
        "spectral_centroid": centroid, "spectral_spread": spread,
        "spectral_entropy": entropy, "spectral_flatness": flat, **bands,
        "n_spectral_peaks": peaks.cast("bigint"),
    }
    return t.select(*df.columns, *[F.when(nonempty, v).alias(prefix + k) for k, v in feats.items()])


def envelope_domain(df: DataFrame, samples: str = "samples", rate: float = SAMPLING_RATE,
                    prefix: str = "") -> DataFrame:
    """SIG22-SIG24: envelope statistics and envelope spectrum (power not
    divided by n)."""
    t = df.withColumn("_env", envelope(samples))
    env = F.col("_env")
    n = F.size(env)
    t = t.withColumn("_emean", arr_mean(env))
    t = t.withColumn("_emag", fft_magnitude("_env"))
    em = F.col("_emag")
    feats = {
        "envelope_mean": F.col("_emean"),
        "envelope_std": F.sqrt(arr_mean(env, lambda x: (x - F.col("_emean")) * (x - F.col("_emean")))),
        "envelope_max": F.array_max(env),
        "envelope_rms": F.sqrt(arr_mean(env, lambda x: x * x)),
        "envelope_dominant_freq": F.when(F.size(em) > 0, F.array_position(em, F.array_max(em))
                                         * F.lit(float(rate)) / n),
        "envelope_total_power": F.when(F.size(em) > 0, arr_sum(em, lambda x: x * x)),
    }
    return t.select(*df.columns, *[v.alias(prefix + k) for k, v in feats.items()])


def all_features(df: DataFrame, samples: str = "samples", rate: float = SAMPLING_RATE,
                 prefix: str = "") -> DataFrame:
    """SIG25: time + frequency + envelope features in one projection chain."""
    out = time_domain(df, samples, prefix)
    out = frequency_domain(out, samples, rate, prefix=prefix)
    return envelope_domain(out, samples, rate, prefix)


def multi_channel(features: DataFrame, key: Sequence[str], channels: Sequence[str],
                  names: Sequence[str], channel_col: str = "channel",
                  cross: bool = True) -> DataFrame:
    """SIG26 + SIG27: one row per snapshot with `<channel>_<feature>`
    columns, plus cross-channel rms std(pop)/max/min when there is more than
    one channel. Groups only the channel rows of each snapshot."""
    aggs = [F.max(F.when(F.col(channel_col) == c, F.col(f))).alias(f"{c}_{f}")
            for c in channels for f in names]
    if cross and "rms" in names:
        many = F.count("rms") > 1
        aggs += [F.when(many, F.stddev_pop("rms")).alias("cross_channel_rms_std"),
                 F.when(many, F.max("rms")).alias("cross_channel_rms_max"),
                 F.when(many, F.min("rms")).alias("cross_channel_rms_min")]
    return features.groupBy(*key).agg(*aggs)


def summarise_snapshots(signals: DataFrame, key: Sequence[str], channels: Sequence[str],
                        samples: str = "samples", channel_col: str = "channel") -> DataFrame:
    """SRC7: per channel rms, peak (max |x|), mean, std(pop), wide
    `<channel>_<stat>`."""
    a = F.col(samples)
    n = F.size(a)
    mu = F.col("mean")
    per = signals.select(*key, channel_col, samples, arr_mean(a).alias("mean")).select(
        *key, channel_col, "mean",
        F.sqrt(arr_sum(a, lambda x: x * x) / n).alias("rms"),
        F.array_max(F.transform(a, F.abs)).alias("peak"),
        F.sqrt(arr_mean(a, lambda x: (x - mu) * (x - mu))).alias("std"))
    aggs = [F.max(F.when(F.col(channel_col) == c, F.col(s))).alias(f"{c}_{s}")
            for c in channels for s in ("rms", "peak", "mean", "std")]
    return per.groupBy(*key).agg(*aggs)
