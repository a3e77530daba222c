"""Signal-feature queries on the `embeddings` table as vibration snapshots
(SIG1-SIG27, SRC7). Oracles use SQL aggregates over unnested samples and a
direct discrete Fourier transform, independent of the FFT used by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import EMBED_SQL, embedding_signals, round_doubles
from ..operators import signals as sg
from .registry import ORACLES, register
from .sql import r

CHANNELS = [f"bearing{i}" for i in range(1, 5)]
CH_LEN = 16
RATE = sg.SAMPLING_RATE


def channel_signals(spark, sf):
    """The 64 samples of each snapshot as 4 channels of 16 samples."""
    s = embedding_signals(spark, sf)
    parts = [F.struct(F.lit(c).alias("channel"), F.slice("samples", i * CH_LEN + 1, CH_LEN)
                      .alias("samples")) for i, c in enumerate(CHANNELS)]
    return s.select("E", "snapshot", F.explode(F.array(*parts)).alias("c")) \
            .select("E", "snapshot", "c.channel", "c.samples")


CHANNEL_SQL = (
    f"s0 AS ({EMBED_SQL}), s AS (SELECT E, snapshot, 'bearing' || CAST(c + 1 AS VARCHAR) AS channel, "
    f"samples[c * {CH_LEN} + 1 : (c + 1) * {CH_LEN}] AS samples FROM s0, range(4) t(c))")


def _time_sql(src: str, key: str) -> str:
    """CTE `tf` with the time-domain features of every row of `src`."""
    return (
        f"u AS (SELECT {key}, unnest(samples) AS x, generate_subscripts(samples, 1) AS i FROM {src}), "
        f"v AS (SELECT *, avg(x) OVER (PARTITION BY {key}) AS mu, lead(x) OVER (PARTITION BY {key} "
        "ORDER BY i) AS nx FROM u), "
        f"g AS (SELECT {key}, count(*) AS n, avg(x) AS mean, avg(pow(x - mu, 2)) AS m2, "
        "avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4, min(x) AS mn, max(x) AS mx, "
        "quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, "
        "sqrt(avg(x * x)) AS rms, avg(abs(x)) AS mabs, avg(abs(x - mu)) AS mad, sum(x * x) AS energy, "
        "count_if(nx IS NOT NULL AND (x < 0) <> (nx < 0)) AS zc "
        f"FROM v GROUP BY {key}), "
        f"tf AS (SELECT {key}, mean, sqrt(m2) AS std, m2 AS var, mn AS min, mx AS max, median, rms, "
        "mx - mn AS peak_to_peak, CASE WHEN rms > 0 THEN mx / rms ELSE 0.0 END AS crest_factor, "
        "CASE WHEN mabs > 0 THEN rms / mabs ELSE 0.0 END AS shape_factor, CASE WHEN mabs > 0 THEN "
        "mx / mabs ELSE 0.0 END AS impulse_factor, CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) END AS "
        "skewness, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3.0 ELSE 0.0 END AS kurtosis, p25, p75, "
        "p75 - p25 AS iqr, zc / n AS zero_crossing_rate, mad, energy FROM g)")


def q_time_features(spark, sf):
    """SIG1-SIG12 per snapshot."""
    s = embedding_signals(spark, sf)
    return round_doubles(sg.time_domain(s).drop("samples"))


register("time_features",
         f"WITH s AS ({EMBED_SQL}), {_time_sql('s', 'E, snapshot')} SELECT E, snapshot, " +
         ", ".join(f"{r(c)} AS {c}" for c in sg.TIME_FEATURES) + " FROM tf")(q_time_features)


def _freq_sql(n_bands=sg.N_BANDS):
    edges = sg.band_edges(RATE, n_bands)
    bands = ", ".join(
        f"{r(f'coalesce(sum(CASE WHEN f >= {edges[i]!r} AND f < {edges[i + 1]!r} THEN p END), 0.0)')}"
        f" AS band_{i + 1}_power" for i in range(n_bands))
    return (
        f"WITH s AS ({EMBED_SQL}), "
        "u AS (SELECT E, snapshot, len(samples) AS n, unnest(samples) AS x, "
        "generate_subscripts(samples, 1) - 1 AS j FROM s), "
        "k AS (SELECT snapshot, unnest(range(1, (len(samples) - 1) // 2 + 1)) AS k FROM s), "
        "d AS (SELECT u.E, u.snapshot, u.n, k.k, sqrt(pow(sum(x * cos(2 * pi() * j * k.k / n)), 2) + "
        "pow(sum(x * sin(2 * pi() * j * k.k / n)), 2)) AS mag FROM u JOIN k USING (snapshot) "
        "GROUP BY u.E, u.snapshot, u.n, k.k), "
        f"e AS (SELECT *, k * {float(RATE)!r} / n AS f, pow(mag / n, 2) AS p, "
        "max(mag) OVER (PARTITION BY snapshot) AS mx, sum(pow(mag / n, 2)) OVER (PARTITION BY snapshot) "
        "AS tot, lag(mag) OVER (PARTITION BY snapshot ORDER BY k) AS pm, lead(mag) OVER (PARTITION BY "
        "snapshot ORDER BY k) AS nm FROM d), "
        "c AS (SELECT *, sum(f * p) OVER (PARTITION BY snapshot) / tot AS cen FROM e) "
        f"SELECT E, snapshot, {r('any_value(tot)')} AS total_power, "
        f"{r(f'arg_max(k, mag) * {float(RATE)!r} / any_value(n)')} AS dominant_freq, "
        f"{r('max(mag) / any_value(n)')} AS dominant_amplitude, "
        f"{r('CASE WHEN any_value(tot) > 0 THEN any_value(cen) ELSE 0.0 END')} AS spectral_centroid, "
        f"{r('CASE WHEN any_value(tot) > 0 THEN sqrt(sum(pow(f - cen, 2) * p) / any_value(tot)) ELSE 0.0 END')}"
        " AS spectral_spread, "
        f"{r('-sum(p / (tot + 1e-10) * log2(p / (tot + 1e-10) + 1e-10))')} AS spectral_entropy, "
        f"{r('exp(avg(ln(p + 1e-10))) / (avg(p) + 1e-10)')} AS spectral_flatness, {bands}, "
        "CAST(count_if(pm IS NOT NULL AND nm IS NOT NULL AND mag > pm AND mag > nm AND mag >= mx * 0.1) "
        "AS BIGINT) AS n_spectral_peaks FROM c GROUP BY E, snapshot")


def q_frequency_features(spark, sf):
    """SIG13-SIG21: spectrum by the FFT pandas UDF, statistics in SQL arrays."""
    s = embedding_signals(spark, sf)
    return round_doubles(sg.frequency_domain(s, rate=RATE).drop("samples"))


register("frequency_features", _freq_sql())(q_frequency_features)


def q_envelope_features(spark, sf):
    """SIG22-SIG24."""
    s = embedding_signals(spark, sf)
    return round_doubles(sg.envelope_domain(s, rate=RATE).drop("samples"))


def _envelope_sql():
    """The imaginary part of the analytic signal of an even number of samples by its kernel in time, 2/n * cot(pi * m / n) at
    odd distances m; then the spectrum of the envelope by its definition."""
    return (f"WITH s AS ({EMBED_SQL}), u AS (SELECT E, snapshot, len(samples) AS n, unnest(samples) AS x, generate_subscripts(samples, 1) - 1 "
            "AS j FROM s), v AS (SELECT a.E, a.snapshot, a.n, a.j, sqrt(pow(any_value(a.x), 2) + pow(sum(CASE WHEN abs(a.j - b.j) % 2 = 1 THEN "
            "b.x * 2 / a.n / tan(pi() * (a.j - b.j) / a.n) ELSE 0.0 END), 2)) AS x FROM u a JOIN u b ON a.snapshot = b.snapshot GROUP BY ALL), "
            "k AS (SELECT snapshot, unnest(range(1, (len(samples) - 1) // 2 + 1)) AS k FROM s), "
            "d AS (SELECT v.E, v.snapshot, v.n, k.k, sqrt(pow(sum(x * cos(2 * pi() * j * k.k / n)), 2) + pow(sum(x * sin(2 * pi() * j * k.k "
            "/ n)), 2)) AS mag FROM v JOIN k USING (snapshot) GROUP BY v.E, v.snapshot, v.n, k.k), "
            "m AS (SELECT E, snapshot, avg(x) AS mean, stddev_pop(x) AS std, max(x) AS max, sqrt(avg(x * x)) AS rms FROM v GROUP BY ALL), "
            f"p AS (SELECT E, snapshot, arg_max(k, mag) * {float(RATE)!r} / any_value(n) AS f, sum(mag * mag) AS tot FROM d GROUP BY ALL) "
            f"SELECT E, snapshot, {r('mean')} AS envelope_mean, {r('std')} AS envelope_std, {r('max')} AS envelope_max, {r('rms')} AS "
            f"envelope_rms, {r('f')} AS envelope_dominant_freq, {r('tot')} AS envelope_total_power FROM m JOIN p USING (E, snapshot)")


register("envelope_features", _envelope_sql())(q_envelope_features)


def q_all_features(spark, sf):
    """SIG25: every feature of every snapshot."""
    s = embedding_signals(spark, sf)
    return round_doubles(sg.all_features(s, rate=RATE).drop("samples"))


register("all_features", f"SELECT * FROM ({ORACLES['time_features']}) JOIN ({ORACLES['frequency_features']}) USING (E, snapshot) JOIN "
         f"({ORACLES['envelope_features']}) USING (E, snapshot)")(q_all_features)


MC_FEATS = ["rms", "kurtosis", "peak_to_peak", "mean", "std"]


def q_multi_channel(spark, sf):
    """SIG26 + SIG27: channel features side by side plus cross-channel rms."""
    ch = channel_signals(spark, sf)
    tf = sg.time_domain(ch)
    return round_doubles(sg.multi_channel(tf, ["E", "snapshot"], CHANNELS, MC_FEATS))


register("multi_channel",
         f"WITH {CHANNEL_SQL}, {_time_sql('s', 'E, snapshot, channel')} SELECT E, snapshot, " +
         ", ".join(f"{r(f'max(CASE WHEN channel = {chr(39)}{c}{chr(39)} THEN {f} END)')} AS {c}_{f}"
                   for c in CHANNELS for f in MC_FEATS) +
         f", {r('stddev_pop(rms)')} AS cross_channel_rms_std, {r('max(rms)')} AS cross_channel_rms_max, "
         f"{r('min(rms)')} AS cross_channel_rms_min FROM tf GROUP BY E, snapshot")(q_multi_channel)


def q_summarise_snapshots(spark, sf):
    """SRC7: rms, peak, mean, std(pop) per channel, wide."""
    ch = channel_signals(spark, sf)
    return round_doubles(sg.summarise_snapshots(ch, ["E", "snapshot"], CHANNELS))


register("summarise_snapshots",
         f"WITH {CHANNEL_SQL}, u AS (SELECT E, snapshot, channel, unnest(samples) AS x FROM s), "
         "g AS (SELECT E, snapshot, channel, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, avg(x) AS mean, "
         "stddev_pop(x) AS std FROM u GROUP BY ALL) SELECT E, snapshot, " +
         ", ".join(f"{r(f'max(CASE WHEN channel = {chr(39)}{c}{chr(39)} THEN {st} END)')} AS {c}_{st}"
                   for c in CHANNELS for st in ("rms", "peak", "mean", "std")) +
         " FROM g GROUP BY E, snapshot")(q_summarise_snapshots)
