"""Source and sink queries (SRC2-SRC11, SNK1-SNK5). Snapshot tables come
from `embeddings` (machine = label, one snapshot every 10 minutes by
vec_id); messages come from `events`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..model import (E, LINEITEM_METRICS as LM, LINEITEM_ORDER as LO,
                     embedding_signals, events_readings, lineitem_features, rnd, round_doubles,
                     table)
from ..functions.scalar import format_snapshot_ts
from ..operators import baseline as bl
from ..session import scratch_path
from ..sinks import files as fs
from ..sinks import messages as sm
from ..sources import messages as msg
from ..sources import snapshot_stream as ss
from ..sources import snapshots as sn
from ..streaming import streams as st
from .registry import register
from .sql import LI_ORDER, LI_METRICS, fit_cte, li_src, r

K = [E]
T0 = "2004-02-12 10:32:39"  # first snapshot time of the stand-in data set


def snapshots(spark, sf):
    s = embedding_signals(spark, sf)
    t = (F.to_timestamp(F.lit(T0)) + F.make_interval(mins=F.col("snapshot") * 10)).cast("timestamp_ntz")
    return s.withColumn("T", t).withColumn("channel", F.lit("bearing1"))


SNAP_SQL = ("s AS (SELECT CAST(label AS BIGINT) AS E, vec_id AS snapshot, TIMESTAMP '2004-02-12 10:32:39' "
            "+ to_minutes(vec_id * 10) AS T, len(embedding) AS n FROM embeddings), "
            "fi AS (SELECT E, T, row_number() OVER (PARTITION BY E ORDER BY T) - 1 AS file_idx, "
            "row_number() OVER (PARTITION BY E ORDER BY T DESC) - 1 AS rev_idx FROM (SELECT DISTINCT E, T "
            "FROM s))")


def q_slice_snapshots(spark, sf):
    """SRC2: snapshots 5 .. 14 of every machine (half-open [5, 15))."""
    return sn.slice_snapshots(snapshots(spark, sf), 5, 15).select("E", "snapshot", "T", "file_idx")


register("slice_snapshots", f"WITH {SNAP_SQL} SELECT s.E, snapshot, s.T, file_idx FROM s JOIN fi ON "
         "s.E = fi.E AND s.T = fi.T WHERE file_idx >= 5 AND file_idx < 15")(q_slice_snapshots)


def written_snapshots(spark, sf, at):
    """The embeddings as snapshot files: 16 lines of 4 channels each."""
    s = embedding_signals(spark, sf)
    t = (F.to_timestamp(F.lit(T0)) + F.make_interval(mins=F.col("snapshot") * 10)).cast("timestamp_ntz")
    line = lambda i: F.array(*[F.get("samples", i + 16 * c) for c in range(4)])
    ss.write_snapshots(s.select(format_snapshot_ts(t).alias("file"), F.transform(F.sequence(F.lit(0), F.lit(15)), line).alias("lines")), at)


def _snapshot_files(rows):
    return rows.select(F.col("T").cast("timestamp_ntz").alias("T"), "file", "channel", F.size("samples").cast("bigint").alias("n"),
                       rnd(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total"))


FILES_SQL = ("WITH s AS (SELECT TIMESTAMP '2004-02-12 10:32:39' + to_minutes(vec_id * 10) AS T, list_transform(embedding, "
             "lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings) SELECT T, strftime(T, '%Y.%m.%d.%H.%M.%S') AS file, 'bearing' || c AS "
             "channel, CAST(16 AS BIGINT) AS n, " + r("list_sum(x[16 * c - 15:16 * c])") + " AS total FROM s, range(1, 5) t(c)")


def q_read_snapshots(spark, sf):
    """SRC1: snapshot files, written from the embeddings and read back."""
    at = scratch_path(spark, f"snapshots-{uuid.uuid4().hex}")
    written_snapshots(spark, sf, at)
    return _snapshot_files(sn.read_snapshots(spark, at))


register("read_snapshots", FILES_SQL)(q_read_snapshots)


def q_stream_snapshots(spark, sf):
    """SRC4: the same files as a stream in the order of their names, a fifth of them per batch, restarted from the checkpoint
    after every batch."""
    at = scratch_path(spark, f"snapshot-stream-{uuid.uuid4().hex}")
    written_snapshots(spark, sf, at + "/in")
    files = max(1, -(-table(spark, sf, "embeddings").count() // 5))
    st.run_in_steps(lambda: ss.stream_snapshots(spark, at + "/in", at + "/_checkpoint", files), at + "/out", at + "/_checkpoint")
    return _snapshot_files(spark.read.parquet(at + "/out"))


register("stream_snapshots", FILES_SQL)(q_stream_snapshots)


def q_snapshot_at(spark, sf):
    """SRC3: the 4th snapshot of every machine, with its sample count."""
    return sn.snapshot_at(snapshots(spark, sf), 3).select(
        "E", "snapshot", F.size("samples").cast("bigint").alias("n_samples"))


register("snapshot_at", f"WITH {SNAP_SQL} SELECT s.E, snapshot, CAST(n AS BIGINT) AS n_samples FROM s "
         "JOIN fi ON s.E = fi.E AND s.T = fi.T WHERE file_idx = 3")(q_snapshot_at)


def q_failure_region(spark, sf):
    """SRC5: the last 20 snapshots of every machine."""
    return sn.failure_region(snapshots(spark, sf), 20).select("E", "snapshot")


register("failure_region", f"WITH {SNAP_SQL} SELECT s.E, snapshot FROM s JOIN fi ON s.E = fi.E AND "
         "s.T = fi.T WHERE rev_idx < 20")(q_failure_region)


def q_dataset_info(spark, sf):
    """SRC6: files, first/last time, duration, interval, channels."""
    d = sn.dataset_info(snapshots(spark, sf))
    return d.select("E", "n_files", "start_time", "end_time", rnd("duration_hours").alias("duration_hours"),
                    "interval", F.array_join("channels", ",").alias("channels"))


register("dataset_info", f"WITH {SNAP_SQL} SELECT E, CAST(count(DISTINCT T) AS BIGINT) AS n_files, "
         "min(T) AS start_time, max(T) AS end_time, round(CASE WHEN count(DISTINCT T) >= 2 THEN "
         "(epoch_us(max(T)) - epoch_us(min(T))) / 3.6e9 ELSE 0.0 END, 6) AS duration_hours, "
         "'10 minutes' AS interval, 'bearing1' AS channels FROM s GROUP BY E")(q_dataset_info)


def q_feature_csv_roundtrip(spark, sf):
    """SNK1 + SRC8: features written as header CSV to the shared scratch
    folder and read back with an explicit schema."""
    f = lineitem_features(spark, sf).select(F.col("E").alias("equipment"),
                                            F.col("T").alias("timestamp"), *LM)
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    fs.write_results_csv(f, path)
    schema = ("equipment bigint, timestamp string, " + ", ".join(f"{m} double" for m in LM))
    return round_doubles(fs.read_feature_csv(spark, path, schema))


register("feature_csv_roundtrip", "SELECT l_suppkey AS equipment, l_shipdate AS timestamp, " +
         ", ".join(f"{r(m)} AS {m}" for m in LM) + " FROM lineitem")(q_feature_csv_roundtrip)


def q_parse_messages(spark, sf):
    """SRC9: sensor messages derived from events, every 13th cut short;
    corrupt payloads are dropped."""
    m = msg.sensor_messages_from_events(table(spark, sf, "events"), malformed_every=13)
    p = msg.parse_messages(m, ["value", "k"])
    return p.select("E", "T", "equipment_id", rnd("value").alias("value"), rnd("k").alias("k"))


register("parse_messages", "SELECT CAST(user_id AS VARCHAR) AS E, ts AS T, CAST(user_id AS VARCHAR) AS "
         "equipment_id, round(value, 6) AS value, round(CAST(json_extract(props, '$.k') AS DOUBLE), 6) AS k "
         "FROM events WHERE event_id % 13 <> 0")(q_parse_messages)


def q_corrupt_messages(spark, sf):
    """SRC9 side output: how many payloads were corrupt."""
    m = msg.sensor_messages_from_events(table(spark, sf, "events"), malformed_every=13)
    p = msg.parse_messages(m, ["value", "k"], keep_corrupt=True)
    return p.agg(F.count_if("corrupt").cast("bigint").alias("corrupt"),
                 F.count_if(~F.col("corrupt")).cast("bigint").alias("valid"))


register("corrupt_messages", "SELECT CAST(count_if(event_id % 13 = 0) AS BIGINT) AS corrupt, "
         "CAST(count_if(event_id % 13 <> 0) AS BIGINT) AS valid FROM events")(q_corrupt_messages)


KIND_SQL = ("CASE event_type WHEN 'error' THEN 'alerts' WHEN 'purchase' THEN 'health' ELSE 'sensors' END")
PATTERNS = ["equipment/+/sensors", "equipment/#", "equipment/1/+", "equipment/+/alerts/#", "+/7/health",
            "equipment"]


def topics(spark, sf):
    ev = table(spark, sf, "events")
    kind = (F.when(F.col("event_type") == "error", "alerts")
             .when(F.col("event_type") == "purchase", "health").otherwise("sensors"))
    return ev.select("event_id", msg.topic_of(F.col("user_id"), "x").alias("_t"), kind.alias("_k")) \
             .select("event_id", F.regexp_replace("_t", "/x$", F.concat(F.lit("/"), F.col("_k")))
                     .alias("topic"))


def q_match_topics(spark, sf):
    """SRC10: message x subscription matches under standard wildcards."""
    subs = msg.subscriptions_table(spark, PATTERNS)
    return msg.match_topics(topics(spark, sf), subs).select("event_id", "topic", "pattern")


def _topics_sql():
    vals = ", ".join(f"('{p}', '{msg.topic_regex(p)}')" for p in PATTERNS)
    return (f"WITH t AS (SELECT event_id, 'equipment/' || user_id || '/' || {KIND_SQL} AS topic FROM "
            f"events), s AS (SELECT * FROM (VALUES {vals}) v(pattern, rx))")


register("match_topics", _topics_sql() + " SELECT event_id, topic, pattern FROM t JOIN s ON "
         "regexp_matches(topic, rx)")(q_match_topics)


def q_filter_messages(spark, sf):
    """SRC11: messages on equipment/+/alerts."""
    return msg.filter_messages(topics(spark, sf), "equipment/+/alerts")


register("filter_messages", _topics_sql() + f" SELECT event_id, topic FROM t WHERE regexp_matches(topic, "
         f"'{msg.topic_regex('equipment/+/alerts')}')")(q_filter_messages)


def q_sensor_messages(spark, sf):
    """SNK2: topic and JSON payload per events reading."""
    ev = events_readings(spark, sf).select("E", "T", "V")
    return sm.to_sensor_messages(ev, ["V"])


register("sensor_messages", "SELECT 'equipment/' || user_id || '/sensors' AS topic, '{\"timestamp\":\"' || "
         "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '\",\"equipment_id\":\"' || user_id || '\",\"V\":' || "
         "CAST(value AS VARCHAR) || '}' AS payload FROM events")(q_sensor_messages)


def q_alert_messages(spark, sf):
    """SNK3: the cooled-down alerts of the events flow as messages."""
    from .q_alerts import kept_alerts
    return sm.to_alert_messages(kept_alerts(spark, sf))


def _alert_msg_sql():
    from .q_alerts import CANDS_SQL, KEPT_SQL, SCORED_SQL
    return (f"WITH RECURSIVE {SCORED_SQL}, {CANDS_SQL}, {KEPT_SQL} SELECT 'equipment/' || E || '/alerts' "
            "AS topic, '{\"timestamp\":\"' || strftime(T, '%Y-%m-%dT%H:%M:%S.%f') || '\",\"equipment_id\":\"' "
            "|| E || '\",\"type\":\"' || alert_type || '\",\"severity\":\"' || severity || '\",\"message\":\"' "
            "|| message || '\"}' AS payload FROM ids")


register("alert_messages", _alert_msg_sql())(q_alert_messages)


def q_saved_params(spark, sf):
    """SNK5: the fitted baseline saved as Parquet with a settings document
    and loaded back."""
    f = lineitem_features(spark, sf)
    p = bl.fit_baseline(f, K, LO, LM, n=100)
    path = scratch_path(spark, f"params-{uuid.uuid4().hex}")
    fs.save_params({"baseline": p}, {"n": 100, "pct": 95.0, "methods": ["zscore", "iqr"]}, path)
    tables, settings = fs.load_params(spark, path, ["baseline"])
    assert settings["n"] == 100
    b = tables["baseline"]
    return round_doubles(b.select("E", "M", F.col("n").cast("bigint"), "mean", "std", "q1", "q3"))


register("saved_params", f"WITH {li_src()}, {fit_cte('src', 'E', LI_ORDER, LI_METRICS, 100)} SELECT E, M, "
         f"n, {r('mean')} AS mean, {r('std')} AS std, {r('q1')} AS q1, {r('q3')} AS q3 FROM fit")(
    q_saved_params)


def q_health_messages(spark, sf):
    """SNK4: health score and components of every events reading as a
    message (scores rounded to 6 decimals in the payload)."""
    from .q_alerts import scored_events
    s = scored_events(spark, sf)
    s = s.withColumn("health_score", rnd("health_score")).withColumn("comp_V", F.col("health_score"))
    return sm.to_health_messages(s, ["V"])


def _health_msg_sql():
    from .q_alerts import SCORED_SQL
    return (f"WITH {SCORED_SQL} SELECT 'equipment/' || E || '/health' AS topic, '{{\"timestamp\":\"' || "
            "strftime(T, '%Y-%m-%dT%H:%M:%S.%f') || '\",\"equipment_id\":\"' || E || '\",\"health_score\":' "
            "|| CAST(round(hs, 6) AS VARCHAR) || ',\"components\":{\"V\":' || CAST(round(hs, 6) AS VARCHAR) "
            "|| '}}' AS payload FROM sc")


register("health_messages", _health_msg_sql())(q_health_messages)


def q_batch_analysis(spark, sf):
    """PIP2: every snapshot of every machine -> all features -> baseline on the first 20 -> per snapshot the votes, health
    and early warning, and the number of alerts it raised (each step has its own SQL)."""
    from ..operators import alerts as al
    from . import pipeline as pl
    s = snapshots(spark, sf)
    t = pl.batch_analysis(s, K, ["T"], al.thresholds_table(spark), n=20, rate=20_000.0, alert_metrics=["rms", "kurtosis"])
    return t.select("E", "T", "is_anomaly", rnd("health_score").alias("health_score"), "status", "has_warning",
                    rnd("overall_risk_score").alias("overall_risk_score"), "n_alerts")


register("batch_analysis")(q_batch_analysis)
