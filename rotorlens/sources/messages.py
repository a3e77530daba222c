"""Sensor messages: (topic, JSON payload) rows (SRC9-SRC11, STR1 input).

Topic filters follow the standard wildcard rules: `+` is exactly one level,
`#` (last) is any number of remaining levels including none, so `a/b/#`
matches `a/b` and `a/b/c` but not `a`.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

TOPIC_FORMAT = "equipment/{}/{}"  # fixed value: equipment/<id>/<sensors|alerts|health>


def topic_regex(pattern: str) -> str:
    """Anchored regular expression of a topic filter."""
    parts = pattern.split("/")
    out = []
    for i, p in enumerate(parts):
        if p == "#":
            if i != len(parts) - 1:
                raise ValueError("'#' must be the last level")
            return "^" + "/".join(out) + ("(/.*)?$" if out else ".*$")
        out.append("[^/]*" if p == "+" else re.escape(p))
    return "^" + "/".join(out) + "$"


def filter_messages(messages: DataFrame, topic_filter: str | None = None,
                    topic_col: str = "topic") -> DataFrame:
    """SRC11."""
    if topic_filter is None:
        return messages
    return messages.filter(F.col(topic_col).rlike(topic_regex(topic_filter)))


def subscriptions_table(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    for p in patterns:
        topic_regex(p)  # raises for a misplaced '#'
    return spark.createDataFrame([(p,) for p in patterns], "pattern string")


def match_topics(messages: DataFrame, subscriptions: DataFrame, topic_col: str = "topic") -> DataFrame:
    """SRC10: every (message, subscription) pair whose topic matches, for any number of subscriptions (`pattern`).

    Patterns without wildcards are joined on the topic itself. The others form a trie, whose edges (node, level, next
    node) are a table: every distinct topic starts at the root and follows, level by level, the edges named like
    its level and those named `+`; a `#` edge ends the walk with a match. Each level is one equi-join, so
    there is no pair of a topic and a pattern that doesn't share its beginning. Null topics match nothing."""
    patterns = subscriptions.select("pattern").filter("pattern IS NOT NULL")
    parts = F.split("pattern", "/")
    wild = F.exists(parts, lambda p: p.isin("+", "#"))
    exact = messages.join(patterns.filter(~wild), F.col(topic_col) == F.col("pattern"))
    trie = patterns.filter(wild).select("pattern", parts.alias("p"))
    depth = trie.agg(F.max(F.size("p"))).first()[0]
    if not depth:
        return exact
    # a node is the beginning of a pattern
    edges = trie.select(F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"), "p").select(
        F.array_join(F.slice("p", 1, F.col("i") - 1), "/").alias("node"), (F.col("i") - 1).alias("level"),
        F.get("p", F.col("i") - 1).alias("edge"), F.array_join(F.slice("p", 1, F.col("i")), "/").alias("next")).distinct()
    edges = written(edges, "topic-edges")
    ends = patterns.filter(wild).distinct()
    topics = written(messages.select(F.col(topic_col).alias("_topic")).filter("_topic IS NOT NULL").distinct()
                     .select("_topic", F.split("_topic", "/").alias("_levels"), F.lit("").alias("node")), "topics")
    at, found = topics, []
    for level in range(depth):
        here = edges.filter(F.col("level") == level).drop("level")
        # '#' stands for the levels that are left, none included
        rest = here.filter("edge = '#'").select("node", F.col("next").alias("_pattern"))
        found.append(at.filter(F.size("_levels") >= level).join(rest, "node").select("_topic", "_pattern"))
        names = F.array_distinct(F.array(F.get("_levels", F.lit(level)), F.lit("+")))
        step = at.filter(F.size("_levels") > level).select("_topic", "_levels", "node", F.explode(names).alias("edge"))
        at = written(step.join(here.filter("edge <> '#'"), ["node", "edge"]).select("_topic", "_levels", F.col("next").alias("node"))
                     .distinct(), "topic-walk")
        done = at.filter(F.size("_levels") == level + 1)
        found.append(done.join(ends, F.col("node") == F.col("pattern")).select("_topic", F.col("pattern").alias("_pattern")))
    pairs = reduce(DataFrame.unionByName, found)
    several = patterns.groupBy("pattern").count().withColumnRenamed("pattern", "_pattern")  # a repeated subscription matches again
    pairs = pairs.distinct().join(several, "_pattern").withColumn("_pattern", F.explode(F.array_repeat("_pattern", F.col("count").cast("int"))))
    matched = messages.join(pairs.drop("count"), F.col(topic_col) == F.col("_topic")).drop("_topic") \
        .withColumnRenamed("_pattern", "pattern")
    return exact.unionByName(matched.select(*exact.columns))


def payload_schema(metrics: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField("timestamp", T.StringType()),
                         T.StructField("equipment_id", T.StringType())] +
                        [T.StructField(m, T.DoubleType()) for m in metrics])


def parse_messages(messages: DataFrame, metrics: Sequence[str], topic_col: str = "topic",
                   payload_col: str = "payload", keep_corrupt: bool = False) -> DataFrame:
    """SRC9: JSON payload -> sensor row (E from the topic's second level, T
    from the payload timestamp). Payloads that are not a JSON object are
    dropped, or returned with `corrupt = true` when `keep_corrupt`."""
    schema = payload_schema(metrics)
    parsed = messages.withColumn("_p", F.from_json(payload_col, schema, {"mode": "PERMISSIVE"})) \
        .withColumn("_v", F.try_parse_json(payload_col))
    valid = F.coalesce(F.expr("schema_of_variant(_v) LIKE 'OBJECT%'"), F.lit(False))
    out = parsed.select(
        F.split(F.col(topic_col), "/").getItem(1).alias("E"),
        F.to_timestamp(F.col("_p.timestamp")).cast("timestamp_ntz").alias("T"),
        F.col("_p.equipment_id").alias("equipment_id"),
        *[F.col(f"_p.{m}").alias(m) for m in metrics], (~valid).alias("corrupt"))
    if keep_corrupt:
        return out
    return out.filter(~F.col("corrupt")).drop("corrupt")


def sensor_messages_from_events(events: DataFrame, malformed_every: int | None = None) -> DataFrame:
    """Messages derived from the events table: topic equipment/<user>/sensors,
    payload {timestamp, equipment_id, value, k}. With `malformed_every`, the
    payloads of every n-th event id are cut short (a corrupt message)."""
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    payload = F.to_json(F.struct(ts.alias("timestamp"), F.col("user_id").cast("string")
                                 .alias("equipment_id"), F.col("value").alias("value"),
                                 F.get_json_object("props", "$.k").cast("double").alias("k")))
    if malformed_every:
        payload = F.when(F.col("event_id") % malformed_every == 0,
                         F.substring(payload, 1, 12)).otherwise(payload)
    return events.select("event_id", F.format_string("equipment/%d/sensors", F.col("user_id"))
                         .alias("topic"), payload.alias("payload"))


def topic_of(equipment: Column, kind: str) -> Column:
    return F.concat(F.lit("equipment/"), equipment.cast("string"), F.lit(f"/{kind}"))
