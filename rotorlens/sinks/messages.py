"""Outgoing messages (SNK2-SNK4): rows (topic, payload) ready for a Kafka or
file sink. Timestamps are ISO strings, numbers stay JSON numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.messages import topic_of


def _iso(c) -> F.Column:
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def to_sensor_messages(df: DataFrame, metrics: Sequence[str], key: str = "E",
                       time_col: str = "T") -> DataFrame:
    """SNK2: topic equipment/<E>/sensors; payload timestamp, equipment_id and
    the metrics flattened."""
    payload = F.to_json(F.struct(_iso(time_col).alias("timestamp"),
                                 F.col(key).cast("string").alias("equipment_id"),
                                 *[F.col(m) for m in metrics]))
    return df.select(topic_of(F.col(key), "sensors").alias("topic"), payload.alias("payload"))


def to_alert_messages(alerts: DataFrame, key: str = "E", time_col: str = "T") -> DataFrame:
    """SNK3: topic equipment/<E>/alerts; payload type, severity, message."""
    payload = F.to_json(F.struct(_iso(time_col).alias("timestamp"),
                                 F.col(key).cast("string").alias("equipment_id"),
                                 F.col("alert_type").alias("type"), "severity", "message"))
    return alerts.select(topic_of(F.col(key), "alerts").alias("topic"), payload.alias("payload"))


def to_health_messages(df: DataFrame, components: Sequence[str], key: str = "E",
                       time_col: str = "T", score_col: str = "health_score") -> DataFrame:
    """SNK4: topic equipment/<E>/health; payload score and components."""
    comps = F.struct(*[F.col(f"comp_{c}").alias(c) for c in components])
    payload = F.to_json(F.struct(_iso(time_col).alias("timestamp"),
                                 F.col(key).cast("string").alias("equipment_id"),
                                 F.col(score_col).alias("health_score"), comps.alias("components")))
    return df.select(topic_of(F.col(key), "health").alias("topic"), payload.alias("payload"))
