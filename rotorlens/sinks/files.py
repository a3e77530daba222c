"""File sinks and the feature-CSV source (SNK1, SNK5, SRC8).

Model parameters are tables, not pickles: the fitted baseline (and forest,
PCA) tables go to Parquet and a one-row JSON document holds settings.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_results_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: header CSV; nested columns become JSON text first."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    df.select(*out).write.mode(mode).option("header", True).csv(path)


def read_feature_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                     time_col: str = "timestamp") -> DataFrame:
    """SRC8: header CSV with numeric features; `timestamp` parsed when
    present. Pass `schema` on large inputs (no inference pass)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    if time_col in df.columns:
        df = df.withColumn(time_col, F.to_timestamp(F.col(time_col)).cast("timestamp_ntz"))
    return df


def save_params(tables: Mapping[str, DataFrame], settings: Mapping, path: str) -> None:
    """SNK5: each fitted table as Parquet under path/<name>, settings as one
    JSON row under path/settings."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(dict(settings), sort_keys=True),)], "settings string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load_params(spark: SparkSession, path: str, names) -> tuple[dict, dict]:
    """SNK5: the tables written by `save_params` and the settings dict (one
    small row read on the driver)."""
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    row = spark.read.json(f"{path}/settings").first()
    return tables, json.loads(row["settings"]) if row else {}
