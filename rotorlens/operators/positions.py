"""Positions in a total order without a one-task window.

Rows are range-partitioned and sorted, the sorted table is written, and each row's position is its
row number in its file plus the number of rows in earlier files (one row per file). A key that holds
a large share of the rows lies in many files, so no task gets more than its range.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: rows a range holds at most, as far as the sampled range bounds are even
RANGE_ROWS = 1_000_000


def sorted_table(df: DataFrame, order: Sequence[str | Column], name: str, rows: int | None = None,
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """`df` written in `order`, one file per range, and read back with `_part` (the file's place in
    the order) and `_at` (the row's place in its file, from 0). `rows` is `df`'s row count if known;
    it only sets how many ranges there are."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        ranges = max(ranges, -(-rows // range_rows))
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    # one file per task: their numbers are the ranges'
    df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write \
        .option("maxRecordsPerFile", 0).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select("*", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint").alias("_part"),
                       F.col("_metadata.row_index").alias("_at"))


def file_offsets(table: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """_part, *key, _before: rows of the key in earlier files; one row per file and key that meet."""
    counts = table.groupBy("_part", *key).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_part", *key, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def with_position(table: DataFrame, out: str, key: Sequence[str] = ()) -> DataFrame:
    """Adds `out`: the row's position (from 0) among the rows of its key, for a `sorted_table` whose
    order begins with the key. Null keys are a key."""
    named = {"_part": "_p", **{k: f"_k{i}" for i, k in enumerate(key)}}
    offs = file_offsets(table, key).withColumnsRenamed(named)
    on = F.col("_part") == F.col("_p")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(named[k]))
    return table.join(offs, on).select(*table.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(out))


def with_global_position(table: DataFrame, out: str) -> DataFrame:
    """Adds `out`: the row's position in a whole `sorted_table`. The offsets are one row per file, so this needs
    no shuffle."""
    offs = file_offsets(table).select(F.col("_part").alias("_p"), "_before")
    return table.join(F.broadcast(offs), F.col("_part") == F.col("_p")).select(
        *[c for c in table.columns if c not in ("_part", "_at")], (F.col("_before") + F.col("_at")).alias(out))
