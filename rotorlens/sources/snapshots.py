"""Vibration snapshot files (SRC1-SRC6).

A snapshot is one tab-separated text file per instant, named
`YYYY.MM.DD.HH.MM.SS`, one column per channel. Files are read in parallel
as whole texts (so the sample order inside a file survives), one row per
(file, channel) with the samples as `array<double>`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import parse_snapshot_ts

CHANNELS = ["bearing1", "bearing2", "bearing3", "bearing4"]  # fixed value
SNAPSHOT_INTERVAL_MINUTES = 10                                  # nominal spacing


def read_snapshots(spark: SparkSession, path: str, equipment: str | None = None,
                   channels: Sequence[str] = CHANNELS) -> DataFrame:
    """SRC1: files directly in `path` whose name parses as a snapshot time
    (others skipped). Output: E, T, file, channel, samples."""
    raw = (spark.read.option("recursiveFileLookup", False)
           .text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file")))
    raw = raw.withColumn("T", parse_snapshot_ts("file")).filter(F.col("T").isNotNull())
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda s: F.trim(s) != "")
    rows = F.transform(lines, lambda s: F.split(F.trim(s), "\t"))

    def column(i):
        return lambda r: F.get(r, i).cast("double")

    per_channel = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.transform(rows, column(i)).alias("samples"))
        for i, c in enumerate(channels)])
    e = F.lit(equipment) if equipment is not None else F.regexp_extract(F.lit(path), r"([^/]+)/?$", 1)
    out = raw.select(e.alias("E"), "T", "file", F.explode(per_channel).alias("c"))
    return out.select("E", "T", "file", "c.channel", "c.samples").filter(
        F.exists("samples", lambda x: x.isNotNull()))


def file_index(signals: DataFrame, key: Sequence[str] = ("E",), time_col: str = "T",
               descending: bool = False) -> DataFrame:
    """Position of every distinct snapshot time within its machine (0-based).
    Works on the distinct times only (one row per file), not on samples."""
    times = signals.select(*key, time_col).distinct()
    o = F.col(time_col).desc() if descending else F.col(time_col)
    w = Window.partitionBy(*key).orderBy(o)
    return times.withColumn("file_idx", (F.row_number().over(w) - 1).cast("bigint"))


def slice_snapshots(signals: DataFrame, start: int = 0, end: int | None = None,
                    key: Sequence[str] = ("E",), time_col: str = "T") -> DataFrame:
    """SRC2: snapshots with file index in [start, end) (half-open)."""
    idx = file_index(signals, key, time_col)
    cond = F.col("file_idx") >= start
    if end is not None:
        cond = cond & (F.col("file_idx") < end)
    return signals.join(idx.filter(cond), on=[*key, time_col])


def snapshot_at(signals: DataFrame, i: int, key: Sequence[str] = ("E",),
                time_col: str = "T") -> DataFrame:
    """SRC3: the raw channels of the i-th snapshot (empty when out of range;
    callers that need the reference's error check the row count)."""
    if i < 0:
        raise IndexError("snapshot index must be >= 0")
    return slice_snapshots(signals, i, i + 1, key, time_col)


def failure_region(signals: DataFrame, n: int = 100, key: Sequence[str] = ("E",),
                   time_col: str = "T") -> DataFrame:
    """SRC5: the last n snapshots of each machine."""
    idx = file_index(signals, key, time_col, descending=True)
    return signals.join(idx.filter(F.col("file_idx") < n).drop("file_idx"), on=[*key, time_col])


def dataset_info(signals: DataFrame, key: Sequence[str] = ("E",), time_col: str = "T",
                 channel_col: str = "channel") -> DataFrame:
    """SRC6: file count, first/last time, duration in hours (0 with fewer
    than 2 files), nominal interval and channel list per machine."""
    g = signals.groupBy(*key).agg(
        F.count_distinct(time_col).alias("n_files"), F.min(time_col).alias("start_time"),
        F.max(time_col).alias("end_time"),
        F.array_sort(F.collect_set(channel_col)).alias("channels"))  # few channels: bounded
    dur = (F.unix_micros(F.col("end_time").cast("timestamp")) -
           F.unix_micros(F.col("start_time").cast("timestamp"))) / 3.6e9
    return g.select(*key, F.col("n_files").cast("bigint"), "start_time", "end_time",
                    F.when(F.col("n_files") >= 2, dur).otherwise(0.0).alias("duration_hours"),
                    F.lit(f"{SNAPSHOT_INTERVAL_MINUTES} minutes").alias("interval"), "channels")
