"""Shared helpers of the subpackage: tables, scratch tables, size-checked
broadcasts and access to text columns as raw UTF-8 buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What every operator needs from a session: the package on the executors' path, and Arrow batches that
    stay small with long texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet under the shared checkpoint folder and read it
    back, so that a lost executor costs only the step it was working on."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS = "2000"

#: Rows of narrow keys (two longs) that may be broadcast: about 100 MB as a hash relation.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `max_rows` rows (counted), else as it is,
    which leaves the join to a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` is called so (any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows (n + 1); nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type):
        wide, kind = np.int64, pa.large_string()
    else:
        wide, kind = np.int32, pa.string()
    col = col.cast(kind).fill_null("") if col.null_count else col.cast(kind)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, wide, len(col) + 1, col.offset * wide().itemsize).astype(np.int64) \
        if offs is not None and offs.size else np.zeros(len(col) + 1, np.int64)
    first, last = (int(o[0]), int(o[-1])) if len(o) else (0, 0)
    b = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first \
        else np.zeros(0, np.uint8)
    return b, o - first


def blocks(batch: pa.RecordBatch, text: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most `max_bytes` of text each (a longer text alone)."""
    _, o = utf8(batch.column(text))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(o, o[lo] + max_bytes, side="right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = hi
