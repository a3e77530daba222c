"""Series windows that survive a machine with a large share of all rows.

A window partitioned by machine runs each machine in one task. That is used only where the largest series is
counted to have at most CHUNK_ROWS rows. Longer ones are cut:

1. `sorted_table` (operators.positions) writes the rows range-partitioned and sorted by (key, order), so every row has
   a position in the whole table and a series is a run of positions;
2. `chunked`: chunk = position // chunk_rows; each row is also copied into the later chunks whose frames reach back to
   it and the earlier ones whose frames reach forward to it (the halo); `_own` marks the original;
3. `carry` and `carry_sum`: what an unbounded frame needs from other chunks (the last or next value that is there, a
   running sum) comes from a scan over one row per series and chunk.

The values are the same either way; `chunk_rows` forces the cut at any size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .positions import RANGE_ROWS, sorted_table, with_global_position
from .quantiles import largest_group

#: rows of a series that one task may hold
CHUNK_ROWS = 2_000_000


def resolve_chunk_rows(df: DataFrame, key: Sequence[str], chunk_rows) -> int | None:
    """Rows per chunk, or None if no series needs to be cut: with `"auto"`, if none has more than CHUNK_ROWS rows."""
    if chunk_rows == "auto":
        return CHUNK_ROWS if largest_group(df, key) > CHUNK_ROWS else None
    return int(chunk_rows) if chunk_rows else None


def join_on(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; `other`'s key columns go."""
    named = other.withColumnsRenamed({c: f"_on_{c}" for c in on})
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return df.join(named, cond, how).drop(*[f"_on_{c}" for c in on])


def series_index(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "_g",
                 chunk_rows="auto") -> DataFrame:
    """Add `out` = position of the row within its series (0-based). Series that need no cut are numbered
    by a window, others by their positions in the sorted table less their first."""
    if not resolve_chunk_rows(df, key, chunk_rows):
        w = Window.partitionBy(*key).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    g = with_global_position(sorted_table(df, [*key, *order], "series"), "_pos_")
    first = g.groupBy(*key).agg(F.min("_pos_").alias("_first_"))
    return join_on(g, first, key).withColumn(out, F.col("_pos_") - F.col("_first_")).drop("_pos_", "_first_")


def chunked(df: DataFrame, key: Sequence[str], order: Sequence[str], back: int, fwd: int = 0,
            chunk_rows: int = CHUNK_ROWS, in_series: bool = False) -> DataFrame:
    """Rows with their position `_g` in the whole sorted table, `_chunk` and `_own`, with halo copies so that a frame of
    `back` preceding and `fwd` following rows is complete for every owned row inside its (key, _chunk)
    partition. Positions of a series are consecutive, but begin at 0 only with `in_series`, which takes another join."""
    g = with_global_position(sorted_table(df, [*key, *order], "chunks"), "_g")
    C = int(chunk_rows)
    if in_series:
        first = g.groupBy(*key).agg(F.min("_g").alias("_first_"))
        g = join_on(g, first, key).withColumn("_g", F.col("_g") - F.col("_first_")).drop("_first_")
    # chunk c needs the rows from c*C - back to c*C + C-1 + fwd
    first = F.greatest(F.lit(0), F.ceil((F.col("_g") - fwd - (C - 1)) / C)).cast("long")
    last = F.floor((F.col("_g") + back) / C).cast("long")
    return g.withColumn("_chunk", F.explode(F.sequence(first, last))) \
        .withColumn("_own", F.col("_chunk") == F.floor(F.col("_g") / C))


def tasks_for(rows: int, spark) -> int:
    """Partitions of a chunked frame: as many as a shuffle has, more if they held over RANGE_ROWS / 4 rows. The number is
    passed to `repartition`, as adaptive coalescing goes by compressed bytes: of columns that are mostly null, that is millions of rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * rows // RANGE_ROWS))


def carry(df: DataFrame, key: Sequence[str], back: Mapping[str, str] | None = None, ahead: Mapping[str, str] | None = None,
          of: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Unbounded fills over the owned rows of a chunked frame, for any number of columns at once. `back` maps a column
    to the name of its last non-null value at or before the row, `ahead` to that of the next at or after it:
    from the row's chunk, else from the nearest other chunk of the series that has one. `of` is a smaller frame to take
    other chunks' values from (key, `_chunk`, `_g` and the columns), `tasks` the number of partitions of the result."""
    back, ahead = dict(back or {}), dict(ahead or {})
    there = lambda c: F.when(F.col(c).isNotNull(), F.col("_g"))
    per = (df.filter("_own") if of is None else of).groupBy(*key, "_chunk").agg(
        *[F.max_by(c, there(c)).alias(f"_l{i}") for i, c in enumerate(back)],
        *[F.min_by(c, there(c)).alias(f"_f{i}") for i, c in enumerate(ahead)])
    chunks = Window.partitionBy(*key)
    earlier = chunks.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = chunks.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*key, "_chunk", *[F.last(f"_l{i}", ignorenulls=True).over(earlier).alias(f"_cl{i}") for i in range(len(back))],
                         *[F.last(f"_f{i}", ignorenulls=True).over(later).alias(f"_cf{i}") for i in range(len(ahead))])
    j = join_on(df, carried, [*key, "_chunk"], "left")
    if tasks:
        j = j.repartition(tasks, *key, "_chunk")
    own = Window.partitionBy(*key, "_chunk")
    up = own.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    down = own.orderBy(F.desc("_g")).rowsBetween(Window.unboundedPreceding, 0)
    filled = {out: F.coalesce(F.last(c, ignorenulls=True).over(up), F.col(f"_cl{i}")) for i, (c, out) in enumerate(back.items())}
    filled |= {out: F.coalesce(F.last(c, ignorenulls=True).over(down), F.col(f"_cf{i}")) for i, (c, out) in enumerate(ahead.items())}
    return j.withColumns(filled).drop(*[f"_cl{i}" for i in range(len(back))], *[f"_cf{i}" for i in range(len(ahead))])


def carry_sum(df: DataFrame, key: Sequence[str], col: str, out: str) -> DataFrame:
    """Running sum of `col` from the series' start over the owned rows of a chunked frame."""
    own = df.filter("_own")
    tot = own.groupBy(*key, "_chunk").agg(F.sum(col).alias("_tot"))
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = tot.select(*key, "_chunk", F.coalesce(F.sum("_tot").over(earlier), F.lit(0)).alias("_before"))
    in_chunk = Window.partitionBy(*key, "_chunk").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    j = join_on(own, before, [*key, "_chunk"], "left")
    return j.withColumn(out, F.sum(col).over(in_chunk) + F.col("_before")).drop("_before")


def on_chunks(df: DataFrame, key: Sequence[str], order: Sequence[str], back: int, fwd: int,
              fn, chunk_rows="auto") -> DataFrame:
    """Run `fn(frame, key, order)` - an operator whose values depend only on rows within `back` before and `fwd`
    after each row - per (key, chunk) where series are cut, else on the plain series."""
    chunk_rows = resolve_chunk_rows(df, key, chunk_rows)
    if not chunk_rows:
        return fn(df, list(key), list(order))
    c = chunked(df, key, order, back, fwd, chunk_rows)
    out = fn(c, [*key, "_chunk"], ["_g"])
    return out.filter("_own").drop("_own", "_chunk", "_g")
