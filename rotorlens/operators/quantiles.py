"""Exact percentiles of groups of any size.

An aggregate `percentile` keeps every value of a group in one task. Here only groups of at most `limit`
values are sorted that way. For larger ones the ranks that the percentiles need are found by selection: the values between two
bounds are cut into bins by their approximate quantiles, bins are counted exactly, and only those that hold a wanted
rank are cut again, each round into about 64 times fewer values. A value that is a bin edge has a bin of its own, so
one that makes up most of a group is found at once. When a bin holds at most `limit` values, or a single one, the rank is read
from it. Counts are aggregated before they are shuffled, so a group that holds a third of all rows is
counted by all tasks.

The result equals linear interpolation between the two nearest ranks, whatever the group's size. Nulls are left out,
NaN is larger than any number, a group without values has no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: values of a group that one task may sort
LIMIT = 100_000
EDGES = 64
#: the approximate quantiles' rank error is the group's size divided by this
ACCURACY = 1000
#: rows of bins or ranks that may be broadcast (some 64 bytes each)
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if it is counted to be small; else a shuffle join, with AQE's skew splitting."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def largest_group(df: DataFrame, key: Sequence[str]) -> int:
    """Rows of the largest group."""
    n = df.groupBy(*key).count() if key else df.agg(F.count(F.lit(1)).alias("count"))
    return n.agg(F.max("count")).first()[0] or 0


def interpolated(at, n: Column, p: float) -> Column:
    """The p-quantile of n sorted values, `at(rank)` being the value of a rank from 0."""
    pos = (n - 1) * F.lit(float(p))
    lo, hi = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
    return F.when(lo == hi, at(lo)).otherwise((hi - pos) * at(lo) + (pos - lo) * at(hi))


def exact_quantiles(df: DataFrame, key: Sequence[str], value: str, probs: Sequence[float], limit: int | None = None) -> DataFrame:
    """key..., n, q (array of the quantiles, in the order of `probs`) of each group. Null keys are a key."""
    limit = LIMIT if limit is None else limit
    group = F.struct(*key) if key else F.struct(F.lit(0).alias("_all"))
    vals = df.filter(F.col(value).isNotNull()).select(group.alias("k"), F.col(value).cast("double").alias("v"))
    sizes = vals.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    probs = [float(p) for p in probs]
    sorted_at_once = [F.count(F.lit(1)).alias("n"), F.percentile("v", probs).alias("q")]
    if (sizes.agg(F.max("n")).first()[0] or 0) <= limit:
        out = vals.groupBy("k").agg(*sorted_at_once)
    else:
        sizes = written(sizes, "group-sizes")
        few = vals.join(_small(sizes.filter(F.col("n") <= limit).select("k")), "k", "left_semi")
        out = few.groupBy("k").agg(*sorted_at_once).unionByName(_selected(vals, sizes.filter(F.col("n") > limit), probs, limit))
    return out.select(*([f"k.{c}" for c in key]), "n", "q")


def _selected(vals: DataFrame, sizes: DataFrame, probs: list[float], limit: int) -> DataFrame:
    pos = [(F.col("n") - 1) * F.lit(p) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in pos for f in (F.floor, F.ceil)]))
    wanted = written(sizes.select("k", "n", F.explode(ranks).alias("r")), "ranks")
    nothing = F.lit(None).cast("double")
    bins = wanted.select("k").distinct().select("k", F.lit(0).alias("bin"), nothing.alias("lo"), nothing.alias("hi"),
                                                F.lit(0).cast("long").alias("below"))
    found = []
    while True:
        hits = written(_cut(vals, bins).join(wanted.select(F.col("k").alias("_k"), "r"),
                       (F.col("k") == F.col("_k")) & (F.col("r") >= F.col("below")) & (F.col("r") < F.col("below") + F.col("c"))).drop("_k"), "hits")
        single = F.col("lo").eqNullSafe(F.col("hi"))
        found.append(hits.filter(single).select("k", "r", F.col("lo").alias("v")))
        last = hits.filter(~single & (F.col("c") <= limit))
        if last.limit(1).count():
            found.append(_read(vals, last))
        more = hits.filter(~single & (F.col("c") > limit)).select("k", "lo", "hi", "below").distinct()
        if not more.limit(1).count():
            break
        bins = written(more.select("k", F.row_number().over(Window.partitionBy("k").orderBy("below")).alias("bin"),
                                   "lo", "hi", "below"), "bins")
    by_rank = reduce(DataFrame.unionByName, found).distinct().groupBy("k").agg(
        F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))
    quantiles = [interpolated(lambda r: F.element_at("at", r), F.col("n"), p) for p in probs]
    return sizes.join(by_rank, "k").select("k", "n", F.array(*quantiles).alias("q"))


def _inside(vals: DataFrame, bins: DataFrame) -> DataFrame:
    """The values that lie in a bin, with its number and the rank of its first value."""
    b = _small(bins.select(F.col("k").alias("_k"), "bin", "lo", "hi", "below"))
    on = (F.col("k") == F.col("_k")) & (F.col("lo").isNull() | ((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))))
    return vals.join(b, on).select("k", "v", "bin", "below")


def _cut(vals: DataFrame, bins: DataFrame) -> DataFrame:
    """Finer bins: k, lo, hi (their smallest and largest value), c (values), below (rank of the first)."""
    rows = _inside(vals, bins)
    edges = rows.groupBy("k", "bin").agg(F.array_distinct(F.percentile_approx(
        "v", [i / EDGES for i in range(EDGES + 1)], ACCURACY)).alias("edges"))
    cut = rows.join(_small(written(edges, "edges")), ["k", "bin"])
    at = F.size(F.filter("edges", lambda e: e < F.col("v"))) * 2 + F.array_contains("edges", F.col("v")).cast("int")
    parts = cut.groupBy("k", "bin", "below", at.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"),
                                                                  F.max("v").alias("hi"))
    # at most 2 * EDGES + 3 rows a bin
    w = Window.partitionBy("k", "bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("k", "lo", "hi", "c", (F.col("below") + F.coalesce(F.sum("c").over(w), F.lit(0))).alias("below"))


def _read(vals: DataFrame, last: DataFrame) -> DataFrame:
    """k, r, v: wanted ranks in bins that are small enough to be sorted."""
    bins = last.select("k", "lo", "hi", "below").distinct().withColumn("bin", F.col("below"))
    rank = F.col("below") + F.row_number().over(Window.partitionBy("k", "bin").orderBy("v")) - 1
    ranked = _inside(vals, bins).select("k", rank.alias("r"), "v")
    return ranked.join(last.select("k", "r").distinct(), ["k", "r"]).select("k", "r", "v")
