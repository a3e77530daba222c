"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds.

For a vector in cluster a, let u be its distance to a's centroid and l the distance to the next nearest. While
centroids move, u grows by at most a's drift and l shrinks by at most the largest drift of the others, so
the vector can't change cluster before a's accumulated drift has grown by the gap l - u. Each cluster keeps its vectors in the order of
gap + (a's accumulated drift when the gap was measured); a round pops those whose value has been reached,
measures these, and only these, against all centroids, and pushes them with new values.

The heap is kept in runs: each round's pushed rows are a written table, sorted by (cluster, expiry), so popping reads a
range of it (Parquet statistics skip the rest). Runs are never rewritten: accumulated drift never falls, so a row
of an earlier run has been popped exactly if its expiry was at most the drift of an earlier round. Sums of
clusters change by the rows that moved. Nothing is shuffled but the clusters' sums, and a lost executor
costs the files it was reading.

Distances, sums and centroids are exact integers; bounds are doubles that are widened by more than their rounding,
which can only pop a vector early.

Defined results: vectors of another length than `dim`, null ones, and those with null or non-finite components, or one whose integer
fits no long, take no part; ties go to the smaller centroid number; equal hashes start in the order of
(id, components), null ids last; repeated rows and null ids are vectors like others; fewer vectors than `k` start as
many centroids; empty centroids stay; distances and inertias beyond a long are the largest long;
an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import written
from .vectors import integers, widest

K = 8
ROUNDS = 10
DIM = 64
SEED = 3
SCALE = 1024.0
TOP = 2 ** 63 - 1
#: relative widening of bounds
SLACK = 1e-9


def _kept(dim: int, scale: float):
    def run(batches):
        for rb in batches:
            at, x = integers(rb.column("v"), dim, scale)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * dim, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([rb.column("id").take(pa.array(at)), rows], names=["id", "x"])
    return run


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return pa.compute.list_flatten(col).to_numpy(zero_copy_only=False).reshape(len(col), dim)


def squared(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances, a row per vector and a column per centroid."""
    c = np.array(centroids, object)
    widest_diff = widest(x) + max((abs(v) for row in centroids for v in row), default=0)
    exact = np.int64 if widest_diff ** 2 * max(1, x.shape[1]) < 2 ** 62 else object
    x, c = x.astype(exact), c.astype(exact)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _two_nearest(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the first of equals), distance to it and to the next one (infinite if there is none)."""
    rows = np.arange(len(d2))
    near = d2.argmin(1) if d2.dtype != object else np.array([min(range(len(r)), key=lambda j: r[j]) for r in d2], np.int64)
    best = np.sqrt(d2[rows, near].astype(np.float64))
    if d2.shape[1] == 1:
        return near, best, np.full(len(d2), np.inf)
    rest = d2.astype(np.float64)
    rest[rows, near] = np.inf
    return near, best, np.sqrt(rest.min(1))


def _measure(dim: int, centroids: list[list[int]], drift: list[float]):
    """Popped rows with their new cluster and expiry."""
    def run(batches):
        offset = np.array(drift)
        for rb in batches:
            if not rb.num_rows:
                continue
            near, up, low = _two_nearest(squared(_matrix(rb.column("x"), dim), centroids))
            with np.errstate(invalid="ignore"):
                expiry = np.where(np.isinf(low), np.inf, low - up - SLACK * (low + up + offset[near])) + offset[near]
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("x"), pa.array(near, pa.int32()), pa.array(expiry),
                                              rb.column("cluster")], names=["id", "x", "cluster", "expiry", "was"])
    return run


def _sums(dim: int, k: int):
    """What the moved rows of a task add to each cluster: a row per cluster and dimension, the count at dimension -1."""
    def run(batches):
        total = np.zeros((k, dim + 1), object)
        for rb in batches:
            x = np.concatenate([np.ones((rb.num_rows, 1), np.int64), _matrix(rb.column("x"), dim)], 1)
            if widest(x) * max(1, len(x)) >= 2 ** 62:
                x = x.astype(object)
            for col, sign in (("cluster", 1), ("was", -1)):
                at = rb.column(col).to_numpy(zero_copy_only=False)
                for c in np.unique(at[at >= 0]):
                    total[c] += sign * x[at == c].sum(0).astype(object)
        c, d = np.nonzero(total)
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d - 1, pa.int32()), pa.array(
                [Decimal(int(v)) for v in total[c, d]], pa.decimal128(38, 0))], names=["cluster", "d", "v"])
    return run


def _distances(dim: int, centroids: list[list[int]]):
    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            x, at = _matrix(rb.column("x"), dim), rb.column("cluster").to_numpy(zero_copy_only=False)
            out = np.zeros(len(x), np.int64)
            for c in np.unique(at):
                out[at == c] = np.minimum(squared(x[at == c], [centroids[c]])[:, 0], TOP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("cluster"), pa.array(out)], names=["id", "cluster", "distance"])
    return run


def _popped(before: list[float], upto: list[float], newest: int) -> Column:
    """Rows whose expiry their cluster's drift has reached since the last round: the newest run has not been
    popped yet, the others up to `before`. Each cluster's rows lie together in a file, in the order of expiry."""
    return reduce(lambda a, b: a | b, [
        (F.col("cluster") == c) & (F.col("expiry") <= u) & ((F.col("run") == newest) | (F.col("expiry") > a))
        for c, (a, u) in enumerate(zip(before, upto))])


def _live(drift: list[float], newest: int) -> Column:
    """Rows that have not been popped."""
    return (F.col("run") == newest) | reduce(lambda a, b: a | b, [
        (F.col("cluster") == c) & (F.col("expiry") > d) for c, d in enumerate(drift)])


def _moved(old: list[list[int]], new: list[list[int]]) -> list[float]:
    """What each cluster's accumulated drift grows by: its own and the largest of the others, rounded up."""
    own = [float(sum((a - b) ** 2 for a, b in zip(x, y))) ** 0.5 * (1 + 1e-12) for x, y in zip(old, new)]
    return [d + max((o for j, o in enumerate(own) if j != c), default=0.0) for c, d in enumerate(own)]


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dim: int = DIM, scale: float = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(rows, centroids, popped): id, cluster and squared distance of every vector; the final centroids; and how
    many vectors each assignment measured."""
    src = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = src.schema["id"].dataType.simpleString()
    base = written(src.mapInArrow(_kept(dim, scale), f"id {kind}, x array<bigint>"), "vectors")
    first = base.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)) \
        .orderBy(F.asc_nulls_last("h"), "id", "x").limit(k).collect()
    centroids = [[int(v) for v in r["x"]] for r in first]
    shape = f"id {kind}, cluster int, distance bigint"
    if not centroids:
        return base.sparkSession.createDataFrame([], shape).withColumnRenamed("id", vec_id), centroids, []
    k, spark = len(centroids), base.sparkSession
    drift, before, sums, popped = [0.0] * k, [0.0] * k, np.zeros((k, dim + 1), object), []
    # a round reads all runs but writes no more files than the first one, else their number grows with every round
    files = base.rdd.getNumPartitions()
    heap = f"{checkpoint_dir(spark).rstrip('/')}/heap-{uuid.uuid4().hex}"
    pushed = f"id {kind}, x array<bigint>, cluster int, expiry double, was int"
    for r in range(rounds + 1):
        if r:
            expired = spark.read.schema(f"{pushed}, run int").parquet(heap).filter(_popped(before, drift, r - 1)) \
                .select("id", "x", "cluster").coalesce(files)
        else:
            expired = base.withColumn("cluster", F.lit(-1))
        expired.mapInArrow(_measure(dim, centroids, drift), pushed).sortWithinPartitions("cluster", "expiry") \
            .write.parquet(f"{heap}/run={r}")
        run = spark.read.schema(pushed).parquet(f"{heap}/run={r}")
        popped.append(run.count())
        if r == rounds:
            break
        for row in run.filter("cluster <> was").select("x", "cluster", "was").mapInArrow(
                _sums(dim, k), "cluster int, d int, v decimal(38,0)").groupBy("cluster", "d").agg(F.sum("v").alias("v")).collect():
            sums[row["cluster"], row["d"] + 1] += int(row["v"])
        after = [[int(s) // int(total[0]) for s in total[1:]] if total[0] else c for total, c in zip(sums, centroids)]
        grown = _moved(centroids, after)
        before, drift, centroids = drift, [d + g for d, g in zip(drift, grown)], after
    out = spark.read.schema(f"{pushed}, run int").parquet(heap).filter(_live(drift, rounds)) \
        .select("id", "x", "cluster").mapInArrow(_distances(dim, centroids), shape)
    return out.withColumnRenamed("id", vec_id), centroids, popped


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds each cluster's inertia, that of all, and the centroid's digest."""
    rows = written(rows, "clusters")  # what follows reads it twice
    total = {r["cluster"]: int(r["s"]) for r in
             rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [(c, min(total.get(c, 0), TOP), min(sum(total.values()), TOP),
              hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    table = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster")  # a row per centroid


def query(embeddings: DataFrame) -> DataFrame:
    rows, centroids, _ = cluster(embeddings)
    return with_inertia(rows, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds written out; floor(sum / count) by remainders, as it must be exact."""
    d2 = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT v.id, min(struct_pack(d := CAST({d2} AS BIGINT), c := c.c)) AS m FROM v CROSS JOIN c{r} c GROUP BY v.id)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT m.c AS c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (id), range(1, 65) t(i) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(any_value(n.x), any_value(c.x)) AS x FROM c{r} c LEFT JOIN
    (SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS x FROM s{r} GROUP BY c) n ON n.c = c.c GROUP BY c.c)""")
    last = f"a{ROUNDS}"
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, vec_id, x) - 1 AS INT) AS c, x FROM
    (SELECT *, sha256('{SEED}:' || vec_id) AS h FROM v ORDER BY h, vec_id, x LIMIT {K})),
{", ".join(steps)}
SELECT v.vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(z.x, ',')) AS centroid_sha256 FROM {last} a JOIN v USING (id) JOIN c{ROUNDS} z ON z.c = a.m.c
"""


ORACLE_SQL = _oracle()
