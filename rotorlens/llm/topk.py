"""Exact top-k search by columnar branch and bound.

Candidates are laid out in vertical blocks (a row per dimension). Inner products are accumulated
dimension block by dimension block for all queries of a block; after each, a candidate's score is
at most what it has plus the product of both sides' remaining norms (its remaining mass), so those
that cannot reach a query's k-th best score so far are dropped and the rest compacted.

Queries go out in blocks of at most `block_queries`, one pass over the candidates per block;
each task returns k rows a query, which are ranked per query at the end.

Components are floor(scale * x), so scores are integers and every comparison is exact: sums stay
below 2^53 in doubles, and are taken in Python integers where they would not.

Defined results: rows whose id or vector is null, or whose vector holds null, NaN or infinity, take no part;
a shorter vector counts as filled with zeros; a candidate is a query's own if it has its id;
repeated candidates count each for themselves, a repeated query once (per distinct vector); equal
scores rank by smaller id; scores beyond a long are its largest or smallest; other columns aren't read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM_BLOCK = 16
ROWS = 8192
QUERIES_AT_ONCE = 256
EXACT = float(2 ** 53)


def matrix(ids: pa.Array, vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows (zero-filled) of the usable vectors, as integers in doubles."""
    sizes = pa.compute.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pa.compute.list_flatten(vectors).cast(pa.float64())
    x = np.floor(scale * flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(ids)), sizes)
    good = np.ones(len(ids), bool)
    good[row[~np.isfinite(x)]] = False
    good &= ~np.asarray(ids.is_null()) & ~np.asarray(vectors.is_null())
    dim = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(ids), dim))
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, np.arange(len(row)) - first] = x
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[good], out[good]


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.q, self.k = qid, q, k
        self.found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in qid]
        self.floor = np.full(len(qid), -np.inf)

    def take(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        mine = ids != self.qid[i]
        s = np.concatenate([self.found[i][0], score[mine]])
        d = np.concatenate([self.found[i][1], ids[mine]])
        if len(s) > self.k:
            if s.dtype != object:
                near = np.flatnonzero(s >= np.partition(s, len(s) - self.k)[len(s) - self.k])
                s, d = s[near], d[near]
            top = np.lexsort((d, -s))[:self.k] if s.dtype != object else \
                np.array(sorted(range(len(s)), key=lambda j: (-s[j], d[j]))[:self.k], np.int64)
            s, d = s[top], d[top]
        self.found[i] = s, d
        if len(s) == self.k:
            self.floor[i] = float(min(s))

    def search(self, ids: np.ndarray, rows: np.ndarray) -> None:
        dim = max(rows.shape[1], self.q.shape[1])
        cols = np.zeros((dim, len(rows)))
        cols[:rows.shape[1]] = rows.T
        q = np.zeros((len(self.q), dim))
        q[:, :self.q.shape[1]] = self.q
        if dim * max(1.0, np.abs(cols).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) >= EXACT:
            exact = [[int(x) for x in c] for c in cols.T]
            for i in range(len(q)):
                mine = [int(x) for x in q[i]]
                s = np.array([sum(a * b for a, b in zip(mine, c)) for c in exact], object)
                self.take(i, s, ids)
            return
        cuts = [*range(0, dim, DIM_BLOCK), dim]
        left = lambda m, axis: [np.sqrt(np.sum(m.take(range(c, dim), axis) ** 2, axis)) for c in cuts]
        c_left, q_left = left(cols, 0), left(q, 1)
        for lo in range(0, len(q), QUERIES_AT_ONCE):
            part = slice(lo, min(lo + QUERIES_AT_ONCE, len(q)))
            first = q[part, :cuts[1]] @ cols[:cuts[1]] if len(cuts) > 1 else np.zeros((part.stop - lo, len(ids)))
            for i in range(lo, part.stop):
                acc, idx = first[i - lo], None
                for b in range(1, len(cuts) - 1):
                    rest = c_left[b] if idx is None else c_left[b][idx]
                    # the slack covers the rounding of norms and their product
                    alive = np.flatnonzero(acc + (q_left[b][i] * rest * (1 + 1e-9) + 1) >= self.floor[i])
                    acc, idx = acc[alive], alive if idx is None else idx[alive]
                    acc = acc + q[i, cuts[b]:cuts[b + 1]] @ cols[cuts[b]:cuts[b + 1], idx]
                if idx is None:
                    idx = np.arange(len(ids))
                keep = acc >= self.floor[i]
                self.take(i, acc[keep], ids[idx[keep]])


def _search(bc, vec_id: str, vector: str, k: int, scale: float):
    def run(batches):
        qid, q = bc.value
        best = Best(qid, q, k)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                rb = b.slice(lo, ROWS)
                ids, rows = matrix(rb.column(vec_id), rb.column(vector), scale)
                # a few rows first set the floors for the others
                for cut in (slice(0, 256), slice(256, None)):
                    if len(ids[cut]):
                        best.search(ids[cut], rows[cut])
        n = [len(s) for s, _ in best.found]
        if sum(n):
            top = 2 ** 63
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(qid, n)), pa.array(np.concatenate([d for _, d in best.found])),
                pa.array([max(-top, min(top - 1, int(x))) for s, _ in best.found for x in s], pa.int64())],
                names=["query_id", "vec_id", "score"])
    return run


def _pack(vec_id: str, vector: str, scale: float):
    def run(batches):
        for rb in batches:
            ids, rows = matrix(rb.column(vec_id), rb.column(vector), scale)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(
                [r.tobytes() for r in rows], pa.binary())], names=["id", "v"])
    return run


def top_k(candidates: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10,
          scale: float = 1024.0, block_queries: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products among the candidates."""
    spark = candidates.sparkSession
    both = lambda df: df.select(F.col(vec_id).cast("bigint").alias("id"),
                                F.col(vector).cast("array<double>").alias("v"))
    packed = both(queries).mapInArrow(_pack("id", "v", scale), "id bigint, v binary").distinct()
    n_blocks = max(1, -(-packed.count() // block_queries))
    parts = []
    for b in range(n_blocks):
        rows = packed.filter(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)) == b).collect()
        dim = max((len(r["v"]) // 8 for r in rows), default=0)
        q = np.zeros((len(rows), dim))
        for i, r in enumerate(rows):
            v = np.frombuffer(bytes(r["v"]))
            q[i, :len(v)] = v
        bc = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), q))
        found = both(candidates).mapInArrow(_search(bc, "id", "v", k, scale),
                                            "query_id bigint, vec_id bigint, score bigint")
        parts.append(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    """The rows whose id is divisible by 100 against all rows."""
    return top_k(embeddings, embeddings.filter(F.col("vec_id") % 100 == 0))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1),
    lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
