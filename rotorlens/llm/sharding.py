"""Minimax contiguous shards: documents with equal texts form a group, groups lie in a fixed order, and the
shards are runs of that order whose largest is as small as it can be.

The smallest feasible capacity is found by binary search; whether one is feasible is checked greedily (fill a
shard while the next group fits). The order is that of the texts' MD5, so the driver needs no list of
all groups: it holds the sizes of cells (groups whose MD5 begins alike), at first 16^FIRST_HEX of them.
A check with cells that may be cut anywhere bounds the smallest capacity from below, one with cells that may not be
cut from above. Cells in which a cut may lie between the two bounds are split by two more hex digits, at most
REFINED at a time, until none is left; the bounds have met then. The result is that of the check over all groups, and the driver
holds about 16^FIRST_HEX + rounds * 256 * REFINED numbers however many groups there are.

A group larger than an even share of what is left has a shard to itself, in front of the others (at most
one less than the shards); the rest is cut as above.

A row's slot is its position in its shard in the order of (MD5, id); it comes from a range-partitioned sort, so a
group with a large share of all rows is spread over many tasks.

Defined results: a null text counts as an empty one, of size 1; repeated rows count each and
have slots of their own; null ids are rows like others; with fewer groups than shards some shards are
empty; equal sizes need no rule, as the order decides; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import sorted_table, with_position
from .common import written

SHARDS = 8
FIRST_HEX = 3
REFINED = 256
KEY_HEX = 32


class Cells:
    """Sizes of consecutive cells of the order: prefix (of the groups' keys), size, number of groups."""

    def __init__(self, cells: dict[str, tuple[int, int]]):
        self.prefix = sorted(cells)
        self.size = [cells[p][0] for p in self.prefix]
        self.single = [cells[p][1] == 1 or len(p) >= KEY_HEX for p in self.prefix]
        self.ends = np.concatenate([[0], np.cumsum(np.array(self.size, np.int64))]) if self.size else np.zeros(1, np.int64)
        self.total = int(self.ends[-1])

    def cuts(self, capacity: int, shards: int, whole: bool) -> tuple[list[int], bool]:
        """Where a greedy filling ends its shards, and whether everything fits. `whole`: no cell is cut,
        else only cells of one group aren't."""
        at, out = 0, []
        for _ in range(shards):
            reach = at + capacity
            if reach >= self.total:
                return out + [self.total] * (shards - len(out)), True
            j = int(np.searchsorted(self.ends, reach, side="right")) - 1
            at = max(at, int(self.ends[j])) if whole or self.single[j] else reach
            out.append(at)
        return out, False

    def least(self, shards: int, whole: bool) -> int:
        """Smallest capacity at which everything fits."""
        lo, hi = -(-self.total // shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, shards, whole)[1]:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def open(self, lo: int, hi: int, shards: int) -> list[str]:
        """The largest cells in which a cut may lie for a capacity between lo and hi."""
        first, last = self.cuts(lo, shards, True)[0], self.cuts(hi, shards, False)[0]
        found = set()
        for a, b in zip(first, last):
            i, j = (int(np.searchsorted(self.ends, x, side="right")) - 1 for x in (a, max(a, b)))
            found.update(k for k in range(i, min(j + 1, len(self.size))) if not self.single[k])
        return [self.prefix[k] for k in sorted(found, key=lambda k: (-self.size[k], k))[:REFINED]]


def _counted(groups: DataFrame, prefix) -> dict[str, tuple[int, int]]:
    rows = groups.groupBy(prefix.alias("p")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return {r["p"]: (int(r["size"]), r["n"]) for r in rows}


def boundaries(groups: DataFrame, shards: int, key_hex: int = FIRST_HEX) -> tuple[list[str], int]:
    """(keys, capacity): the key prefixes at which a new shard begins, and the largest shard's size. `groups` has
    a row (key, size) for every group, with hex keys."""
    cells = _counted(groups, F.substring("key", 1, key_hex))
    while True:
        now = Cells(cells)
        if not now.size:
            return [], 0
        lo, hi = now.least(shards, False), now.least(shards, True)
        split = now.open(lo, hi, shards)
        if not split:
            break
        by_length: dict[int, list[str]] = {}
        for p in split:
            by_length.setdefault(len(p), []).append(p)
        finer = F.coalesce(*[F.when(F.substring("key", 1, n).isin(ps), F.substring("key", 1, n + 2))
                             for n, ps in by_length.items()])
        found = _counted(groups.filter(finer.isNotNull()), finer)
        for p in split:
            del cells[p]
        cells.update(found)
    ends = now.cuts(hi, shards, True)[0]
    begin = [int(np.searchsorted(now.ends, e, side="left")) for e in ends]
    return [now.prefix[j] for j in begin[:-1] if j < len(now.prefix)], hi


def oversized(groups: DataFrame, shards: int) -> list[str]:
    """Keys of the groups that are larger than an even share of what is left, largest first."""
    total = int(groups.agg(F.sum("size")).first()[0] or 0)
    alone: list[str] = []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect():
        if r["size"] * (shards - len(alone)) <= total:
            break
        alone.append(r["key"])
        total -= r["size"]
    return alone


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("bigint").alias("size"),
                               F.crc32(t.cast("binary")).alias("text_crc32"), F.md5(t.cast("binary")).alias("key")), "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    alone = oversized(groups, shards)
    rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
    starts, _ = boundaries(rest, shards - len(alone))
    shard = F.lit(len(alone))
    for b in starts:
        shard = shard + (F.col("key") >= b).cast("int")
    for i, key in enumerate(alone):
        shard = F.when(F.col("key") == key, i).otherwise(shard)
    # repeated rows are told apart by their place, so that they too can lie in several ranges
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("_row", F.monotonically_increasing_id())
    ordered = sorted_table(placed, ["shard", "key", "doc_id", "_row"], "shards", rows.count())
    return with_position(ordered, "slot", ["shard"]).select(
        F.col("doc_id").alias(doc_id), "size", "text_crc32", "shard", "slot")


def query(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                               F.lit(None).cast("int").alias("grown_shard"))


def _oracle() -> str:
    """Dynamic programming over the groups for the smallest capacity, then greedy cuts at it. CRC-32 goes by
    half bytes, with a table of sixteen."""
    half = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        half.append(n)
    levels = ",\n".join(
        f"d{s} AS MATERIALIZED (SELECT b.i, min(greatest(a.v, b.p - a.p)) AS v, b.p FROM d{s - 1} a JOIN c b ON a.i <= b.i GROUP BY b.i, b.p)"
        for s in range(2, SHARDS + 1))
    picks = " UNION ALL ".join(f"SELECT {s} AS s, v FROM d{s} WHERE i = (SELECT max(i) FROM c)" for s in range(1, SHARDS + 1))
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5(coalesce(text, '')) AS key,
    coalesce(text, '') AS text FROM documents),
g AS MATERIALIZED (SELECT key, sum(size) AS size FROM t GROUP BY key),
o AS (SELECT key, size, row_number() OVER (ORDER BY size DESC, key) AS r, sum(size) OVER (ORDER BY size DESC, key
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM g),
alone AS MATERIALIZED (SELECT key, r FROM (SELECT *, bool_and(r < {SHARDS} AND size * ({SHARDS + 1} - r) > left_) OVER (ORDER BY r) AS big FROM o) WHERE big),
k AS (SELECT count(*) AS k FROM alone),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key) AS i, key, CAST(sum(size) OVER (ORDER BY key) AS BIGINT) AS p FROM g
    WHERE key NOT IN (SELECT key FROM alone) UNION ALL SELECT 0, '', 0),
d1 AS MATERIALIZED (SELECT i, p AS v, p FROM c),
{levels},
cap AS (SELECT v FROM ({picks}) WHERE s = {SHARDS} - (SELECT k FROM k)),
cuts AS (SELECT 0 AS n, CAST(0 AS BIGINT) AS p UNION ALL
    SELECT n + 1, (SELECT max(c.p) FROM c WHERE c.p <= cuts.p + (SELECT v FROM cap)) FROM cuts WHERE n < {SHARDS}),
b AS MATERIALIZED (SELECT p, min(n) AS n FROM cuts GROUP BY p),
s AS (SELECT t.*, CAST(CASE WHEN a.r IS NOT NULL THEN a.r - 1 ELSE (SELECT k FROM k) + (SELECT min(b.n) FROM b WHERE b.p >= c.p) - 1 END AS INT) AS shard
    FROM t LEFT JOIN alone a ON a.key = t.key LEFT JOIN c ON c.key = t.key),
h AS MATERIALIZED (SELECT key, string_split(hex(encode(any_value(text))), '') AS l, any_value(size) AS size FROM t GROUP BY key),
crc AS (SELECT key, CASE WHEN size = 1 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(2 * (size - 1)),
    lambda i: CAST(instr('0123456789ABCDEF', l[xor(i, 1) + 1]) - 1 AS BIGINT))),
    lambda c, d: xor(c >> 4, {half}[(xor(c, d) & 15) + 1]))) END AS c FROM h)
SELECT doc_id, size, crc.c AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY s.key, doc_id) - 1 AS slot,
    CAST(NULL AS INT) AS grown_shard FROM s JOIN crc ON crc.key = s.key
"""


ORACLE_SQL = _oracle()
