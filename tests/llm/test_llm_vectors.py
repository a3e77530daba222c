"""Sharding, whitening and clustering against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from rotorlens.llm import centroids, sharding, whitening


def minimax(sizes, shards):
    """Smallest capacity by trying them all, and the greedy runs at it."""
    def runs(cap):
        out, used = [0], 0
        for s in sizes:
            if s > cap:
                return None
            if used + s > cap:
                out.append(0)
                used = 0
            used += s
            out[-1] += 1
        return out if len(out) <= shards else None
    cap = next(c for c in range(max([*sizes, 0]), sum(sizes) + 1) if runs(c))
    return cap, runs(cap)


@pytest.mark.parametrize("seed", (1, 2))
def test_shards_are_minimax(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "FIRST_HEX", 1)
    monkeypatch.setattr(sharding, "REFINED", 3)
    rng = random.Random(seed)
    texts = ["é" * rng.randrange(1, 40) + str(i) for i in range(rng.choice([3, 60, 400]))]
    rows = [(rng.randrange(10 ** 6), rng.choice(texts[:1 + 3 * i])) for i in range(len(texts)) for _ in range(rng.randrange(1, 4))]
    if seed % 2:  # a group with more than a third of all rows, in rows that repeat
        rows += [(7, "hot")] * len(rows) + [(None, "hot")] * 3
    rows += [(None, None), (5, None), (5, "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, shard string, key int").repartition(3)
    got = sharding.query(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    group = {}
    for _, t in rows:
        key = hashlib.md5((t or "").encode()).hexdigest()
        group[key] = group.get(key, 0) + len((t or "").encode()) + 1
    left, alone = sum(group.values()), []
    for key in sorted(group, key=lambda k: (-group[k], k))[:7]:
        if group[key] * (8 - len(alone)) <= left:
            break
        alone.append(key)
        left -= group[key]
    rest = sorted(set(group) - set(alone))
    want = {zlib.crc32(b"hot"): i for i, k in enumerate(alone) if k == hashlib.md5(b"hot").hexdigest()}
    _, runs = minimax([group[k] for k in rest], 8 - len(alone)) if rest else (0, [])
    shard_of = {k: i for i, k in enumerate(alone)}
    for i, n in enumerate(runs):
        for k in rest[sum(runs[:i]):sum(runs[:i]) + n]:
            shard_of[k] = len(alone) + i
    of_crc = {(zlib.crc32((t or "").encode())): shard_of[hashlib.md5((t or "").encode()).hexdigest()] for _, t in rows}
    assert all(r["shard"] == of_crc[r["text_crc32"]] for r in got) and want.items() <= of_crc.items()
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_shards_of_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.query(empty).collect() == []
    one = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert [(r["shard"], r["slot"], r["size"]) for r in sharding.query(one).collect()] == [(0, 0, 2)]
    assert {r["shard"] for r in sharding.assign(one, shards=1).collect()} == {0}


@pytest.mark.parametrize("dim", [1, 5])
def test_cells_of_any_depth(dim):
    rng = random.Random(dim)
    for _ in range(200):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))]
        cells = sharding.Cells({f"{i:04x}": (s, 1) for i, s in enumerate(sizes)})
        assert cells.least(dim, True) == cells.least(dim, False) == minimax(sizes, dim)[0]


def some_vectors(rng, n, dim, scale=1.0):
    x = (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * scale).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [None] * dim), (9003, [float("nan")] * dim), (9004, [float("inf")] + [0.0] * (dim - 1)),
           (9005, []), (9006, [1.0]), (9007, rows[0][1]), (9007, rows[0][1]), (None, rows[1][1])]
    return rows, odd


@pytest.mark.parametrize("scale", [0.2, 1e10])
def test_whitening(spark, scale):
    rows, odd = some_vectors(np.random.default_rng(1), 700, 40, scale)
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id bigint, embedding array<float>, component string").repartition(3)
    good = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows + odd[6:]]
    n, sums = len(good), [sum(c) for c in zip(*[v for _, v in good])]
    got = whitening.query(df).collect()
    assert len(got) == 32 * n and {r["n"] for r in got} == {n}
    dev = {}
    for i, v in good:
        dev.setdefault(i, []).append(min(sum((n * x - s) ** 2 for x, s in zip(v, sums)), 2 ** 63 - 1))
    for r in got:
        assert r["deviation"] == dev[r["vec_id"]][0]
    x = np.array([v for _, v in good], np.float64)
    cov = np.cov(x.T, bias=True)
    e = np.linalg.eigvalsh(cov)[::-1][:32]
    share = {r["component"]: r["explained"] for r in got}
    assert np.allclose([share[k + 1] for k in range(32)], e / np.trace(cov), rtol=1e-6)
    assert max(r["identity_error"] for r in got) < 1e-8
    order = {}
    for r in sorted(got, key=lambda r: (r["vec_id"] is None, r["vec_id"], r["component"])):
        order.setdefault(r["vec_id"], []).append(r["whitened"])
    flat = [w for i, _ in good if i != 9007 for w in order[i]] + order[9007][0:64]
    assert abs(np.mean(np.square(flat)) - 1) < 1e-6
    w = np.array([order[i] for i, _ in good[:700]])
    # each column is the projection on a unit eigenvector over the root of its value
    for k in range(32):
        u, *_ = np.linalg.lstsq(x[:700] - x.mean(0), w[:, k] * np.sqrt(e[k]), rcond=None)
        assert abs(np.linalg.norm(u) - 1) < 1e-6 and np.abs(cov @ u - e[k] * u).max() < 1e-6 * e[0]


def test_cross_products_are_exact():
    rng = np.random.default_rng(5)
    for top, n in ((2, 1), (100, 64), (2 ** 20, 77), (2 ** 61, 130)):
        x = rng.integers(-top, top, (n, 7))
        want = x.astype(object).T @ x.astype(object)
        assert (whitening.cross_products(x) == want).all()
    assert (whitening.cross_products(np.full((9, 2), 5)) == 225).all()
    assert whitening.cross_products(np.zeros((0, 3), np.int64)).shape == (3, 3)


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.query(spark.createDataFrame([], schema)).collect() == []
    assert whitening.query(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect() == []
    # the second dimension is constant, the third twice the first
    rows = [(i, [i / 8, 3.0, i / 4]) for i in range(50)]
    got = whitening.query(spark.createDataFrame(rows, schema)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12 and got[0]["identity_error"] < 1e-9


def lloyd(rows, k, rounds):
    kept = [(i, [int(np.floor(1024.0 * c)) for c in v]) for i, v in rows]
    named = [(hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None]
    cents = [v for _, _, v in sorted(named)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], cents


@pytest.mark.parametrize("kind", ["blobs", "ties", "huge"])
def test_clusters_are_lloyds(spark, kind):
    rng = np.random.default_rng(9)
    if kind == "blobs":
        centre = rng.normal(size=(12, 64))
        x = centre[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 64))
    elif kind == "ties":  # few distinct vectors, so that start centroids are equal and some stay empty
        x = rng.integers(0, 2, (300, 64)) * (np.arange(64) < 3) / 1024
    else:
        x = rng.normal(size=(120, 64)) * 1e9
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [None] * 64), (9003, [float("nan")] * 64), (9004, [0.0] * 63), (9005, []), (9006, [0.0] * 65)]
    more = [(7, rows[7][1]), (None, rows[8][1]), (None, rows[8][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd + more], "vec_id bigint, embedding array<double>, cluster string").repartition(3)
    want, cents = lloyd(rows + more, 8, 10)
    found, ends, popped = centroids.cluster(df)
    got = centroids.with_inertia(found, ends).collect()
    key = lambda t: (t[0] is None, t)
    top = 2 ** 63 - 1
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(
        ((i, c, min(d, top)) for i, c, d in want), key=key)
    total = sum(min(d, top) for *_, d in want)
    assert {r["inertia"] for r in got} == {min(total, top)}
    for r in got:
        assert r["cluster_inertia"] == min(sum(min(d, top) for _, c, d in want if c == r["cluster"]), top)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()
    assert popped[0] == len(want) and len(popped) == 11
    if kind == "blobs":  # only what expires is measured again
        assert sum(popped[1:]) < 0.7 * 10 * len(want)


def test_clusters_of_few_vectors(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert centroids.query(spark.createDataFrame([], schema)).collect() == []
    got = centroids.query(spark.createDataFrame([(4, [0.5] * 64), (5, [float("nan")] * 64)], schema)).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in got] == [(4, 0, 0, 0)]
