"""N-gram Jaccard join: links between texts whose word n-gram sets are similar, and their components.

Sets of n-gram hashes (64 bit) are joined by rare-first prefix filtering. Any fixed order of the
n-grams makes prefix filtering exact; here n-grams whose hash lies in the first `share` of the hash range
come first (a text with too few of them for its prefix gives all its n-grams), and within both parts
the rarest first, by exact document frequency over all texts. So only that share of the n-grams is
counted and shuffled. An n-gram that occurs once can't link anything, and a text whose prefix
holds no other is done: in most corpora that is nearly every text.

For the rest ("open" texts):
1. equal sets are one class from the start (copies are never compared);
2. each class joins the classes that share its most frequent prefix n-gram. Such a group is cut
   into chunks of at most `CHUNK` classes, each with the group's least unusual class as its pivot; a chunk
   verifies what its filters leave, skipping pairs that are connected already;
   Then the least unusual class of each component that an n-gram meets is compared with those of the
   other components there, in the same way: copies of one text mostly part by their most frequent n-gram;
3. every prefix n-gram whose classes are not all connected yet is joined in block pairs: length,
   positional and suffix filters drop pairs, and what remains, between different components only,
   is verified once per pair, at the first prefix n-gram that both sets hold. The group that finds a link
   skips what it connects from then on, so it returns fewer links than it has components. Sets of more than
   LONG n-grams aren't sent to the groups; their pairs are verified afterwards;
4. connected components of all verified links give each document's component.

The suffix filter bounds the symmetric difference from below by a histogram of the sets' hashes.

Defined results: null and empty texts (no words) have an empty set and link with nothing; fewer
than n words make one n-gram; a null id links with nothing and gets a null component; repeated rows are
copies; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ngrams as ng
from .common import blocks, small_side, utf8, written

SHARE = 3 / 16
CHUNK = 512
BLOCK = 1024
BUCKET_ROWS = 8192
BINS = 512
#: sets of more n-grams are known in block pairs by their histogram only
LONG = 256


def least_overlap(n, m, num: int, den: int):
    """Smallest intersection of sets of n and m at which den * inter >= num * union."""
    return -(-(num * (n + m)) // (num + den))


def prefix_length(n, num: int, den: int):
    """So many n-grams of a set of n must hold one of any partner's prefix."""
    return n - -(-(num * n) // den) + 1


def sets_of(rb: pa.RecordBatch, text: str, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    data, offs = utf8(rb.column(text))
    _, _, doc, h = ng.words(data, offs, ng.BLANK)
    count = np.bincount(doc, minlength=rb.num_rows)
    ends = np.cumsum(count)
    g = ng.grams(h, n)
    out = []
    for c, e in zip(count.tolist(), ends.tolist()):
        if c >= n:
            out.append(np.unique(g[e - c:e - n + 1]))
        elif c:  # all words as one n-gram, told apart from others by its length
            out.append(ng.mix(ng.grams(h[e - c:e], c) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def head(s: np.ndarray, share: float, num: int, den: int) -> np.ndarray:
    """The n-grams that can lie in the set's prefix: those of the first part, or all if these are too few."""
    k = int(np.searchsorted(s, np.uint64(int(share * 2 ** 64))))
    return s[:k] if k >= prefix_length(len(s), num, den) else s


def _classes(text: str, n: int, share: float):
    def run(batches):
        limit = np.uint64(int(share * 2 ** 64))
        for batch in batches:
            for rb in blocks(batch, text):
                s = sets_of(rb, text, n)
                yield pa.RecordBatch.from_arrays([
                    rb.column("doc_id"), rb.column("th"), pa.array([len(x) for x in s], pa.int64()),
                    pa.array([class_key(x) for x in s], pa.int64()),
                    pa.array([int(np.searchsorted(x, limit)) for x in s], pa.int64())],
                    names=["doc_id", "th", "n", "node", "n_first"])
    return run


def _tokens(text: str, n: int, share: float, num: int, den: int):
    def run(batches):
        for batch in batches:
            for rb in blocks(batch, text):
                s = [x for x in sets_of(rb, text, n) if len(x)]
                heads = [head(x, share, num, den) for x in s]
                node = np.array([class_key(x) for x in s], np.int64)
                if heads:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(heads).view(np.int64)),
                        pa.array(np.repeat(node, [len(x) for x in heads]))], names=["token", "node"])
    return run


def histogram(s: np.ndarray) -> bytes:
    """Histogram of a set's hashes by some of their bits. Counts stop at 255, which can only lower differences."""
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def _histograms(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, BINS)


def _sets(text: str, n: int):
    def run(batches):
        for batch in batches:
            for rb in blocks(batch, text):
                s = sets_of(rb, text, n)
                yield pa.RecordBatch.from_arrays([
                    pa.array([class_key(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary()),
                    pa.array([histogram(x) for x in s], pa.binary())], names=["node", "grams", "hist"])
    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b| of sorted sets."""
    inter = int(np.intersect1d(a, b, assume_unique=True).size)
    return den * inter >= num * (len(a) + len(b) - inter)


def _difference(hist: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Lower bound of the symmetric difference of set i and each of the sets js."""
    return np.abs(hist[js].astype(np.int16) - hist[i]).sum(1, dtype=np.int32)


def _chunk_links(num: int, den: int):
    """Links that connect what is connected in a chunk of classes (spanning only)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values(["unusual", "node"]).reset_index(drop=True)
        grams = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        hist = _histograms(pdf["hist"])
        n = np.array([len(g) for g in grams], np.int64)
        root = np.arange(len(n))
        node, out = pdf["node"].to_numpy(), []
        for i in range(len(n) - 1):
            js = np.arange(i + 1, len(n))
            js = js[root[js] != root[i]]
            need = least_overlap(n[i], n[js], num, den)
            js = js[(need <= np.minimum(n[i], n[js])) & (_difference(hist, i, js) <= n[i] + n[js] - 2 * need)]
            for j in js:
                if root[j] != root[i] and linked(grams[i], grams[j], num, den):
                    root[root == root[j]] = root[i]
                    out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _block_links(num: int, den: int):
    """Links between classes in different components, among the rows of some n-grams; only those that connect
    what isn't connected yet in the group, so at most one less than its components. Rows with `side` 0 lie in a block met with itself,
    sides 1 and 2 in two different blocks of one n-gram.

    A pair is compared at the first prefix n-gram that both sets hold, so nothing in front of it is in
    both. Pairs with a set of more than LONG n-grams come out unverified (`sure` false), once per group."""
    def run(pdf: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", kind="stable")
        token = pdf["token"].to_numpy()
        node, n, pos, side = (pdf[c].to_numpy() for c in ("node", "n", "pos", "side"))
        names, label = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        root = np.arange(len(names))
        there = there.sort_values("node")
        grams = [None if g is None else np.frombuffer(g, np.uint64) for g in there["grams"]]
        hist = _histograms([h if g is None else histogram(g) for g, h in zip(grams, there["hist"])])
        prefix = [None if g is None else p.tolist() for g, p in zip(grams, there["prefix"])]
        at = np.searchsorted(there["node"].to_numpy(), node)
        cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        links, unsure = [], set()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = np.arange(lo, hi)
            left = rows[side[rows] < 2] if side[lo:hi].any() else rows[:-1]
            front: dict[int, frozenset] = {}  # a row's prefix n-grams in front of this one

            def in_front(i):
                if i not in front:
                    p = prefix[at[i]]
                    front[i] = frozenset(p[:p.index(token[i])])
                return front[i]

            for i in left:
                js = rows[side[rows] == 2] if side[i] else np.arange(i + 1, hi)
                js = js[root[label[js]] != root[label[i]]]
                if not len(js):
                    continue
                need = least_overlap(n[i], n[js], num, den)
                keep = np.minimum(n[i] - pos[i], n[js] - pos[js]) >= need
                js, need = js[keep], need[keep]
                js = js[_difference(hist, at[i], at[js]) <= n[i] + n[js] - 2 * need]
                for j in js:
                    if root[label[i]] == root[label[j]]:
                        continue
                    a, b = grams[at[i]], grams[at[j]]
                    if a is None or b is None:
                        unsure.add((min(node[i], node[j]), max(node[i], node[j]), False))
                    elif in_front(i).isdisjoint(in_front(j)) and linked(a, b, num, den):
                        root[root == root[label[j]]] = root[label[i]]
                        links.append((node[i], node[j], True))
        return pd.DataFrame(links + sorted(unsure), columns=["a", "b", "sure"]).astype({"a": "int64", "b": "int64", "sure": bool})
    return run


def _verify(num: int, den: int):
    def run(batches):
        for rb in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den)
                  for x, y in zip(rb.column("ga").to_pylist(), rb.column("gb").to_pylist())]
            yield pa.RecordBatch.from_arrays([rb.column("a"), rb.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, label (the smallest node of its component) for every node of the links.

    Each round every node hooks onto its smallest neighbour, the trees this makes are followed to their
    roots, and the edges are contracted to edges between roots. At least half of the nodes of
    a component that isn't done disappear each round, and most edges with them."""
    def undirected(df: DataFrame) -> DataFrame:
        return written(df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), f"{name}-edges")

    edges, label = undirected(links.select("a", "b")), None
    while True:
        both = edges.union(edges.select("b", "a"))
        hook = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")),
                       f"{name}-hooks")
        while True:
            above = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            hook = written(hook.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root"))
                                                           .alias("moved")), f"{name}-hooks")
            moved = hook.filter("moved").limit(1).count()
            hook = hook.select("node", "root")
            if not moved:
                break
        label = hook.withColumnRenamed("root", "label") if label is None else written(
            label.join(hook.select(F.col("node").alias("label"), "root"), "label", "left")
            .select("node", F.coalesce("root", "label").alias("label")), f"{name}-labels")
        at_a = edges.join(hook.withColumnRenamed("node", "a"), "a").select(F.col("root").alias("ra"), "b")
        edges = undirected(at_a.join(hook.withColumnRenamed("node", "b"), "b").select(
            F.col("ra").alias("a"), F.col("root").alias("b")))
        if not edges.limit(1).count():
            return label


def _prefixes(classes: DataFrame, tokens: DataFrame, share: float, num: int, den: int) -> DataFrame:
    """token, node, n, pos (its place in the set's order, from 0), df, unusual (the set's n-grams of
    frequency one) of the repeated n-grams in the prefixes of the open classes."""
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    rep = tokens.join(df, "token").join(classes.select("node", "n", "n_first"), "node")
    # the hash is unsigned; the first part holds the positive longs below share * 2^64
    rep = rep.withColumn("part", F.when((F.col("token") >= 0) & (F.col("token") < int(share * 2 ** 64)), 0).otherwise(1))
    per = Window.partitionBy("node")
    order = per.orderBy("part", "df", "token")
    rep = (rep.withColumn("r0", F.sum((F.col("part") == 0).cast("bigint")).over(per))
           .withColumn("r1", F.sum(F.col("part").cast("bigint")).over(per))
           .withColumn("rank", F.row_number().over(order) - 1))
    p = F.expr(f"n - CAST(ceil({num} * n / {den}) AS BIGINT) + 1")
    all_given = F.col("n_first") < p
    once0 = F.col("n_first") - F.col("r0")
    once1 = F.when(all_given, F.col("n") - F.col("n_first") - F.col("r1")).otherwise(0)
    pos = F.col("rank") + once0 + F.when(F.col("part") == 1, once1).otherwise(0)
    return rep.select("token", "node", "n", pos.alias("pos"), "df", (once0 + once1).alias("unusual"), p.alias("p")) \
        .filter("pos < p").drop("p")


def _home_chunks(prefixes: DataFrame) -> DataFrame:
    """home, chunk, node, unusual: each class at its most frequent prefix n-gram, in chunks that each
    hold the home's pivot too."""
    home = prefixes.groupBy("node").agg(F.max_by("token", F.struct("df", "token")).alias("home"),
                                        F.first("unusual").alias("unusual"))
    return _dealt(home)


def _met_chunks(prefixes: DataFrame, label: DataFrame) -> DataFrame:
    """home, chunk, node, unusual: at each n-gram whose classes are in several components, the least unusual
    class of each. Of the n-grams between the same two outermost components that with most components stands for all."""
    met = prefixes.join(label, "node", "left").groupBy("token", F.coalesce("label", "node").alias("label")) \
        .agg(F.min(F.struct("unusual", "node")).alias("least"))
    met = written(met, "met")
    homes = met.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")) \
        .filter("lo <> hi").groupBy("lo", "hi").agg(F.max_by("token", F.struct("k", "token")).alias("token"))
    return _dealt(met.join(homes.select("token"), "token").select(F.col("token").alias("home"), "least.node", "least.unusual"))


def _dealt(home: DataFrame) -> DataFrame:
    """The classes of each home in chunks that each hold the home's pivot too."""
    size = home.groupBy("home").agg(F.count("*").alias("size"), F.min(F.struct("unusual", "node")).alias("pivot")) \
        .filter("size > 1")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = home.join(size, "home").select("home", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"),
                                           "node", "unusual")
    pivots = size.select("home", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"),
                         F.col("pivot.node").alias("node"), F.col("pivot.unusual").alias("unusual"))
    return dealt.unionByName(pivots)


def _open_links(prefixes: DataFrame, label: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, sure: links between different components, and unverified pairs of them that pass all filters."""
    rows = prefixes.select("token", "node", "n", "pos").join(label, "node", "left") \
        .withColumn("label", F.coalesce("label", "node"))
    # n-grams of the same texts mostly share their smallest class, so a group of them finds a pair once
    open_tokens = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                            F.count("*").alias("size"), F.min("node").alias("lead")) \
        .filter("lo <> hi").select("token", "size", "lead")
    open_tokens = written(open_tokens, "open-tokens")
    per_lead = open_tokens.filter(F.col("size") <= BLOCK).groupBy("lead").agg(F.sum("size").alias("lead_rows"))
    buckets = max(1, -(-(open_tokens.agg(F.sum("size")).first()[0] or 0) // BUCKET_ROWS))
    parts = F.ceil(F.coalesce("lead_rows", F.lit(1)) / (8 * BUCKET_ROWS)).cast("int")
    small_key = F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("token"), parts)), F.lit(buckets))
    open_tokens = open_tokens.join(per_lead, "lead", "left").select(
        "token", F.ceil(F.col("size") / BLOCK).cast("int").alias("nb"),
        F.when(F.col("size") <= BLOCK, small_key).otherwise(F.col("token")).alias("key"))
    rows = rows.join(open_tokens, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    # an n-gram of several blocks: each block meets itself and every other one
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "token", "node", "label", "n", "pos", "key",
        F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    spread = written(spread, "open-rows")
    group = ["key", "x", "y"]
    ordered = prefixes.filter(F.col("n") <= LONG).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("p")) \
        .select("node", F.col("p.token").alias("prefix"))
    short = F.length("grams") <= 8 * LONG
    known = sets.join(ordered, "node", "left").select("node", F.when(short, F.col("grams")).alias("grams"),
                                                      F.when(~short, F.col("hist")).alias("hist"), "prefix")
    there = written(spread.select(*group, "node").distinct().join(known, "node"), "open-sets")
    return (spread.groupBy(*group).cogroup(there.groupBy(*group))
            .applyInPandas(_block_links(num, den), "a bigint, b bigint, sure boolean"))


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, num: int = 90,
                   den: int = 100, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(rows, links): per document its id, set size, class and component_id (smallest id reachable by
    links); and the verified links between classes that connect them."""
    if not 0 < num <= den or n < 1:
        raise ValueError("0 < num <= den and n >= 1 are needed")
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")) \
        .withColumn("th", F.xxhash64("t"))
    kind = src.schema["doc_id"].dataType.simpleString()
    rows = written(src.select("doc_id", "th", "t").mapInArrow(
        _classes("t", n, share), f"doc_id {kind}, th bigint, n bigint, node bigint, n_first bigint"), "classes")
    named = rows.filter("doc_id IS NOT NULL AND n > 0")
    per_class = named.groupBy("node", "n", "n_first").agg(F.min(F.struct("doc_id", "th")).alias("rep"),
                                                          F.count("*").alias("copies"))
    per_class = written(per_class.select("node", "n", "n_first", "rep", "copies"), "per-class")
    several = named.join(per_class.filter("copies > 1").select("node", "rep"), "node") \
        .groupBy("doc_id", "th").agg(F.first(F.struct("doc_id", "th") == F.col("rep")).alias("is_rep"), F.count("*").alias("k"))
    several = written(several.filter("NOT is_rep OR k > 1"), "copies")
    firsts = src.filter("doc_id IS NOT NULL").join(small_side(several.select("doc_id", "th")), ["doc_id", "th"], "left_anti")
    # a class whose own row is repeated gives its n-grams once
    again = small_side(several.filter("is_rep").select("doc_id", "th"))
    repeated = src.join(again, ["doc_id", "th"], "left_semi")

    def tokens_of(df: DataFrame) -> DataFrame:
        return df.select("t").mapInArrow(_tokens("t", n, share, num, den), "token bigint, node bigint")

    tokens = tokens_of(firsts)
    if again.limit(1).count():
        tokens = tokens.unionByName(tokens_of(repeated).distinct())
    prefixes = written(_prefixes(per_class, tokens, share, num, den), "prefixes")
    shared = prefixes.groupBy("token").count().filter("count > 1").select("token")
    prefixes = written(prefixes.join(shared, "token"), "prefixes")

    open_docs = per_class.join(prefixes.select("node").distinct(), "node", "left_semi").select("rep.doc_id", "rep.th")
    sets = written(src.join(small_side(written(open_docs.distinct(), "open")), ["doc_id", "th"], "left_semi").select("t")
                   .mapInArrow(_sets("t", n), "node bigint, grams binary, hist binary").dropDuplicates(["node"]), "sets")

    def linked_in(chunks: DataFrame) -> DataFrame:
        return chunks.join(sets, "node").groupBy("home", "chunk").applyInPandas(_chunk_links(num, den), "a bigint, b bigint")

    near = written(linked_in(_home_chunks(prefixes)), "near-links")
    label = components(near, "near")
    near = written(near.unionByName(linked_in(_met_chunks(prefixes, label))), "met-links")
    label = components(near, "met")
    open_links = written(_open_links(prefixes, label, sets, num, den), "open-links")
    far = open_links.filter("NOT sure").select("a", "b").distinct().join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b") \
        .select("a", "b", "ga", "gb").mapInArrow(_verify(num, den), "a bigint, b bigint")
    links = written(near.unionByName(open_links.filter("sure").select("a", "b")).unionByName(far), "links")

    label = components(links, "all")
    labelled = rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.filter("doc_id IS NOT NULL AND n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = labelled.join(least, "label", "left").select(
        F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("node")).alias("class"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    return out, links


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, num: int = 90,
             den: int = 100) -> DataFrame:
    """The rows of `docs` that are their component's smallest id. Rows that repeat an id and its text
    count as one; rows without words or id stay as they are."""
    # the counted share keeps its ratio to the prefixes' share; the first part must be positive longs
    share = min(SHARE * 10 * (den - num) / den, 15 / 32)
    rows, _ = link_documents(docs, doc_id, text, n, num, den, share)
    known = rows.filter(f"n_shingles > 0 AND {doc_id} IS NOT NULL")
    others = known.filter(f"component_id <> {doc_id}").select(doc_id).distinct()
    again = known.groupBy(doc_id).count().filter("count > 1").select(doc_id)
    kept = docs.join(small_side(written(others, "others")), doc_id, "left_anti")
    again = small_side(written(again, "again"))
    once = kept.join(again, doc_id, "left_anti")
    repeated = kept.join(again, doc_id, "left_semi")
    one = repeated.groupBy(F.col(doc_id), F.xxhash64(text)).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return once.select(*docs.columns).unionByName(one)


def query(docs: DataFrame) -> DataFrame:
    rows, _ = link_documents(docs)
    return rows.select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS m FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a)
SELECT n.doc_id, n.n AS n_shingles, CAST(least(n.doc_id, coalesce(min(r.m), n.doc_id)) AS BIGINT) AS component_id
FROM n LEFT JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
