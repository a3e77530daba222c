"""Benchmark decontamination by winnowing.

Fingerprints: of every `window - k + 1` consecutive k-gram hashes the smallest is kept (all that
tie), so two texts that share `window` words share a fingerprint at the same place of that span.
The documents' fingerprints are looked up among the benchmark's, each hit is extended to both
sides, and the spans of at least `window` equal words are reported.

Items of fewer than `window` words have no complete window; each is one span as a whole, found by
its own n-gram (only the lengths that occur are hashed).

The benchmark's index is broadcast in blocks of at most `block_words` words: one block for usual
benchmarks, otherwise one pass over the documents per block, which adds to the rows' spans and is
written before the next one. A block holds each distinct window once, with the list of its items, so a line
that many items share costs its places plus its items, not their product.

Defined results: null and empty texts have no words and no spans; repeated rows and null ids are
judged each for itself; an empty benchmark hits nothing; items with null text or no words never
occur; items with a null id count for `n_hit`, but aren't named.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams as ng
from .common import blocks, fresh, utf8, written

K = 7
SPANS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([      # word positions, end exclusive, merged
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW = pa.struct([("n_words", pa.int64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ("items", pa.list_(pa.string()))])


def fingerprints(g: np.ndarray, w: int) -> np.ndarray:
    """Places of the k-grams that are smallest in some w consecutive ones. At the ends the
    incomplete windows count too, which can only add places."""
    n = len(g)
    if n == 0:
        return np.zeros(0, np.int64)
    top = np.full(w - 1, np.iinfo(np.uint64).max, np.uint64)
    pad = np.concatenate([top, g, top])
    low = pad[:n + w - 1].copy()
    for j in range(1, w):
        np.minimum(low, pad[j:j + n + w - 1], out=low)
    high = low[:n].copy()                       # the largest of the minima of a gram's windows
    for j in range(1, w):
        np.maximum(high, low[j:j + n], out=high)
    return np.flatnonzero(high == g)


@dataclass
class Windows:
    """The distinct windows of one length, sorted by hash: where one of each stands among the words, and the items of each
    (those of window c are items[start[c]:start[c + 1]])."""

    key: np.ndarray
    place: np.ndarray
    start: np.ndarray
    items: np.ndarray

    def match(self, index_word: np.ndarray, word: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places `at` where a window begins whose words are all equal, and which window."""
        if not len(self.key) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = ng.grams(word, n)[at]
        c = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        hit = self.key[c] == h
        at, c = at[hit], c[hit]
        same = np.ones(len(at), bool)
        for i in range(n):
            same &= word[at + i] == index_word[self.place[c] + i]
        return at[same], c[same]

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([self.items[self.start[c]:self.start[c + 1]] for c in np.unique(windows)]))


def _windows(h: np.ndarray, at: np.ndarray, item: np.ndarray) -> Windows:
    """From the windows' hashes, places and items."""
    order = np.lexsort((item, h))
    h, at, item = h[order], at[order], item[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    pair = new.copy()
    pair[1:] |= item[1:] != item[:-1]
    return Windows(h[new], at[new].astype(np.int32), np.append(np.flatnonzero(new[pair]), pair.sum()).astype(np.int32), item[pair].astype(np.int32))


@dataclass
class Index:
    """A block of benchmark items: its words, its distinct fingerprints, and its distinct windows by length."""

    ids: list[str | None]
    word: np.ndarray
    fp: np.ndarray          # sorted
    windows: dict[int, Windows]


def build_index(ids: list[str | None], counts: np.ndarray, word: np.ndarray, window: int, k: int) -> Index:
    ends = np.cumsum(counts)
    item = np.repeat(np.arange(len(ids)), counts)
    g = ng.grams(word, k)
    at = fingerprints(g, window - k + 1)
    at = at[(item[at] == item[at + k - 1]) & (counts[item[at]] >= window)] if len(at) else at
    h = ng.grams(word, window)
    whole = np.flatnonzero(item[:len(h)] == item[len(item) - len(h):])
    windows = {window: _windows(h[whole], whole, item[whole])}
    for n in np.unique(counts[(counts > 0) & (counts < window)]).tolist():
        which = np.flatnonzero(counts == n)
        windows[n] = _windows(ng.grams(word, n)[ends[which] - n], ends[which] - n, which)
    return Index(ids, word, np.unique(g[at]), windows)


def find(index: Index, word: np.ndarray, doc: np.ndarray, window: int, k: int):
    """(first word, length, window) of each occurring window, by first word. Only places around a fingerprint of the
    benchmark are looked at for complete windows; however many items hold a window, it is met once a place."""
    out = []
    for n, known in index.windows.items():
        if n == window:
            g = ng.grams(word, k)
            at = fingerprints(g, window - k + 1)
            at = at[np.isin(g[at], index.fp)]
            near = np.zeros(len(word) + 1, np.int64)      # places that begin a window around a fingerprint
            np.add.at(near, np.maximum(at - (window - k), 0), 1)
            np.add.at(near, at + 1, -1)
            at = np.flatnonzero(np.cumsum(near) > 0)
        else:
            at = np.arange(len(word))
        at = at[at + n <= len(word)]
        at = at[doc[at] == doc[at + n - 1]]
        at, c = known.match(index.word, word, at, n)
        out.append(np.stack([at, np.full(len(at), n), c]))
    found = np.concatenate(out, axis=1)
    return found[:, np.argsort(found[0], kind="stable")]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(index_bc, text: str, out: str, keep: list[str], window: int, k: int, earlier: bool):
    def run(batches):
        index = index_bc.value
        for batch in batches:
            for rb in blocks(batch, text):
                _, _, doc, h = ng.words(*utf8(rb.column(text)), ng.ALNUM)
                n_words = np.bincount(doc, minlength=rb.num_rows)
                first = np.cumsum(n_words) - n_words
                s, n, item = find(index, h, doc, window, k)
                rows: list[dict] = [{"n_words": int(c), "spans": [], "items": []} for c in n_words]
                if earlier:
                    for r, old in zip(rows, rb.column(out).to_pylist()):
                        r["spans"] = [(x["start"], x["end"]) for x in old["spans"]]
                        r["items"] = old["items"]
                d = doc[s] if len(s) else s
                for r in np.unique(d):
                    mine = slice(*np.searchsorted(d, [r, r + 1]))
                    a, length, which = s[mine] - first[r], n[mine], item[mine]
                    reach = np.maximum.accumulate(a + length)
                    cut = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
                    spans = list(zip(a[cut].tolist(), reach[np.append(cut[1:], len(a)) - 1].tolist()))
                    names = {index.ids[i] for m in np.unique(length).tolist()
                             for i in index.windows[m].items_of(which[length == m]).tolist()} - {None}
                    rows[r]["spans"] = _merge(rows[r]["spans"] + spans)
                    rows[r]["items"] = sorted(names.union(rows[r]["items"]))
                for r in rows:
                    r["spans"] = [{"start": a, "end": b} for a, b in r["spans"]]
                cols = [rb.column(c) for c in keep] + [pa.array(rows, _ARROW)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, out])
    return run


def _item_words(window_text: str):
    def run(batches):
        for rb in batches:
            _, _, doc, h = ng.words(*utf8(rb.column(window_text)), ng.ALNUM)
            n = np.bincount(doc, minlength=rb.num_rows)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [rb.column("id"), pa.array([h[e - c:e].tobytes() for c, e in zip(n, ends)], pa.binary())],
                names=["id", "words"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", keep: list[str] | None = None, window: int = 13, k: int = K,
                  block_words: int = 4_000_000) -> tuple[DataFrame, str]:
    """The `keep` columns of `docs` (all by default) and a struct (n_words, merged word spans that
    lie in windows of the benchmark, ids of the items found); returned with the struct's name."""
    if not 0 < k <= window:
        raise ValueError("k must lie in 1 .. window")
    spark = docs.sparkSession
    keep = list(docs.columns) if keep is None else keep
    out = fresh(docs, "contamination")
    items = (benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t"))
             .mapInArrow(_item_words("t"), "id string, words binary").filter(F.length("words") > 0))
    total = items.agg(F.sum(F.length("words")) / 8).first()[0] or 0
    n_blocks = max(1, -int(-total // block_words))
    if n_blocks > 1:
        items = written(items, "benchmark")  # read once a block
    kinds, whole = {f.name: f for f in docs.schema.fields}, list(docs.columns)
    schema = T.StructType([*(kinds[c] for c in keep), T.StructField(out, SPANS)])
    for b in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("id", "words"), F.lit(n_blocks)) == b).collect()
        counts = np.array([len(r["words"]) // 8 for r in part], np.int64)
        word = np.frombuffer(b"".join(bytes(r["words"]) for r in part), np.uint64)
        bc = spark.sparkContext.broadcast(build_index([r["id"] for r in part], counts, word, window, k))
        last = b == n_blocks - 1
        cols = keep if last else whole
        src = docs if b else docs.select(*dict.fromkeys([*keep, text])) if last else docs
        docs = src.mapInArrow(_scan(bc, text, out, cols, window, k, b > 0),
                              schema if last else T.StructType([*(kinds[c] for c in cols), T.StructField(out, SPANS)]))
        if not last:
            docs = written(docs, "decontamination")  # one block at a time in memory
            bc.unpersist()
    return docs, out


def n_hit(out: str):
    """Words in the spans."""
    return F.aggregate(f"{out}.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])


def is_contaminated(out: str, share: int = 20):
    """At least one word, and at least 1 / share of all words, lie in benchmark windows."""
    return (n_hit(out) > 0) & (share * n_hit(out) >= F.col(f"{out}.n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, without those that are contaminated."""
    flagged, out = contamination(docs, benchmark, text)
    return flagged.filter(~is_contaminated(out)).select(*docs.columns)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: counts of words, hit words and items, digest of the items, verdict."""
    flagged, out = contamination(docs, benchmark, keep=["doc_id"])
    return flagged.select(
        "doc_id", F.col(f"{out}.n_words").alias("n_words"), n_hit(out).alias("n_hit"),
        F.size(f"{out}.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(f"{out}.items", ","), 256).alias("items_sha256"),
        is_contaminated(out).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM
    (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM
    (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT r, dw.n, s, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
