"""Language identification by nearest centroids.

A text is the normalised TF-IDF vector of its hashed byte trigrams (A-Z lowered, runs of other
ASCII signs and digits read as one blank). Each language has up to `CLUSTERS` centroids, from
k-means by cosine on a bounded sample of its documents; a text gets the language of its nearest centroid.
A text farther from that centroid than nearly all of the language's sample is marked `rejected`.

Document frequencies are counted over all training documents. The sample has at most `SAMPLE` documents,
the same number a language, those with the smallest hash of their id.

Defined results: null texts and texts without a letter are `und` with score 0, and so is every text if nothing could be
learned; rows with null language or null id aren't learned from; repeated rows are judged each for itself; other columns
aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, utf8

DIM = 4096
SAMPLE = 4000
CLUSTERS = 4
ROUNDS = 12
FOLDS = 5
UNKNOWN = "und"
MOST_LANGUAGES = 500
#: share of a language's sample that lies beyond its rejection distance
REJECT = 0.002
ROWS = 256

_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[65:91] += 32
_SPACE[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def counts(col: pa.Array) -> np.ndarray:
    """Trigram counts (rows x DIM) of at most ROWS texts."""
    data, offs = utf8(col)
    low, n = _SPACE[data], len(col)
    if len(low) < 3:
        return np.zeros((n, DIM))
    edge = (low[:-1] == 32) & (low[1:] == 32)       # drop all but one of a run's blanks, but never a text's border
    keep = np.concatenate([~edge, [True]])
    doc = np.repeat(np.arange(n), np.diff(offs))[keep]
    low = low[keep].astype(np.int64)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    feat = ((code * 0x9E3779B1) >> 12) & (DIM - 1)
    whole = doc[:-2] == doc[2:]
    return np.bincount(doc[:-2][whole] * DIM + feat[whole], minlength=n * DIM).reshape(n, DIM).astype(float)


def has_letter(col: pa.Array) -> np.ndarray:
    data, offs = utf8(col)
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    cum = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = cum[offs[1:]] > cum[offs[:-1]]
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])):
        out[i] = any(c.isalpha() for c in data[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k unit centroids of unit vectors by cosine; starts from the farthest points."""
    centre = x.mean(0)
    best = [int(np.argmax(x @ centre))]
    near = x @ x[best[0]]
    while len(best) < min(k, len(x)):
        i = int(np.argmin(near))
        if near[i] > 1 - 1e-9:
            break
        best.append(i)
        near = np.maximum(near, x @ x[i])
    c = x[best]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, 1)
        new = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.sqrt((new * new).sum(1, keepdims=True)), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray      # rows x DIM
    language: np.ndarray       # of each centroid
    least: np.ndarray          # cosine below which a text is rejected, by language

    def predict(self, col: pa.Array):
        """(language, score, rejected) of at most ROWS texts."""
        n, letters = len(col), has_letter(col)
        if not len(self.centroids):
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        sim = vectors(counts(col), self.idf) @ self.centroids.T
        at = np.argmax(sim, 1)
        score = np.where(letters, np.clip(sim[np.arange(n), at], 0, 1), 0.0)
        lang = self.language[at]
        return ([self.languages[i] if ok else UNKNOWN for i, ok in zip(lang, letters)], score,
                ~letters | (score < self.least[lang]))


def _frequencies(batches):
    total, n = np.zeros(DIM, np.int64), 0
    for b in batches:
        for rb in blocks(b, "text"):
            for lo in range(0, rb.num_rows, ROWS):
                total += (counts(rb.column("text").slice(lo, ROWS)) > 0).sum(0)
        n += b.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(total, n))], names=["feature", "n"])


def _sample_counts(batches):
    for b in batches:
        for rb in blocks(b, "text"):
            for lo in range(0, rb.num_rows, ROWS):
                part = rb.slice(lo, ROWS)
                c = counts(part.column("text"))
                rows = [np.flatnonzero(x) for x in c]
                yield pa.RecordBatch.from_arrays([
                    part.column("lang"), part.column("rank"),
                    pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary()),
                    pa.array([np.minimum(x[r], 65535).astype("<u2").tobytes() for x, r in zip(c, rows)], pa.binary())],
                    names=["lang", "rank", "features", "counts"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
          clusters: int = CLUSTERS) -> Model:
    """Fit on documents with a language whose crc32(id as text) mod FOLDS is not 0."""
    learn = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")) \
        .filter(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS != 0) \
        .filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    names = sorted(sizes)
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    empty = Model([], np.ones(DIM), np.zeros((0, DIM)), np.zeros(0, np.int64), np.zeros(0))
    if not names:
        return empty
    df = np.zeros(DIM + 1)
    for r in learn.select("text").mapInArrow(_frequencies, "feature bigint, n bigint").groupBy("feature").sum("n").collect():
        df[r[0]] = r[1]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 0.1
    each = max(1, sample // len(names))
    # the smallest hashes of a language, first by a share of the hash range that holds some four times as many
    far = F.coalesce(*[F.when(F.col("lang") == n, min(1.0, (4 * each + 64) / c)) for n, c in sizes.items()])
    w = Window.partitionBy("lang").orderBy("hash", "id")
    picked = learn.withColumn("hash", F.xxhash64("id")) \
        .filter(F.col("hash").cast("double") / 2.0 ** 64 + 0.5 <= far) \
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each)
    rows = picked.select("lang", "rank", "text").mapInArrow(
        _sample_counts, "lang string, rank int, features binary, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["rank"], bytes(r["features"])))
    centroids, language, least = [], [], np.zeros(len(names))
    for i, name in enumerate(names):
        mine = [r for r in rows if r["lang"] == name]
        c = np.zeros((len(mine), DIM))
        for x, r in zip(c, mine):
            x[np.frombuffer(bytes(r["features"]), "<u2")] = np.frombuffer(bytes(r["counts"]), "<u2")
        v = vectors(c, idf)
        v = v[v.any(1)]
        if len(v):
            own = cluster(v, clusters)
            centroids.append(own)
            language += [i] * len(own)
            least[i] = np.quantile((v @ own.T).max(1), REJECT)
    return Model(names, idf, np.concatenate(centroids), np.array(language), least) if centroids else empty


def _predict(bc, text: str, keep: list[str]):
    def run(batches):
        model = bc.value
        for b in batches:
            for rb in blocks(b, text):
                for lo in range(0, rb.num_rows, ROWS):
                    part = rb.slice(lo, ROWS)
                    lang, score, rejected = model.predict(part.column(text))
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                        names=[*keep, "lang_pred", "score", "rejected"])
    return run


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), rejected; from the text alone."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(
        _predict(bc, text, [doc_id]), f"`{doc_id}` {kind}, lang_pred string, score double, rejected boolean")


def query(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return identify(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
