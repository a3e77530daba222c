"""Toxicity by a classifier chain: categories are predicted one after the other by linear models, each
of which also sees the probabilities of the categories before it. In training those are
out-of-fold (each fold's by models fitted without it), so later models learn from probabilities as good as new
texts will get.

Models are logistic regressions (Newton steps, ridge) on the presence of the words that tell a
category's texts from others, and on a few measures of the text. They are fitted on the driver from at most
`SAMPLE` labelled documents among those given, those with the smallest hash of their id; scoring reads every whole
text where it lies.

Defined results: null and empty texts are scored as texts without words; labels that are null don't count, of repeated
labels of a document the largest does; repeated rows are scored each for itself; without labels, or with labels of one
kind only, the probability is the share of that category (0 without any); other columns are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams as ng
from .common import blocks, fresh, utf8

#: Labelled documents at most that the models are fitted on.
SAMPLE = 8000
FOLDS = 5
FEATURES = 384
LEAST_DOCS = 4
RIDGE = 0.02
STEPS = 12
THRESHOLD = 0.5

#: Categories in chain order, as SQL over the labels table.
CATEGORIES = (("low_quality", "CAST(quality = 0 AS INT)"), ("toxic", "CAST(toxic = 1 AS INT)"))
N_MEASURES = 4


def text_features(rb: pa.RecordBatch, text: str):
    """(document, hash) of each word, and the measures of each document."""
    data, offs = utf8(rb.column(text))
    starts, ends, doc, h = ng.words(data, offs, ng.ALNUM)
    n = rb.num_rows
    words = np.bincount(doc, minlength=n).astype(float)
    size = np.diff(offs).astype(float)
    letters = np.bincount(doc, weights=(ends - starts), minlength=n)
    cum = np.concatenate([[0], np.cumsum((data < 128) & ~ng.ALNUM[ng.LOWER[data]] & (data > 32))])
    signs = cum[offs[1:]] - cum[offs[:-1]]
    m = np.stack([np.log1p(words) / 5, signs / np.maximum(size, 1) * 5, letters / np.maximum(words, 1) / 5,
                  (words > 0).astype(float)], 1)
    return doc, h, m


@dataclass
class Linear:
    """Weights of words (by sorted hash), measures and earlier categories' logits."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def probability(self, doc, h, dense) -> np.ndarray:
        n = len(dense)
        if np.isinf(self.bias):
            return np.full(n, float(self.bias > 0))
        z = np.full(n, self.bias)
        if len(self.dense):
            z = z + dense @ self.dense
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            key = np.unique(doc[hit] * len(self.words) + at[hit])
            z = z + np.bincount(key // len(self.words), weights=self.weights[key % len(self.words)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit(doc: np.ndarray, h: np.ndarray, dense: np.ndarray, y: np.ndarray, rows: np.ndarray) -> Linear:
    """Fit on the documents `rows`; (doc, h) are the distinct words of all documents."""
    yes = y[rows].sum()
    if yes in (0, len(rows)):
        return Linear(bias=-np.inf if yes == 0 else np.inf)
    use = np.zeros(len(y), bool)
    use[rows] = True
    d, w = doc[use[doc]], h[use[doc]]
    vocab, inv = np.unique(w, return_inverse=True)
    n1 = np.bincount(inv, weights=y[d], minlength=len(vocab))
    n0 = np.bincount(inv, minlength=len(vocab)) - n1
    a, b = n1 / yes, n0 / (len(rows) - yes)
    p = (n1 + n0) / len(rows)
    z = np.abs(a - b) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / yes + 1 / (len(rows) - yes)))
    z[n1 + n0 < LEAST_DOCS] = 0
    top = np.sort(np.lexsort((vocab, -z))[:FEATURES])
    top = top[z[top] > 2]
    col = np.full(len(vocab), -1)
    col[top] = np.arange(len(top))
    place = np.full(len(y), -1)
    place[rows] = np.arange(len(rows))
    x = np.zeros((len(rows), len(top) + dense.shape[1] + 1))
    hit = col[inv] >= 0
    x[place[d[hit]], col[inv[hit]]] = 1
    x[:, len(top):-1] = dense[rows]
    x[:, -1] = 1
    t, beta = y[rows].astype(float), np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        g = x.T @ (q - t) + ridge * beta
        hess = (x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge + 1e-8)
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        beta -= step
        if np.abs(step).max() < 1e-4:
            break
    return Linear(vocab[top], beta[:len(top)], beta[len(top):-1], float(beta[-1]))


def fit_chain(doc, h, measures, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model per category (column of `labels`), in order."""
    chain, dense = [], measures
    rows = np.arange(len(labels))
    for c in range(labels.shape[1]):
        y = labels[:, c]
        chain.append(fit(doc, h, dense, y, rows))
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(y))
            for f in range(FOLDS):
                mine = fold == f
                m = fit(doc, h, dense, y, rows[~mine]) if (~mine).any() else Linear()
                out[mine] = m.probability(doc, h, dense)[mine]
            dense = np.column_stack([dense, logit(out)])
    return chain


def predict(chain: list[Linear], doc, h, measures) -> np.ndarray:
    dense, out = measures, []
    for m in chain:
        p = m.probability(doc, h, dense)
        out.append(p)
        dense = np.column_stack([dense, logit(p)])
    return np.stack(out, 1) if out else np.zeros((len(measures), 0))


def _features(text: str):
    def run(batches):
        for b in batches:
            for rb in blocks(b, text):
                doc, h, m = text_features(rb, text)
                cuts = np.searchsorted(doc, np.arange(rb.num_rows + 1))
                yield pa.RecordBatch.from_arrays([
                    rb.column("id"), rb.column("y"),
                    pa.array([np.unique(h[lo:hi]).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    pa.array([x.tobytes() for x in m], pa.binary())], names=["id", "y", "words", "measures"])
    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", categories=CATEGORIES,
          sample: int = SAMPLE) -> list[Linear]:
    """The chain's models from a bounded sample of labelled documents."""
    lab = labels.select(F.col("doc_id").alias("id"), *[F.expr(sql).alias(f"c{i}") for i, (_, sql) in enumerate(categories)])
    lab = lab.dropna().groupBy("id").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))])
    # labels of documents that aren't there take no place in the sample
    lab = lab.join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi")
    lab = lab.select("id", F.array(*[F.col(f"c{i}") for i in range(len(categories))]).alias("y")) \
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    # bounded by `sample`; a document's repeated rows count once
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(lab), "id") \
        .mapInArrow(_features("t"), "id bigint, y array<int>, words binary, measures binary") \
        .groupBy("id").agg(F.min(F.struct("y", "words", "measures")).alias("r")).select("id", "r.*").orderBy("id").collect()
    if not found:
        return [Linear() for _ in categories]
    words = [np.frombuffer(bytes(r["words"]), np.uint64) for r in found]
    measures = np.stack([np.frombuffer(bytes(r["measures"])) for r in found])
    fold = ng.mix(np.array([r["id"] for r in found], np.int64).view(np.uint64)) % np.uint64(FOLDS)
    return fit_chain(np.repeat(np.arange(len(found)), [len(w) for w in words]), np.concatenate(words), measures,
                     np.array([r["y"] for r in found], np.int64), fold)


def _score(bc, text: str, keep: list[str], out: str, names: list[str]):
    kind = pa.struct([(n, pa.float64()) for n in names])

    def run(batches):
        chain = bc.value
        for b in batches:
            for rb in blocks(b, text):
                p = predict(chain, *text_features(rb, text))
                col = pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(len(names))], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in keep], col], names=[*keep, out])
    return run


def score(docs: DataFrame, chain: list[Linear], text: str = "text", categories=CATEGORIES,
          keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The `keep` columns (default all) and a struct with each category's probability; with its name."""
    keep = list(docs.columns) if keep is None else keep
    out, names = fresh(docs, "toxicity"), [n for n, _ in categories]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.StructType(
        [T.StructField(n, T.DoubleType()) for n in names]))])
    bc = docs.sparkSession.sparkContext.broadcast(chain)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_score(bc, text, keep, out, names), schema), out


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, unchanged, whose probability of `toxic` is below the threshold."""
    scored, out = score(docs, train(docs, labels))
    return scored.filter(F.col(f"{out}.toxic") < threshold).select(*docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored, out = score(docs, train(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", *[F.col(f"{out}.{n}").alias(f"p_{n}") for n, _ in CATEGORIES],
                         (F.col(f"{out}.toxic") >= THRESHOLD).alias("toxic"))
