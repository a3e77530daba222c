"""Archive, url, search and model operators against brute force, and the pipeline's stages."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rotorlens.llm import langid, topk, toxicity, urlfilter, warc


def test_warc_round_trip(spark, scratch):
    rows = [(3, "http://a/x?y#z", "same"), (1, "https://b.c", "same"), (7, None, None), (8, "bad\r\nurl", ""), (None, "http://n", "n"),
            (9, "http://w", "inner WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (4, "u", "é" * 300000),
            (1, "https://b.c", "same"), (5, "x", "n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    warc.write_archive(df, scratch + "/w")
    records = warc.read_records(spark, scratch + "/w")
    assert records.count() == 3 * len(rows)
    got = sorted(warc.assemble(records).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    assert len(got) == len(rows)
    for r in got:
        assert r["request"]["target_uri"] == r["response"]["target_uri"] and r["metadata"] is not None
    by = {r["page_id"]: r for r in got}
    for page, _, html in rows:
        raw = (html or "").encode()
        assert by[page]["response"]["payload_bytes"] == len(raw)
        assert by[page]["response"]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert by[9]["response"]["payload"] == rows[5][2]
    assert (by[3]["response"]["type"], by[3]["refers_to"]) == ("revisit", 1) and by[3]["response"]["payload"] is None
    assert (by[8]["response"]["type"], by[8]["refers_to"]) == ("revisit", 7) and by[7]["response"]["type"] == "response"
    assert (by[None]["response"]["type"], by[None]["refers_to"]) == ("revisit", 5)
    assert warc.query(df.limit(0)).count() == 0


def judge(url):
    i = (url or "").find("://")
    rest = url[i + 3:] if i >= 0 else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[re.match(r"[^/?#]*", rest).end():])[0]
    under = lambda h: host == h or host.endswith("." + h)
    fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if under(h) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if any(under(h) for h in urlfilter.LISTED_HOSTS) else "allow"


def test_url_verdicts(spark):
    urls = [None, "", "nothing", "http://", "http://net", "http://net/", "http://NET/x?y", "http://a.net?x", "http://example.net/en/1",
            "http://a.b.example.net/en/1", "http://example.net/en", "http://notexample.com/de/", "http://m.example.com/de/q#f",
            "http://org/fr/", "http://x.org/fr/a", "http://free-bets.example.com/en/", "http://m.ADULT-X.example.org/",
            "x://spam-farm.example.org/fr/1", "http://a..net/", "http://example.com:80/de/", "http://é.net/\n", "a://b://c.net/"] * 2
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    for r in urlfilter.query(df).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(urls[r["page_id"]]), urls[r["page_id"]]
    assert urlfilter.query(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(df, rules=(), listed_hosts=()).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    rng = random.Random(2)
    universe = [f"k{i}" for i in range(5000)]
    listed = rng.sample(universe, 300) + ["absent"]
    u = spark.createDataFrame([(k,) for k in universe + universe[:50]], "k string")
    c = urlfilter.Cascade(spark.createDataFrame([(k,) for k in listed], "k string"), u)
    got = {r["k"] for r in u.filter(c.contains(F.col("k"))).collect()}
    assert got == set(listed) & set(universe) and len(c.levels) > 1


def best(rows, k=10):
    ok = {}
    good = [(i, np.floor(1024 * np.array(v, float))) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, dim - len(v)))) for i, v in good]
    for i, q in good:
        if i % 100 == 0:
            s = sorted((-sum(int(a) * int(b) for a, b in zip(q, c)), j) for j, c in good if j != i)[:k]
            ok[i] = [(r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return ok


@pytest.mark.parametrize("size", [1.0, 3e4])
def test_top_k(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "ROWS", 70)
    rng = np.random.default_rng(4)
    rows = [(int(i), (size * np.round(rng.normal(size=40), 1)).tolist()) for i in range(300 if size > 1 else 900)]
    rows += [(901, None), (902, [None] * 40), (903, [float("nan")] * 40), (904, [float("inf")] + [0.0] * 39), (None, [1.0] * 40),
             (1000, []), (905, [5.0]), (906, rows[3][1]), (907, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    want = best(rows)
    for blocks in (4096, 3):
        out = topk.top_k(df, df.filter("vec_id % 100 = 0"), block_queries=blocks).collect()
        got = {}
        for r in out:
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: sorted(v) for q, v in got.items()} == want
    assert topk.query(df.limit(0)).count() == 0


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "é"), (None, "the of and"), (5, "the " * 50000)],
                                "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] in model.languages and got[5]["lang_pred"] == "en"
    assert langid.query(docs.limit(0)).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.query(nothing).collect()} == {"und"}


TOXIC = {"idiot", "scum", "moron", "clown"}


def test_toxicity_chain(spark):
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(400)]

    def doc(toxic):
        w = [rng.choice(voc) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(sorted(TOXIC))
        return " ".join(w)
    flags = [int(rng.random() < 0.2) for _ in range(900)]
    docs = spark.createDataFrame([(i, doc(t), "clash") for i, t in enumerate(flags)] + [(900, None, ""), (901, "", "")],
                                 "doc_id bigint, text string, toxicity string")
    labels = spark.createDataFrame([(i, 1 - t, t) for i, t in enumerate(flags[:500])] + [(0, None, None), (5000, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.query(docs, labels).collect()}
    wrong = [i for i in range(500, 900) if got[i]["toxic"] != bool(flags[i])]
    assert len(wrong) <= 8
    assert not got[900]["toxic"] and not got[901]["toxic"]
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["toxic"]}
    none = toxicity.query(docs, labels.limit(0)).collect()
    assert len(none) == 902 and all(r["p_toxic"] == 0 for r in none)
    assert toxicity.query(docs.limit(0), labels).count() == 0


def test_labels_of_absent_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "good day") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(i, 1, 0) for i in range(1000, 5000)],
                                   "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(docs, labels, sample=40)
    scored, out = toxicity.score(docs, chain)
    assert all((r[out]["toxic"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in scored.collect())


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(1)
    n = 400
    y1 = rng.integers(0, 2, n)
    doc, h = np.arange(n), np.where(y1 == 1, 7, 9).astype(np.uint64)
    chain = toxicity.fit_chain(doc, h, np.zeros((n, 1)), np.stack([y1, y1], 1), np.arange(n) % 5)
    assert len(chain[1].dense) == 2 and chain[1].dense[1] > 0
    p = toxicity.predict(chain, doc, h, np.zeros((n, 1)))
    assert ((p[:, 1] > 0.5) == (y1 == 1)).all()


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from rotorlens.llm.common import written
    from rotorlens.llm.packing import default_tokenizer
    from test_llm_text import base_spans, contaminated, near_components
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(120)
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    before = written(docs, "t")
    for name, stage in cp.STAGES:
        after = written(stage(spark, before, SF_SMALL), "t")
        a = sorted(before.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
        b = after.collect()
        ids = [r["doc_id"] for r in b]
        if name != "packing":
            assert after.columns == list(cp.COLUMNS)
        if name == "ngram_jaccard":
            _, comp = near_components([r["text"] for r in a])
            want = {a[i]["doc_id"] for i in range(len(a)) if a[comp[i]]["doc_id"] == a[i]["doc_id"]}
            assert set(ids) == want and len(ids) == len(want)
        elif name == "decontamination":
            want = [r["doc_id"] for r, c in zip(a, contaminated([r["text"] for r in a], items)) if not c[4]]
            assert sorted(ids, key=str) == sorted(want, key=str)
        elif name == "pii":
            assert len(b) == len(a) and not any(base_spans(r["text"] or "") for r in b)
            assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in b)
        elif name == "packing":
            tok = Tokenizer.from_file(default_tokenizer())
            for r in a:
                pieces = sorted((p["start"], p["ids"]) for p in b if p["doc_id"] == r["doc_id"])
                assert sum((p for _, p in pieces), []) == tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        before = after


def test_near_copies_of_the_pipeline(spark):
    import corpus_pipeline as cp
    from test_llm_text import shingles, similar_texts
    rng = random.Random(5)
    base = [f"v{i}" for i in range(200)]
    texts = similar_texts() + [" ".join(base), " ".join(base[:170]), " ".join(base + [f"x{i}" for i in range(30)])]
    texts += [" ".join(f"e{rng.randrange(9999)}" if i % 50 == 20 else w for i, w in enumerate(base))]
    sets, comp = [shingles(t, 5) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if a and 100 * a >= 80 * b and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"] for r in cp.one_of_each(spark, docs, SF_SMALL).collect()}
    assert got == {i for i in range(len(texts)) if comp[i] == i}
    assert not got & set(range(len(texts) - 3, len(texts)))


@pytest.mark.parametrize("name", ["op1_pii", "op2_decontamination", "op4_warc", "op5_url_filter", "op6_jaccard", "op10_topk"])
def test_queries_match_their_sql(spark, name):
    import __spark_entry__ as se
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    key = lambda r: tuple(map(str, r))
    cols = sorted(se.queries()[name](spark, SF_SMALL).columns)
    got = sorted((tuple(r[c] for c in cols) for r in se.queries()[name](spark, SF_SMALL).collect()), key=key)
    rel = con.sql(se.oracle_sql()[name])
    want = sorted(rel.select(*cols).fetchall(), key=key)
    assert got == want
