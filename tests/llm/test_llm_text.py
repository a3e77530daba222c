"""Text operators against brute-force versions on small fixtures (op1, op2, op6, op9, op3)."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from rotorlens.llm import decontam, htmltext, jaccard, packing, pii
from rotorlens.llm import ngrams as ng
from rotorlens.llm.common import utf8
from rotorlens.llm.tokens import Encoder

LONG = "long " * 40000
TEXTS = [
    None, "", " ", "x", "write to a.b@c.d.e or q@r, _f@g.h now", "a@b.c_d@e.f.g..h@i.j-k", "ünï@ö.de é a@é.b",
    "ip 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 001.002.003.004", "1.2.3", "9" * 400 + ".1.1.1",
    "card 4041894974608795, 4041 8949 7460 8795 4041-8949-7460-8795 40418949746087951234 4041  8949", "7" * 50000,
    "call +1 (988) 555-2485 or +49((((( or +12 or +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 or +44 20 7946 0958.",
    "bank account GB82WEST12345698765432 iban DE89370400440532013000 not GB82WEST12345698765433",
    "social security 123-45-6789; other 123-45-6789-1 000-12-3456", "😀 a@b.cd 😀 10.1.2.3", LONG + "z@y.xw", "a." * 20000 + "@x",
    "a@" + "b.c" * 5000, "write to a.b@c.d.e or q@r, _f@g.h now",
]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base_spans(t):
    out = []
    for kind, pat in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
                      ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("card", r"[0-9](?:[ -]?[0-9])+"),
                      ("phone", r"\+[0-9][ ().0-9-]+[0-9]")):
        # run starts only, where the plain pattern would be quadratic; equal by definition of the leftmost match
        for m in re.finditer(pat, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m[0].split(".")) \
                    or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) \
                    or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, pii string, contamination int")


def test_pii_equals_plain_patterns(spark):
    slow = [i for i, t in enumerate(TEXTS) if t and (t.startswith("a." * 100))]
    got = {r["doc_id"]: r for r in pii.query(frame(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        if i in slow:
            continue
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        c = Counter(w.split(":")[0] for w in want)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [c[k] for k in ("email", "ip", "card", "phone")]
    assert got[13]["spans"].count("iban") == 2 and got[14]["spans"].count("national_id") == 1


def test_pii_random(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a@.b-_1 +(4") for _ in range(rng.randrange(60))) for _ in range(800)]
    got = {r["doc_id"]: r["base_sha256"] for r in pii.query(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest(), t


def test_pii_many_spans_and_no_rows(spark):
    text = "".join(f"ä a{i}@b.cd 10.0.0.{i % 300} " for i in range(50000))  # 2 MB
    got = pii.query(frame(spark, [text, "a@b.cd", "a@b.cd"])).collect()
    want = base_spans(text)
    assert got[0]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert got[0]["n_email"] == 50000 and got[1][1:] == got[2][1:]
    assert pii.query(frame(spark, [])).collect() == [] and pii.redact(frame(spark, [])).collect() == []


def test_redaction_of_overlapping_spans(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["1.2.3.4", "@a.b", "x", " ", "+1 555 0000 000", "4041894974608795", "é"]) for _ in range(30)) for _ in range(60)]
    flagged, out = pii.find_spans(frame(spark, texts))
    spans = {r["doc_id"]: sorted((s["start"], -s["end"], s["kind"]) for s in r[out]) for r in flagged.collect()}
    got = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want, at = "", 0
        for start, end, kind in spans[i]:
            if start >= at:
                want += t[at:start] + f"[{kind.upper()}]"
            at = max(at, -end)
        assert got[i] == want + t[at:], t


def test_redaction(spark):
    df = frame(spark, ["mail a.b@c.de and 10.0.0.1!", None, "none", "+1 (988) 555-2485x", "1.2.3.4@a.b"])
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert [out[i]["text"] for i in range(5)] == ["mail [EMAIL] and [IP]!", None, "none", "[PHONE]x", "[EMAIL]"]
    assert out[0]["pii"] == "clash" and pii.redact(df).columns == df.columns


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def contaminated(docs, items, window=13):
    out = []
    for t in docs:
        w, hit, names = words(t), set(), set()
        for name, item in items:
            x = words(item)
            n = min(len(x), window)
            grams = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    names.add(str(name))
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_words", [4_000_000, 60])
def test_decontamination(spark, block_words):
    rng = random.Random(3)
    voc = ["a", "b", "Ab", "c9", "é", "ß", "d"]
    text = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 8, 12, 13, 14, 40]))) for i in range(20)] + [(20, None), (21, "")]
    docs = [None, "", "!!", *[text(rng.randrange(80)) for _ in range(60)]]
    docs += [text(30) + ", " + (items[i][1] or "").upper() + ". " + text(30) for i in range(20)] + [docs[-1]] * 2
    df = frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    flagged, out = decontam.contamination(df, bench, keep=["doc_id"], block_words=block_words)
    assert out == "contamination_"
    got = {r["doc_id"]: r[out] for r in flagged.collect()}
    want = contaminated(docs, items)
    for i, (n, h, k, sha, _) in enumerate(want):
        r = got[i]
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"])) == (n, h, k), docs[i]
        assert hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == sha
    kept = {r["doc_id"] for r in decontam.clean(df, bench).collect()}
    assert kept == {i for i, w in enumerate(want) if not w[4]}
    empty = decontam.query(df, bench.limit(0)).collect()
    assert len(empty) == len(docs) and not any(r["contaminated"] for r in empty)
    assert decontam.query(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_words", [4_000_000, 20_000])
def test_a_line_that_all_items_share(spark, block_words):
    rng = random.Random(4)
    voc = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    line = text(20)
    items = [(i, f"{text(12)} {line} {text(12)}") for i in range(2000)]
    docs = [" ".join([line] * 400), "x " * 40 + line + " y" * 400, text(300), items[7][1], None]
    t0 = time.time()
    flagged, out = decontam.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"),
                                          keep=["doc_id"], block_words=block_words)
    got = {r["doc_id"]: r[out] for r in flagged.collect()}
    assert time.time() - t0 < 60
    assert [len(got[i]["items"]) for i in range(5)] == [2000, 2000, 0, 2000, 0]
    assert [[(s["start"], s["end"]) for s in got[i]["spans"]] for i in range(5)] == [[(0, 8000)], [(40, 60)], [], [(0, 44)], []]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 6))
def test_fingerprints_reach_every_window(values, w):
    g = ng.mix(np.array(values, np.uint64))
    at = set(decontam.fingerprints(g, w).tolist())
    for i in range(len(g) - w + 1):
        low = g[i:i + w].min()
        assert {i + j for j in range(w) if g[i + j] == low} <= at


def shingles(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_components(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            a, b = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if b and sets[i] and sets[j] and 100 * a >= 90 * b:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def similar_texts():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", "one", "ONE", "one two", "one  two", "two one", "a b c", "A b\tc", LONG, LONG + "long"]
    for n in (9, 10, 11, 40, 150, 300):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = word()
            texts.append(" ".join(w))
        texts += [" ".join(base + [word()]), " ".join(base[1:])]
    common = " ".join(word() for _ in range(60))     # a passage that many share
    texts += [common + " " + " ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("chunk,block", [(512, 1024), (8, 8)])
def test_jaccard_components(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = similar_texts()
    sizes, comp = near_components(texts)
    got = {r["doc_id"]: r for r in jaccard.query(frame(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    if chunk == 512:
        kept = {r["doc_id"] for r in jaccard.keep_one(frame(spark, texts)).collect()}
        assert kept == {i for i in range(len(texts)) if comp[i] == i}


def test_jaccard_edges(spark):
    kind = "doc_id bigint, text string"
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, None)], kind)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in jaccard.query(df).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 3), (True, 0, None)]
    assert sorted((r["doc_id"] or 0) for r in jaccard.keep_one(df).collect()) == [0, 1, 3]
    assert jaccard.query(df.limit(0)).count() == 0


def test_repeated_rows_link_in_block_pairs(spark, monkeypatch):
    dealt = jaccard._dealt
    monkeypatch.setattr(jaccard, "_dealt", lambda home: dealt(home).limit(0))     # all links come from the block pairs
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(base[:60] + ["new", "words"] + base[62:])]
    _, comp = near_components(texts)
    assert comp == [i - i % 2 for i in range(24)]
    df = frame(spark, texts)
    df = df.unionByName(df.filter("doc_id % 2 = 0")).unionByName(df.filter("doc_id % 3 = 0")).unionByName(df.filter("doc_id = 5"))
    got = jaccard.query(df).collect()
    assert len(got) == df.count() and all(r["component_id"] == comp[r["doc_id"]] for r in got)


@pytest.mark.parametrize("long", [256, 10])
def test_near_copies_of_a_short_text(spark, monkeypatch, long):
    """Links come out of a large group as a forest, whether or not its sets are known there."""
    dealt = jaccard._dealt
    monkeypatch.setattr(jaccard, "_dealt", lambda home: dealt(home).limit(0))
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    monkeypatch.setattr(jaccard, "LONG", long)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(350):
        w = list(base)
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
    _, comp = near_components(texts)
    rows, found = jaccard.link_documents(frame(spark, texts))
    assert {r["doc_id"]: r["component_id"] for r in rows.collect()} == dict(enumerate(comp))
    if long == 256:
        assert found.count() < 2 * len(texts)


def test_encoder_equals_tokenizer():
    enc = Encoder(packing.default_tokenizer())
    texts = ["", None, "it's a DON'T ''s x<|endoftext|>y", "Ünïcode ÀÉ × ÷ 12½ ²", "日本語 テスト İstanbul", "a\x0bb\x1cc", "'re'll 'x ''",
             "é́ é", "a\u00a0b\u2003c", "Straße ÞÿŸ ŉ ſ", "1234 !?!? --", "😀😀", LONG]
    got = enc.encode(pa.array(texts + texts))
    for t, ids in zip(texts + texts, got):
        assert ids.tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids, t


def test_packing_round_trip(spark):
    texts = [None, "", "one two", LONG, "x" * 5000, *[" ".join("word" for _ in range(n)) for n in range(1, 1500, 37)], "one two"]
    df = frame(spark, texts).repartition(3)
    rows = packing.pack(df, packing.default_tokenizer(), tiers=(64, 256, 4096)).collect()
    tok = Encoder(packing.default_tokenizer()).tok
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["context"]))
    for i, t in enumerate(texts):
        at, ids = 0, []
        for start, piece, total in sorted(by_doc[i]):
            assert start == at
            ids += piece
            at += len(piece)
        assert ids == tok.encode(t or "", add_special_tokens=False).ids + [2] and total == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length, context in sorted(parts):
            assert offset == at
            at += length
        assert at == context <= 4096 and at & (at - 1) == 0      # no padding at all
    assert packing.query(df.limit(0)).count() == 0
    steps = Counter()
    for r in rows:
        steps[r["step_group"]] += r["length"]
    assert max(steps.values()) <= packing.STEP_TOKENS


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=120), st.integers(1, 20))
def test_packer_keeps_every_id(sizes, pool):
    p, out, at = packing.Packer((8, 32, 128), pool), [], 0
    for d, n in enumerate(sizes):
        out += p.add(d, np.arange(at, at + n, dtype=np.uint32))
        at += n
    out += p.finish()
    assert sorted(int(x) for _, w in out for q in w for x in q.ids) == list(range(at))
    assert all(sum(len(q.ids) for q in w) == c for c, w in out)


PAGES = [
    ("<p>a<p>b <b>c</b>d<br>e", "a\n\nb cd\ne"),
    ("<ul><li>one<li>two<ol start=3><li>x<li hidden>no<li>y</ol></ul>", "- one\n- two\n  3. x\n  4. y"),
    ("<table><tr><th>Name<th>N<tr><td>al<td>1<tr><td>longer<td>22</table>", "Name    N\nal      1\nlonger  22"),
    ("x<div style='display: none'>z</div><span aria-hidden=true>q</span><script>var a='</p>'</script>y", "xqy"),
    ("<title>T &amp; u</title><pre> a\n  b</pre>t", " a\n  b\n\nt"),
    ("<!-- a <p> -->k<!-- open", "k"), ("", ""), (None, None), ("a &lt; b &amp;amp; c", "a < b &amp; c"),
    ("<p>one</div>two</p></p>three", "onetwo\n\nthree"), ("<td>lone</td>", "lone"),
    ("<blockquote>q<p>r</blockquote>s", "> q\n\n> r\n\ns"),
]


def test_html_text(spark):
    df = spark.createDataFrame([(i, h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id bigint, html string, title string")
    got = {r["page_id"]: r for r in htmltext.query(df).collect()}
    for i, (h, want) in enumerate(PAGES):
        assert got[i]["extracted_text"] == want, h
    assert got[4]["title"] == "T & u"
    assert htmltext.query(df.limit(0)).count() == 0


def test_html_text_of_odd_pages():
    for h in ("<div>" * 50000 + "x", "<p>a" * 20000, '<a "' * 5000, "<!--" * 5000, "<table><tr><td>" * 500, "</b>" * 9999, "<" * 9999):
        htmltext.page_text(h)


def test_html_keeps_all_visible_words(spark):
    from conftest import SF_SMALL
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r["page_id"]: r["extracted_text"] for r in htmltext.query(pages).collect()}
    from html import unescape
    for r in pages.collect():
        body = r["html"][r["html"].index("</head>"):]
        plain = unescape(re.sub(r"<[^>]*>", " ", re.sub(r"<!--.*?-->|<script.*?</script>", " ", body, flags=re.S)))
        strip = lambda s: re.sub(r"\s", "", s).replace("-", "")
        assert strip(got[r["page_id"]]) == strip(plain)


@pytest.mark.parametrize("html,want", [
    ("<table><tr><form><td>a<td>b</form></tr><tr><td>c</table>", "a  b\nc"),
    ("<table>one<tr>two<td>a</td>three</tr><b>four</b></table>five", "onetwothreefour\n\na\n\nfive"),
    ("<table><div>x<tr><td>a</div></table>", "x\n\na"), ("<table><center>x</center><tbody><a>y<tr><td>a</table>", "x\ny\n\na"),
    ("<table><colgroup>w<tr><td>a<table><tr><td>b</td></tr>q</table>c<td>d</table>e", "w\n\naq  d\n\nb\n\nc\n\ne"),
    ("<table><caption>t<tr><td>a</table>", "t\n\na"), ("<table><tr><td>a<tr><table><tr><td>b</table>", "a\n\nb"),
    ("<table><tr><td><template><tr>no</template>a</table>", "a")])
def test_html_tables_keep_what_is_not_in_cells(html, want):
    assert htmltext.page_text(html)[0] == want


@pytest.mark.parametrize("html,want", [
    ("<head><title>T</title>Hello <b>world</b>", "Hello world"), ("<head><title>T</title><a href=x>one <p>two", "one\n\ntwo"),
    ("<html><head><meta charset=u><my-app><div>in</div></my-app></head><body>out", "in\nout"),
    ("<head>\n<style>p{}</style>\n<noscript>no</noscript><script>x</script></head><body>b", "b"), ("<body>a<head>b</head>c", "abc"),
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
    ("a<svg><title>no</title><defs><text>no</text></defs><g>no<line x=1 /><text>North <tspan>7</tspan></text></g>"
     "<text>South</text></svg>b", "a North 7 South b"), ("<svg><defs/><text>in</text><p>out", "in\n\nout")])
def test_html_head_ends_and_drawings_show_text(html, want):
    assert htmltext.page_text(html)[0] == want


def test_words_of_sliced_columns():
    col = pa.array(["zero", None, "b c", "", "d"]).slice(1, 4)
    s, e, doc, h = ng.words(*utf8(col), ng.ALNUM)
    assert doc.tolist() == [1, 1, 3] and len(set(h.tolist())) == 3
