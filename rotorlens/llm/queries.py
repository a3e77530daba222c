"""The registered queries opN_<name>: each applies an operator to its whole table."""

from __future__ import annotations

from . import centroids, decontam, htmltext, jaccard, langid, packing, pii, sharding, topk, toxicity, urlfilter, warc, whitening
from .common import table
from .registry import register


@register("op1_pii", pii.ORACLE_SQL)
def op1_pii(spark, sf):
    """Personal data in every document."""
    return pii.query(table(spark, sf, "documents"))


@register("op2_decontamination", decontam.ORACLE_SQL)
def op2_decontamination(spark, sf):
    """Benchmark windows in every document."""
    return decontam.query(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op9_packing")
def op9_packing(spark, sf):
    """Every document's tokens in packed sequences."""
    return packing.query(table(spark, sf, "documents"))


@register("op5_url_filter", urlfilter.ORACLE_SQL)
def op5_url_filter(spark, sf):
    """A verdict on every page's url."""
    return urlfilter.query(table(spark, sf, "pages"))


@register("op10_topk", topk.ORACLE_SQL)
def op10_topk(spark, sf):
    """The ten best partners of every hundredth vector."""
    return topk.query(table(spark, sf, "embeddings"))


@register("op6_jaccard", jaccard.ORACLE_SQL)
def op6_jaccard(spark, sf):
    """Near-duplicate components of all documents."""
    return jaccard.query(table(spark, sf, "documents"))


@register("op3_html_text")
def op3_html_text(spark, sf):
    """Visible text of every page."""
    return htmltext.query(table(spark, sf, "pages"))


@register("op4_warc", warc.ORACLE_SQL)
def op4_warc(spark, sf):
    """Every page written to archives, read back and assembled."""
    return warc.query(table(spark, sf, "pages"))


@register("op7_toxicity")
def op7_toxicity(spark, sf):
    """Category probabilities of every document."""
    return toxicity.query(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op8_langid")
def op8_langid(spark, sf):
    """Language of every document."""
    return langid.query(table(spark, sf, "documents"))


@register("op11_sharding", sharding.ORACLE_SQL)
def op11_sharding(spark, sf):
    """Every document's shard and slot."""
    return sharding.query(table(spark, sf, "documents"))


@register("op12_whitening")
def op12_whitening(spark, sf):
    """Every vector's whitened components."""
    return whitening.query(table(spark, sf, "embeddings"))


@register("op13_centroids", centroids.ORACLE_SQL)
def op13_centroids(spark, sf):
    """Every vector's cluster."""
    return centroids.query(table(spark, sf, "embeddings"))
