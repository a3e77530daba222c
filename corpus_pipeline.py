"""The corpus pipeline: five stages over `documents`, each with one operator of rotorlens.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as
Parquet under the shared checkpoint folder and reads them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorlens.llm import decontam, jaccard, packing, pii, toxicity
from rotorlens.llm.common import prepare, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is at least toxicity.THRESHOLD go."""
    prepare(spark)
    return toxicity.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word Jaccard of 0.8 and more), the document with the
    smallest id stays."""
    prepare(spark)
    return jaccard.keep_one(docs.select(*COLUMNS), n=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    prepare(spark)
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    prepare(spark)
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                            .otherwise(F.length("text").cast("bigint")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed sequences, as op9 returns them, with the ids themselves."""
    prepare(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", one_of_each), ("decontamination", decontaminate),
          ("pii", redact), ("packing", pack)]

#: The first stage's model can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
