"""Corpus pipeline: language ID, toxicity, exact dedup, SimHash near-dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
reread as the next stage's ``docs``.  All but the last return the columns of ``docs`` and drop
the documents they reject; the last returns the packed pieces.  Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm import exactdedup, langid, packing, simhash, toxicity
from tillroll.llm.common import staged, unpacked

#: languages whose share of a text's odds is below this are no decision
MIN_LANGUAGE_SCORE = 0.3
#: documents that go to a Python worker at once; five stages share the executors' memory
BATCH = 500


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told; null texts, texts without letters (``und``) and
    undecided ones go."""
    _bounded(spark)
    found = langid.predict(docs, langid.fit(docs))
    return unpacked(found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below 0.5, unscorable ones (null or empty texts) included."""
    _bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return unpacked(toxicity.score(docs, toxicity.fit(docs, labels)).where("toxicity < 0.5"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts (null is empty) the row with the largest doc_id; null ids lose to others."""
    _bounded(spark)
    return exactdedup.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each component of fingerprints within two bits (null texts are empty) the smallest
    doc_id; null ids lose to others."""
    _bounded(spark)
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    _bounded(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "padded_length")


STAGES = [("language_id", language_id), ("toxicity", toxic), ("exact_dedup", exact_dedup),
          ("simhash_near_dedup", near_dedup), ("packing", pack)]

#: Models and token merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
