"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.

1. toxicity: documents that the classifier chain rejects go;
2. quality: documents that the calibrated classifier scores below its cut go;
3. near_duplicates: one document of each near-duplicate class stays;
4. mix: every source's documents as often as the mix to source weights takes them, written shard
   after shard, shuffled inside each;
5. tokens: SentencePiece ids of every remaining row.

The first four return the columns of ``documents``. SQL can't express the trained
and randomised stages, so there is no oracle statement; the tests compare each
stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.llm import bagminhash, mixing, quality, sentencepiece_codec, toxicity
from docscope.llm.common import stash
from docscope.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.shuffled_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokens", tokenize),
]

#: No stage can be written in SQL (trained models, random order, token merges).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
