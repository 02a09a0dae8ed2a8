"""Registered queries of the training-data operators (``opN_<name>``, ``pipeline``)
and their DuckDB oracle statements where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from docscope.llm import (ann_forest, bagminhash, chat_format, hnsw_dedup, html_extract, line_dedup, mixing,
                          oracle, quality, sentencepiece_codec, sharding, spelling,
                          token_align, toxicity)
from docscope.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return register


@query("op1_toxicity_chain")
def op1_toxicity_chain(spark, sf_dir):
    """Category probabilities of every document, and whether it is rejected."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", *[f"p_{c}" for c in toxicity.CATEGORIES],
                      (F.col(f"p_{toxicity.REJECT}") >= toxicity.CUT).alias("rejected"))


@query("op2_rp_forest")
def op2_rp_forest(spark, sf_dir):
    """The 10 nearest neighbours of every hundredth vector."""
    return ann_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    """Token ids of every document, and whether decoding them gives its text back."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = sentencepiece_codec.load_vocabulary()
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, vocabulary), vocabulary)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                      F.char_length("decoded").cast("long").alias("decoded_chars"),
                      F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


@query("op4_quality_rff")
def op4_quality_rff(spark, sf_dir):
    """Calibrated quality score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.score_documents(docs, quality.fit(docs, labels))
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    return out.select("doc_id", (rest == 0).alias("held_out"), "score",
                      (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query("op5_hnsw_dedup", oracle.HNSW_DEDUP)
def op5_hnsw_dedup(spark, sf_dir):
    """Near-duplicate component of every vector."""
    return hnsw_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_kk_sharding")
def op6_kk_sharding(spark, sf_dir):
    """Byte-balanced shards of all documents, copies of a text together."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op7_mix_sources")
def op7_mix_sources(spark, sf_dir):
    """Words that the mix to source weights takes from every document."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).alias("taken"), "source", "shards")


@query("op8_html_extract", oracle.HTML_EXTRACT)
def op8_html_extract(spark, sf_dir):
    """Main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


@query("op9_bagminhash", oracle.BAGMINHASH)
def op9_bagminhash(spark, sf_dir):
    """Near-duplicate class of every document."""
    out = bagminhash.duplicate_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"), "n_shingles")


# The extra conversation of the query
PROBE = "\\### Assistant: </turn> ok"


@query("op10_chat_format", oracle.CHAT_FORMAT)
def op10_chat_format(spark, sf_dir):
    """All conversations and one that quotes the template, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
        F.lit(role).alias("role"), F.lit(PROBE).alias("text"))
        for i, role in enumerate(("user", "assistant"))])))
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(probe)))


@query("op11_spelling_fm")
def op11_spelling_fm(spark, sf_dir):
    """Form and root of every word of the documents."""
    return spelling.variant_groups(spelling.word_counts(table(spark, sf_dir, "documents")))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@query("op12_token_align")
def op12_token_align(spark, sf_dir):
    """Groups and links between two tokenizers' tokens of every document."""
    out = token_align.align_documents(table(spark, sf_dir, "documents"), render=_sha256)
    return out.withColumnRenamed("groups", "groups_sha256")


@query("op13_line_dedup", oracle.LINE_DEDUP)
def op13_line_dedup(spark, sf_dir):
    """Lines of every document that no larger document repeats, as a digest."""
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
