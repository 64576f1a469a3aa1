"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.alignment import align_documents
from tapewright.llm.common import cut, scratch_dir
from tapewright.llm.htmltext import main_text
from tapewright.llm.interaction import audit_filters
from tapewright.llm.langid import predict_language, train
from tapewright.llm.mixing import mix_sizes
from tapewright.llm.nndescent import nearest
from tapewright.llm.oracles import OP4, OP11
from tapewright.llm.packing import pack_documents
from tapewright.llm.probminhash import near_classes
from tapewright.llm.quality import host_quality
from tapewright.llm.rollups import Ledger, count_tokens, deletes, inserts, revisions
from tapewright.llm.sequences import read_sequences, write_sequences
from tapewright.llm.substring import substring_dedup
from tapewright.llm.suffixes import suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = host_quality(docs, carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sizes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op3_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_shingles", "kept")


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train(docs.where(~held_out).select("text", "lang"))
    out = predict_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model, carry=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those labelled toxic are deleted; the counts of
    those labelled of low quality are revised from subword tokens to words. The
    last batch runs twice, as after a lost driver."""
    counts = cut(count_tokens(table(spark, sf_dir, "documents")), "token-counts")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = cut(counts.join(marks, "doc_id"), "token-marks")
    ledger = Ledger(spark, f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.commit("load", inserts(counts, "byte_bpe_50k"))
    ledger.commit("takedown", deletes(marked.where("toxic = 1"), "byte_bpe_50k"))
    revised = revisions(marked.where("toxic = 0 and quality = 0"), ("byte_bpe_50k", "n_tokens"), ("words", "n_words"))
    for _ in range(2):
        ledger.commit("recount", revised)
    return ledger.totals()


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op12_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("a", "b")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_sequences(spark, write_sequences(table(spark, sf_dir, "documents")))


QUERIES = {"op4_host_quality": op4_host_quality, "op7_mix_sources": op7_mix_sources, "op3_superkmer_dedup": op3_superkmer_dedup, "op8_suffix_dedup": op8_suffix_dedup, "op10_near_dedup": op10_near_dedup,
    "op6_pattern_packing": op6_pattern_packing, "op1_language_id": op1_language_id,
    "op2_token_rollups": op2_token_rollups, "op9_nn_descent": op9_nn_descent,
    "op5_page_differencing": op5_page_differencing, "op12_shared_cuts": op12_shared_cuts, "op11_filter_audit": op11_filter_audit, "op13_sequence_files": op13_sequence_files}
ORACLES = {"op4_host_quality": OP4, "op11_filter_audit": OP11}
