"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing and packing, each on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import cut
from tapewright.llm.mixing import mix_documents
from tapewright.llm.packing import pack_documents
from tapewright.llm.probminhash import near_dedup
from tapewright.llm.quality import host_quality
from tapewright.llm.substring import substring_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own rules or their host's verdict don't reject."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("__text"), F.col("source").alias("__source"))
    return host_quality(rows, text="__text", host="__source").where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier one holds.

    A document that loses words keeps the others, joined by one space, and gets
    their length; one that loses all goes; the others stay as they are.
    """
    columns = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in columns])
    out = substring_dedup(rows, id_col="in_doc_id", text="in_text").where("n_removed = 0 or n_removed < n_words")
    cols = {c: F.col(f"`in_{c}`") for c in columns}
    for c, new in (("text", F.col("kept_text")), ("n_chars", F.length("kept_text"))):
        if c in cols:
            cols[c] = F.when(F.col("n_removed") > 0, new.cast(docs.schema[c].dataType)).otherwise(cols[c])
    return out.select(*[v.alias(k) for k, v in cols.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each pass over it."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place there."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix),
    ("packing", pack),
]

#: Mixing draws and packing can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
