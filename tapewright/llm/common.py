"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII characters.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Where it is unset (tests, notebooks), a folder in the warehouse is set for
    this session, so that a single machine needs no configuration.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        root = f"{warehouse.rstrip('/')}/_scratch"
    return root.rstrip("/")


def tasks_for(rows: int, each: int = 50_000) -> int:
    """How many tasks so many rows take."""
    return max(1, -(-rows // each))


def cut(df: DataFrame, name: str, tasks: int | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    It cuts the lineage: what follows survives a lost executor without doing
    the work again, and several readers share one computation. tasks: a bound on
    the writing tasks, for tables whose number of rows is known. codec: the
    compression, if not the session's.
    """
    spark = df.sparkSession
    df = df if tasks is None else df.coalesce(tasks)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for a row and hand it to ``body`` (a lambda
    variable, so the optimizer can't copy the expression into inner lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """The words of a text in order; an empty array if there are none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_RUN)
    )


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def others(df: DataFrame, own: list[str]) -> list[str]:
    """The columns that an operator carries along: all but those it makes."""
    return [c for c in df.columns if c not in own]
