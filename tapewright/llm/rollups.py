"""Token counts by delta-maintained rollups.

A batch of signed events (inserts, deletes, and revisions as a delete and an
insert) is summed by source, language and tokenizer version and folded into the
totals of the last version, which are written as the next one. Its head, written
last, makes a version valid.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.tokens import default_path, encoder

KEYS = ("source", "lang", "tokenizer_version")
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
HEADS = "batch_id string"


def token_rows(path: str):
    def go(batches):
        encode = encoder(path).encode
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n, pa.int64())], [*names, "n_tokens"])

    return go


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, lang, n_words and n_tokens of each whole text; a null text has none."""
    from tapewright.llm.common import count_words

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`").cast("string").alias(k) for c, k in ((source, "source"), (lang, "lang"))], count_words(F.col(f"`{text}`")).alias("n_words"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(token_rows(tokenizer or default_path()), "doc_id long, source string, lang string, n_words long, n_tokens long")


def inserts(counts: DataFrame, version: str, n_tokens: str = "n_tokens") -> DataFrame:
    """Events that add the documents of ``counts`` under a tokenizer version."""
    return counts.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(1).cast("long").alias("sign"), F.col(n_tokens).cast("long").alias("n_tokens"))


def deletes(counts: DataFrame, version: str, n_tokens: str = "n_tokens") -> DataFrame:
    return inserts(counts, version, n_tokens).withColumn("sign", F.lit(-1).cast("long"))


def revisions(counts: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """Events that replace counts: (version, column) before and after."""
    return deletes(counts, *old).union(inserts(counts, *new))


class Ledger:
    """Maintained totals in a shared folder, for one writer at a time.

    A commit folds a batch's sums into the totals, which are written as the next
    version; then the version's head, with the batch's id, makes it valid, and a mark
    by batch id makes a second commit of the batch do nothing. A job that breaks off
    before the head leaves the totals as they were and may run again, over what it
    left; one that breaks off after it finds its batch in the head. The work of a commit
    grows with the batch and the number of keys, not with the batches before.

    Cases: null sources and languages are keys of their own; a null count adds a
    document and no tokens; keys whose sums are all 0 stay, with 0; an empty batch
    commits; without batches the totals are empty.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _write(self, df: DataFrame, part: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{part}")

    def _head(self, version: int) -> str | None:
        """The batch that made a version; None if there is no whole one."""
        held = self._read(f"heads/v{version}", HEADS)
        row = held.first() if held is not None else None
        return row["batch_id"] if row else None

    def version(self) -> int:
        """The last version, found in steps that double and then halve."""
        lo, step = 0, 1
        while self._head(lo + step) is not None:
            lo, step = lo + step, 2 * step
        while step > 1:
            step //= 2
            if self._head(lo + step) is not None:
                lo += step
        return lo

    def _marked(self, batch_id: str) -> bool:
        mark = self._read(f"commits/{batch_id}", HEADS)
        return mark is not None and not mark.isEmpty()

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Add a batch; whether it was new. batch_id: letters, digits, - and _."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self._marked(batch_id):
            return False
        version = self.version()
        head = self.spark.range(1).select(F.lit(batch_id).alias("batch_id"))
        if version and (last := self._head(version)) != batch_id and not self._marked(last):
            self._write(self.spark.range(1).select(F.lit(last).alias("batch_id")), f"commits/{last}")  # broke off after its head
        fresh = not version or last != batch_id
        if fresh:
            sums = events.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.coalesce(F.sum(F.col("sign") * F.col("n_tokens")), F.lit(0)).alias("n_tokens"))
            self._write(_summed(self._totals(version).unionByName(sums)), f"totals/v{version + 1}")
            self._write(head, f"heads/v{version + 1}")
        self._write(head, f"commits/{batch_id}")
        return fresh

    def _totals(self, version: int) -> DataFrame:
        held = self._read(f"totals/v{version}", TOTALS) if version else None
        return held if held is not None else self.spark.createDataFrame([], TOTALS)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens over all committed batches."""
        return self._totals(self.version())


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
