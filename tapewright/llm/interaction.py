"""Audit of how filters interact, whatever order they run in.

Each filter has a table of the ids that fail it. What a filter removes after a set of
others is its table left-anti their tables, and what it finds gone already is its
table left-semi theirs. What an order keeps and loses at each step follows from the
removals of its prefixes; a prefix counts as a set, since its order doesn't change
what is left after it. Documents that fail nothing never leave the first table.
"""

from __future__ import annotations

import itertools
import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import WORD, cut, let, scratch_dir, split_words

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides."""
    words = split_words(text)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.regexp_count(text, F.lit(WORD)) < 50,
        "B": let(words, lambda w: 100 * F.size(F.array_distinct(w)) < 65 * F.size(w)),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failing_ids(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents by part, and the failing ids, stored as one table a filter.

    First: (part, total). Second: (row, part, good, toxic, filter), in a folder for
    each filter, so that a filter's ids are read alone. ``row`` numbers the rows of
    ``docs``, so that rows with one id stay apart.
    """
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"), own.alias("text"))
    narrow = rows.select(F.monotonically_increasing_id().alias("row"), "id", "part", F.sha2("text", 256).alias("mark"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()])
    narrow = cut(narrow, "audit-rows")
    # texts that stand once have no smaller id; the others meet their first id by the text's hash
    firsts = narrow.groupBy("mark").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "first")
    judged = narrow.join(firsts, "mark", "left").withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    fails = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in FILTERS]))
    failing = judged.select("row", "id", "part", fails.alias("fails")).where(F.size("fails") > 0).join(marks.withColumnRenamed("doc_id", "id"), "id", "left")
    failing = failing.select("row", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), F.explode("fails").alias("filter"))
    return narrow.groupBy("part").agg(F.count(F.lit(1)).alias("total")), by_filter(failing, f"{scratch_dir(docs.sparkSession)}/failing-{uuid.uuid4().hex}")


def by_filter(failing: DataFrame, path: str) -> DataFrame:
    """``failing`` written with a folder for each filter, and read again."""
    failing.write.partitionBy("filter").parquet(path)
    return failing.sparkSession.read.schema(failing.schema).parquet(path)


def bit(name: Column) -> Column:
    """The bit of a filter in a set of filters."""
    return F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)]), name)


def prefix_removals(failing: DataFrame) -> DataFrame:
    """(part, filter, before, removed, good_lost, toxic_lost, redundant): what each
    filter removes after each set of others (``before``, as bits), and how many rows
    that fail it the set has removed already.

    The ids are dealt out by row once; each meets, in its own partition, the tables
    of the filters that stand before.
    """
    every = (1 << len(FILTERS)) - 1
    ids = failing.repartition("row")
    sets = F.filter(F.sequence(F.lit(0), F.lit(every)), lambda s: s.bitwiseAND(bit(F.col("filter"))) == 0)
    candidates = ids.withColumn("before", F.explode(sets)).alias("c")
    others = failing.select(F.col("row").alias("other_row"), bit(F.col("filter")).alias("other")).repartition("other_row").alias("o")
    met = (F.col("c.row") == F.col("o.other_row")) & (F.col("c.before").bitwiseAND(F.col("o.other")) != 0)
    by = ["part", "filter", "before"]
    removed = candidates.join(others, met, "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("removed"), F.sum(F.col("good").cast("long")).alias("good_lost"), F.sum(F.col("toxic").cast("long")).alias("toxic_lost"), F.lit(0).cast("long").alias("redundant"))
    redundant = candidates.join(others, met, "left_semi").groupBy(*by).agg(*[F.lit(0).cast("long").alias(c) for c in ("removed", "good_lost", "toxic_lost")], F.count(F.lit(1)).alias("redundant"))
    return removed.unionByName(redundant).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost", "redundant")])


def audit_orders(totals: DataFrame, removals: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, for each part.

    ``removals`` has at most 80 rows a part; each part's rows meet the 600 steps of
    all orders, 120 for each filter and set that starts an order.
    """
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [("".join(o), k + 1, f, sum(bits[g] for g in o[:k])) for o in itertools.permutations(FILTERS) for k, f in enumerate(o)]
    spark = totals.sparkSession
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    sets = [(f, s) for f in FILTERS for s in range(1 << len(FILTERS)) if not s & bits[f]]
    grid = totals.withColumn("set", F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(s).alias("before")) for f, s in sets]))).select("part", "total", "set.*")
    cells = grid.join(removals, ["part", "filter", "before"], "left").fillna(0)
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), (F.bit_count("before") + 1).cast("int"))
    filters = Window.partitionBy("part", "filter")
    alone = F.col("before") == (1 << len(FILTERS)) - 1 - bit(F.col("filter"))
    cells = cells.withColumn("shapley", F.sum(F.col("removed") * weight).over(filters)).withColumn("unique_fails", F.sum(F.when(alone, F.col("removed")).otherwise(0)).over(filters))
    rows = cells.join(F.broadcast(steps), ["filter", "before"])  # 600 steps
    upto = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kept", F.col("total") - F.sum("removed").over(upto))
    return rows.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) for each source, order and step, zeros included.

    Cases: a null text is empty; a null source is the part of the empty string;
    repeated rows each count, and share their id's labels; of rows with one text, those
    with the smallest id pass E, all of them if it repeats; a null id is no smaller id
    and passes E; an id is good (toxic) if any of its labels says so; empty tables give
    an empty result, or no label losses; other columns are not read.
    """
    totals, failing = failing_ids(docs, labels, id_col, text, source)
    return audit_orders(totals, prefix_removals(failing))
