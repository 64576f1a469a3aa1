"""Connected components of links by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import cut, tasks_for


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(a, b) links -> (node, label): each linked node with the smallest node of its component.

    Each step takes the smallest label among a node's neighbours and then the
    label of that label, so that the number of steps grows with the logarithm of
    the longest path. Labels are written out after each step.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # one pass over the links
    both = cut(links.where("a != b").select(F.explode(ways).alias("x")).select("x.*").distinct(), "links", tasks)
    tasks = tasks_for(both.count())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels", tasks)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = cut(step, "labels", tasks)
        labels = step.select("node", "label")
        if step.where("old != label").isEmpty():
            return labels
