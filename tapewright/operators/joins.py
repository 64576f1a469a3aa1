"""As-of and bucketed range joins, without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it.

    The sides are stacked, right rows first at equal times, and the last right row
    is carried forward: one sort by key and time, no join.
    """
    held = F.struct(*values)
    r = right.select(*by, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), held.alias("__held"), F.lit(None).cast(left.schema).alias("__row"))
    row = F.struct(*left.columns)
    kind = right.select(held.alias("x")).schema["x"].dataType
    l_ = left.select(*by, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__held"), row.alias("__row"))
    w = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l_).withColumn("__last", F.last("__held", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points within [lo, hi) of integer ranges, met in buckets of ``width``."""
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(cells, [*by, "__cell"]).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__cell")
