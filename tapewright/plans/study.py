"""Studies: factor expansion, ranking, group summaries, paired deltas."""

from __future__ import annotations

import hashlib
import itertools
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The axes of a study.
AXES = ("core_level", "partner_levels", "confluence_mode", "trigger", "trigger_timeframe", "otf", "direction")


def fingerprint(cell: dict) -> str:
    return hashlib.sha256(json.dumps(cell, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def expand(factors: dict[str, list]) -> list[dict]:
    """Cartesian cells of the declared axes, in their order, each with a name and a fingerprint."""
    unknown = set(factors) - set(AXES)
    if unknown:
        raise ValueError(f"not axes of a study: {sorted(unknown)}")
    axes = [a for a in AXES if a in factors]
    cells = [dict(zip(axes, values, strict=True)) for values in itertools.product(*(factors[a] for a in axes))]
    return [{**c, "run_name": "_".join(str(c[a]) for a in axes), "fingerprint": fingerprint(c)} for c in cells]


def overview(index: DataFrame, factors: DataFrame) -> DataFrame:
    """Runs with their factors, where they have any."""
    return index.join(factors, "run_name", "left")


def ranked(rows: DataFrame, metric: str, min_trades: int) -> DataFrame:
    """status: ranked, low_n or unresolved; ranked runs by metric, then name."""
    status = F.when(F.col("trade_count") < min_trades, "low_n").when(F.col(metric).isNull(), "unresolved").otherwise("ranked")
    out = rows.withColumn("status", status)
    w = Window.partitionBy("status").orderBy(F.desc_nulls_last(metric), "run_name")
    return out.withColumn("rank", F.when(F.col("status") == "ranked", F.row_number().over(w)))


def group_summaries(rows: DataFrame, axis: str, metric: str, min_trades: int) -> DataFrame:
    ok = rows.where((F.col("trade_count") >= min_trades) & F.col(metric).isNotNull())
    return ok.groupBy(axis).agg(F.count(F.lit(1)).alias("cell_count"), F.avg(metric).alias("mean_metric"), F.percentile(metric, 0.5).alias("median_metric"), F.avg("trade_count").alias("mean_trade_count"))


def paired_delta(rows: DataFrame, axis: str, baseline: str, pair_on: list[str], metric: str, min_trades: int) -> DataFrame:
    """metric(variant) - metric(baseline) for runs equal in all other factors."""
    base = rows.where(F.col(axis) == baseline).select(*pair_on, F.col(metric).alias("base_metric"), F.col("trade_count").alias("base_trades"))
    out = rows.where(F.col(axis) != baseline).join(base, pair_on)
    return out.select(*pair_on, F.col(axis).alias("variant"), (F.col(metric) - F.col("base_metric")).alias("delta"), (F.least("trade_count", "base_trades") >= min_trades).alias("meets_min_trades"))


def promoted(rows: DataFrame, metric: str, min_trades: int, n: int) -> DataFrame:
    """The n best ranked runs, for a narrower study."""
    return ranked(rows, metric, min_trades).where((F.col("status") == "ranked") & (F.col("rank") <= n))


def rollup(runs: DataFrame, diagnostics: dict[str, DataFrame]) -> DataFrame:
    """Each run with a status by diagnostic, present or not_run, and its columns after
    their diagnostic's name. diagnostics: tables with a row a run_name."""
    out = runs
    for name, table in diagnostics.items():
        side = table.select("run_name", *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c != "run_name"], F.lit("present").alias(f"{name}_status"))
        out = out.join(side, "run_name", "left").fillna("not_run", [f"{name}_status"])
    return out


def admit_bucket(buckets: DataFrame, label: str, by: list[str], min_trades: int, allow_thin: bool = False) -> DataFrame:
    """By key, the bucket of the best avg_r and its status: ok, or the reason why it admits
    nothing. Buckets of enough trades come first, and thin ones only count if there are no
    others; tie: two share the best avg_r; thin: too few trades.
    """
    rows = buckets.where("avg_r is not null").withColumn("thin", F.col("trade_count") < min_trades)
    w = Window.partitionBy(*by).orderBy("thin", F.desc("avg_r"), label)
    rows = rows.withColumns({"r": F.row_number().over(w), "next_thin": F.lead("thin").over(w), "next_r": F.lead("avg_r").over(w)}).where("r = 1")
    tie = (F.col("next_thin") == F.col("thin")) & (F.col("next_r") == F.col("avg_r"))
    status = F.when(F.coalesce(tie, F.lit(False)), "tie").when(F.col("thin") & F.lit(not allow_thin), "thin").otherwise("ok")
    return rows.select(*by, label, "trade_count", "avg_r", status.alias("status"))
