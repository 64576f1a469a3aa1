"""Portfolios of setups: tagging, exposure, correlations, equity, contributions."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.simulate import admit
from tapewright.plans.metrics import ORDER, equity_curve


def tag_setups(setups: dict[str, DataFrame]) -> DataFrame:
    """All setups' trades in one frame, with setup_id."""
    out = None
    for name, trades in setups.items():
        one = trades.withColumn("setup_id", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def portfolio_exposure(trades: DataFrame, policy: str = "single_position", cooldown: int = 0, by: list[str] = ()) -> DataFrame:
    """Admission over all setups, by entry bar, setup and trade."""
    order = F.xxhash64("setup_id", "trade_id")
    rows = trades.withColumn("signal_id", order) if "signal_id" not in trades.columns else trades
    return admit(rows, policy, cooldown, "setup_id", list(by))


def setup_correlations(trades: DataFrame, setup_ids: list[str]) -> DataFrame:
    """Pearson correlations of the setups' summed R by exit time, missing times as 0; one pass for all pairs."""
    wide = trades.groupBy("exit_ts").pivot("setup_id", setup_ids).agg(F.sum("r_multiple")).fillna(0.0, setup_ids)
    pairs = list(itertools.combinations(setup_ids, 2))
    one = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("setup_a"), F.lit(b).alias("setup_b"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs])).alias("x")).select("x.*")


def marginal_contributions(trades: DataFrame, setup_ids: list[str]) -> DataFrame:
    """Total R and largest drawdown without each setup, against the whole.

    The equities without each setup run side by side within blocks of an hour; a block
    leaves their sum, highest and lowest point and largest drawdown, and the table of
    blocks is folded by setup. So trades aren't copied, and no task has a setup's trades.
    """
    names = ["(none)", *setup_ids]
    rows = trades.where("r_multiple is not null").select("setup_id", *ORDER, "r_multiple").withColumn("block", F.date_trunc("hour", "exit_ts"))
    run = Window.partitionBy("block").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    own = [F.when(F.col("setup_id") != name, F.col("r_multiple")) for name in names]
    rows = rows.withColumns({f"cum{i}": F.sum(r).over(run) for i, r in enumerate(own)})
    rows = rows.withColumns({f"high{i}": F.max(f"cum{i}").over(run) for i in range(len(names))})
    parts = []
    for i, (name, r) in enumerate(zip(names, own, strict=True)):
        cum, high = F.col(f"cum{i}"), F.col(f"high{i}")
        parts.append(F.struct(F.lit(name).alias("without"), F.count(r).alias("n"), F.sum(r).alias("s"), F.max(cum).alias("high"), F.min(cum).alias("low"), F.max(high - cum).alias("fall")))
    blocks = rows.groupBy("block").agg(F.array(*parts).alias("x")).select("block", F.inline("x")).where("n > 0")
    earlier = Window.partitionBy("without").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("s").over(earlier), F.lit(0.0)))
    blocks = blocks.withColumn("peak", F.greatest(F.max(F.col("before") + F.col("high")).over(earlier), F.lit(0.0)))
    fall = F.greatest("fall", F.col("peak") - F.col("before") - F.col("low"))
    out = blocks.groupBy("without").agg(F.sum("s").alias("total_r"), F.max(fall).alias("max_drawdown_r"))
    base = out.where("without = '(none)'").select(F.col("total_r").alias("t"), F.col("max_drawdown_r").alias("d"), F.lit(1).alias("k"))
    return out.where("without <> '(none)'").withColumn("k", F.lit(1)).join(base, "k").select(F.col("without").alias("setup_id"), (F.col("t") - F.col("total_r")).alias("marginal_total_r"), (F.col("d") - F.col("max_drawdown_r")).alias("marginal_max_drawdown_r"))


def portfolio_equity(trades: DataFrame, by: list[str] = ()) -> DataFrame:
    return equity_curve(trades, list(by))
