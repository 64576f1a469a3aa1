"""Trade statistics: R-multiple metrics, equity, streaks, groups, time pivots.

Trades have trade_id, exit_ts, r_multiple, direction and more; ``keys`` make every
metric grouped (a grid's cells, folds, setups), in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("exit_ts", "trade_id")


def _by(keys: list[str], *order: str):
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    return w.orderBy(*order) if order else w


def equity_curve(trades: DataFrame, keys: list[str] = (), block: str | None = None) -> DataFrame:
    """cum_r and the drawdown from the highest equity so far, at least 0.

    block: a unit of exit time, such as ``day``. Sums and highs then run within the
    blocks of a key, and what lies before a block comes from a table of blocks, so that
    one key takes many tasks. Without keys, blocks are days.
    """
    keys = list(keys)
    rows = trades.where("r_multiple is not null")
    if not keys and block is None:
        block = "day"
    if block is None:
        run = _by(keys, *ORDER).rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("cum_r", F.sum("r_multiple").over(run))
        return out.withColumn("drawdown_r", F.greatest(F.max("cum_r").over(run), F.lit(0.0)) - F.col("cum_r"))
    rows = rows.withColumn("__block", F.date_trunc(block, "exit_ts"))
    run = _by([*keys, "__block"], *ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.sum("r_multiple").over(run)).withColumn("__high", F.max("__sum").over(run))
    before = _by(keys, "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "__block").agg(F.sum("r_multiple").alias("s"), F.max("__sum").alias("h"))
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("s").over(before), F.lit(0.0))).withColumn("__peak", F.greatest(F.max(F.col("__before") + F.col("h")).over(before), F.lit(0.0)))
    held = blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__block"])], "__before", "__peak")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__block"])]
    out = rows.join(held, same)
    out = out.withColumn("cum_r", F.col("__before") + F.col("__sum")).withColumn("drawdown_r", F.greatest("__peak", F.col("__before") + F.col("__high")) - F.col("cum_r"))
    return out.select(*trades.columns, "cum_r", "drawdown_r")


def streaks(trades: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Longest runs of wins and of losses."""
    keys = list(keys)
    w = _by(keys, *ORDER)
    sign = F.signum("r_multiple")
    rows = trades.where("r_multiple is not null").withColumn("sign", sign)
    rows = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(_by([*keys, "sign"], *ORDER)))
    runs = rows.groupBy(*keys, "sign", "island").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda s: F.coalesce(F.max(F.when(F.col("sign") == s, F.col("n"))), F.lit(0))
    return runs.groupBy(*keys).agg(pick(1.0).alias("max_consecutive_wins"), pick(-1.0).alias("max_consecutive_losses"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is about 0."""
    return F.when(F.abs(b) > 1e-8, a / b)


def trade_summary(trades: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The metrics of trades with an R multiple; zero is neither win nor loss.

    Skewness and kurtosis are corrected for bias, percentiles interpolate, the
    profit factor is infinite without losses and 0 without wins or losses.
    """
    keys = list(keys)
    r = F.col("r_multiple")
    curve = equity_curve(trades, keys)
    win, loss = r > 0, r < 0
    n = F.count(F.lit(1))
    out = curve.groupBy(*keys).agg(
        n.alias("trade_count"), F.count_if(win).alias("win_count"), F.count_if(loss).alias("loss_count"), F.avg(r).alias("avg_r"), F.percentile(r, 0.5).alias("median_r"), F.sum(r).alias("total_r"),
        F.stddev_samp(r).alias("std_r"), F.stddev_samp(F.when(loss, r)).alias("downside_std_r"), F.percentile(r, 0.95).alias("p95_r"), F.percentile(r, 0.05).alias("p05_r"),
        F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"), F.avg(F.when(win, r)).alias("avg_win_r"), F.avg(F.when(loss, r)).alias("avg_loss_r"), F.max(r).alias("best_r"), F.min(r).alias("worst_r"),
        F.coalesce(F.sum(F.when(win, r)), F.lit(0.0)).alias("gross_win"), F.coalesce(F.sum(F.when(loss, -r)), F.lit(0.0)).alias("gross_loss"), F.max("drawdown_r").alias("max_drawdown_r"),
        F.sqrt(F.avg(F.col("drawdown_r") * F.col("drawdown_r"))).alias("ulcer_index_r"), F.avg(F.abs(r)).alias("avg_abs_r"), F.max_by(r, F.struct(F.abs(r), -F.col("trade_id"))).alias("top_r"),
    )
    c = F.col("trade_count").cast("double")
    out = out.withColumns({
        "win_rate": F.col("win_count") / c, "loss_rate": F.col("loss_count") / c,
        "skew_r": F.when(c >= 3, F.col("g1") * F.sqrt(c * (c - 1)) / (c - 2)),
        "kurtosis_r": F.when(c >= 4, (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * F.col("g2") + 6)),
        "profit_factor": F.when(F.col("gross_loss") > 0, F.col("gross_win") / F.col("gross_loss")).when(F.col("gross_win") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)),
    })
    out = out.withColumns({
        "expectancy_r": F.coalesce(F.col("win_rate") * F.col("avg_win_r") + F.col("loss_rate") * F.col("avg_loss_r"), F.col("avg_r")),
        "payoff_ratio": _ratio(F.col("avg_win_r"), -F.col("avg_loss_r")), "sharpe_r": _ratio(F.col("avg_r"), F.col("std_r")), "sortino_r": _ratio(F.col("avg_r"), F.col("downside_std_r")),
        "recovery_factor": _ratio(F.col("total_r"), F.col("max_drawdown_r")), "outlier_dependency": _ratio(F.col("total_r") - F.col("top_r"), F.col("total_r")), "payoff_stability": _ratio(F.col("median_r"), F.col("avg_abs_r")),
    }).drop("g1", "g2", "top_r", "avg_abs_r")
    s = streaks(trades, keys)
    return out.join(s, keys) if keys else out.withColumn("__one", F.lit(1)).join(s.withColumn("__one", F.lit(1)), "__one").drop("__one")


def group_summary(trades: DataFrame, keys: list[str], min_trades: int = 30) -> DataFrame:
    """Basic metrics by group; rows with a null key are left out."""
    rows = trades.dropna(subset=list(keys)).where("r_multiple is not null")
    r = F.col("r_multiple")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("trade_count"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_r"), F.percentile(r, 0.5).alias("median_r"), F.sum(r).alias("total_r"), F.avg("bars_held").alias("avg_bars_held"))
    return out.withColumn("sample_warning", F.col("trade_count") < min_trades)


def direction_summary(trades: DataFrame) -> DataFrame:
    """long and short, with zero counts where there are none."""
    both = trades.sparkSession.createDataFrame([("long",), ("short",)], "direction string")
    rows = trades.withColumn("direction", F.lower("direction"))
    out = both.join(F.broadcast(group_summary(rows, ["direction"], 0).drop("sample_warning")), "direction", "left")
    return out.fillna(0, ["trade_count"])


def pivot_metric(grouped: DataFrame, index: str, column: str, values: list, metric: str) -> DataFrame:
    return grouped.groupBy(index).pivot(column, values).agg(F.first(metric))


def trade_count_diagnostics(trades: DataFrame, keys: list[str] = (), hard: int = 30, soft: int = 100) -> DataFrame:
    n = F.col("trade_count")
    return trades.where("r_multiple is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("trade_count")).withColumn("status", F.when(n < hard, "insufficient").when(n < soft, "limited").otherwise("reasonable"))


def best_cell(grid: DataFrame, metric: str = "expectancy_r", keys: list[str] = (), min_trades: int = 1) -> DataFrame:
    """The cell of the highest metric, ties to the smaller stop, then target."""
    w = _by(list(keys)).orderBy(F.desc(metric), "stop_ticks", "target_ticks")
    return grid.where((F.col("trade_count") >= min_trades) & F.col(metric).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def exit_reasons(trades: DataFrame, keys: list[str] = ()) -> DataFrame:
    return trades.groupBy(*keys, "exit_reason").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("r_multiple").alias("avg_r"))


def worst_losers(trades: DataFrame, n: int = 10) -> DataFrame:
    return trades.where("r_multiple < 0").orderBy("r_multiple", "trade_id").limit(n)
