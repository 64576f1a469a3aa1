"""Diagnostics of grids and walk-forwards, hits of bracket VWAPs, random entries,
one-time-framing matrices, and windows of rows for displays."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.operators.bars import micros
from tapewright.operators.simulate import simulate
from tapewright.operators.zones import otf_filter
from tapewright.plans.attribution import tokens
from tapewright.plans.research import draw, sharpe_moments

# Cell counts from which a grid's best is suspect.
FEW, SOME, MANY = 10, 25, 100
EULER_GAMMA = 0.5772156649015329
# The one-time-framing settings that are compared.
OTF_CONFIGS = {"no_otf": (), "otf_15m": (900,), "otf_30m": (1800,), "otf_15m_30m": (900, 1800), "otf_5m_15m_30m": (300, 900, 1800)}


def grid_overfit(grid: DataFrame, metric: str = "expectancy_r", top: int = 5) -> DataFrame:
    """Best against median of a grid's cells, and how suspect it is by their number."""
    rows = grid.where(F.col(metric).isNotNull()).withColumn("r", F.row_number().over(Window.orderBy(F.desc(metric))))
    out = rows.agg(F.count(F.lit(1)).alias("valid_cell_count"), F.max(metric).alias("best_metric"), F.percentile(metric, 0.5).alias("median_metric"), F.avg(metric).alias("mean_metric"), F.avg(F.when(F.col("r") <= top, F.col(metric))).alias("top_n_mean_metric"))
    n, gap = F.col("valid_cell_count"), F.col("best_metric") - F.col("median_metric")
    size = F.when(F.col("median_metric") == 0, 1.0).otherwise(F.abs("median_metric"))
    risk = F.when(n <= 1, "none").when(n >= MANY, "high").when(n >= SOME, "medium").when((n >= FEW) & (gap > 0.5 * size), "medium").otherwise("low")
    return out.withColumns({"best_vs_median_delta": gap, "risk_level": risk})


def walk_forward_summary(folds: DataFrame) -> DataFrame:
    ok = F.col("test_metric").isNotNull()
    out = folds.agg(F.count(F.lit(1)).alias("fold_count"), F.count_if(ok).alias("valid_fold_count"), F.count_if(ok & (F.col("test_total_r") > 0)).alias("oos_profitable_fold_count"), F.percentile(F.when(ok, F.col("train_metric")), 0.5).alias("median_train_metric"), F.percentile("test_metric", 0.5).alias("median_test_metric"), F.sum("test_total_r").alias("aggregate_test_total_r"), F.coalesce(F.sum("test_trades"), F.lit(0)).alias("aggregate_test_trades"))
    status = F.when(F.col("fold_count") == 0, "empty").when(F.col("valid_fold_count") == 0, "no_valid_folds").otherwise("ok")
    return out.withColumns({"oos_profitable_fold_rate": F.when(F.col("valid_fold_count") > 0, F.col("oos_profitable_fold_count") / F.col("valid_fold_count")), "status": status})


def trades_at_level(trades: DataFrame, level: str) -> DataFrame:
    return trades.where(F.array_contains(tokens(F.col("level_names")), level))


def bracket_hit_lookup(bars: DataFrame, columns: list[str]) -> DataFrame:
    """The last known hit flags by symbol, session and bracket."""
    keys = ["symbol", "session_date", "bracket"]
    return bars.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in columns])


def hit_contingency(trades: DataFrame, a: str, b: str) -> DataFrame:
    return trades.groupBy(a, b).agg(F.count(F.lit(1)).alias("trade_count"), F.avg("r_multiple").alias("avg_r"))


def random_entries(bars: DataFrame, reference: DataFrame, replicas: int, seed: int = 9) -> DataFrame:
    """As many entries a replica and symbol as the reference has, at bars in the order
    of their draws, with directions drawn from the reference's shares."""
    need = reference.groupBy("symbol").agg(F.count(F.lit(1)).alias("need"), F.avg((F.col("direction") == "long").cast("double")).alias("long_share"))
    rows = bars.select("symbol", "bar_index").withColumn("replica_id", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    rows = rows.withColumns({"d": draw(F.col("replica_id"), F.col("bar_index"), seed), "w": draw(F.col("replica_id"), F.col("bar_index"), seed + 1) / 2147483647.0})
    rows = rows.join(need, "symbol").withColumn("place", F.row_number().over(Window.partitionBy("symbol", "replica_id").orderBy("d", "bar_index"))).where("place <= need")
    return rows.select("symbol", "replica_id", "bar_index", F.when(F.col("w") < F.col("long_share"), "long").otherwise("short").alias("direction"), F.xxhash64("replica_id", "place").alias("signal_id"))


def random_benchmark(bars: DataFrame, reference: DataFrame, replicas: int = 500, seed: int = 9, **settings) -> DataFrame:
    """Where the mean R of the reference's trades stands among that of random entries.

    Each replica has as many entries by symbol as the reference has trades; all of them are
    simulated in one plan with ``settings``, as the replica is a key of its signals.
    One row: a replica without a trade counts as 0, and a reference without one gives none.
    """
    drawn = random_entries(bars, reference, replicas, seed)
    means = simulate(bars, drawn, **settings).where("r_multiple is not null").groupBy("replica_id").agg(F.avg("r_multiple").alias("m"))
    every = bars.sparkSession.range(replicas).select(F.col("id").cast("int").alias("replica_id")).join(means, "replica_id", "left").select(F.coalesce("m", F.lit(0.0)).alias("m"))
    seen = reference.agg(F.avg("r_multiple").alias("observed")).where("observed is not null")
    met = every.crossJoin(F.broadcast(seen))  # one row
    at_least = F.count_if(F.col("m") >= F.col("observed"))
    n = F.count(F.lit(1))
    return met.groupBy(F.col("observed").alias("observed_expectancy_r")).agg(n.alias("n_replicas"), F.avg("m").alias("null_expectancy_mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("null_expectancy_std"), (F.avg((F.col("m") < F.col("observed")).cast("double")) * 100).alias("percentile"), ((1 + at_least) / (n + 1)).alias("p_value"))


def normal_probability(z: Column) -> Column:
    """The normal distribution function by its power series, to about 1e-15."""
    x = F.when(z.isNotNull(), F.greatest(F.least(z.cast("double"), F.lit(8.0)), F.lit(-8.0)))  # without the test, a null is 8
    grow = lambda s, k: F.struct((s["term"] * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * x * x / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(150)), F.struct(x.alias("term"), x.alias("sum")), grow)
    return 0.5 + series["sum"] * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_quantile(p: Column) -> Column:
    """Its inverse by bisection between -8 and 8."""
    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        below = normal_probability(mid) < p
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-8.0).alias("lo"), F.lit(8.0).alias("hi")), halve)
    return (at["lo"] + at["hi"]) / 2


def deflated_sharpe(trades: DataFrame, keys: list[str], trials: int | None = None) -> DataFrame:
    """By cell (``keys``): its probabilistic Sharpe ratio, and that against the best that
    so many trials reach by chance, given the spread of the cells' own ratios.

    trials: how many cells count as independent; all with a ratio unless given. Cells
    of under four trades or without spread have no psr, and with under two trials no
    cell has a dsr. The cells' moments are one grouping; the trials are one row of it.
    """
    m = sharpe_moments(trades, keys)
    tried = m.agg(F.count(F.lit(1)).alias("tested_trials"), F.stddev_samp("sharpe").alias("sigma"))
    n = F.lit(float(trials)) if trials else F.col("tested_trials").cast("double")
    can = (n >= 2) & (F.col("tested_trials") >= 2) & (F.col("sigma") > 0)
    most = F.col("sigma") * ((1 - EULER_GAMMA) * normal_quantile(1 - 1 / n) + EULER_GAMMA * normal_quantile(1 - 1 / (n * math.e)))
    tried = tried.select("tested_trials", n.cast("long").alias("effective_trials"), F.when(can, most).alias("expected_max_sharpe"))
    spread = 1 - F.col("g1") * F.col("sharpe") + (F.col("g2") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    z = lambda over: F.when((F.col("n") >= 4) & (spread > 0), (F.col("sharpe") - over) * F.sqrt(F.col("n") - 1) / F.sqrt(spread))
    out = m.crossJoin(F.broadcast(tried))  # one row
    return out.select(*keys, "n", "sharpe", "tested_trials", "effective_trials", "expected_max_sharpe", normal_probability(z(F.lit(0.0))).alias("psr"), normal_probability(z(F.col("expected_max_sharpe"))).alias("dsr"))


def otf_settings(trades: DataFrame, signals: DataFrame, states: dict[int, DataFrame], configs: dict[str, tuple[int, ...]] = OTF_CONFIGS) -> DataFrame:
    """Trades by setting ``config``: those of signals that every time frame of the setting
    accepts. All signals are simulated and filtered once, each on its own.

    states: from otf_state, by seconds of the time frame.
    """
    frames = sorted(states)
    known = otf_filter(signals.select("symbol", "signal_id", "direction", "ts"), [states[s] for s in frames])
    want = F.when(F.col("direction") == "long", "up").otherwise("down")
    met = {s: F.coalesce(F.col(f"otf_{i}") == want, F.lit(False)) for i, s in enumerate(frames)}
    names = [F.when(reduce(lambda a, b: a & b, [met[s] for s in need], F.lit(True)), F.lit(c)) for c, need in configs.items()]
    kept = known.select("symbol", "signal_id", F.explode(F.array_compact(F.array(*names))).alias("config"))
    return trades.join(kept, ["symbol", "signal_id"])


def otf_matrix(filtered: DataFrame, split_at: int) -> DataFrame:
    """By setting and period: trades, expectancy and their change against no_otf.

    filtered: trades of each setting's accepted signals, with config and
    entry_bar_index; the split by entry bar makes the training and later periods.
    """
    period = F.when(F.col("entry_bar_index") < split_at, "train").otherwise("oos")
    g = filtered.withColumn("period", period).groupBy("config", "period").agg(F.count(F.lit(1)).alias("trade_count"), F.avg("r_multiple").alias("expectancy_r"))
    base = g.where("config = 'no_otf'").select("period", F.col("trade_count").alias("base_count"), F.col("expectancy_r").alias("base_expectancy"))
    out = g.join(base, "period").withColumns({"delta_trades": F.col("trade_count") - F.col("base_count"), "delta_expectancy": F.col("expectancy_r") - F.col("base_expectancy")})
    return out.withColumn("train_rank", F.when(F.col("period") == "train", F.rank().over(Window.partitionBy("period").orderBy(F.desc_nulls_last("expectancy_r"))))).drop("base_count", "base_expectancy")


def around_trades(bars: DataFrame, trades: DataFrame, before: int, after: int) -> DataFrame:
    """The bars of each trade with so many more on both sides."""
    spans = trades.select("symbol", "trade_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("entry_bar_index") - before), F.col("exit_bar_index") + after)).alias("bar_index"))
    return bars.join(spans, ["symbol", "bar_index"])


def recent(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars by symbol."""
    return bars.withColumn("__r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("__r") <= n).drop("__r")


def sub_bar_faults(parents: DataFrame, sub: DataFrame, parent_s: int, sub_s: int, tick: float = 0.25) -> DataFrame:
    """The first reason, if any, why a parent bar's sub-bars can't stand in for it."""
    from tapewright.operators.bars import floored

    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tick * 1e-6
    agg = sub.groupBy("symbol", floored(F.col("ts"), parent_s).alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.pmod(micros(F.col("ts")), F.lit(sub_s * 1_000_000)) == 0).alias("aligned"), F.min_by("open", "ts").alias("s_open"), F.max("high").alias("s_high"), F.min("low").alias("s_low"), F.max_by("close", "ts").alias("s_close"))
    out = parents.join(agg, ["symbol", "ts"], "left")
    fault = F.when(F.coalesce(F.col("n"), F.lit(0)) != parent_s // sub_s, "incomplete_coverage").when(~F.col("aligned"), "timestamp_misalignment")
    fault = fault.when(F.greatest("open", "close") > F.col("high"), "parent_invalid_ohlc").when(~(close("open", "s_open") & close("high", "s_high") & close("low", "s_low") & close("close", "s_close")), "ohlc_mismatch")
    return out.withColumn("fault", fault)


def confirm_three_bars(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """Three bars in a row: one that tests a level from its far side and closes back,
    one that closes beyond the first, and one that trades at the second's close.

    Of several levels that a bar tests, the highest counts for longs, the lowest for shorts.
    """
    w = Window.partitionBy("symbol").orderBy("bar_index")
    rows = bars.select("symbol", "bar_index", "open", "high", "low", "close", F.lag("close").over(w).alias("prev"), *[F.lead(c, k).over(w).alias(f"{c}{k}") for c in ("high", "low", "close") for k in (1, 2)])
    met = levels.select("symbol", "bar_index", "level_price").join(rows, ["symbol", "bar_index"])
    p = F.col("level_price")
    long = (F.col("low") <= p) & (F.col("close") > p) & ((F.col("open") > p) | F.coalesce(F.col("prev") > p, F.lit(False)))
    short = (F.col("high") >= p) & (F.col("close") < p) & ((F.col("open") < p) | F.coalesce(F.col("prev") < p, F.lit(False)))
    out = met.groupBy("symbol", "bar_index").agg(F.max(F.when(long, p)).alias("long_level"), F.min(F.when(short, p)).alias("short_level"), *[F.first(c).alias(c) for c in ("high", "low", "high1", "low1", "close1", "high2", "low2")])
    sides = F.array(F.struct(F.lit("long").alias("direction"), F.col("long_level").alias("level_price")), F.struct(F.lit("short").alias("direction"), F.col("short_level").alias("level_price")))
    out = out.withColumn("x", F.explode(sides)).select("*", "x.*").where("level_price is not null")
    up = F.col("direction") == "long"
    reversed_ = F.when(up, F.col("close1") > F.col("high")).otherwise(F.col("close1") < F.col("low"))
    filled = F.when(up, F.col("low2") <= F.col("close1")).otherwise(F.col("high2") >= F.col("close1"))
    out = out.where(reversed_)
    return out.select("symbol", "bar_index", "direction", "level_price", F.col("close1").alias("entry_price"), F.when(F.coalesce(filled, F.lit(False)), "filled").otherwise("void").alias("status"))
