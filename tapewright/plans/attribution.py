"""Attribution of results to levels, combinations of levels, and excursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(names: Column) -> Column:
    """Level names of a text separated by | or comma: trimmed, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.replace(names, F.lit(","), F.lit("|")), r"\|"), F.trim), lambda x: x != ""))


def combo_key(names: Column) -> Column:
    return F.array_join(F.array_sort(tokens(names)), "|")


def _stats(rows: DataFrame, keys: list[str], min_trades: int, *more: Column) -> DataFrame:
    r = F.col("r_multiple")
    out = rows.where("r_multiple is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("trade_count"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_r"), F.percentile(r, 0.5).alias("median_r"), F.sum(r).alias("total_r"), *more)
    return out.withColumn("sample_warning", F.col("trade_count") < min_trades)


def by_combo(trades: DataFrame, keys: list[str] = (), min_trades: int = 30) -> DataFrame:
    """By exact combination of levels, with the earliest trade's raw names as example."""
    rows = trades.withColumn("combo", combo_key(F.col("level_names"))).where("combo <> ''")
    return _stats(rows, ["combo", *keys], min_trades, F.min_by("level_names", F.struct("exit_ts", "trade_id")).alias("example"))


def by_level(trades: DataFrame, min_trades: int = 30) -> DataFrame:
    """By member level; a trade counts for each of its levels."""
    return _stats(trades.withColumn("level", F.explode(tokens(F.col("level_names")))), ["level"], min_trades)


def by_level_count(trades: DataFrame, min_trades: int = 30) -> DataFrame:
    n = F.size(tokens(F.col("level_names")))
    return _stats(trades.withColumn("bucket", F.when(n == 0, "(unknown)").when(n >= 5, "5+").otherwise(n.cast("string"))), ["bucket"], min_trades)


def by_pair(trades: DataFrame, min_trades: int = 30, anchor: str | None = None) -> DataFrame:
    """By unordered pair of levels, or by anchor and partner. Pairs are within a trade's few levels."""
    t = F.array_sort(tokens(F.col("level_names")))
    if anchor:
        pairs = F.when(F.array_contains(t, anchor), F.transform(F.array_remove(t, F.lit(anchor)), lambda x: F.concat(F.lit(f"{anchor}|"), x)))
    else:
        pairs = F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda y: F.concat(x, F.lit("|"), y))))
    return _stats(trades.withColumn("pair", F.explode(pairs)), ["pair"], min_trades)


def excursions(trades: DataFrame, tick: float = 0.25) -> DataFrame:
    """Excursions in units of risk, what was given back, and their ratio."""
    risk = F.col("stop_ticks") * tick
    return trades.withColumns({"risk_points": risk, "mae_r": F.col("mae_points") / risk, "mfe_r": F.col("mfe_points") / risk, "giveback_r": F.col("mfe_points") / risk - F.col("r_multiple"), "edge_ratio": F.when(F.col("mae_points") > 0, F.col("mfe_points") / F.col("mae_points"))})


def excursion_distribution(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Means and percentiles by group; a null key is a group."""
    stats = [f(c).alias(f"{n}_{c}") for c in ("mae_r", "mfe_r", "giveback_r") for n, f in {"mean": F.avg, "median": lambda x: F.percentile(x, 0.5), "p25": lambda x: F.percentile(x, 0.25), "p75": lambda x: F.percentile(x, 0.75), "p95": lambda x: F.percentile(x, 0.95)}.items()]
    return trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("trade_count"), *stats)


def quadrants(trades: DataFrame, mae: float = 0.5, mfe: float = 1.0) -> DataFrame:
    """Counts in the four quadrants of excursions, empty ones included."""
    q = F.concat(F.when(F.col("mfe_r") >= mfe, "high_mfe").otherwise("low_mfe"), F.lit("_"), F.when(F.col("mae_r") >= mae, "high_mae").otherwise("low_mae"))
    dim = trades.sparkSession.createDataFrame([(f"{a}_mfe_{b}_mae",) for a in ("high", "low") for b in ("high", "low")], "quadrant string")
    got = trades.where("mae_r is not null and mfe_r is not null").groupBy(q.alias("quadrant")).agg(F.count(F.lit(1)).alias("trade_count"), F.avg("r_multiple").alias("avg_r"))
    return dim.join(F.broadcast(got), "quadrant", "left").fillna(0, ["trade_count"])


def hit_grid(trades: DataFrame, stops: list[float], targets: list[float], both: str = "stop_first") -> DataFrame:
    """For each stop and target in R: how many trades reach one, the other, both or none. The grid is a literal array."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("stop_r"), F.lit(float(t)).alias("target_r")) for s in stops for t in targets]))
    rows = trades.where("mae_r is not null and mfe_r is not null").select("mae_r", "mfe_r", grid.alias("g")).select("mae_r", "mfe_r", "g.*")
    s, t = F.col("mae_r") >= F.col("stop_r"), F.col("mfe_r") >= F.col("target_r")
    out = rows.groupBy("stop_r", "target_r").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(s & ~t).alias("stop_only"), F.count_if(t & ~s).alias("target_only"), F.count_if(s & t).alias("ambiguous"), F.count_if(~s & ~t).alias("unresolved"))
    hits = {"stop_first": F.col("target_only"), "target_first": F.col("target_only") + F.col("ambiguous"), "exclude": F.col("target_only")}[both]
    base = F.col("evaluated") - (F.col("ambiguous") if both == "exclude" else 0)
    return out.withColumn("target_probability", F.when(base > 0, hits / base))


def edge_by_holding(trades: DataFrame, edges: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    b = F.lit(f">{edges[-1]}")
    for lo, hi in reversed(list(zip((0, *edges[:-1]), edges, strict=True))):
        b = F.when(F.col("bars_held") <= hi, f"({lo},{hi}]").otherwise(b)
    return trades.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("trade_count"), F.avg("edge_ratio").alias("avg_edge_ratio"), F.avg("r_multiple").alias("avg_r"))
