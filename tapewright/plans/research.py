"""Parameter grids, walk-forward, resampling and overfitting statistics.

Cells, folds, replicas and simulations are keys of one plan. Draws are integers
from a linear congruence of (simulation, position, seed), so a result doesn't
depend on partitions and SQL can make the same draws.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapewright.operators import zones as Z
from tapewright.operators.joins import asof_backward
from tapewright.operators.simulate import simulate
from tapewright.plans.metrics import best_cell, trade_summary
from tapewright.session import stored

# Multipliers and modulus of the draws.
A, B, C, M = 1103515245, 12345, 134775813, 2147483647


def draw(sim: Column, pos: Column, seed: int) -> Column:
    """A pseudorandom integer below M: two rounds of a congruence."""
    one = F.pmod(sim.cast("long") * A + pos.cast("long") * C + F.lit(seed * B).cast("long"), F.lit(M).cast("long"))
    return F.pmod(one * 48271 + F.lit(B).cast("long"), F.lit(M).cast("long"))


def draws(sim: int, pos: np.ndarray, seed: int) -> np.ndarray:
    """``draw`` of one simulation at many positions."""
    return ((sim * A + pos * C + seed * B) % M * 48271 + B) % M


def grid_cells(stops: list[float], targets: list[float], breakeven: list[float | None] = (None,), trail: list[tuple[float, float] | None] = (None,), limit: int = 10_000) -> list[dict]:
    cells = [{"stop_ticks": s, "target_ticks": t, "breakeven_r": b, "trail_r": x and x[0], "trail_ticks": x and x[1]} for s, t, b, x in itertools.product(stops, targets, breakeven, trail)]
    if len(cells) > limit:
        raise ValueError(f"{len(cells)} cells; the limit is {limit}")
    return cells


def grid(bars: DataFrame, signals: DataFrame, cells: list[dict], **options) -> DataFrame:
    """One row a cell with its metrics, from one simulation, persisted as the metrics read it twice."""
    trades = simulate(bars, signals, cells, **options).withColumn("trade_id", F.col("signal_id")).persist()
    return trade_summary(trades, ["cell_id", "stop_ticks", "target_ticks"])


def folds(n_bars: int, train: int, test: int, step: int | None = None, anchored: bool = False) -> list[tuple[int, int, int, int]]:
    """(train from, train to, test from, test to), ends excluded."""
    out, at = [], 0
    while at + train + test <= n_bars:
        out.append((0 if anchored else at, at + train, at + train, at + train + test))
        at += step or test
    return out


def walk_forward(trades: DataFrame, fold_list: list[tuple[int, int, int, int]], metric: str = "expectancy_r", min_trades: int = 1, labels: list[int] | None = None) -> DataFrame:
    """By fold (and label, such as a matrix cell): the cell that is best on trades which enter and exit within the
    training bars, and its metrics within the test bars.

    trades: of all cells, simulated once; the few folds are a literal array.
    """
    spans = F.explode(F.array(*[F.struct(F.lit(i).alias("fold_id"), F.lit((labels or [0] * len(fold_list))[i]).alias("label"), *[F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "d"), f, strict=True)]) for i, f in enumerate(fold_list)]))
    return _walked(trades.withColumn("f", spans).select("*", "f.*").drop("f"), metric, min_trades)


def walk_forward_all(trades: DataFrame, bars: DataFrame, spans: list[tuple[int, int, int]], anchored: bool = False, metric: str = "expectancy_r", min_trades: int = 1) -> DataFrame:
    return _walked(_in_folds(trades, bars, spans, anchored), metric, min_trades)


def _in_folds(trades: DataFrame, bars: DataFrame, spans: list[tuple[int, int, int]], anchored: bool) -> DataFrame:
    """As walk_forward, over all bars there are: spans are (train, test, step) bars, each a label with its own folds.

    The number of folds follows from the longest symbol's bars, as a table of one row; a trade
    meets only the folds whose bars hold it.
    """
    if any(min(x) < 1 for x in spans):
        raise ValueError("train, test and step must be 1 bar or more")
    n_bars = bars.agg(F.max("bar_index").alias("__last"))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("label"), *[F.lit(v).alias(n) for n, v in zip(("__train", "__test", "__step"), x, strict=True)]) for i, x in enumerate(spans)]))
    rows = trades.crossJoin(F.broadcast(n_bars)).withColumn("f", kinds).select("*", "f.*").drop("f")
    first = F.greatest(F.lit(0), F.ceil((F.col("exit_bar_index") + 1 - F.col("__train") - F.col("__test")) / F.col("__step"))).cast("int")
    end = F.floor((F.col("__last") + 1 - F.col("__train") - F.col("__test")) / F.col("__step"))
    last = (end if anchored else F.least(end, F.floor(F.col("entry_bar_index") / F.col("__step")))).cast("int")
    rows = rows.withColumns({"__first": first, "__end": last}).where("__first <= __end").withColumn("fold_id", F.explode(F.sequence("__first", "__end")))
    at = F.col("fold_id") * F.col("__step")
    rows = rows.withColumns({"a": F.lit(0) if anchored else at, "b": at + F.col("__train"), "c": at + F.col("__train"), "d": at + F.col("__train") + F.col("__test")})
    return rows.drop("__last", "__train", "__test", "__step", "__first", "__end")


def fold_verdicts(signals: DataFrame, bars: DataFrame, span: tuple[int, int, int], base_s: int, timeframes_s: list[int], least: int = 3, mode: str = "all", policy: str = "fold_local", anchored: bool = False) -> DataFrame:
    """(symbol, signal_id, part, start, accepted) for each signal and each training or
    test part of a fold that holds its bar, named by the part's first bar.

    A long needs the time frames (all, or any) up as known at the signal, a short down.
    ``causal_prefix`` reads states off all bars before; ``fold_local`` off the bars of the
    part alone. States start anew with each session, so those of a part differ from those
    of all bars in the session that the part starts in and nowhere else: this session's
    bars from the start on are the part's version, two as-of joins find the version's
    state and that of all bars, and the latter counts once it is of a later session.
    """
    if policy not in ("fold_local", "causal_prefix"):
        raise ValueError(f"no such policy of one-time-framing by fold: {policy}")
    if mode not in ("all", "any"):
        raise ValueError(f"no such alignment: {mode}")
    train, test, step = span
    at = bars.select("symbol", "bar_index", "ts")
    rows = signals.select("symbol", "signal_id", "bar_index", "direction").join(at, ["symbol", "bar_index"])
    i = F.col("bar_index")
    starts = lambda name, offset, n: F.transform(F.filter(F.sequence(F.floor((i - offset - n) / step), F.floor((i - offset) / step)), lambda k: (k >= 0) & (k * step + offset + n > i)), lambda k: F.struct(F.lit(name).alias("part"), (k * step + offset).cast("int").alias("start")))
    first = F.array(F.struct(F.lit("train").alias("part"), F.lit(0).alias("start"))) if anchored else starts("train", 0, train)
    want = F.when(F.col("direction") == "long", "up").otherwise("down")
    versions = None
    if policy == "fold_local":
        begins = bars.where((F.pmod("bar_index", F.lit(step)) == 0) | (F.pmod(F.col("bar_index") - train, F.lit(step)) == 0) | (F.col("bar_index") == 0))
        begins = begins.select("symbol", "session_date", F.col("bar_index").alias("start"))
        versions = bars.join(begins, ["symbol", "session_date"]).where(F.col("bar_index") >= F.col("start"))
    fits = []
    for k, secs in enumerate(timeframes_s):
        whole = Z.otf_state(bars, secs, base_s, least).select("symbol", F.col("available_at").alias("__known"), F.struct("state", "session_date").alias(f"__g{k}"))
        rows = asof_backward(rows, whole, ["symbol"], "ts", "__known", [f"__g{k}"])
    rows = rows.withColumn("x", F.explode(F.concat(first, starts("test", train, test)))).select("*", "x.*").drop("x")
    if policy == "fold_local":
        rows = rows.join(begins.withColumnRenamed("session_date", "__began"), ["symbol", "start"], "left")
    for k, secs in enumerate(timeframes_s):
        state = F.col(f"__g{k}.state")
        if policy == "fold_local":
            own = Z.otf_state(versions, secs, base_s, least, ["start"]).select("symbol", "start", F.col("available_at").alias("__known"), F.col("state").alias(f"__v{k}"))
            rows = asof_backward(rows, own, ["symbol", "start"], "ts", "__known", [f"__v{k}"])
            state = F.when(F.col(f"__g{k}.session_date") > F.col("__began"), state).otherwise(F.col(f"__v{k}"))
        fits.append(F.coalesce(state == want, F.lit(False)))
    return rows.select("symbol", "signal_id", "part", "start", reduce(lambda x, y: x & y if mode == "all" else x | y, fits).alias("accepted"))


def walk_forward_otf(trades: DataFrame, signals: DataFrame, bars: DataFrame, span: tuple[int, int, int], base_s: int, timeframes_s: list[int], least: int = 3, mode: str = "all", policy: str = "fold_local", anchored: bool = False, metric: str = "expectancy_r", min_trades: int = 1) -> DataFrame:
    """As walk_forward_all for one span, on the signals that one-time-framing accepts in
    each part of each fold; with the numbers of signals of the parts, and rejected ones.

    trades: of all cells and signals, simulated once, as outcomes don't depend on the filter.
    """
    train, _, step = span
    verdicts = stored(fold_verdicts(signals, bars, span, base_s, timeframes_s, least, mode, policy, anchored))
    ok = verdicts.where("accepted").select("symbol", "signal_id", "part", "start")
    rows = _in_folds(trades, bars, [span], anchored)
    rows = rows.withColumn("x", F.explode(F.array(F.struct(F.lit("train").alias("part"), F.col("a").alias("start")), F.struct(F.lit("test").alias("part"), F.col("c").alias("start"))))).select("*", "x.*").drop("x")
    rows = rows.withColumn("start", F.col("start").cast("int")).join(ok, ["symbol", "signal_id", "part", "start"])
    out = _walked(rows, metric, min_trades, by_part=True)
    held = verdicts.groupBy("part", "start").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("accepted"), 1)).alias("rejected"))
    for part, start in (("train", F.lit(0) if anchored else F.col("fold_id") * step), ("test", F.col("fold_id") * step + train)):
        side = held.where(F.col("part") == part).select(F.col("start").alias("__start"), F.col("n").alias(f"{part}_signals"), F.col("rejected").alias(f"{part}_rejected"))
        out = out.join(side, start == F.col("__start"), "left").drop("__start")
    return out.fillna(0, [f"{p}_{c}" for p in ("train", "test") for c in ("signals", "rejected")])


def walk_forward_sessions(trades: DataFrame, bars: DataFrame, spans: list[tuple[int, int, int]], anchored: bool = False, metric: str = "expectancy_r", min_trades: int = 1) -> DataFrame:
    """As walk_forward_all with spans counted in sessions, numbered over all symbols."""
    dated, numbered = _by_session(trades, bars)
    return walk_forward_all(dated, numbered, spans, anchored, metric, min_trades)


def _by_session(trades: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades and bars whose bar numbers are those of their sessions. There are as many
    sessions as days, so one task numbers them."""
    dates = bars.select("session_date").distinct().withColumn("__no", F.row_number().over(Window.orderBy("session_date")) - 1)
    of = bars.select("symbol", "bar_index", "session_date").join(dates, "session_date").select("symbol", "bar_index", "__no")
    out = trades
    for c in ("entry_bar_index", "exit_bar_index"):
        out = out.join(of.withColumnsRenamed({"bar_index": c, "__no": f"__{c}"}), ["symbol", c])
    out = out.drop("entry_bar_index", "exit_bar_index").withColumnsRenamed({f"__{c}": c for c in ("entry_bar_index", "exit_bar_index")})
    return out, dates.select(F.col("__no").alias("bar_index"))


def stitched_trades(trades: DataFrame, folds_: DataFrame, span: tuple[int, int, int], policy: str = "reject") -> DataFrame:
    """The out-of-sample trades of each fold's best cell, once each.

    folds_: from walk_forward_all with this (train, test, step) alone. Where test bars overlap
    (step < test), the ``first`` or ``last`` fold keeps a trade of a signal and entry bar;
    ``reject`` raises then.
    """
    train, test, step = span
    if policy not in ("reject", "first", "last"):
        raise ValueError(f"no such overlap policy: {policy}")
    if step < test and policy == "reject":
        raise ValueError("test bars of neighbouring folds overlap")
    low = F.greatest(F.lit(0), F.floor((F.col("entry_bar_index") - train - test) / step) + 1)
    high = F.floor((F.col("entry_bar_index") - train) / step)
    held = trades.withColumns({"__a": low.cast("int"), "__b": high.cast("int")}).where("__a <= __b").withColumn("fold_id", F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")
    held = held.where(F.col("exit_bar_index") < F.col("fold_id") * step + train + test).join(folds_.select("fold_id", "cell_id"), ["fold_id", "cell_id"])
    if step >= test:
        return held
    once = Window.partitionBy("symbol", "entry_bar_index", "signal_id").orderBy(F.asc("fold_id") if policy == "first" else F.desc("fold_id"))
    return held.withColumn("__r", F.row_number().over(once)).where("__r = 1").drop("__r")


def _walked(rows: DataFrame, metric: str, min_trades: int, by_part: bool = False) -> DataFrame:
    """Trades with a label, fold_id and the fold's bars (a, b, c, d) -> the best cell of
    each fold. by_part: a row counts for its ``part`` alone."""
    inside = lambda lo, hi: (F.col("entry_bar_index") >= F.col(lo)) & (F.col("exit_bar_index") < F.col(hi))
    keys = ["fold_id", "label", "cell_id", "stop_ticks", "target_ticks"]
    of = lambda part: F.col("part") == part if by_part else F.lit(True)
    train = best_cell(trade_summary(rows.where(inside("a", "b") & of("train")), keys), metric, ["label", "fold_id"], min_trades)
    test = trade_summary(rows.where(inside("c", "d") & of("test")), ["label", "fold_id", "cell_id"])
    test = test.select("label", "fold_id", "cell_id", F.col("trade_count").alias("test_trades"), F.col(metric).alias("test_metric"), F.col("total_r").alias("test_total_r"))
    out = train.select(*keys, F.col("trade_count").alias("train_trades"), F.col(metric).alias("train_metric")).join(test, ["label", "fold_id", "cell_id"], "left")
    return out.withColumn("retention", F.when(F.abs("train_metric") > 1e-8, F.col("test_metric") / F.col("train_metric")))


def _numbered(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trades by key with their position in order of exit and their number."""
    w = Window.partitionBy(*keys)
    return trades.where("r_multiple is not null").select(*keys, "trade_id", "exit_ts", "r_multiple").withColumns({"pos": F.row_number().over(w.orderBy("exit_ts", "trade_id")) - 1, "n": F.count(F.lit(1)).over(w)})


def _by_group(trades: DataFrame, keys: list[str], made: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """Columns that ``made`` gets from the R multiples of each group of ``keys``, in order of exit.

    Trades are shuffled once, as they are; a group's simulations are made where it is, so
    no row is kept or sorted for a trade of a simulation. A task holds one group at a time.
    """
    rows = trades.where("r_multiple is not null").select(*keys, "exit_ts", "trade_id", F.col("r_multiple").cast("double").alias("r"))
    names = schema.replace(",", "").split()[::2]

    def go(key, table):
        order = pc.sort_indices(table, sort_keys=[("exit_ts", "ascending"), ("trade_id", "ascending")], null_placement="at_start")
        out = made(table["r"].to_numpy()[order.to_numpy()])
        n = len(out[names[0]])
        return pa.table([*[pa.repeat(k, n) for k in key], *[pa.array(out[c]) for c in names]], names=[*keys, *names])

    kinds = StructType([rows.schema[k] for k in keys])
    return rows.groupBy(*keys).applyInArrow(go, StructType([*kinds.fields, *StructType.fromDDL(schema).fields]))


def _sims(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sim")


def bootstrap_ci(trades: DataFrame, keys: list[str], n_sims: int = 2000, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """Resampled means: percentile interval and share above 0. Each draw is a position of its group."""

    def resampled(r):
        pos = np.arange(len(r))
        return {"sim": np.arange(n_sims, dtype=np.int32), "m": np.array([np.cumsum(r[draws(sim, pos, seed) % len(r)])[-1] / len(r) for sim in range(n_sims)])}

    means = _by_group(trades, keys, resampled, "sim int, m double")
    lo = (1 - confidence) / 2
    return means.groupBy(*keys).agg(F.percentile("m", lo).alias("ci_low"), F.percentile("m", 1 - lo).alias("ci_high"), F.avg("m").alias("mean_of_means"), F.avg((F.col("m") > 0).cast("double")).alias("prob_positive"))


def permutation_test(trades: DataFrame, keys: list[str], n_sims: int = 1000, seed: int = 2) -> DataFrame:
    """Sign flips: share of flipped means that are at least the observed."""
    rows = _numbered(trades, keys)
    flips = rows.select(*keys, "pos", "r_multiple", _sims(n_sims)).withColumn("r", F.when(F.pmod(draw(F.col("sim"), F.col("pos"), seed), F.lit(1009)) % 2 == 0, F.col("r_multiple")).otherwise(-F.col("r_multiple")))
    means = flips.groupBy(*keys, "sim").agg(F.avg("r").alias("m"), F.avg("r_multiple").alias("observed"))
    return means.groupBy(*keys).agg(F.max("observed").alias("observed_mean"), F.avg((F.round("m", 9) >= F.round("observed", 9)).cast("double")).alias("p_value"))


def monte_carlo(trades: DataFrame, keys: list[str], method: str = "reshuffle", n_sims: int = 200, seed: int = 3, skip: float = 0.1, block: int | None = None) -> DataFrame:
    """Paths of reordered (reshuffle), thinned (skip) or block-resampled trades:
    final R and largest drawdown of each simulation."""
    path = _path(method, seed, skip, block)

    def ends(r):
        final, worst = np.empty(n_sims), np.empty(n_sims)
        for sim in range(n_sims):
            cum = np.cumsum(path(r, sim))
            final[sim], worst[sim] = cum[-1], (np.maximum(np.maximum.accumulate(cum), 0.0) - cum).max()
        return {"sim": np.arange(n_sims, dtype=np.int32), "final_r": final, "max_drawdown_r": worst}

    return _by_group(trades, keys, ends, "sim int, final_r double, max_drawdown_r double")


def _path(method: str, seed: int, skip: float, block: int | None) -> Callable[[np.ndarray, int], np.ndarray]:
    """From R multiples in order of exit and a simulation to those of its path, in order."""
    if method not in ("reshuffle", "skip", "block"):
        raise ValueError(f"no such method: {method}")

    def path(r: np.ndarray, sim: int) -> np.ndarray:
        pos = np.arange(len(r))
        if method == "reshuffle":
            return r[np.argsort(draws(sim, pos, seed), kind="stable")]
        if method == "skip":
            return np.where(draws(sim, pos, seed) >= int(skip * M), r, 0.0)
        size = block or max(2, round(math.sqrt(len(r))))
        return r[(draws(sim, pos // size, seed) % len(r) + pos % size) % len(r)]

    return path


def monte_carlo_fan(trades: DataFrame, keys: list[str], method: str = "reshuffle", n_sims: int = 200, seed: int = 3, skip: float = 0.1, block: int | None = None, percentiles: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """Percentiles of the equity over all simulations by key and trade_index (from 1), and
    the observed equity. The simulations of a position are sorted by their equity, and the
    two that a percentile lies between are picked by their place. A task holds n_sims
    doubles for each trade of the group that it is at."""
    path = _path(method, seed, skip, block)

    def fan(r):
        cum = np.empty((len(r), n_sims))
        for sim in range(n_sims):
            cum[:, sim] = np.cumsum(path(r, sim))
        cum.sort(axis=1)
        out = {"trade_index": np.arange(1, len(r) + 1, dtype=np.int32), "observed_cum_r": np.cumsum(r)}
        for p in percentiles:
            place = (n_sims - 1) * (p / 100)
            low, high = cum[:, math.floor(place)], cum[:, math.ceil(place)]
            out[f"p{p}"] = low + (high - low) * (place - math.floor(place))
        return out

    return _by_group(trades, keys, fan, "trade_index int, " + ", ".join(f"p{p} double" for p in percentiles) + ", observed_cum_r double")


def monte_carlo_streaks(trades: DataFrame, keys: list[str], method: str = "reshuffle", n_sims: int = 200, seed: int = 3, skip: float = 0.1, block: int | None = None) -> DataFrame:
    """The longest run of losses of each simulation: the largest gap between trades that are none."""
    path = _path(method, seed, skip, block)

    def streaks(r):
        longest = []
        for sim in range(n_sims):
            ends = np.flatnonzero(~(path(r, sim) < 0))  # the trades between two others are all losses
            longest.append(np.diff(ends, prepend=-1, append=len(r)).max() - 1)
        return {"sim": np.arange(n_sims, dtype=np.int32), "max_loss_streak": np.array(longest, np.int64)}

    return _by_group(trades, keys, streaks, "sim int, max_loss_streak long")


def monte_carlo_summary(paths: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (3, 5, 10)) -> DataFrame:
    p = lambda c, q: F.percentile(c, q / 100).alias(f"{c}_p{q}")
    return paths.groupBy(*keys).agg(*[p(c, q) for c in ("final_r", "max_drawdown_r") for q in (5, 50, 95)], *[F.avg((F.col("max_drawdown_r") > t).cast("double")).alias(f"prob_dd_over_{t}") for t in thresholds])


def perturb(bars: DataFrame, fraction: float, replicas: int, seed: int = 5) -> DataFrame:
    """Noisy copies of bars by replica_id: each price moves by up to a fraction of the
    bar's range; the extremes are then those of the four prices."""
    rows = bars.withColumn("replica_id", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    size = (F.col("high") - F.col("low")) * fraction
    move = lambda i: (draw(F.col("replica_id"), F.col("bar_index"), seed + i) / M * 2 - 1) * size
    moved = {c: F.col(c) + move(i) for i, c in enumerate(("open", "high", "low", "close"))}
    rows = rows.withColumns({f"__{c}": v for c, v in moved.items()})
    four = [F.col(f"__{c}") for c in moved]
    return rows.withColumns({"open": F.col("__open"), "close": F.col("__close"), "high": F.greatest(*four), "low": F.least(*four)}).drop(*[f"__{c}" for c in moved])


def persistence(base: DataFrame, replica: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """Share of the base trades' keys that a replica has too."""
    a, b = base.select(*keys).distinct(), replica.select(*by, *keys).distinct()
    total = a.count()
    return b.join(a, keys, "left_semi").groupBy(*by).agg((F.count(F.lit(1)) / max(total, 1)).alias("persistence_rate"))


def noise_replicas(bars: DataFrame, baseline: DataFrame, runner: Callable[[DataFrame], DataFrame], fraction: float, replicas: int, keys: list[str], seed: int = 5) -> DataFrame:
    """A row by noisy replica: trades, expectancy, profit factor, and the share of the
    baseline's ``keys`` (beside the symbol) that it trades too.

    runner: from bars to trades, as the baseline had it. It runs once: a replica's bars are
    symbols of their own, so no operator needs to know of replicas. A replica without trades has a row too.
    """
    name = F.concat_ws("#", "symbol", "replica_id")
    noisy = perturb(bars, fraction, replicas, seed).withColumn("symbol", name).drop("replica_id")
    cut = F.length("symbol") - F.length(F.substring_index("symbol", "#", -1))
    trades = runner(noisy).withColumns({"replica_id": F.substring_index("symbol", "#", -1).cast("int"), "symbol": F.substring(F.col("symbol"), F.lit(1), cut - 1)})
    held = baseline.select("symbol", *keys).distinct().withColumn("__held", F.lit(True))
    trades = trades.select("replica_id", "symbol", *keys, "r_multiple").join(held, ["symbol", *keys], "left")
    r = F.col("r_multiple")
    won, lost = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(-F.sum(F.when(r < 0, r)), F.lit(0.0))
    by = trades.groupBy("replica_id").agg(F.count(F.lit(1)).alias("trade_count"), F.avg(r).alias("expectancy_r"), F.when(lost > 0, won / lost).when(won > 0, float("inf")).otherwise(0.0).alias("profit_factor"), F.count_distinct(F.when(F.col("__held"), F.struct("symbol", *keys))).alias("__kept"))
    total = held.agg(F.count(F.lit(1)).alias("__total"))
    out = bars.sparkSession.range(replicas).select(F.col("id").cast("int").alias("replica_id")).join(by, "replica_id", "left").crossJoin(F.broadcast(total))
    kept = F.when(F.col("__total") > 0, F.coalesce("__kept", F.lit(0)) / F.col("__total"))
    return out.select("replica_id", F.coalesce("trade_count", F.lit(0)).alias("trade_count"), "expectancy_r", "profit_factor", kept.alias("persistence_rate"))


def noise_summary(replicas: DataFrame, percentiles: tuple[int, ...] = (5, 50, 95)) -> DataFrame:
    """Percentiles over replicas of expectancy, profit factor and persistence."""
    names = ("expectancy_r", "profit_factor", "persistence_rate")
    return replicas.agg(F.count(F.lit(1)).alias("n_replicas"), *[F.percentile(c, p / 100).alias(f"{c}_p{p}") for c in names for p in percentiles])


def sensitivity_cells(base: dict, fraction: float = 0.25, steps: int = 2) -> list[dict]:
    """One-at-a-time cells: each parameter moved in steps to both sides, ticks at least 1."""
    out = [{**base, "parameter": "base", "step": 0}]
    for name in ("stop_ticks", "target_ticks"):
        seen = {}
        for k in [*range(-steps, 0), *range(1, steps + 1)]:
            v = max(1, round(base[name] * (1 + fraction * k / steps)))
            seen[v] = {**base, name: float(v), "parameter": name, "step": k}
        out += seen.values()
    return out


def cscv_pbo(cell_trades: DataFrame, partitions: int = 8) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    Blocks cut the distinct exit times evenly; sums and counts by (cell, block) are
    all that the C(P, P/2) splits see, a literal array.
    """
    stamps = cell_trades.select("exit_ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("exit_ts")) - 1)
    total = stamps.count()
    stamps = stamps.withColumn("block", F.floor(F.col("i") * partitions / max(total, 1)).cast("int"))
    blocks = cell_trades.join(stamps, "exit_ts").groupBy("cell_id", "block").agg(F.sum("r_multiple").alias("s"), F.count("r_multiple").alias("k"))
    splits = F.explode(F.array(*[F.struct(F.lit(i).alias("split_id"), F.array(*[F.lit(b) for b in c]).alias("train")) for i, c in enumerate(itertools.combinations(range(partitions), partitions // 2))]))
    rows = blocks.withColumn("x", splits).select("cell_id", "block", "s", "k", "x.*")
    sides = rows.withColumn("is", F.array_contains("train", F.col("block"))).groupBy("split_id", "cell_id").agg(*[(F.sum(F.when(c, F.col("s"))) / F.sum(F.when(c, F.col("k")))).alias(n) for n, c in (("ins", F.col("is")), ("oos", ~F.col("is")))]).where("ins is not null and oos is not null")
    w = Window.partitionBy("split_id")
    ranked = sides.withColumns({"n": F.count(F.lit(1)).over(w), "rk": F.rank().over(w.orderBy("oos")) + (F.count(F.lit(1)).over(Window.partitionBy("split_id", "oos")) - 1) / 2, "best": F.row_number().over(w.orderBy(F.desc("ins"), "cell_id"))})
    omega = F.col("rk") / (F.col("n") + 1)
    return ranked.where("best = 1").select("split_id", "cell_id", omega.alias("omega"), F.ln(omega / (1 - omega)).alias("logit"))


def pbo(splits: DataFrame) -> DataFrame:
    """From cscv_pbo(): the share of splits whose best cell in sample is at or below the
    median out of sample (logit at most 0), and the mean logit. One row; null without splits."""
    return splits.agg(F.count(F.lit(1)).alias("n_splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit"))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def sharpe_moments(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Sharpe ratio with its standard error's moments (plain skewness and kurtosis around the sample deviation)."""
    r = F.col("r_multiple")
    m = trades.where("r_multiple is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("g1"), (F.kurtosis(r) + 3).alias("g2"))
    f = (F.col("n") - 1) / F.col("n")
    return m.where("n > 2 and sd > 0").withColumns({"sharpe": F.col("mean") / F.col("sd"), "g1": F.col("g1") * F.pow(f, 1.5), "g2": F.col("g2") * F.pow(f, 2)})


def probabilistic_sharpe(trades: DataFrame, keys: list[str], benchmark: float = 0.0) -> DataFrame:
    """z = (SR - benchmark) sqrt(n-1) / sqrt(1 - g1 SR + (g2-1)/4 SR^2); psr = its normal probability
    (a polynomial approximation of the error function, exact to 1.5e-7)."""
    m = sharpe_moments(trades, keys)
    z = (F.col("sharpe") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("g1") * F.col("sharpe") + (F.col("g2") - 1) / 4 * F.col("sharpe") * F.col("sharpe"))
    x = F.abs(F.col("z")) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return m.withColumn("z", z).withColumn("psr", F.when(F.col("z") >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2))
