"""Which trades an exposure policy and the clock admit, and why the others are skipped."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.config import EXPOSURE_POLICIES, choose, seconds

#: The reasons of skipped signals.
WINDOW, CUTOFF, COOLDOWN = "outside_entry_window", "after_entry_cutoff", "cooldown_active"
OVERLAP = {"single_position": "overlapping_position", "single_direction": "overlapping_direction", "single_setup": "overlapping_setup"}
BAR = ("__group", "__bar", "__signal", "__exit")
MADE = "admitted boolean, skip_reason string, blocking_signal_id long, blocking_exit_bar_index long"


def _fold(cooldown: int):
    """Batches of bars in order of group and bar, each with the first trade that would block
    (or none) -> group, bar, whether the bar is open, and the trade that blocks from then on.
    The last admitted trade of a group has the latest exit of all admitted ones, so it and
    its exit are all that is carried from bar to bar."""

    def go(batches):
        group = blocker = until = None
        for batch in batches:
            out = []
            for g, bar, signal, leave in zip(*[batch.column(c).to_pylist() for c in BAR], strict=True):
                if g != group:
                    group, blocker, until = g, None, None
                free = until is None or bar > until + cooldown
                if free:
                    blocker, until = signal, leave
                out.append((free, blocker, until))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            made = [pa.array(c, k) for c, k in zip(columns, (pa.bool_(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["__group", "__bar", "__open", "__blocker", "__until"])

    return go


def admissions(trades: DataFrame, policy: str = "single_position", cooldown: int = 0, group: str | None = None, by: list[str] = ("symbol", "cell_id")) -> DataFrame:
    """Every trade with ``admitted`` and, if it isn't, ``skip_reason``, the trade that
    blocks it (``blocking_signal_id``) and that one's exit bar.

    Trades are taken by entry bar, signal bar (where there is a column ``bar_index``)
    and signal; a trade is blocked while an admitted one of its group lasts, plus the
    cooldown. Groups are those of ``by`` and, by the policy, the direction or ``group``.
    At one bar, only the first trade that lasts to its own bar can block. So one narrow row
    for each entry bar of a group is read in order by one task, which holds one trade; the
    trades themselves are dealt out by bar, and get their verdict by a join with these rows.
    Outcomes don't depend on admission, so trades are simulated before.
    """
    choose(policy, EXPOSURE_POLICIES, "exposure policy")
    if policy == "single_setup" and not group:
        raise ValueError("single_setup needs the column of the setup")
    trades = trades.drop(*[c.split()[0] for c in MADE.split(", ")], "exposure_group_key")
    if policy == "allow_all":
        kinds = (c.split() for c in MADE.split(", "))
        return trades.withColumns({n: F.lit(True if n == "admitted" else None).cast(k) for n, k in kinds}).withColumn("exposure_group_key", F.lit("all"))
    keys = [*by, *(["direction"] if policy == "single_direction" else [group] if policy == "single_setup" else [])]
    rows = trades.withColumn("exposure_group_key", F.to_json(F.struct(*keys))) if keys else trades.withColumn("exposure_group_key", F.lit("all"))
    at, order = ["exposure_group_key", "entry_bar_index"], [*(["bar_index"] if "bar_index" in trades.columns else []), "signal_id", "exit_bar_index"]
    blocks = F.coalesce(F.col("exit_bar_index") + cooldown >= F.col("entry_bar_index"), F.lit(False))
    bars = rows.where("entry_bar_index is not null").groupBy(*at).agg(F.min(F.when(blocks, F.struct(*order))).alias("head"))
    bars = bars.select(F.col(at[0]).alias("__group"), F.col(at[1]).cast("long").alias("__bar"), F.col("head.signal_id").cast("long").alias("__signal"), F.col("head.exit_bar_index").cast("long").alias("__exit"))
    verdicts = bars.repartition("__group").sortWithinPartitions("__group", "__bar").mapInArrow(_fold(cooldown), "__group string, __bar long, __open boolean, __blocker long, __until long")
    before = Window.partitionBy("exposure_group_key", "__bar").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__bar", F.col("entry_bar_index").cast("long")).withColumn("__behind", F.coalesce(F.max(blocks).over(before), F.lit(False)))
    rows = rows.join(verdicts.withColumnRenamed("__group", "exposure_group_key"), ["exposure_group_key", "__bar"], "left")
    admitted = F.coalesce(F.col("__open") & ~F.col("__behind"), F.lit(False))
    reason = F.when(F.col("__bar") > F.col("__until"), COOLDOWN).when(F.col("__until").isNotNull(), OVERLAP[policy])
    made = {"admitted": admitted, "skip_reason": F.when(~admitted, reason), "blocking_signal_id": F.when(~admitted, F.col("__blocker")), "blocking_exit_bar_index": F.when(~admitted, F.col("__until"))}
    return rows.select(*trades.columns, "exposure_group_key", *[c.alias(n) for n, c in made.items()])


def admit(trades: DataFrame, policy: str = "single_position", cooldown: int = 0, group: str | None = None, by: list[str] = ("symbol", "cell_id")) -> DataFrame:
    """Trades with ``admitted``, as ``admissions`` says."""
    return admissions(trades, policy, cooldown, group, by).drop("exposure_group_key", "skip_reason", "blocking_signal_id", "blocking_exit_bar_index")


def clock_reasons(sod: Column, window: Column | None = None, no_new_after: str | None = None) -> Column:
    """Why the clock skips an entry at a local second of the day, or null: outside of
    the window (a condition on the entry), or else after the cutoff."""
    reason = F.lit(None).cast("string")
    if no_new_after:
        reason = F.when(sod > seconds(no_new_after), CUTOFF)
    return reason if window is None else F.when(~window, WINDOW).otherwise(reason)


def with_admissions(bars: DataFrame, trades: DataFrame, policy: str = "single_position", cooldown: int = 0, group: str | None = None, window=None, no_new_after: str | None = None, by: list[str] = ("symbol", "cell_id")) -> DataFrame:
    """Every candidate trade with its verdict by the clock and then by exposure: what the
    clock skips blocks no other. window: a function from the local second of the day of
    an entry to whether it may enter."""
    sod = bars.select("symbol", F.col("bar_index").alias("entry_bar_index"), F.col("sod").alias("__sod"))
    rows = trades.join(sod, ["symbol", "entry_bar_index"])
    rows = rows.withColumn("__reason", clock_reasons(F.col("__sod"), None if window is None else window(F.col("__sod")), no_new_after)).drop("__sod")
    open_ = admissions(rows.where("__reason is null"), policy, cooldown, group, by).drop("__reason")
    late = admissions(rows.where("__reason is not null"), "allow_all").withColumns({"admitted": F.lit(False), "skip_reason": F.col("__reason")}).drop("__reason")
    return open_.unionByName(late)


def skip_counts(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Skipped signals by key: all, by the window, by the cutoff, and others."""
    skipped = rows.where("not admitted")
    n = lambda c: F.count(F.when(c, 1))
    clock = F.col("skip_reason").isin(WINDOW, CUTOFF)
    return skipped.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), n(F.col("skip_reason") == WINDOW).alias(WINDOW), n(F.col("skip_reason") == CUTOFF).alias(CUTOFF), n(~F.coalesce(clock, F.lit(False))).alias("other"))


def exit_diagnostics(bars: DataFrame, trades: DataFrame, by: list[str] = ()) -> DataFrame:
    """How trades ended, by key: those that ended at a bracket, how many of these left on
    a bar that reaches stop and target both (and the share), the number of such bars, and
    exits by a moved stop."""
    reach = bars.select("symbol", F.col("bar_index").alias("exit_bar_index"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    rows = trades.join(reach, ["symbol", "exit_bar_index"])
    long = F.col("direction") == "long"
    stop = F.when(long, F.col("__low") <= F.col("stop_price")).otherwise(F.col("__high") >= F.col("stop_price"))
    target = F.when(long, F.col("__high") >= F.col("target_price")).otherwise(F.col("__low") <= F.col("target_price"))
    bracket = F.col("exit_reason").isin("SL", "TP", "BE", "TRAIL")
    both = bracket & stop & target
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trade_count"), F.count(F.when(bracket, 1)).alias("bracket_exit_trade_count"), F.count(F.when(both, 1)).alias("same_bar_both_hit_count"),
        F.count_distinct(F.when(both, F.struct("symbol", "exit_bar_index"))).alias("bars_affected_count"),
        F.count(F.when(F.col("exit_reason") == "BE", 1)).alias("be_exit_count"), F.count(F.when(F.col("exit_reason") == "TRAIL", 1)).alias("trail_exit_count"),
    )
    share = F.when(F.col("bracket_exit_trade_count") > 0, F.col("same_bar_both_hit_count") / F.col("bracket_exit_trade_count")).otherwise(0.0)
    return out.withColumn("same_bar_both_hit_pct", share)


__all__ = ["admissions", "admit", "clock_reasons", "exit_diagnostics", "skip_counts", "with_admissions"]
