"""Experiments: bars to trades by one configuration, alone or in a batch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.config import DIRECTIONS, INTRABAR_MODELS, TRIGGERS, choose
from tapewright.operators import levels as L
from tapewright.operators import simulate as S
from tapewright.operators import zones as Z
from tapewright.operators.bars import OHLCV, indexed, sessionised
from tapewright.plans.metrics import trade_summary
from tapewright.session import stored


@dataclass(frozen=True)
class Setup:
    """What to trade; checked when it is made."""

    name: str
    levels: tuple[str, ...]
    trigger: str = "touch"
    direction: str = "both"
    tolerance: float = 2.0
    min_confluences: int = 2
    max_confluences: int = 5
    anchor: str | None = None
    rules: tuple[tuple[str, float, bool], ...] = ()
    naked_only: bool = False
    model: str = "sl_first"
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        choose(self.trigger, TRIGGERS, "trigger")
        choose(self.direction, DIRECTIONS, "direction")
        choose(self.model, INTRABAR_MODELS, "intrabar model")
        if not self.levels and not self.anchor:
            raise ValueError("a setup needs levels or an anchor")
        if self.tolerance < 0 or not 1 <= self.max_confluences <= 5:
            raise ValueError("tolerance or number of confluences out of range")


def all_levels(bars: DataFrame) -> DataFrame:
    """Indexed, sessionised bars with the levels that need no parameters."""
    b = indexed(sessionised(bars.select("symbol", "ts", *OHLCV)))
    return L.session_vwaps(L.level_frame(b))


def find_signals(levels: DataFrame, setup: Setup) -> DataFrame:
    names = list(setup.levels)
    zones = Z.anchor_zones(levels, setup.anchor, list(setup.rules)) if setup.anchor else Z.cluster_zones(levels, names, setup.tolerance, setup.min_confluences, setup.max_confluences)
    if setup.naked_only:
        flagged = levels
        for n in names:
            flagged = L.naked(flagged, n)
        flags = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}_naked`"))])
        zones = Z.naked_zones(zones.join(flagged.select("symbol", "bar_index", flags.alias("flags")), ["symbol", "bar_index"]), F.col("flags")).drop("flags")
    if setup.trigger == "3c":
        prices = zones if "level_prices" in zones.columns else zones.withColumn("level_prices", F.array_repeat("anchor_price", F.size("level_names")))
        found = Z.three_candle(levels, Z.candidates(prices, "anchor" if setup.anchor else "cluster")).where("status = 'filled'")
        return found.withColumn("signal_id", F.xxhash64("arrival_bar_index", "direction", "level_price")).withColumn("bar_index", F.col("reversal_bar_index"))
    return Z.signals(levels, zones, setup.trigger, setup.direction)


def run(levels: DataFrame, setup: Setup) -> DataFrame:
    """The setup's trades on a level frame, with run_name. The frame is read several
    times over: store it, as run_batch does."""
    trades = S.simulate(levels, find_signals(levels, setup), model=setup.model, **setup.options)
    return trades.withColumns({"run_name": F.lit(setup.name), "trade_id": F.xxhash64("symbol", "signal_id")})


def run_batch(bars: DataFrame, setups: list[Setup]) -> DataFrame:
    """One row of metrics a run, from one plan over all runs, which share the stored levels."""
    levels = stored(all_levels(bars))
    out = None
    for s in setups:
        one = run(levels, s).select("run_name", "symbol", "trade_id", "exit_ts", "r_multiple", "direction", "bars_held")
        out = one if out is None else out.union(one)
    return trade_summary(out, ["run_name"])
