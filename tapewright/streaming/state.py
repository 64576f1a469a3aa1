"""Naked levels and trades with moved stops on streams of bars.

Both give what the batch operators give for the same bars: late bars, up to the
watermark, are put in their place before anything is decided. Bars start at whole
milliseconds and one (symbol, ts) has one bar; of two, the later arrival holds. A
bar comes out, and a trade ends, once the watermark has passed it. State and output
survive a restart from the checkpoint of the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tapewright.config import DEFAULT
from tapewright.streaming.ordered import Ordered


def _at() -> Column:
    return F.unix_millis("ts").alias("at")


def _keyed(rows: DataFrame, processor: Ordered, out: str) -> DataFrame:
    return rows.groupBy("symbol").transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


class _Naked(Ordered):
    buffered = "low double, high double, level double"

    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def open_state(self, handle) -> None:
        self.last = handle.getValueState("last", "level double, gone boolean")

    def settle(self, key, rows):
        before, gone = self.last.get() if self.last.exists() else (None, False)
        for r in rows:
            if r.level is None or before is None or r.level != before:
                gone = False
            elif None not in (r.low, r.high) and r.low <= r.level + self.tolerance and r.high >= r.level - self.tolerance:
                gone = True
            before = r.level
            yield Row(symbol=key[0], at=r.at, level=r.level, naked=r.level is not None and not gone)
        self.last.update((before, gone))


def stream_naked(bars: DataFrame, level: str, tolerance: float = 0.0, lateness: str = "10 minutes") -> DataFrame:
    """{level}_naked of a streaming frame with symbol, ts (timestamp), low, high and the
    level: true from its formation until a later bar touches it. State: two values a
    symbol, and the bars that the watermark hasn't passed."""
    rows = bars.withWatermark("ts", lateness).select("symbol", "ts", _at(), F.lit("").alias("tag"), "low", "high", F.col(f"`{level}`").cast("double").alias("level"))
    out = _keyed(rows, _Naked(tolerance), "symbol string, at long, level double, naked boolean")
    return out.select("symbol", F.timestamp_millis("at").alias("ts"), F.col("level").alias(level), F.col("naked").alias(f"{level}_naked"))


class _Trades(Ordered):
    buffered = "open double, high double, low double, close double, signal_id long, direction string"

    def __init__(self, risk: float, target: float, breakeven_r: float | None, trail_r: float | None, trail: float | None, max_bars: int | None):
        self.risk, self.target, self.breakeven_r, self.trail_r, self.trail, self.max_bars = risk, target, breakeven_r, trail_r, trail, max_bars

    def open_state(self, handle) -> None:
        self.running = handle.getMapState("running", "signal_id long", "sign double, fill double, entry_at long, held int, best double, mae double, mfe double")

    def stop(self, best: float) -> tuple[float, str]:
        """The stop in points of gain after a best gain, and what it is called."""
        level, name = -self.risk, "SL"
        if self.breakeven_r is not None and best >= self.breakeven_r * self.risk and level < 0:
            level, name = 0.0, "BE"
        if self.trail_r is not None and best >= self.trail_r * self.risk and best - self.trail > level:
            level, name = best - self.trail, "TRAIL"
        return level, name

    def settle(self, key, rows):
        trades = {k[0]: tuple(v) for k, v in self.running.iterator()}
        stored = set(trades)
        for r in rows:
            if r.signal_id is not None:
                trades.setdefault(r.signal_id, (1.0 if r.direction == "long" else -1.0, None, None, 0, 0.0, None, None))
                continue
            for i, (sign, fill, entry_at, held, best, mae, mfe) in list(trades.items()):
                if fill is None:
                    fill, entry_at = r.open, r.at
                good, bad = (r.high - fill, r.low - fill) if sign > 0 else (fill - r.low, fill - r.high)
                level, name = self.stop(best)
                mae, mfe = max(-bad, mae or 0.0), max(good, mfe or 0.0)
                best, held = max(best, good), held + 1
                end = (level, name) if bad <= level else (self.target, "TP") if good >= self.target else (sign * (r.close - fill), "TIME") if held == self.max_bars else None
                if end is None:
                    trades[i] = (sign, fill, entry_at, held, best, mae, mfe)
                    continue
                del trades[i]
                yield Row(symbol=key[0], signal_id=i, entry_at=entry_at, exit_at=r.at, exit_price=fill + sign * end[0], exit_reason=end[1], bars_held=held, r_multiple=end[0] / self.risk, mae_points=mae, mfe_points=mfe)
        for i in stored - set(trades):
            self.running.removeKey((i,))
        for i, t in trades.items():
            self.running.updateValue((i,), t)


def stream_trades(bars: DataFrame, signals: DataFrame, *, stop_ticks: float = 8, target_ticks: float = 16, tick: float = DEFAULT.tick_size, breakeven_r: float | None = None, trail_r: float | None = None, trail_ticks: float | None = None, max_bars: int | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Trades of streams of bars (symbol, ts, open, high, low, close) and signals
    (symbol, ts of their bar, signal_id, direction): entered at the next bar's open and
    left at the stop, moved to the entry and trailed as ``simulate`` does it, at the
    target, or at the close of the max_bars-th bar; a bar that reaches stop and target is a
    stop. A signal_id is one trade of its symbol. State: the trades that run. Those that
    never end don't come out."""
    none = lambda names, kind: [F.lit(None).cast(kind).alias(c) for c in names]
    b = bars.select("symbol", "ts", _at(), F.lit("bar").alias("tag"), "open", "high", "low", "close", *none(["signal_id"], "long"), *none(["direction"], "string"))
    # a signal of a bar comes after it, and is entered with the next
    s = signals.select("symbol", "ts", _at(), F.concat(F.lit("signal "), F.col("signal_id").cast("string")).alias("tag"), *none(["open", "high", "low", "close"], "double"), F.col("signal_id").cast("long"), "direction")
    rows = b.unionByName(s).withWatermark("ts", lateness)
    trail = None if trail_ticks is None else trail_ticks * tick
    made = _keyed(rows, _Trades(stop_ticks * tick, target_ticks * tick, breakeven_r, trail_r, trail, max_bars), "symbol string, signal_id long, entry_at long, exit_at long, exit_price double, exit_reason string, bars_held int, r_multiple double, mae_points double, mfe_points double")
    at = lambda c: F.timestamp_millis(f"{c}_at").alias(f"{c}_ts")
    return made.select("symbol", "signal_id", at("entry"), at("exit"), "exit_price", "exit_reason", "bars_held", "r_multiple", "mae_points", "mfe_points")
