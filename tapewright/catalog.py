"""The registered queries of the bar engine: each runs operators over whole tables.

Ticks are the events (symbol = type, price = value); bars are half-hours of them.
Where a query needs trades without a simulation, each event to the next of its
symbol is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.operators import admission as AD
from tapewright.operators import bars as B
from tapewright.operators import levels as L
from tapewright.operators import simulate as S
from tapewright.operators import zones as Z
from tapewright.plans import attribution as A
from tapewright.plans import diagnostics as D
from tapewright.plans import metrics as M
from tapewright.plans import portfolio as P
from tapewright.plans import research as R
from tapewright.plans import study as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
HALF_HOUR = 1800


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return B.ticks_of(spark.read.parquet(f"{sf}/events.parquet"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.indexed(B.sessionised(B.bars_from_ticks(ticks(spark, sf), HALF_HOUR)))


def only(df: DataFrame, *cols: str, digits: int | None = None) -> DataFrame:
    kinds = dict(df.dtypes)
    # a nudge keeps exact decimals off the edge between two roundings
    return df.select(*[F.round(F.col(c) + 3.7e-10, digits).alias(c) if digits is not None and kinds[c] == "double" else F.col(c) for c in cols])


def event_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Each event to the next of its type, in blocks of an hour: what follows a block, and
    the number of events before it, come from a table of blocks, so that a type takes many tasks."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    # neither key is null, and a block without a time is the first one, as the order by time has it
    block = {"__type": F.coalesce(F.concat(F.lit("="), "event_type"), F.lit("")), "__hour": F.coalesce(F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00")))}
    e = e.withColumns(block)
    by_type = Window.partitionBy("__type").orderBy("__hour")
    blocks = e.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id", "value")).alias("head"))
    blocks = blocks.select(*block, F.lead("head").over(by_type).alias("__next"), F.coalesce(F.sum("n").over(by_type.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = Window.partitionBy(*block).orderBy("ts", "event_id")
    e = e.withColumns({"__ts": F.lead("ts").over(w), "__value": F.lead("value").over(w), "__last": F.lead(F.lit(0), 1, 1).over(w) == 1, "__row": F.row_number().over(w)}).join(blocks, list(block))
    following = lambda c: F.when(F.col("__last"), F.col(f"__next.{c}")).otherwise(F.col(f"__{c}"))
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.concat_ws("|", *[F.when(k % d == 0, n) for d, n in ((2, "dOpen"), (3, "pdHigh"), (5, "VWAP"), (7, "pdLow"))])
    sign = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    t = e.select(
        F.col("event_id").alias("trade_id"), F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("direction"), F.col("ts").alias("entry_ts"), following("ts").alias("exit_ts"),
        ((following("value") - F.col("value")) / 50 * sign).alias("r_multiple"), (F.col("event_id") % 23 + 1).cast("int").alias("bars_held"), (F.col("event_id") % 11 * 0.5).alias("mae_points"), (F.col("event_id") % 13 * 0.75).alias("mfe_points"),
        F.lit(8.0).alias("stop_ticks"), names.alias("level_names"), (F.col("__before") + F.col("__row")).cast("int").alias("entry_bar_index"),
    )
    return t.where("exit_ts is not null").withColumn("exit_bar_index", F.col("entry_bar_index") + F.col("bars_held") - 1)


def break_signals(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with pdHigh, persisted as every step of a simulation reads them, and
    signals at breaks of it in both directions."""
    levels = L.prior_period(b, "d").persist()
    return levels, Z.signals(levels, Z.anchor_zones(levels, "pdHigh", [], least=0), "break", "both")


# --- bars


@query
def scan_bars_from_ticks(spark, sf):
    return only(bars(spark, sf), "symbol", "ts", "bar_index", "open", "high", "low", "close", "volume")


@query
def one_minute_bars(spark, sf):
    return only(B.bars_from_ticks(ticks(spark, sf), 60), "symbol", "ts", "open", "high", "low", "close", "volume")


@query
def resample_4h_local(spark, sf):
    return only(B.resample(bars(spark, sf), "4h"), "symbol", "ts", "open", "high", "low", "close", "volume")


@query
def resample_daily_local(spark, sf):
    return only(B.resample(bars(spark, sf), "1D"), "symbol", "ts", "open", "high", "low", "close", "volume")


@query
def infer_interval(spark, sf):
    return B.base_interval(bars(spark, sf))


@query
def validate_ohlcv(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("open"), F.col("value").alias("high"), F.col("value").alias("low"), F.col("value").alias("close"), F.get_json_object("props", "$.k").cast("double").alias("volume"))
    return B.validate(rows, 3600)


def _hourly_rows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    v = F.floor(F.col("value") / 100)
    return e.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), *[v.alias(c) for c in ("open", "high", "low", "close")], (F.get_json_object("props", "$.k").cast("int") % 4).alias("volume"))


@query
def duplicate_report(spark, sf):
    return only(B.duplicate_report(_hourly_rows(spark, sf)), "row_id", "group_size", "position", "exact_duplicate_group", "ohlc_identical_group", "volume_conflict")


@query
def dedupe_lowest_volume(spark, sf):
    return only(B.lowest_volume(_hourly_rows(spark, sf)), "row_id", "symbol", "ts", "volume")


@query
def tag_session(spark, sf):
    return only(bars(spark, sf), "symbol", "ts", "sod", "session", "session_date", "week_key", "month_key")


@query
def session_brackets(spark, sf):
    return only(B.session_brackets(bars(spark, sf)), "symbol", "ts", "bracket")


@query
def time_buckets(spark, sf):
    return only(B.time_buckets(event_trades(spark, sf), "entry_ts"), "trade_id", "entry_date", "hour", "minute", "hour_bucket", "half_hour_bucket", "rth_segment")


def _contracts(spark, sf):
    return bars(spark, sf).withColumn("contract", F.concat(F.lit("C"), F.date_format("week_key", "MMdd")))


@query
def contract_segments(spark, sf):
    return B.contract_segments(_contracts(spark, sf))


@query
def roll_gaps(spark, sf):
    return only(B.roll_gaps(_contracts(spark, sf)), "symbol", "ts", "from_contract", "to_contract", "gap_points", "gap_ticks", digits=7)


@query
def roll_assumptions(spark, sf):
    """The weekly contracts of each symbol as segments; their codes as one text."""
    a = B.roll_assumptions(_contracts(spark, sf), "segmented_contracts")
    return a.withColumn("issues", F.array_join("issues", ","))


@query
def clock_issues(spark, sf):
    """Events by minute in the order of their ids reversed, against New York's clock."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), (-F.col("event_id")).alias("row_id"))
    return B.clock_issues(rows.groupBy("symbol", "ts").agg(F.min("row_id").alias("row_id")), 600, "America/New_York", "row_id")


@query
def derive_parents(spark, sf):
    return B.derive_parents(bars(spark, sf).select("symbol", "ts", *B.OHLCV), 1800, 7200)


@query
def parent_volume_match(spark, sf):
    lower = B.bars_from_ticks(ticks(spark, sf), 900)
    return only(B.parent_volume_match(bars(spark, sf), lower, 1800), "symbol", "ts", "n_lower", "status")


# --- levels


@query
def current_opens(spark, sf):
    return only(L.current_opens(bars(spark, sf)), "symbol", "ts", "dOpen", "wOpen", "mOpen")


@query
def prior_period_levels(spark, sf):
    b = bars(spark, sf)
    for p in "dwm":
        b = L.prior_period(b, p)
    return only(b, "symbol", "ts", *[f"p{p}{c}" for p in "dwm" for c in ("Open", "High", "Low", "EQ")])


@query
def session_levels(spark, sf):
    return only(L.session_levels(bars(spark, sf)), "symbol", "ts", "RTH_Open", "ONH", "ONL", "pONH", "pONL", "pRTH_Open", "pRTH_High", "pRTH_Low", "prevSettlement")


@query
def asia_london_levels(spark, sf):
    b = L.clock_window(bars(spark, sf), "Asia", "20:00", "00:00")
    return only(L.clock_window(b, "London", "02:00", "05:00"), "symbol", "ts", "AsiaHigh", "AsiaLow", "LondonHigh", "LondonLow")


@query
def opening_range(spark, sf):
    return only(L.opening_range(bars(spark, sf)), "symbol", "ts", "OR_High", "OR_Low")


@query
def sma(spark, sf):
    return only(L.sma(bars(spark, sf), 20), "symbol", "ts", "SMA_20", digits=7)


@query
def ema(spark, sf):
    return only(L.ema(bars(spark, sf).select("symbol", "ts", "close"), 20), "symbol", "ts", "EMA_20", digits=7)


@query
def htf_ema_asof(spark, sf):
    return only(L.higher_ema(bars(spark, sf).select("symbol", "ts", *B.OHLCV), 5, "1h"), "symbol", "ts", "EMA_5_1h", digits=7)


@query
def htf_sma_asof(spark, sf):
    return only(L.higher_sma(bars(spark, sf).select("symbol", "ts", *B.OHLCV), 5, "1h"), "symbol", "ts", "SMA_5_1h", digits=7)


@query
def rolling_vwap(spark, sf):
    return only(L.rolling_vwap(bars(spark, sf), 4 * 3600, "VWAP_rolling_4h"), "symbol", "ts", "VWAP_rolling_4h", digits=7)


@query
def session_vwap(spark, sf):
    return only(L.session_vwaps(bars(spark, sf)), "symbol", "ts", "dVWAP", "wVWAP", "mVWAP", "dVWAP_RTH", digits=7)


@query
def atr(spark, sf):
    return only(L.atr(bars(spark, sf), 14), "symbol", "ts", "ATR_14", digits=7)


@query
def value_area(spark, sf):
    return only(L.profiles(bars(spark, sf), ["symbol", "session_date"], 25.0), "symbol", "session_date", "POC", "VAH", "VAL")


@query
def prior_profile_levels(spark, sf):
    return only(L.prior_profiles(bars(spark, sf), "d", 25.0), "symbol", "ts", "pdPOC")


@query
def prior_profile_areas(spark, sf):
    b = bars(spark, sf)
    for period in ("d", "w"):
        b = L.prior_profiles(b, period, 25.0)
    return only(b, "symbol", "ts", *[f"p{p}{c}" for p in ("d", "w") for c in ("POC", "VAH", "VAL")])


@query
def rolling_poc(spark, sf):
    return only(L.rolling_poc(bars(spark, sf), 6 * 3600, "POC_rolling_6h", 25.0), "symbol", "ts", "POC_rolling_6h")


@query
def pivots(spark, sf):
    return only(L.pivots(bars(spark, sf).select("symbol", "ts", *B.OHLCV), HALF_HOUR), "symbol", "ts", "Pivot_High", "Pivot_Low")


@query
def pivots_4h(spark, sf):
    return only(L.higher_pivots(bars(spark, sf), "4h"), "symbol", "ts", "Pivot_4h_High", "Pivot_4h_Low")


@query
def single_prints(spark, sf):
    return only(L.single_prints(bars(spark, sf), 1.0), "symbol", "ts", "dSinglePrint_30m_NearestAbove", "dSinglePrint_30m_NearestBelow")


@query
def prior_single_prints(spark, sf):
    return only(L.prior_single_prints(bars(spark, sf), 1.0), "symbol", "ts", "pSinglePrint_30m_NearestAbove", "pSinglePrint_30m_NearestBelow")


@query
def apoc(spark, sf):
    return only(L.apoc(bars(spark, sf), 1.0), "symbol", "ts", "APOC", "pAPOC")


@query
def prev30m_vwap(spark, sf):
    return only(L.bracket_vwaps(bars(spark, sf), 3), "symbol", "ts", "prev30mVWAP", "prev30mVWAP_2", "prev30mVWAP_3", digits=7)


@query
def prev30m_hits(spark, sf):
    five = B.indexed(B.sessionised(B.bars_from_ticks(ticks(spark, sf), 300)))
    return only(L.bracket_hits(L.bracket_vwaps(five, 4), 300), "symbol", "ts", "prev30mVWAP_hit_m5")


@query
def naked_flags(spark, sf):
    return only(L.naked(L.prior_period(bars(spark, sf), "d"), "pdHigh"), "symbol", "ts", "pdHigh", "pdHigh_naked")


# --- zones and signals


def _leveled(spark, sf):
    return L.prior_period(L.current_opens(bars(spark, sf)), "d")


LEVELS = ["dOpen", "wOpen", "mOpen", "pdOpen", "pdHigh", "pdLow", "pdEQ"]


@query
def confluence_zones(spark, sf):
    z = Z.cluster_zones(_leveled(spark, sf), LEVELS, 30.0)
    return z.select("symbol", "bar_index", "zone_seq", "zone_low", "zone_high", "level_count", F.array_join("level_names", "|").alias("level_names"))


@query
def anchor_zones(spark, sf):
    z = Z.anchor_zones(_leveled(spark, sf), "pdEQ", [("dOpen", 200, False), ("wOpen", 400, False), ("pdOpen", 400, False)], least=1)
    return z.select("symbol", "bar_index", "zone_low", "zone_high", "valid_count", F.array_join("level_names", "|").alias("level_names"))


def _trigger(name):
    def f(spark, sf):
        b = _leveled(spark, sf)
        s = Z.signals(b, Z.anchor_zones(b, "pdEQ", [("pdOpen", 400, True)]), name, "both")
        return only(s, "symbol", "bar_index", "direction", "signal_id", "zone_low", "zone_high")

    f.__name__ = f"trigger_{name}"
    return query(f)


for _name in ("touch", "reject", "break", "reclaim"):
    _trigger(_name)


@query
def trigger_timeframe_bars(spark, sf):
    return only(Z.trigger_bars(_leveled(spark, sf), 7200, ["pdHigh"]), "symbol", "ts", "open", "high", "low", "close", "volume", "base_start_bar_index", "base_end_bar_index", "pdHigh")


@query
def trigger_timeframe_zones(spark, sf):
    b = _leveled(spark, sf)
    z = Z.on_trigger_bars(Z.anchor_zones(b, "pdEQ", [("pdOpen", 400, True)]), Z.trigger_bars(b, 7200))
    return only(z, "symbol", "bar_index", "base_bar_index", "zone_low", "zone_high")


def _coarse_trigger(name):
    def f(spark, sf):
        b = _leveled(spark, sf)
        s = Z.trigger_signals(b, Z.anchor_zones(b, "pdEQ", [("pdOpen", 400, True)]), name, 7200)
        return only(s, "symbol", "bar_index", "direction", "signal_id", "trigger_ts", "zone_low", "zone_high")

    f.__name__ = f"trigger_{name}_2h"
    return query(f)


for _name in ("touch", "reject", "break", "reclaim"):
    _coarse_trigger(_name)


@query
def trigger_3c(spark, sf):
    b = _leveled(spark, sf)
    levels = Z.candidates(Z.anchor_zones(b, "pdHigh", [], least=0).withColumn("level_prices", F.array("anchor_price")), "anchor")
    return only(Z.three_candle(b, levels), "symbol", "arrival_bar_index", "reversal_bar_index", "entry_bar_index", "direction", "level_price", "entry_price", "variant", "inside_count", "status")


@query
def trigger_3c_2h(spark, sf):
    b = _leveled(spark, sf)
    levels = Z.candidates(Z.anchor_zones(b, "pdHigh", [], least=0).withColumn("level_prices", F.array("anchor_price")), "anchor")
    s = Z.three_candle_on(b, Z.trigger_bars(b, 7200), levels, 7200)
    return only(s, "symbol", "arrival_bar_index", "reversal_bar_index", "entry_bar_index", "direction", "level_price", "entry_price", "variant", "inside_count", "status", "trigger_ts")


@query
def otf_state(spark, sf):
    s = Z.otf_state(bars(spark, sf), 3600, HALF_HOUR, 2)
    return only(s, "symbol", "ts", "up_run", "down_run", "state")


@query
def otf_filter(spark, sf):
    b = bars(spark, sf)
    _, s = break_signals(b)
    return only(Z.otf_filter(s, [Z.otf_state(b, 3600, HALF_HOUR, 1)]), "symbol", "signal_id", "direction", "otf_0", "accepted")


# --- simulation

TRADE = ("symbol", "signal_id", "direction", "entry_bar_index", "exit_bar_index", "exit_reason", "r_multiple", "mae_points", "mfe_points", "bars_held")


def _simulated(spark, sf, **options):
    b = bars(spark, sf)
    rows, s = break_signals(b)
    return S.simulate(rows, s, **({"max_bars": 50, "stop_ticks": 400, "target_ticks": 600} | options))


@query
def simulate_fixed_bracket(spark, sf):
    return only(_simulated(spark, sf), *TRADE, digits=7)


@query
def simulate_unlimited(spark, sf):
    return only(_simulated(spark, sf, max_bars=None), *TRADE, digits=7)


@query
def simulate_trailing_unlimited(spark, sf):
    """A wide bracket, which trades hold for hundreds of bars."""
    return only(_simulated(spark, sf, max_bars=None, stop_ticks=1600, target_ticks=2400, breakeven_r=0.5, trail_r=1.0, trail_ticks=300), *TRADE, digits=7)


@query
def simulate_costs_session_close(spark, sf):
    return only(_simulated(spark, sf, commission=2.5, slippage_ticks=1.0, session_close="16:00", no_new_after="15:00"), *TRADE, digits=7)


@query
def simulate_path_model(spark, sf):
    return only(_simulated(spark, sf, model="path_open_proximity"), *TRADE, digits=7)


@query
def simulate_trailing(spark, sf):
    return only(_simulated(spark, sf, breakeven_r=0.5, trail_r=1.0, trail_ticks=300), *TRADE, digits=7)


@query
def simulate_subtimeframe(spark, sf):
    t = _simulated(spark, sf)
    b = bars(spark, sf).select("symbol", F.col("bar_index").alias("exit_bar_index"), F.col("ts").alias("parent_ts"))
    sub = B.bars_from_ticks(ticks(spark, sf), 300)
    return only(S.subtimeframe_exits(t.join(b, ["symbol", "exit_bar_index"]), sub, HALF_HOUR), "symbol", "signal_id", "resolved")


def _retraces(spark, sf, **options):
    """Breaks whose entry is the next bar's middle price, within that bar."""
    b = bars(spark, sf)
    rows, s = break_signals(b)
    nxt = rows.select("symbol", (F.col("bar_index") - 1).alias("bar_index"), F.col("bar_index").alias("entry_bar_index"), ((F.col("high") + F.col("low")) / 2).alias("entry_price"))
    return only(S.simulate(rows, s.join(nxt, ["symbol", "bar_index"]), max_bars=50, stop_ticks=40, target_ticks=60, **options), *TRADE, digits=7)


@query
def simulate_retrace_entry(spark, sf):
    return _retraces(spark, sf)


@query
def simulate_retrace_path(spark, sf):
    return _retraces(spark, sf, model="path_open_proximity")


def _sub_bars(spark, sf):
    return B.bars_from_ticks(ticks(spark, sf), 300)


@query
def simulate_subtimeframe_strict(spark, sf):
    sub = B.filled_sub_bars(bars(spark, sf), _sub_bars(spark, sf), HALF_HOUR, 300)
    return only(_simulated(spark, sf, model="subtimeframe", sub=sub, parent_s=HALF_HOUR, sub_s=300), *TRADE, digits=7)


@query
def simulate_subtimeframe_conservative(spark, sf):
    return only(_simulated(spark, sf, model="subtimeframe_conservative", sub=_sub_bars(spark, sf), parent_s=HALF_HOUR, sub_s=300), *TRADE, digits=7)


@query
def exposure_single_position(spark, sf):
    return only(S.admit(_simulated(spark, sf), "single_position", 2), "symbol", "signal_id", "admitted")


@query
def exposure_single_direction(spark, sf):
    return only(S.admit(_simulated(spark, sf), "single_direction"), "symbol", "signal_id", "admitted")


VERDICT = ("symbol", "signal_id", "admitted", "skip_reason", "blocking_signal_id", "blocking_exit_bar_index")


@query
def exposure_reasons(spark, sf):
    """Every candidate trade with the trade that blocks it, and why."""
    return only(AD.admissions(_simulated(spark, sf), "single_position", 2), *VERDICT)


@query
def exposure_direction_reasons(spark, sf):
    return only(AD.admissions(_simulated(spark, sf), "single_direction", 1), *VERDICT)


def _admitted_by_clock(spark, sf):
    window = lambda sod: S.in_entry_window(sod, clock=("08:00", "16:00"))
    return AD.with_admissions(bars(spark, sf), _simulated(spark, sf), "single_position", 2, window=window, no_new_after="15:00")


@query
def skipped_signals(spark, sf):
    """Signals that the clock or an open position skips."""
    return only(_admitted_by_clock(spark, sf).where("not admitted"), *(c for c in VERDICT if c != "admitted"))


@query
def skip_counts(spark, sf):
    return AD.skip_counts(_admitted_by_clock(spark, sf), ["symbol"])


@query
def exit_diagnostics(spark, sf):
    d = AD.exit_diagnostics(bars(spark, sf), _simulated(spark, sf), ["symbol"])
    return only(d, *d.columns, digits=7)


@query
def entry_window_filter(spark, sf):
    t = B.sessionised(event_trades(spark, sf).withColumnRenamed("entry_ts", "ts"))
    return only(t.where(S.in_entry_window(F.col("sod"), ["rth_open_30m", "rth_morning"])), "trade_id", "symbol", "sod")


# --- trade statistics


@query
def trade_summary(spark, sf):
    s = M.trade_summary(event_trades(spark, sf), ["symbol"])
    return only(s, "symbol", "trade_count", "avg_r", "median_r", "total_r", "std_r", "skew_r", "kurtosis_r", "max_drawdown_r", "ulcer_index_r", "sharpe_r", digits=7)


@query
def direction_summary(spark, sf):
    s = M.direction_summary(event_trades(spark, sf))
    return only(s, *s.columns, digits=7)


@query
def group_summary(spark, sf):
    t = B.time_buckets(event_trades(spark, sf), "entry_ts")
    s = M.group_summary(t, ["symbol", "rth_segment"])
    return only(s, *s.columns, digits=7)


@query
def pivot_heatmap(spark, sf):
    g = M.group_summary(B.time_buckets(event_trades(spark, sf), "entry_ts"), ["symbol", "rth_segment"])
    p = M.pivot_metric(g, "symbol", "rth_segment", ["pre_rth", "rth_morning", "post_rth"], "avg_r")
    return only(p, *p.columns, digits=7)


@query
def equity_curve(spark, sf):
    return only(M.equity_curve(event_trades(spark, sf), ["symbol"]), "symbol", "trade_id", "cum_r", "drawdown_r", digits=7)


@query
def streaks(spark, sf):
    return M.streaks(event_trades(spark, sf), ["symbol"])


@query
def trade_count_diagnostics(spark, sf):
    return M.trade_count_diagnostics(event_trades(spark, sf), ["symbol", "level_names"])


@query
def worst_losers(spark, sf):
    return only(M.worst_losers(event_trades(spark, sf), 20), "trade_id", "r_multiple", digits=7)


@query
def combo_attribution(spark, sf):
    s = A.by_combo(event_trades(spark, sf), ["direction"])
    return only(s, *s.columns, digits=7)


@query
def level_membership(spark, sf):
    s = A.by_level(event_trades(spark, sf))
    return only(s, *s.columns, digits=7)


@query
def level_count_buckets(spark, sf):
    s = A.by_level_count(event_trades(spark, sf))
    return only(s, *s.columns, digits=7)


@query
def level_pairs(spark, sf):
    s = A.by_pair(event_trades(spark, sf))
    return only(s, *s.columns, digits=7)


@query
def anchor_pairs(spark, sf):
    s = A.by_pair(event_trades(spark, sf), anchor="dOpen")
    return only(s, *s.columns, digits=7)


@query
def excursion_distribution(spark, sf):
    s = A.excursion_distribution(A.excursions(event_trades(spark, sf)), ["symbol", "direction"])
    return only(s, *s.columns, digits=7)


@query
def excursion_quadrants(spark, sf):
    s = A.quadrants(A.excursions(event_trades(spark, sf)))
    return only(s, *s.columns, digits=7)


@query
def sl_tp_probability_grid(spark, sf):
    s = A.hit_grid(A.excursions(event_trades(spark, sf)), [0.5, 1.0, 1.5], [1.0, 2.0, 3.0])
    return only(s, *s.columns, digits=7)


@query
def edge_ratio(spark, sf):
    s = A.edge_by_holding(A.excursions(event_trades(spark, sf)))
    return only(s, *s.columns, digits=7)


# --- research

CELLS = R.grid_cells([200, 400], [300, 600, 900])


def _cell_trades(spark, sf):
    return _simulated(spark, sf, cells=CELLS).withColumn("trade_id", F.xxhash64("symbol", "signal_id")).persist()


@query
def grid_search(spark, sf):
    g = M.trade_summary(_cell_trades(spark, sf), ["cell_id", "stop_ticks", "target_ticks"])
    return only(g, "cell_id", "stop_ticks", "target_ticks", "trade_count", "win_rate", "expectancy_r", "total_r", "profit_factor", digits=7)


@query
def best_grid_cell(spark, sf):
    g = M.trade_summary(_cell_trades(spark, sf), ["cell_id", "stop_ticks", "target_ticks"])
    return only(M.best_cell(g), "cell_id", "stop_ticks", "target_ticks", "trade_count", "expectancy_r", digits=7)


@query
def walk_forward(spark, sf):
    return walk_forward_all(spark, sf)


@query
def wfa_matrix(spark, sf):
    return wfa_matrix_all(spark, sf)


@query
def walk_forward_all(spark, sf):
    """walk_forward over every bar of the table."""
    w = R.walk_forward_all(_cell_trades(spark, sf), bars(spark, sf), [(400, 200, 200)])
    return only(w, "fold_id", "cell_id", "train_trades", "train_metric", "test_trades", "test_metric", digits=7)


def _fold_otf(spark, sf, policy):
    """Walk-forward on the signals that hourly one-time-framing accepts in each part of a fold."""
    b = bars(spark, sf)
    _, s = break_signals(b)
    w = R.walk_forward_otf(_cell_trades(spark, sf), s, b, (400, 200, 150), HALF_HOUR, [3600], least=1, policy=policy)
    return only(w, "fold_id", "cell_id", "train_trades", "train_metric", "test_trades", "test_metric", "train_signals", "train_rejected", "test_signals", "test_rejected", digits=7)


@query
def walk_forward_fold_local(spark, sf):
    return _fold_otf(spark, sf, "fold_local")


@query
def walk_forward_causal_prefix(spark, sf):
    return _fold_otf(spark, sf, "causal_prefix")


@query
def grid_search_otf(spark, sf):
    """The grid on the signals that hourly one-time-framing accepts."""
    b = bars(spark, sf)
    rows, s = break_signals(b)
    kept = Z.otf_filter(s, [Z.otf_state(b, 3600, HALF_HOUR, 1)]).where("accepted").drop("otf_0", "accepted")
    t = S.simulate(rows, kept, CELLS, max_bars=50).withColumn("trade_id", F.xxhash64("symbol", "signal_id"))
    g = M.trade_summary(t, ["cell_id", "stop_ticks", "target_ticks"])
    return only(g, "cell_id", "stop_ticks", "target_ticks", "trade_count", "win_rate", "expectancy_r", "total_r", digits=7)


@query
def walk_forward_sessions(spark, sf):
    w = R.walk_forward_sessions(_cell_trades(spark, sf), bars(spark, sf), [(10, 5, 5)])
    return only(w, "fold_id", "cell_id", "train_trades", "train_metric", "test_trades", "test_metric", digits=7)


@query
def wfa_matrix_sessions(spark, sf):
    """Walk-forward by session over several training and test lengths."""
    w = R.walk_forward_sessions(_cell_trades(spark, sf), bars(spark, sf), [(6, 3, 3), (10, 5, 5), (10, 2, 4)])
    s = w.groupBy(F.col("label").alias("matrix_id")).agg(F.count(F.lit(1)).alias("folds"), F.avg("test_metric").alias("mean_test"), F.sum("test_total_r").alias("oos_total_r"))
    return only(s, *s.columns, digits=7)


@query
def walk_forward_stitched(spark, sf):
    """Equity of the out-of-sample trades, of overlapping test bars those of the first fold."""
    span = (400, 300, 200)
    t = _cell_trades(spark, sf).withColumn("trade_id", F.concat_ws("#", "symbol", "signal_id"))
    s = R.stitched_trades(t, R.walk_forward_all(t, bars(spark, sf), [span]), span, "first")
    return only(M.equity_curve(s), "fold_id", "cell_id", "trade_id", "cum_r", "drawdown_r", digits=7)


@query
def wfa_matrix_all(spark, sf):
    """wfa_matrix over every bar of the table."""
    w = R.walk_forward_all(_cell_trades(spark, sf), bars(spark, sf), [(300, 150, 150), (300, 300, 300), (600, 150, 150)])
    s = w.groupBy(F.col("label").alias("matrix_id")).agg(F.count(F.lit(1)).alias("folds"), F.avg("test_metric").alias("mean_test"), F.sum("test_total_r").alias("oos_total_r"))
    return only(s, *s.columns, digits=7)


@query
def bootstrap_ci(spark, sf):
    t = event_trades(spark, sf).withColumn("day", F.to_date("exit_ts"))
    s = R.bootstrap_ci(t, ["symbol", "day"], 50)
    return only(s, *s.columns, digits=7)


@query
def permutation_test(spark, sf):
    t = event_trades(spark, sf).withColumn("day", F.to_date("exit_ts"))
    s = R.permutation_test(t, ["symbol", "day"], 50)
    return only(s, *s.columns, digits=7)


def _paths(method):
    def f(spark, sf):
        t = event_trades(spark, sf).withColumn("day", F.to_date("exit_ts"))
        s = R.monte_carlo(t, ["symbol", "day"], method, 20, block=4 if method == "block" else None)
        return only(s, "symbol", "day", "sim", "final_r", "max_drawdown_r", digits=7)

    f.__name__ = f"mc_{method}"
    return query(f)


for _name in ("reshuffle", "skip", "block"):
    _paths(_name)


@query
def mc_summary(spark, sf):
    t = event_trades(spark, sf).withColumn("day", F.to_date("exit_ts"))
    s = R.monte_carlo_summary(R.monte_carlo(t, ["symbol", "day"], "reshuffle", 20), ["symbol"])
    return only(s, *s.columns, digits=7)


@query
def mc_fan(spark, sf):
    """The equity fan of each symbol and day over 20 simulations."""
    t = event_trades(spark, sf).withColumn("day", F.to_date("exit_ts"))
    f = R.monte_carlo_fan(t, ["symbol", "day"], "reshuffle", 20)
    return only(f, *f.columns, digits=7)


@query
def mc_loss_streaks(spark, sf):
    t = event_trades(spark, sf).withColumn("day", F.to_date("exit_ts"))
    return R.monte_carlo_streaks(t, ["symbol", "day"], "reshuffle", 20)


@query
def equity_curve_whole(spark, sf):
    """The equity of all symbols' trades together."""
    return only(M.equity_curve(event_trades(spark, sf)), "trade_id", "cum_r", "drawdown_r", digits=7)


@query
def noise_bars(spark, sf):
    return only(R.perturb(bars(spark, sf), 0.1, 3), "symbol", "bar_index", "replica_id", "open", "high", "low", "close", digits=7)


def _noise(spark, sf):
    b = bars(spark, sf)

    def runner(x):
        rows, signals = break_signals(x)
        return S.simulate(rows, signals, max_bars=50, stop_ticks=400, target_ticks=600)

    return R.noise_replicas(b, runner(b), runner, 0.1, 3, ["entry_bar_index", "direction"])


@query
def noise_replicas(spark, sf):
    n = _noise(spark, sf)
    return only(n, *n.columns, digits=7)


@query
def noise_summary(spark, sf):
    s = R.noise_summary(_noise(spark, sf))
    return only(s, *s.columns, digits=7)


@query
def sensitivity_oat(spark, sf):
    cells = R.sensitivity_cells({"stop_ticks": 400.0, "target_ticks": 600.0})
    t = _simulated(spark, sf, cells=[{k: c[k] for k in ("stop_ticks", "target_ticks")} for c in cells]).withColumn("trade_id", F.xxhash64("symbol", "signal_id"))
    g = M.trade_summary(t, ["cell_id", "stop_ticks", "target_ticks"])
    return only(g, "cell_id", "stop_ticks", "target_ticks", "trade_count", "expectancy_r", digits=7)


@query
def pbo_cscv(spark, sf):
    return only(R.cscv_pbo(_cell_trades(spark, sf), 4), "split_id", "cell_id", "omega", "logit", digits=7)


@query
def pbo(spark, sf):
    """The probability of backtest overfitting over eight blocks."""
    s = R.pbo(R.cscv_pbo(_cell_trades(spark, sf)))
    return only(s, *s.columns, digits=7)


@query
def sharpe_psr(spark, sf):
    s = R.probabilistic_sharpe(event_trades(spark, sf), ["symbol"])
    return only(s, "symbol", "n", "sharpe", "z", digits=7)


# --- portfolio and studies


def _setups(spark, sf):
    return event_trades(spark, sf).withColumn("setup_id", F.col("symbol"))


SETUPS = ["click", "error", "purchase", "signup", "view"]


@query
def portfolio_exposure(spark, sf):
    t = _setups(spark, sf).withColumns({"signal_id": F.col("trade_id"), "day": F.to_date("entry_ts")})
    return only(P.portfolio_exposure(t, "single_position", by=["day"]), "trade_id", "admitted")


@query
def portfolio_exposure_whole(spark, sf):
    """One position at a time over all setups and days, on a clock of half hours that they share."""
    bar = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / HALF_HOUR).cast("int")
    t = _setups(spark, sf).withColumns({"signal_id": F.col("trade_id"), "entry_bar_index": bar("entry_ts"), "exit_bar_index": bar("exit_ts")})
    return only(AD.admissions(t, "single_position", 1, by=[]), "trade_id", "admitted", "skip_reason", "blocking_signal_id", "blocking_exit_bar_index")


@query
def portfolio_correlation(spark, sf):
    t = _setups(spark, sf).withColumn("exit_ts", F.date_trunc("hour", "exit_ts"))
    return only(P.setup_correlations(t, SETUPS), "setup_a", "setup_b", "correlation", digits=7)


@query
def marginal_contribution(spark, sf):
    return only(P.marginal_contributions(_setups(spark, sf), SETUPS), "setup_id", "marginal_total_r", "marginal_max_drawdown_r", digits=7)


def _runs(spark, sf):
    t = event_trades(spark, sf).withColumns({"core_level": F.col("symbol"), "otf": F.when(F.col("bars_held") > 12, "otf_5m").otherwise("no_otf")})
    s = M.group_summary(t, ["core_level", "direction", "otf"], 0).drop("sample_warning")
    return s.withColumn("run_name", F.concat_ws("_", "core_level", "direction", "otf"))


@query
def study_ranking(spark, sf):
    return only(ST.ranked(_runs(spark, sf), "avg_r", 50), "run_name", "status", "rank", "trade_count")


@query
def study_promotion(spark, sf):
    return only(ST.promoted(_runs(spark, sf), "avg_r", 50, 3), "run_name", "rank")


@query
def study_rollup(spark, sf):
    """Runs with the number and the worst of their losses above 5 R, where they have any."""
    t = event_trades(spark, sf).withColumn("run_name", F.concat_ws("_", "symbol", "direction", F.when(F.col("bars_held") > 12, "otf_5m").otherwise("no_otf")))
    losses = t.where("r_multiple < -5").groupBy("run_name").agg(F.count(F.lit(1)).alias("number"), F.min("r_multiple").alias("worst_r"))
    s = ST.rollup(_runs(spark, sf), {"losses": losses})
    return only(s, "run_name", "trade_count", "losses_status", "losses_number", "losses_worst_r", digits=7)


@query
def study_admit_bucket(spark, sf):
    g = M.group_summary(B.time_buckets(event_trades(spark, sf), "entry_ts"), ["symbol", "rth_segment"])
    s = ST.admit_bucket(g, "rth_segment", ["symbol"], 30)
    return only(s, *s.columns, digits=7)


@query
def study_group_summary(spark, sf):
    s = ST.group_summaries(_runs(spark, sf), "core_level", "avg_r", 10)
    return only(s, *s.columns, digits=7)


@query
def otf_delta(spark, sf):
    s = ST.paired_delta(_runs(spark, sf), "otf", "no_otf", ["core_level", "direction"], "avg_r", 10)
    return only(s, *s.columns, digits=7)


# --- diagnostics


@query
def grid_overfit(spark, sf):
    s = D.grid_overfit(M.trade_summary(_cell_trades(spark, sf), ["cell_id", "stop_ticks", "target_ticks"]))
    return only(s, *s.columns, digits=7)


@query
def recent_bars(spark, sf):
    return only(D.recent(bars(spark, sf), 25), "symbol", "ts", "bar_index")


@query
def sub_bar_faults(spark, sf):
    sub = B.bars_from_ticks(ticks(spark, sf), 900)
    return only(D.sub_bar_faults(bars(spark, sf), sub, HALF_HOUR, 900), "symbol", "ts", "fault")


@query
def trades_at_level(spark, sf):
    return only(D.trades_at_level(event_trades(spark, sf), "VWAP"), "trade_id", "level_names")


@query
def random_entries(spark, sf):
    b = bars(spark, sf)
    _, s = break_signals(b)
    return only(D.random_entries(b, s, 5), "symbol", "replica_id", "bar_index", "direction")


@query
def random_benchmark(spark, sf):
    b = bars(spark, sf)
    rule = {"max_bars": 50, "stop_ticks": 400, "target_ticks": 600}
    s = D.random_benchmark(b, _simulated(spark, sf, **rule), 20, **rule)
    return only(s, *s.columns, digits=7)


@query
def deflated_sharpe(spark, sf):
    s = D.deflated_sharpe(_cell_trades(spark, sf), ["cell_id"])
    return only(s, *s.columns, digits=7)


@query
def otf_validation_matrix(spark, sf):
    """Trades of each fixed setting; a time frame's states come from its own bars."""
    b = bars(spark, sf)
    rows, signals = break_signals(b)
    states = {n: Z.otf_state(B.sessionised(B.bars_from_ticks(ticks(spark, sf), n)), n, n) for n in (300, 900, 1800)}
    t = D.otf_settings(S.simulate(rows, signals, max_bars=50, stop_ticks=400, target_ticks=600), signals, states)
    s = D.otf_matrix(t, 500)
    return only(s, *s.columns, digits=7)


@query
def trade_windows(spark, sf):
    t = _simulated(spark, sf).withColumn("trade_id", F.col("signal_id"))
    return only(D.around_trades(bars(spark, sf), t, 3, 3), "symbol", "trade_id", "bar_index")


@query
def trigger_confirm_3bar(spark, sf):
    b = _leveled(spark, sf)
    levels = b.where("pdEQ is not null").select("symbol", "bar_index", F.col("pdEQ").alias("level_price"))
    return D.confirm_three_bars(b, levels)
