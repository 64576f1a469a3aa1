"""Bars: from ticks, sessions, resampling, data quality, duplicates, derivation, rolls.

Frames hold ``symbol`` and a UTC timestamp without zone ``ts`` at the start of the
bar; every operator is partitioned by symbol, most also by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.config import DEFAULT, GAP_FACTOR, SEGMENTS, TIMEFRAMES, Instrument, seconds

OHLCV = ("open", "high", "low", "close", "volume")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def floored(ts: Column, secs: int, offset: int = 0) -> Column:
    """The start of the bucket of so many seconds, counted from the epoch plus offset."""
    s = F.floor(micros(ts) / 1_000_000).cast("long")
    return F.timestamp_seconds(s - F.pmod(s - offset, F.lit(secs))).cast("timestamp_ntz")


def ticks_of(events: DataFrame) -> DataFrame:
    """Events as ticks: the type is the symbol, the value the price."""
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def bars_from_ticks(ticks: DataFrame, secs: int = 60) -> DataFrame:
    """Open is the first, close the last tick of a bucket by (ts, tick_id)."""
    order = F.struct("ts", "tick_id")
    bars = ticks.groupBy("symbol", floored(F.col("ts"), secs).alias("bucket")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume")
    )
    return bars.withColumnRenamed("bucket", "ts")


def indexed(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_index", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("int"))


def sessionised(bars: DataFrame, inst: Instrument = DEFAULT) -> DataFrame:
    """Adds local_ts, sod, session (RTH from start to before end, else ETH),
    session_date (the next day from the evening start on), week_key and month_key."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(inst.exchange_tz), F.col("ts"))
    out = bars.withColumn("local_ts", local)
    out = out.withColumn("sod", (F.hour("local_ts") * 3600 + F.minute("local_ts") * 60 + F.second("local_ts")).cast("int"))
    rth = (F.col("sod") >= seconds(inst.rth_start)) & (F.col("sod") < seconds(inst.rth_end))
    out = out.withColumn("session", F.when(rth, "RTH").otherwise("ETH"))
    out = out.withColumn("session_date", F.date_add(F.to_date("local_ts"), (F.col("sod") >= seconds(inst.eth_start)).cast("int")))
    return out.withColumns({"week_key": F.date_trunc("week", "session_date").cast("date"), "month_key": F.date_trunc("month", "session_date").cast("date")})


def session_brackets(bars: DataFrame, inst: Instrument = DEFAULT, minutes: int = 30) -> DataFrame:
    """bracket: 30-minute steps of elapsed time since the session's evening start."""
    opened = F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(F.date_sub("session_date", 1)) * 86400 + seconds(inst.eth_start)), inst.exchange_tz)
    gone = micros(F.col("ts")) - F.unix_micros(opened)
    return bars.withColumn("bracket", F.when(gone >= 0, F.floor(gone / (minutes * 60_000_000))).cast("int"))


def segment(sod: Column) -> Column:
    """The part of the trading day of a local second of the day."""
    out = F.lit(SEGMENTS[0][0])
    for name, minute in SEGMENTS[1:]:
        out = F.when(sod >= minute * 60, name).otherwise(out)
    return out


def time_buckets(rows: DataFrame, ts: str, exchange_tz: str = DEFAULT.exchange_tz, bucket_tz: str | None = None) -> DataFrame:
    """entry_date, hour, minute, hour_bucket, half_hour_bucket by the bucket zone; rth_segment by the exchange's."""
    there = F.convert_timezone(F.lit("UTC"), F.lit(bucket_tz or exchange_tz), F.col(ts))
    here = F.convert_timezone(F.lit("UTC"), F.lit(exchange_tz), F.col(ts))
    half = F.lpad((F.floor(F.minute(there) / 30) * 30).cast("string"), 2, "0")
    return rows.withColumns({
        "entry_date": F.to_date(there), "hour": F.hour(there), "minute": F.minute(there),
        "hour_bucket": F.concat(F.lpad(F.hour(there).cast("string"), 2, "0"), F.lit(":00")),
        "half_hour_bucket": F.concat(F.lpad(F.hour(there).cast("string"), 2, "0"), F.lit(":"), half),
        "rth_segment": segment(F.hour(here) * 3600 + F.minute(here) * 60 + F.second(here)),
    })


def base_interval(bars: DataFrame) -> DataFrame:
    """Seconds of the most frequent positive gap by symbol, the smallest of equally frequent ones."""
    gap = (micros(F.col("ts")) - micros(F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts")))) / 1e6
    gaps = bars.withColumn("gap", gap).where("gap > 0").groupBy("symbol", "gap").agg(F.count(F.lit(1)).alias("n"))
    return gaps.groupBy("symbol").agg(F.max_by("gap", F.struct(F.col("n"), -F.col("gap"))).alias("interval_s"))


def resample(bars: DataFrame, timeframe: str, inst: Instrument = DEFAULT) -> DataFrame:
    """Coarser bars: first, max, min, last (nulls skipped) and sum.

    Buckets of up to an hour count from the epoch; 4h and 1D from the local midnight
    of the symbol's first day.
    """
    secs = TIMEFRAMES[timeframe]
    if secs <= 3600:
        bucket = floored(F.col("ts"), secs)
    else:
        local = F.convert_timezone(F.lit("UTC"), F.lit(inst.exchange_tz), F.col("ts"))
        bucket = F.convert_timezone(F.lit(inst.exchange_tz), F.lit("UTC"), floored(local, secs))
    return bars.groupBy("symbol", bucket.alias("bucket")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ts"))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close"), F.sum("volume").alias("volume"),
    ).where("coalesce(open, high, low, close, volume) is not null").withColumnRenamed("bucket", "ts")


def validate(bars: DataFrame, interval_s: float) -> DataFrame:
    """Counts of issues by symbol: duplicates, missing cells, impossible prices, negative volumes, large gaps."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumn("gap", (micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 1e6)
    rows = rows.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("symbol", "ts")))
    missing = sum((F.col(c).isNull().cast("long") for c in OHLCV), F.lit(0))
    outside = (F.least("open", "close") < F.col("low")) | (F.greatest("open", "close") > F.col("high"))
    return rows.groupBy("symbol").agg(
        F.count_if(F.col("copies") > 1).alias("duplicate_timestamps"), F.sum(missing).alias("missing_values"), F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
        F.count_if(outside).alias("open_close_outside_range"), F.count_if(F.col("volume") < 0).alias("negative_volume"), F.count_if(F.col("gap") > GAP_FACTOR * interval_s).alias("significant_gaps"),
    )


def assert_valid_ohlc(bars: DataFrame) -> None:
    """Raises ValueError if prices are absent, null or not finite, or if a bar's high and low don't hold its prices."""
    absent = [c for c in OHLCV[:4] if c not in bars.columns]
    if absent:
        raise ValueError(f"bars lack the columns {absent}")
    wild = F.lit(False)
    for c in OHLCV[:4]:
        v = F.col(c).cast("double")
        wild = wild | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    outside = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    n = bars.agg(F.count_if(wild).alias("wild"), F.count_if(outside).alias("outside")).first()
    if n["wild"]:
        raise ValueError(f"{n['wild']} bars without four finite prices")
    if n["outside"]:
        raise ValueError(f"{n['outside']} bars whose high and low don't hold their prices")


# Names of contract columns, the first found counts.
CONTRACT_COLUMNS = ("contract", "symbol", "ticker", "instrument", "expiry", "expiration")


def contract_column(bars: DataFrame) -> str | None:
    """The column that likely names the contract, by its name without case, or None."""
    by_name = {c.lower(): c for c in bars.columns}
    return next((by_name[c] for c in CONTRACT_COLUMNS if c in by_name), None)


def display_times(rows: DataFrame, zone: str, columns: list[str] | None = None) -> DataFrame:
    """Rows whose UTC timestamps (all columns of that type, or those named) are local times of a zone."""
    kinds = dict(rows.dtypes)
    names = [c for c in (columns or rows.columns) if kinds[c] in ("timestamp_ntz", "timestamp")]
    local = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(f"`{c}`") if kinds[c] == "timestamp_ntz" else F.to_utc_timestamp(F.col(f"`{c}`"), F.current_timezone()).cast("timestamp_ntz"))
    return rows.withColumns({c: local(c) for c in names})


def duplicate_report(bars: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows that share their timestamp: group size, position, and what the group agrees on."""
    by = Window.partitionBy("symbol", "ts")
    distinct = lambda *c: F.size(F.collect_set(F.struct(*c)).over(by))
    out = bars.withColumns({
        "group_size": F.count(F.lit(1)).over(by), "position": F.row_number().over(by.orderBy(row_id)),
        "exact_duplicate_group": distinct(*OHLCV) == 1, "ohlc_identical_group": distinct(*OHLCV[:4]) == 1,
    })
    return out.where("group_size > 1").withColumn("volume_conflict", F.col("ohlc_identical_group") & ~F.col("exact_duplicate_group"))


def lowest_volume(bars: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Of bars with equal timestamps, the one with the lowest volume (then the first)."""
    by = Window.partitionBy("symbol", "ts").orderBy("volume", row_id)
    return bars.withColumn("place", F.row_number().over(by)).where("place = 1").drop("place")


def derive_parents(bars: DataFrame, sub_s: int, parent_s: int) -> DataFrame:
    """Parents from aligned sub-bars: misaligned parents are dropped, incomplete ones kept and marked."""
    s = F.floor(micros(F.col("ts")) / 1_000_000)
    out = bars.withColumns({"parent": floored(F.col("ts"), parent_s), "on_grid": F.pmod(s, F.lit(sub_s)) == 0}).groupBy("symbol", "parent").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("n_sub"), F.bool_and("on_grid").alias("aligned"),
    )
    return out.where("aligned").withColumn("complete", F.col("n_sub") == parent_s // sub_s).drop("aligned").withColumnRenamed("parent", "ts")


def contract_segments(bars: DataFrame, contract: str = "contract") -> DataFrame:
    """Islands of one contract: first and last timestamp and number of bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    change = F.coalesce((~F.lag(contract).over(w).eqNullSafe(F.col(contract))).cast("int"), F.lit(1))
    change = F.when(F.row_number().over(w) == 1, 0).otherwise(change)
    out = bars.withColumn("change", change).withColumn("segment_id", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy("symbol", "segment_id", contract).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_bars"))


def roll_gaps(bars: DataFrame, contract: str = "contract", tick: float = DEFAULT.tick_size) -> DataFrame:
    """At each change of contract: the next open less the previous close, in points and ticks."""
    w = Window.partitionBy("symbol").orderBy("ts")
    out = bars.withColumns({"from_contract": F.lag(contract).over(w), "prev_close": F.lag("close").over(w)})
    out = out.where(F.col("from_contract") != F.col(contract)).withColumn("gap_points", F.col("open") - F.col("prev_close"))
    return out.where("gap_points is not null").select("symbol", "ts", "from_contract", F.col(contract).alias("to_contract"), "gap_points", (F.col("gap_points") / tick).alias("gap_ticks"))


# How contracts were rolled and prices adjusted.
ROLL_METHODS = ("single_contract", "external_continuous", "segmented_contracts")
ADJUSTMENTS = ("unknown", "back_adjusted", "ratio_adjusted", "panama", "none")


def roll_assumptions(bars: DataFrame, method: str, contract: str = "contract", adjustment: str | None = None, rule: str | None = None) -> DataFrame:
    """By symbol: contracts, rolls with a gap, whether the bars bear the declared method
    out (``valid``), and what speaks against or should be known (``issues``, codes).

    Not valid are several bars' contracts as one, and segments without a contract column
    or with fewer than two contracts. The bars are read twice, for the contracts and the gaps.
    """
    if method not in ROLL_METHODS:
        raise ValueError(f"unknown roll method {method!r}; known are {', '.join(ROLL_METHODS)}")
    adjustment, rule = ((x if x is not None else "unknown").strip() for x in (adjustment, rule))
    known = contract in bars.columns
    several = F.col("contract_count") > 1
    faults: list[tuple[str, Column | bool, bool]] = []  # code, when, whether it makes the bars invalid
    if method == "single_contract":
        faults = [("no_contract_column", not known, False), ("several_contracts", several, True)]
    elif method == "external_continuous":
        faults = [("unknown_adjustment", adjustment == "unknown", False), ("unknown_rule", rule == "unknown", False), ("unrecognised_adjustment", adjustment not in ADJUSTMENTS, False), ("empty_rule", rule == "", False), ("several_contracts", several, False)]
    else:
        faults = [("no_contract_column", not known, True), ("too_few_contracts", F.col("contract_count") < 2, True), ("unadjusted_gaps", True, False), ("gaps_not_computed", known and not {"ts", "open", "close"} <= set(bars.columns), False)]
    counted = bars.groupBy("symbol").agg((F.count_distinct(contract) if known else F.lit(None).cast("long")).alias("contract_count"))
    if method == "segmented_contracts" and known and {"ts", "open", "close"} <= set(bars.columns):
        gaps = roll_gaps(bars, contract).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"))
        counted = counted.join(gaps, "symbol", "left")
    else:
        counted = counted.withColumn("gaps", F.lit(None).cast("long"))
    holds = lambda when: F.coalesce(when, F.lit(False)) if isinstance(when, Column) else F.lit(when)
    codes = F.filter(F.array(*[F.when(holds(when), code) for code, when, _ in faults]), lambda x: x.isNotNull())
    broken = F.array(*[holds(when) for _, when, fatal in faults if fatal] or [F.lit(False)])
    return counted.select("symbol", "contract_count", F.coalesce("gaps", F.lit(0)).alias("roll_gap_count"), (~F.array_contains(broken, True)).alias("valid"), codes.alias("issues"))


def clock_issues(bars: DataFrame, interval_s: float, zone: str, row_id: str | None = None) -> DataFrame:
    """By symbol: bars that stand before an earlier one in the order of ``row_id`` (null
    without it), and large gaps near changes of the zone's offset from UTC.

    A change is near a gap that lies from two bars before it to three after; a gap near two
    changes counts twice, and the gap at the second bar isn't counted.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    offset = micros(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))) - micros(F.col("ts"))
    rows = bars.select("symbol", "ts", *([row_id] if row_id else [])).withColumns({"offset": offset, "gap": (micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 1e6, "place": F.row_number().over(w)})
    rows = rows.withColumn("changed", F.coalesce((F.col("offset") != F.lag("offset").over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumn("near", F.when((F.col("gap") > GAP_FACTOR * interval_s) & (F.col("place") > 2), F.sum("changed").over(w.rowsBetween(-3, 2))).otherwise(0))
    back = F.lit(None).cast("long")
    if row_id:
        rows = rows.withColumn("back", F.col("ts") < F.lag("ts").over(Window.partitionBy("symbol").orderBy(row_id)))
        back = F.count_if("back")
    return rows.groupBy("symbol").agg(back.alias("non_monotonic_before_sort"), F.sum("near").alias("dst_transition_gaps"))


def parent_volume_match(primary: DataFrame, lower: DataFrame, parent_s: int) -> DataFrame:
    """Bars against the summed volume of their lower bars, met by an equi-join on the parent's start."""
    sums = lower.groupBy("symbol", floored(F.col("ts"), parent_s).alias("ts")).agg(F.sum("volume").alias("lower_volume"), F.count(F.lit(1)).alias("n_lower"))
    near = F.abs(F.col("volume") - F.col("lower_volume")) <= F.greatest(F.lit(1e-9), F.abs("volume") * 1e-9)
    status = F.when(F.col("lower_volume").isNull(), "lower_group_unavailable").when(near, "matched_one").otherwise("no_primary_volume_match")
    return primary.join(sums, ["symbol", "ts"], "left").withColumn("status", status)


def filled_sub_bars(bars: DataFrame, sub: DataFrame, parent_s: int, sub_s: int) -> DataFrame:
    """Sub-bars with a flat one, at the close before it or the bar's open, wherever a
    bar has none; a bar's sub-bars then are as many as fit and make up the bar."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(parent_s // sub_s - 1))).alias("__k")
    grid = bars.select("symbol", F.col("ts").alias("__parent"), F.col("open").alias("__open"), steps)
    grid = grid.withColumn("ts", (F.col("__parent") + F.make_dt_interval(secs=F.col("__k") * sub_s)).cast("timestamp_ntz")).drop("__k")
    rows = grid.join(sub.select("symbol", "ts", *OHLCV), ["symbol", "ts"], "left")
    run = Window.partitionBy("symbol", "__parent").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    flat = F.coalesce(F.last("close", True).over(run), F.col("__open"))
    return rows.select("symbol", "ts", *[F.coalesce(c, flat).alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))
