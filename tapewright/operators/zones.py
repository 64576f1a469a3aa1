"""Confluence zones, entry triggers, three-candle setups and one-time-framing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.config import DEFAULT, DIRECTIONS, choose
from tapewright.operators.bars import floored, micros
from tapewright.operators.joins import asof_backward, range_join

CAP = 5
SETUP = ("direction", "source_mode", "level_price", "entry_price", "variant", "inside_count", "status")


def _levels(columns: list[str]) -> Column:
    """Non-null levels of a bar by price, then column order."""
    all_ = F.array(*[F.struct(F.col(f"`{c}`").cast("double").alias("price"), F.lit(i).alias("ord"), F.lit(c).alias("name")) for i, c in enumerate(columns)])
    return F.array_sort(F.filter(all_, lambda x: x["price"].isNotNull()))


def cluster_zones(bars: DataFrame, columns: list[str], tolerance: float, least: int = 2, most: int = CAP) -> DataFrame:
    """Greedy clusters of a bar's levels: from the lowest free level, all within the
    tolerance; of a cluster large enough, up to ``most`` (5 at best) make the zone,
    and the whole cluster is used up. One row a zone, folded within the bar's row."""
    cap = min(most, CAP)
    kind = "array<struct<levels:array<struct<price:double,ord:int,name:string>>>>"
    rows = bars.withColumn("p", _levels(columns))
    zero = F.struct(F.lit(0).alias("nxt"), F.array().cast(kind).alias("out"))

    def step(s: Column, j: Column) -> Column:
        near = F.filter(F.col("p"), lambda x, k: (k >= j) & (x["price"] - F.get(F.col("p"), j)["price"] <= tolerance))
        size = F.size(near)
        taken = F.struct((j + size).alias("nxt"), F.concat(s["out"], F.array(F.struct(F.slice(near, 1, cap).alias("levels")))).alias("out"))
        return F.when((j >= s["nxt"]) & (size >= least), taken).otherwise(s)

    n = F.size("p")
    zones = F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda s: s["out"]))
    out = rows.select("symbol", "ts", "bar_index", F.posexplode(zones).alias("zone_seq", "z"))
    prices = F.transform("z.levels", lambda x: x["price"])
    out = out.select("symbol", "ts", "bar_index", "zone_seq", F.array_min(prices).alias("zone_low"), F.array_max(prices).alias("zone_high"), F.size("z.levels").alias("level_count"), F.transform("z.levels", lambda x: x["name"]).alias("level_names"), prices.alias("level_prices"))
    return out.withColumn("zone_mid", (F.col("zone_low") + F.col("zone_high")) / 2)


def anchor_zones(bars: DataFrame, anchor: str, rules: list[tuple[str, float, bool]], tick: float = DEFAULT.tick_size, least: int = 1) -> DataFrame:
    """Zones around an anchor level. rules: (level, tolerance in ticks, required).

    A rule holds within its tolerance plus 1e-9 ticks; a zone needs all required
    rules and ``least`` valid ones, and spans the anchor and the valid levels.
    """
    a = F.col(f"`{anchor}`")
    made = F.array(*[
        F.struct(F.lit(n).alias("level"), F.col(f"`{n}`").cast("double").alias("price"), F.coalesce(F.abs(F.col(f"`{n}`") - a) / tick <= t + 1e-9, F.lit(False)).alias("valid"), F.lit(req).alias("required"))
        for n, t, req in rules
    ]) if rules else F.array().cast("array<struct<level:string,price:double,valid:boolean,required:boolean>>")
    out = bars.where(a.isNotNull()).withColumn("rules", made)
    valid = F.filter("rules", lambda x: x["valid"])
    out = out.withColumn("valid_count", F.size(valid)).where(F.forall("rules", lambda x: x["valid"] | ~x["required"]) & (F.col("valid_count") >= least))
    prices = F.concat(F.array(a), F.transform(valid, lambda x: x["price"]))
    names = F.concat(F.array(F.lit(anchor)), F.transform(valid, lambda x: x["level"]))
    return out.select("symbol", "ts", "bar_index", F.array_min(prices).alias("zone_low"), F.array_max(prices).alias("zone_high"), a.alias("anchor_price"), "valid_count", names.alias("level_names"), "rules").withColumn("zone_mid", (F.col("zone_low") + F.col("zone_high")) / 2)


def candidates(zones: DataFrame, mode: str) -> DataFrame:
    """One row a level of a zone."""
    return zones.select("symbol", "bar_index", F.lit(mode).alias("source_mode"), F.explode(F.arrays_zip("level_names", "level_prices")).alias("x")).select("symbol", "bar_index", "source_mode", F.col("x.level_names").alias("level_name"), F.col("x.level_prices").alias("level_price"))


def naked_zones(zones: DataFrame, flags: Column, need: str = "any") -> DataFrame:
    """Zones of which any or all levels are naked. flags: map from level to its flag at the bar."""
    n = F.size(F.filter("level_names", lambda x: F.coalesce(F.try_element_at(flags, x), F.lit(False))))
    return zones.where(n == F.size("level_names") if need == "all" else n > 0)


def trigger_bars(bars: DataFrame, secs: int, levels: list[str] = ()) -> DataFrame:
    """Coarser bars for triggers, floored in UTC, with the base bars they span and
    the last non-null value of each level."""
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bar_index"))).alias(c) for c in levels}
    return bars.groupBy("symbol", floored(F.col("ts"), secs).alias("bucket")).agg(
        F.min_by("open", "bar_index").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_index").alias("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.min("bar_index").alias("base_start_bar_index"), F.max("bar_index").alias("base_end_bar_index"), F.max("ts").alias("end_ts"), *last.values(),
    ).withColumnRenamed("bucket", "ts")


def condition(trigger: str, direction: str) -> Column:
    """Whether a bar with its previous close triggers at a zone."""
    lo, hi, close, low, high, prev = (F.col(c) for c in ("zone_low", "zone_high", "close", "low", "high", "prev_close"))
    touch = (low <= hi) & (high >= lo)
    long = {"touch": touch, "reject": touch & (close > hi), "break": (prev <= hi) & (close > hi), "reclaim": (low < lo) & (close > hi)}
    short = {"touch": touch, "reject": touch & (close < lo), "break": (prev >= lo) & (close < lo), "reclaim": (high > hi) & (close < lo)}
    return F.coalesce((long if direction == "long" else short)[trigger], F.lit(False))


def signals(bars: DataFrame, zones: DataFrame, trigger: str, direction: str = "both") -> DataFrame:
    """Signals of a simple trigger at zones of the same bar; ``both`` tests long and short."""
    choose(direction, DIRECTIONS, "direction")
    rows = bars.withColumn("prev_close", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")))
    rows = rows.select("symbol", "bar_index", "low", "high", "close", "prev_close")
    ways = ["long", "short"] if direction == "both" else [direction]
    met = zones.join(rows, ["symbol", "bar_index"])
    hit = F.filter(F.array(*[F.when(condition(trigger, d), F.lit(d)) for d in ways]), lambda x: x.isNotNull())
    out = met.withColumn("direction", F.explode(hit)).withColumn("trigger", F.lit(trigger))
    order = [c for c in ("zone_seq",) if c in zones.columns]
    w = Window.partitionBy("symbol").orderBy("bar_index", *order, "direction")
    return out.withColumn("signal_id", F.row_number().over(w)).drop("low", "high", "close", "prev_close")


def on_trigger_bars(zones: DataFrame, triggers: DataFrame) -> DataFrame:
    """Zones of base bars under the trigger bar that holds them: base_bar_index is the
    zone's bar, bar_index the trigger bar's last base bar; zones outside are left out.

    triggers: from trigger_bars. Their spans are dealt out to base bars, so this is an equi-join.
    """
    spans = triggers.select("symbol", F.col("base_end_bar_index").alias("__end"), F.explode(F.sequence("base_start_bar_index", "base_end_bar_index")).alias("bar_index"))
    held = [c for c in zones.columns if c not in ("symbol", "bar_index")]
    return zones.join(spans, ["symbol", "bar_index"]).select("symbol", F.col("__end").alias("bar_index"), F.col("bar_index").alias("base_bar_index"), *held)


def trigger_signals(bars: DataFrame, zones: DataFrame, trigger: str, secs: int, direction: str = "both") -> DataFrame:
    """Signals on coarser trigger bars, at the zones of each one's last base bar, which
    is the signal's bar_index; trigger_ts is when the trigger bar is over."""
    coarse = trigger_bars(bars, secs)
    rows = coarse.select("symbol", "ts", F.col("base_end_bar_index").alias("bar_index"), "open", "high", "low", "close")
    over = coarse.select("symbol", F.col("base_end_bar_index").alias("bar_index"), (F.col("ts") + F.make_dt_interval(secs=F.lit(secs))).alias("trigger_ts"))
    return signals(rows, zones, trigger, direction).join(over, ["symbol", "bar_index"])


def three_candle(bars: DataFrame, levels: DataFrame, tick: float = DEFAULT.tick_size, arrival_ticks: float = 0, retrace_ticks: float = 1, max_wait: int = 5, look: int = 64) -> DataFrame:
    """Three-candle setups: arrival at a level, inside bars, reversal, retrace entry.

    levels: symbol, bar_index, source_mode, level_price. The first bar after the
    arrival that isn't inside it decides: found among the next ``look`` bars by a
    window, and for the few arrivals that need more, by a join on their symbol's
    later bars. A setup occupies its level until it resolves; arrivals meanwhile at
    the same price, direction and mode are passed over, in order, per level.
    """
    met = _reversals(bars, levels, tick, arrival_ticks, retrace_ticks, max_wait, look)
    long = F.col("direction") == "long"
    fills = F.filter("later", lambda b: (b["bar_index"] > F.col("rev.bar_index")) & (b["bar_index"] <= F.col("rev.bar_index") + max_wait) & F.when(long, b["low"] <= F.col("entry_price")).otherwise(b["high"] >= F.col("entry_price")))
    met = met.withColumn("fill", F.when(F.col("reversed"), F.get(fills, F.lit(0))["bar_index"]))
    until = F.when(~F.col("reversed"), F.col("rev.bar_index")).otherwise(F.coalesce("fill", F.least(F.col("last_bar"), F.col("rev.bar_index") + max_wait)))
    out = _merged(_unoccupied(met.withColumn("until", until)))
    return out.select("symbol", F.col("bar_index").alias("arrival_bar_index"), F.col("rev.bar_index").alias("reversal_bar_index"), F.col("fill").alias("entry_bar_index"), *SETUP)


def three_candle_on(bars: DataFrame, triggers: DataFrame, levels: DataFrame, secs: int, tick: float = DEFAULT.tick_size, arrival_ticks: float = 0, retrace_ticks: float = 1, max_wait: int = 5, look: int = 64) -> DataFrame:
    """Three-candle setups on trigger bars of ``secs``, from trigger_bars: arrival, inside
    bars and reversal are theirs; the entry is filled on the base bars that start after the
    reversal bar is over, until ``max_wait`` times its length has passed, which is also how
    long a setup occupies its level. The three bar_index columns are those of base bars.

    levels: symbol, bar_index, source_mode, level_price at any base bar of a trigger bar.
    """
    number = F.row_number().over(Window.partitionBy("symbol").orderBy("base_end_bar_index")) - 1
    coarse = triggers.withColumn("__no", number)
    spans = coarse.select("symbol", "__no", F.explode(F.sequence("base_start_bar_index", "base_end_bar_index")).alias("bar_index"))
    at = levels.join(spans, ["symbol", "bar_index"]).select("symbol", F.col("__no").alias("bar_index"), "source_mode", "level_price")
    met = _reversals(coarse.select("symbol", F.col("__no").alias("bar_index"), "high", "low", "close", "ts"), at, tick, arrival_ticks, retrace_ticks, max_wait, look)
    out = _unoccupied(met.withColumn("until", F.when(F.col("reversed"), F.col("rev.bar_index") + max_wait).otherwise(F.col("rev.bar_index"))))
    size = secs * 1_000_000
    out = out.withColumns({"__id": F.struct("bar_index", "source_mode", "level_price", "direction"), "__from": micros(F.col("rev.ts")) + size + 1}).withColumn("__to", F.col("__from") + max_wait * size)
    wanted = out.select("symbol", "__id", "__from", "__to", "direction", "entry_price")
    points = bars.select("symbol", F.col("bar_index").alias("__bar"), "high", "low", micros(F.col("ts")).alias("__at"))
    hits = range_join(points, wanted, ["symbol"], "__at", "__from", "__to", max_wait * size).where(F.when(F.col("direction") == "long", F.col("low") <= F.col("entry_price")).otherwise(F.col("high") >= F.col("entry_price"))) if max_wait else None
    filled = hits.groupBy("symbol", "__id").agg(F.min("__bar").alias("fill")) if max_wait else wanted.select("symbol", "__id", F.lit(None).cast("int").alias("fill")).distinct()
    out = _merged(out.join(filled, ["symbol", "__id"], "left"))
    ends = coarse.select("symbol", "__no", "base_end_bar_index")
    for c, no in (("arrival_bar_index", F.col("bar_index")), ("reversal_bar_index", F.col("rev.bar_index"))):
        out = out.withColumn("__no", no).join(ends.withColumnRenamed("base_end_bar_index", c), ["symbol", "__no"]).drop("__no")
    over = F.col("rev.ts") + F.make_dt_interval(secs=F.lit(secs))
    return out.select("symbol", "arrival_bar_index", "reversal_bar_index", F.col("fill").alias("entry_bar_index"), *SETUP, over.alias("trigger_ts"))


def _reversals(bars: DataFrame, levels: DataFrame, tick: float, arrival_ticks: float, retrace_ticks: float, max_wait: int, look: int) -> DataFrame:
    """Arrivals at levels with the bar that decides them and whether it reverses."""
    w = Window.partitionBy("symbol").orderBy("bar_index")
    nxt = F.collect_list(F.struct("bar_index", "high", "low", "close", "ts")).over(w.rowsBetween(1, look + max_wait))
    rows = bars.select("symbol", "bar_index", "high", "low", "close", nxt.alias("later"), F.max("bar_index").over(Window.partitionBy("symbol")).alias("last_bar"))
    met = levels.select("symbol", "bar_index", "source_mode", "level_price").distinct().join(rows, ["symbol", "bar_index"])
    met = met.withColumn("direction", F.explode(F.array(F.lit("long"), F.lit("short"))))
    long = F.col("direction") == "long"
    tol = arrival_ticks * tick
    arrived = F.when(long, (F.col("low") <= F.col("level_price") + tol) & (F.col("close") > F.col("level_price"))).otherwise((F.col("high") >= F.col("level_price") - tol) & (F.col("close") < F.col("level_price")))
    met = met.where(arrived)
    outside = F.filter(F.slice("later", 1, look), lambda b: ~((b["high"] <= F.col("high")) & (b["low"] >= F.col("low"))))
    met = met.withColumn("rev", F.get(outside, F.lit(0)))
    far = met.where("rev is null and last_bar > bar_index + %d" % look)
    if not far.isEmpty():
        more = far.select("symbol", "bar_index", "high", "low").distinct().alias("a").join(bars.alias("b"), (F.col("a.symbol") == F.col("b.symbol")) & (F.col("b.bar_index") > F.col("a.bar_index") + look) & ~((F.col("b.high") <= F.col("a.high")) & (F.col("b.low") >= F.col("a.low"))))
        more = more.groupBy("a.symbol", "a.bar_index").agg(F.min(F.col("b.bar_index")).alias("rev_index"))
        tail = bars.select("symbol", F.col("bar_index").alias("rev_index"), F.struct("bar_index", "high", "low", "close", "ts").alias("rev2"), F.collect_list(F.struct("bar_index", "high", "low", "close", "ts")).over(w.rowsBetween(1, max_wait)).alias("tail2"))
        met = met.join(more.join(tail, ["symbol", "rev_index"]), ["symbol", "bar_index"], "left").withColumns({"rev": F.coalesce("rev", "rev2"), "later": F.when(F.col("rev2").isNotNull(), F.col("tail2")).otherwise(F.col("later"))})
    ok = F.when(long, F.col("rev.close") > F.col("high")).otherwise(F.col("rev.close") < F.col("low"))
    sfp = ok & F.when(long, F.col("rev.low") < F.col("low")).otherwise(F.col("rev.high") > F.col("high"))
    met = met.where("rev is not null").withColumns({"reversed": ok, "is_sfp": sfp, "inside": F.col("rev.bar_index") - F.col("bar_index") - 1})
    entry = F.when(long, F.col("rev.close") - retrace_ticks * tick).otherwise(F.col("rev.close") + retrace_ticks * tick)
    return met.withColumns({"entry_price": entry, "price": F.rint(F.col("level_price") / tick) * tick})


def _unoccupied(met: DataFrame) -> DataFrame:
    """Reversed arrivals at levels that no earlier arrival occupies."""
    # greedy admission by level: an arrival is free if it comes after the last admitted one resolves
    keyed = met.groupBy("symbol", "price", "direction", "source_mode").agg(F.array_sort(F.collect_set(F.struct(F.col("bar_index").alias("at"), "level_price", "until"))).alias("a"))
    zero = F.struct(F.lit(-1).alias("until"), F.lit(-1).alias("arrival"), F.array().cast("array<struct<at:int,level_price:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        free = (x["at"] > s["until"]) | (x["at"] == s["arrival"])
        later = x["until"] >= s["until"]
        return F.when(free, F.struct(F.greatest(s["until"], x["until"]).alias("until"), F.when(later, x["at"]).otherwise(s["arrival"]).alias("arrival"), F.concat(s["out"], F.array(F.struct(x["at"].alias("at"), x["level_price"].alias("level_price")))).alias("out"))).otherwise(s)

    admitted = keyed.select("symbol", "direction", "source_mode", F.explode(F.aggregate("a", zero, step, lambda s: s["out"])).alias("x")).select("symbol", "direction", "source_mode", F.col("x.at").alias("bar_index"), F.col("x.level_price").alias("level_price"))
    return met.where("reversed").join(admitted, ["symbol", "direction", "source_mode", "bar_index", "level_price"])


def _merged(out: DataFrame) -> DataFrame:
    """One setup of an arrival, rounded price, direction and mode, filled ones first, with its variant and status."""
    first = Window.partitionBy("symbol", "price", "direction", "bar_index", "source_mode").orderBy(F.col("fill").isNull(), "level_price")
    out = out.withColumn("r", F.row_number().over(first)).where("r = 1")
    variant = F.concat(F.lit("3c"), F.when(F.col("is_sfp"), "_sfp").otherwise(""), F.concat(F.lit("_"), F.col("direction")), F.when(F.col("inside") > 0, "_muted").otherwise(""))
    return out.withColumns({"variant": variant, "inside_count": F.col("inside"), "status": F.when(F.col("fill").isNotNull(), "filled").otherwise("void")})


def otf_state(bars: DataFrame, secs: int, base_s: int, least: int = 3, by: list[str] = ()) -> DataFrame:
    """One-time-framing by coarser bar: up after ``least`` higher lows in a row, down
    after as many lower highs, neutral for both or neither, unknown at a session's
    first bar. Only buckets that the base bars cover whole count. by: further keys, such
    as a version of the bars, that states don't cross."""
    agg = bars.groupBy("symbol", *by, "session_date", floored(F.col("ts"), secs).alias("bucket")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count(F.lit(1)).alias("n"))
    rows = agg.where(F.col("n") == secs // base_s)
    w = Window.partitionBy("symbol", *by, "session_date").orderBy("bucket")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"up": F.coalesce(F.col("low") > F.lag("low").over(w), F.lit(False)), "down": F.coalesce(F.col("high") < F.lag("high").over(w), F.lit(False)), "i": F.row_number().over(w)})
    streak = lambda c: F.col("i") - F.coalesce(F.max(F.when(~F.col(c), F.col("i"))).over(run), F.lit(0))
    rows = rows.withColumns({"up_run": streak("up"), "down_run": streak("down")})
    up, down = F.col("up_run") >= least, F.col("down_run") >= least
    state = F.when(F.col("i") == 1, "unknown").when(up & ~down, "up").when(down & ~up, "down").otherwise("neutral")
    return rows.select("symbol", *by, "session_date", F.col("bucket").alias("ts"), "high", "low", "up_run", "down_run", state.alias("state"), (F.col("bucket") + F.make_dt_interval(secs=F.lit(secs))).alias("available_at"))


def otf_filter(rows: DataFrame, states: list[DataFrame], at: str = "ts") -> DataFrame:
    """Signals with ``accepted``: a long needs every time frame up, a short down, as known at the signal."""
    out = rows
    ok = F.lit(True)
    for i, s in enumerate(states):
        side = s.select("symbol", F.col("available_at").alias("__known"), F.col("state").alias(f"otf_{i}"))
        out = asof_backward(out, side, ["symbol"], at, "__known", [f"otf_{i}"])
        ok = ok & F.coalesce(F.col(f"otf_{i}") == F.when(F.col("direction") == "long", "up").otherwise("down"), F.lit(False))
    return out.withColumn("accepted", ok)


__all__ = ["anchor_zones", "cluster_zones", "micros", "on_trigger_bars", "otf_filter", "otf_state", "signals", "three_candle", "three_candle_on", "trigger_signals"]
