"""Trade simulation as one relational plan.

Signals become candidates with fill, stop, target and last bar; the first bar that
hits decides. Fixed brackets look it up in an index of blocks of bars; the others meet
the bars they may live through by an equi-join on (symbol, bar_index). Every parameter cell is a row of the candidates, so a grid is
the same plan with more rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.config import DEFAULT, INTRABAR_MODELS, choose, seconds
from tapewright.operators.admission import admit
from tapewright.operators.bars import floored, segment
from tapewright.operators.firsthit import first_hits
from tapewright.session import stored

#: Bars of a walk's first step.
STEP = 64


def entries(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals with entry bar and raw price: a given retrace entry, else the next bar's open."""
    cols = signals.columns
    given = "entry_bar_index" in cols and "entry_price" in cols
    rows = signals if given else signals.withColumns({"entry_bar_index": F.lit(None).cast("int"), "entry_price": F.lit(None).cast("double")})
    rows = rows.withColumns({"retrace": F.col("entry_bar_index").isNotNull(), "__at": F.coalesce("entry_bar_index", F.col("bar_index") + 1).cast("int")})
    spine = bars.select("symbol", F.col("bar_index").alias("__at"), F.col("ts").alias("entry_ts"), F.col("open").alias("__open"))
    out = rows.join(spine, ["symbol", "__at"])
    return out.withColumns({"entry_bar_index": F.col("__at"), "entry_price": F.coalesce("entry_price", "__open")}).drop("__at", "__open")


def _beyond(low: Column, high: Column) -> tuple[Column, Column]:
    """Whether a range reaches the stop, and whether the target."""
    long = F.col("direction") == "long"
    return F.when(long, low <= F.col("stop")).otherwise(high >= F.col("stop")), F.when(long, high >= F.col("target")).otherwise(low <= F.col("target"))


def _hit(path: bool) -> Column:
    """SL, TP or null for a bar that the trade lives through whole."""
    long = F.col("direction") == "long"
    sl, tp = _beyond(F.col("low"), F.col("high"))
    if not path:
        return F.when(sl, "SL").when(tp, "TP")
    # open - near extreme - far extreme - close; equal distances test both, a stop wins
    up_first = F.col("high") - F.col("open") < F.col("open") - F.col("low")
    even = F.col("high") - F.col("open") == F.col("open") - F.col("low")
    stop_first = F.when(long, ~up_first | even).otherwise(up_first | even)
    opened = F.when(long, F.when(F.col("open") <= F.col("stop"), "SL").when(F.col("open") >= F.col("target"), "TP")).otherwise(F.when(F.col("open") >= F.col("stop"), "SL").when(F.col("open") <= F.col("target"), "TP"))
    return F.coalesce(opened, F.when(sl & tp, F.when(stop_first, "SL").otherwise("TP")).when(sl, "SL").when(tp, "TP"))


def _retrace_hit(path: bool) -> Column:
    """SL, TP or null for the bar within which a retrace entry is filled.

    Only what follows the entry counts. sl_first wants a hit on both ways through
    the bar, by the high or by the low first: above the open, the price was last at
    the entry on the way up, so that the low may lie before it, and the reverse. The
    path model follows its one way from the entry on.
    """
    e = F.col("entry_price")
    inside = (F.col("low") <= e) & (e <= F.col("high"))
    if not path:
        low = F.when(e > F.col("open"), F.least(e, F.col("close"))).otherwise(F.col("low"))
        high = F.when(e < F.col("open"), F.greatest(e, F.col("close"))).otherwise(F.col("high"))
        sl, tp = _beyond(low, high)
        return F.when(inside & sl, "SL").when(inside & tp, "TP")
    between = lambda x, a, b: (F.least(a, b) <= x) & (x <= F.greatest(a, b))

    def leg(a: Column, b: Column) -> Column:
        stop, target = between(F.col("stop"), a, b), between(F.col("target"), a, b)
        nearer = F.when(F.abs(F.col("stop") - a) <= F.abs(F.col("target") - a), "SL").otherwise("TP")
        return F.when(stop & target, nearer).when(stop, "SL").when(target, "TP")

    sl, tp = _beyond(e, e)
    at_entry = F.when(sl, "SL").when(tp, "TP")

    def way(first: str, second: str) -> Column:
        at = [F.col(k) for k in ("open", first, second, "close")]
        # the leg that holds the entry, from 1; the way then goes on from the entry to that leg's end
        held = F.when(between(e, at[0], at[1]), 1).when(between(e, at[1], at[2]), 2).when(between(e, at[2], at[3]), 3)
        points = F.concat(F.array(e), F.slice(F.array(*at), held + 1, F.lit(4)))
        legs = F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda i: leg(F.get(points, i), F.get(points, i + 1)))
        return F.when(held.isNotNull(), F.coalesce(at_entry, F.get(F.filter(legs, lambda k: k.isNotNull()), F.lit(0))))

    up, down = way("high", "low"), way("low", "high")
    rise, fall = F.col("high") - F.col("open"), F.col("open") - F.col("low")
    both = F.when((up == "SL") | (down == "SL"), "SL").otherwise(F.coalesce(up, down))
    return F.when(rise < fall, up).when(rise > fall, down).otherwise(both)


def sub_bars_of(bars: DataFrame, sub: DataFrame, parent_s: int, sub_s: int, tick: float = DEFAULT.tick_size) -> DataFrame:
    """By bar: its sub-bars in order and what is wrong with them: ``incomplete`` (not as
    many as fit), ``misaligned`` (not at multiples of their length), ``mismatch``
    (their open, high, low or close isn't the bar's), or null."""
    if parent_s % sub_s or parent_s == sub_s:
        raise ValueError(f"sub-bars of {sub_s} s don't divide bars of {parent_s} s")
    rows = sub.select("symbol", floored(F.col("ts"), parent_s).alias("__parent"), (floored(F.col("ts"), sub_s) != F.col("ts")).alias("off"), F.struct(F.col("ts").alias("at"), "open", "high", "low", "close").alias("s"))
    held = rows.groupBy("symbol", "__parent").agg(F.array_sort(F.collect_list("s")).alias("subs"), F.max("off").alias("off"), F.count_distinct("s.at").alias("n"), F.max("s.high").alias("h"), F.min("s.low").alias("l"))
    met = bars.alias("b").join(held, (F.col("b.symbol") == held["symbol"]) & (F.col("b.ts") == F.col("__parent")), "left")
    near = lambda x, y: F.abs(x - y) <= tick * 1e-6
    same = near(F.get("subs", F.lit(0))["open"], F.col("b.open")) & near(F.col("h"), F.col("b.high")) & near(F.col("l"), F.col("b.low")) & near(F.element_at("subs", -1)["close"], F.col("b.close"))
    fault = F.when(F.col("subs").isNull() | (F.size("subs") != parent_s // sub_s), "incomplete").when(F.col("off") | (F.col("n") != F.size("subs")), "misaligned").when(~same, "mismatch")
    return met.select("b.symbol", "b.bar_index", "subs", fault.alias("fault"))


def _sub_hit(conservative: bool) -> Column:
    """SL, TP or null for a bar by its sub-bars in order. A sub-bar that holds both is
    a stop; so is a stop in the sub-bar that holds a retrace entry, whose target doesn't
    count. Bars without whole sub-bars (conservative) go by the bar, the stop first, and
    a retrace entry's own bar then has no target."""
    e = F.col("entry_price")
    own = F.col("retrace") & (F.col("bar_index") == F.col("entry_bar_index"))
    kind = lambda b: F.when(_beyond(b["low"], b["high"])[0], "SL").when(_beyond(b["low"], b["high"])[1], "TP")
    first = lambda bars: F.get(F.filter(F.transform(bars, kind), lambda k: k.isNotNull()), F.lit(0))
    start = F.get(F.filter("subs", lambda b: (b["low"] <= e) & (e <= b["high"])), F.lit(0))
    after = F.filter("subs", lambda b: b["at"] > start["at"])
    entered = F.when(start.isNotNull(), F.when(kind(start) == "SL", "SL").otherwise(first(after)))
    out = F.when(own, entered).otherwise(first(F.col("subs")))
    if conservative:
        bar = _hit(False)
        reached = (F.col("low") <= e) & (e <= F.col("high"))
        out = F.when(F.col("subs").isNotNull(), out).when(~own, bar).when(reached & (bar == "SL"), "SL")
    return out


def _walked(cand: DataFrame, spine: DataFrame, kind: Column, tick: float, moving: bool, width: int | None = None) -> DataFrame:
    """Candidates (s) led through their bars from ``from_bar`` on, ``width`` bars at most:
    where each stands at its first hit or at its last bar (x), whether it ended there,
    and its best gain so far (best1)."""
    to = F.least(F.col("cap"), F.col("from_bar") + width - 1) if width else F.col("cap")
    walk = cand.withColumn("bar_index", F.explode(F.sequence("from_bar", to))).join(spine, ["symbol", "bar_index"])
    by = Window.partitionBy("symbol", "signal_id", "cell_id").orderBy("bar_index")
    gain = F.greatest(F.when(F.col("sign") > 0, F.col("high") - F.col("fill")).otherwise(F.col("fill") - F.col("low")), F.lit(0.0))
    counts = F.when(F.col("retrace") & (F.col("bar_index") == F.col("entry_bar_index")), F.lit(0.0)).otherwise(gain)
    if moving:
        walk = walk.withColumn("best", F.greatest("best0", F.max(counts).over(by.rowsBetween(Window.unboundedPreceding, -1))))
        be = F.when(F.col("best") >= F.col("breakeven_r") * F.col("risk"), F.lit(0.0))
        trail = F.when(F.col("best") >= F.col("trail_r") * F.col("risk"), F.col("best") - F.col("trail_ticks") * tick)
        level = F.greatest(-F.col("risk"), be, trail)  # in points of gain; null levels are skipped
        walk = walk.withColumns({"stop": F.col("fill") + F.col("sign") * level, "stop_label": F.when(trail.isNotNull() & (trail > F.greatest(-F.col("risk"), F.coalesce(be, -F.col("risk")))), "TRAIL").when(be.isNotNull() & (level == 0), "BE").otherwise("SL")})
    else:
        walk = walk.withColumns({"stop": F.col("stop0"), "stop_label": F.lit("SL")})
    walk = walk.withColumn("kind", kind)
    adverse = F.when(F.col("sign") > 0, F.col("fill") - F.col("low")).otherwise(F.col("high") - F.col("fill"))
    favour = F.when(F.col("sign") > 0, F.col("high") - F.col("fill")).otherwise(F.col("fill") - F.col("low"))
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    walk = walk.withColumns({"mae": F.greatest("mae0", F.max(adverse).over(run)), "mfe": F.greatest("mfe0", F.max(favour).over(run))})
    done = F.struct("bar_index", "ts", F.when(F.col("kind") == "TP", F.col("target")).when(F.col("kind") == "SL", F.col("stop")).otherwise(F.col("close")).alias("price"), F.when(F.col("kind") == "SL", F.col("stop_label")).when(F.col("kind") == "TP", "TP").otherwise(F.col("cap_reason")).alias("reason"), "mae", "mfe", "stop", "close")
    best1 = [F.greatest(F.first("best0"), F.max(counts)).alias("best1")] if width else []
    out = walk.groupBy("symbol", "signal_id", "cell_id").agg(F.min_by(done, F.when(F.col("kind").isNotNull(), F.col("bar_index"))).alias("hit"), F.max_by(done, "bar_index").alias("end"), F.first(F.struct(*cand.columns)).alias("s"), *best1)
    return out.withColumns({"x": F.coalesce("hit", "end"), "ended": F.col("hit").isNotNull() | (F.col("end.bar_index") >= F.col("s.cap"))})


def _fixed(cand: DataFrame, spine: DataFrame, last_bar: int, path: bool, given: bool) -> DataFrame:
    """Where candidates with fixed brackets leave (x), by the index of blocks of bars.

    Only what the walk needs travels; the rest of a candidate comes back by its key. The
    bar of a retrace entry has rules of its own and is looked at first.
    """
    keys = ["symbol", "signal_id", "cell_id"]
    none = F.lit(None).cast("double")
    walk = cand.select(*keys, "sign", "direction", F.col("stop0").alias("stop"), "target", "cap", F.col("first_bar").alias("pos"), "entry_bar_index", "entry_price", "retrace", F.lit(False).alias("settled"), none.alias("lo"), none.alias("hi"))
    own_bar = F.lit(None).cast("struct<kind:string,u:int,low:double,high:double,open:double,close:double,ts:timestamp_ntz>")
    if given:
        first = spine.select("symbol", F.col("bar_index").alias("pos"), "ts", "open", "high", "low", "close")
        walk = walk.join(first, ["symbol", "pos"])
        own = F.col("retrace") & (F.col("pos") == F.col("entry_bar_index"))
        kind = F.when(own, _retrace_hit(path))
        walk = walk.withColumn("kind", kind).withColumns({"settled": own & (F.col("kind").isNotNull() | (F.col("pos") >= F.col("cap")))})
        walk = walk.withColumns({"own": F.when(F.col("settled"), F.struct("kind", F.col("pos").alias("u"), "low", "high", "open", "close", "ts")), "lo": F.when(own, F.col("low")), "hi": F.when(own, F.col("high")), "pos": F.col("pos") + own.cast("int")})
        walk = walk.drop("ts", "open", "high", "low", "close", "kind")
    else:
        walk = walk.withColumn("own", own_bar)
    found = first_hits(walk, spine, last_bar)
    at = lambda c: F.coalesce(F.col(f"own.{c}"), F.col(f"bar.{c}"))
    found = found.withColumns({c: at(c) for c in ("open", "high", "low", "close", "ts")}).withColumn("bar_index", at("u"))
    found = found.withColumn("kind", F.when(F.col("settled"), F.col("own.kind")).otherwise(_hit(path)))
    away = lambda up: F.when(up, F.col("hi") - F.col("fill")).otherwise(F.col("fill") - F.col("lo"))
    out = cand.join(found.select(*keys, "bar_index", "ts", "kind", "stop", "close", "lo", "hi"), keys)
    price = F.when(F.col("kind") == "TP", F.col("target")).when(F.col("kind") == "SL", F.col("stop")).otherwise(F.col("close"))
    x = F.struct("bar_index", "ts", price.alias("price"), F.coalesce("kind", "cap_reason").alias("reason"), away(F.col("sign") < 0).alias("mae"), away(F.col("sign") > 0).alias("mfe"), "stop", "close")
    return out.select(*cand.columns, x.alias("x"))


def simulate(bars: DataFrame, signals: DataFrame, cells: list[dict] | None = None, *, stop_ticks: float = 8, target_ticks: float = 16, tick: float = DEFAULT.tick_size, point_value: float = DEFAULT.point_value,
             max_bars: int | None = None, same_bar_exit: bool = True, commission: float = 0.0, slippage_ticks: float = 0.0, session_close: str | None = None, no_new_after: str | None = None,
             model: str = "sl_first", breakeven_r: float | None = None, trail_r: float | None = None, trail_ticks: float | None = None, sub: DataFrame | None = None, parent_s: int | None = None, sub_s: int | None = None) -> DataFrame:
    """Trades with entry, exit, reason, R multiple and excursions.

    bars: with bar_index (and, for session caps, local_ts, sod and session_date).
    cells: parameter cells (stop_ticks, target_ticks, breakeven_r, trail_r,
    trail_ticks); each signal is simulated in each. max_bars bounds the walk. Beyond
    STEP bars, or without a bound, fixed brackets find their bar by an index of blocks
    (``firsthit``), in one plan without a job of its own but for the number of bars.
    Otherwise, and with moved stops or sub-bars, they walk bar by bar, beyond STEP in steps, each four times as
    long as the one before, and only trades still open go on, so a trade meets no more
    than about four times the bars that it lives.

    Order at a bar: stop before target (model sl_first), by the nearer extreme first
    (path_open_proximity), or by its sub-bars (``sub`` of sub_s seconds in bars of
    parent_s): subtimeframe wants whole sub-bars in every bar, and
    subtimeframe_conservative takes sl_first where they are incomplete; both raise
    ValueError if sub-bars don't make up their bar. A stop moved by a bar holds from
    the next bar on.
    """
    choose(model, INTRABAR_MODELS, "intrabar model")
    by_sub = model in ("subtimeframe", "subtimeframe_conservative")
    if by_sub:
        if sub is None or not parent_s or not sub_s:
            raise ValueError(f"{model} needs sub, parent_s and sub_s")
        subs = sub_bars_of(bars, sub, parent_s, sub_s, tick)
        fatal = subs.where(F.col("fault") == "mismatch" if model != "subtimeframe" else F.col("fault").isNotNull()).select("symbol", "bar_index", "fault").first()
        if fatal:
            raise ValueError(f"sub-bars of {fatal['symbol']} bar {fatal['bar_index']}: {fatal['fault']}")
    base = {"stop_ticks": stop_ticks, "target_ticks": target_ticks, "breakeven_r": breakeven_r, "trail_r": trail_r, "trail_ticks": trail_ticks}
    table = [{**base, **c, "cell_id": i} for i, c in enumerate(cells or [{}])]
    kinds = "cell_id int, stop_ticks double, target_ticks double, breakeven_r double, trail_r double, trail_ticks double"
    as_float = lambda v: None if v is None else float(v)
    rows = [(c["cell_id"], *[as_float(c[k]) for k in base]) for c in table]
    cell_array = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, (x.split() for x in kinds.split(", ")), strict=True)]) for r in rows])
    cand = entries(bars, signals).withColumn("c", F.explode(cell_array)).select("*", "c.*").drop("c")
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    cand = cand.withColumn("sign", sign).withColumn("fill", F.col("entry_price") + F.col("sign") * slippage_ticks * tick)
    cand = cand.withColumns({"risk": F.col("stop_ticks") * tick, "stop0": F.col("fill") - F.col("sign") * F.col("stop_ticks") * tick, "target": F.col("fill") + F.col("sign") * F.col("target_ticks") * tick})
    last = bars.groupBy("symbol").agg(F.max("bar_index").alias("last_bar"))
    n_symbols, last_bar = last.agg(F.count(F.lit(1)), F.coalesce(F.max("last_bar"), F.lit(0))).first()
    cand = cand.join(F.broadcast(last) if n_symbols <= 100_000 else last, "symbol")
    time_cap = F.col("entry_bar_index") + max_bars - 1 if max_bars else F.lit(None).cast("int")
    if session_close:
        at = seconds(session_close)
        ends = bars.where(F.col("sod") <= at).groupBy("symbol", "session_date").agg(F.max(F.when(F.col("session") == "RTH", F.col("bar_index"))).alias("close_bar"))
        day = bars.select("symbol", F.col("bar_index").alias("entry_bar_index"), "session_date", F.col("sod").alias("entry_sod"))
        cand = cand.join(day, ["symbol", "entry_bar_index"]).join(ends, ["symbol", "session_date"], "left")
        cand = cand.where(F.col("close_bar").isNull() | (F.col("close_bar") >= F.col("entry_bar_index")))
    else:
        cand = cand.withColumn("close_bar", F.lit(None).cast("int"))
    if no_new_after:
        if "entry_sod" not in cand.columns:
            cand = cand.join(bars.select("symbol", F.col("bar_index").alias("entry_bar_index"), F.col("sod").alias("entry_sod")), ["symbol", "entry_bar_index"])
        cand = cand.where(F.col("entry_sod") <= seconds(no_new_after))
    cand = cand.withColumn("cap", F.least(F.col("last_bar"), time_cap, F.col("close_bar")).cast("int"))
    cand = cand.withColumn("cap_reason", F.when(time_cap == F.col("cap"), "TIME").when(F.col("close_bar") == F.col("cap"), "SESSION_CLOSE").when(F.col("last_bar") == F.col("cap"), "DATA_END").otherwise("EOD"))
    cand = cand.withColumn("first_bar", (F.col("entry_bar_index") + (0 if same_bar_exit else 1)).cast("int"))
    moving = any(c.get("breakeven_r") or c.get("trail_r") for c in table)
    spine = bars.select("symbol", "bar_index", "ts", "open", "high", "low", "close")
    if by_sub:
        spine = spine.join(subs.where("fault is null").select("symbol", "bar_index", "subs"), ["symbol", "bar_index"], "left")
    own = F.col("retrace") & (F.col("bar_index") == F.col("entry_bar_index"))
    path = model == "path_open_proximity"
    kind = _sub_hit(model == "subtimeframe_conservative") if by_sub else F.when(own, _retrace_hit(path)).otherwise(_hit(path))
    keep = [c for c in cand.columns if c not in ("bar_index", "ts", "last_bar", "first_bar", "close_bar", "entry_sod", "session_date", "cap", "cap_reason", "__at")]
    # what a trade carries from step to step: the next bar, the best gain and the excursions so far
    still = cand.drop("bar_index", "ts").where("first_bar <= cap").withColumns({"from_bar": F.col("first_bar"), "best0": F.lit(0.0), "mae0": F.lit(None).cast("double"), "mfe0": F.lit(None).cast("double")})
    short = bool(max_bars) and max_bars <= STEP  # a row for each of a few bars costs less than the joins of the index
    if not moving and not by_sub and not short:
        given = "entry_bar_index" in signals.columns and "entry_price" in signals.columns
        out = _fixed(still.drop("from_bar", "best0", "mae0", "mfe0"), spine, last_bar, path, given)
    elif short:
        out = _walked(still, spine, kind, tick, moving).select("s.*", "x")
    else:
        ended, width = [], STEP
        while not ended or not still.isEmpty():
            step = stored(_walked(still, spine, kind, tick, moving, width))
            ended.append(step.where("ended").select("s.*", "x"))
            still = step.where("not ended").select("s.*", F.struct(F.col("x.bar_index") + 1, "best1", "x.mae", "x.mfe").alias("n"))
            still = still.withColumns({"from_bar": F.col("n.col1").cast("int"), "best0": F.col("n.best1"), "mae0": F.col("n.mae"), "mfe0": F.col("n.mfe")}).drop("n")
            width *= 4
        out = reduce(DataFrame.unionAll, ended)
    out = out.select(*keep, "x")
    exit_price = F.col("x.price") - F.col("sign") * slippage_ticks * tick
    out = out.withColumns({"exit_bar_index": F.col("x.bar_index"), "exit_ts": F.col("x.ts"), "exit_price": exit_price, "exit_reason": F.col("x.reason"), "mae_points": F.greatest(F.col("x.mae"), F.lit(0.0)), "mfe_points": F.greatest(F.col("x.mfe"), F.lit(0.0))})
    out = out.withColumn("pnl_currency", (F.col("exit_price") - F.col("fill")) * F.col("sign") * point_value - 2 * commission)
    out = out.withColumns({"r_multiple": F.col("pnl_currency") / (F.col("risk") * point_value), "bars_held": F.col("exit_bar_index") - F.col("entry_bar_index") + 1, "stop_price": F.col("stop0"), "target_price": F.col("target")})
    return out.drop("x", "sign", "stop0", "target", "risk").withColumnRenamed("fill", "entry_fill")


def in_entry_window(sod: Column, segments: list[str] | None = None, clock: tuple[str, str] | None = None) -> Column:
    """Membership of a local second of the day, to the minute, in segments or a half-open clock range."""
    minute = F.floor(sod / 60) * 60
    if segments is not None:
        return segment(minute).isin(segments)
    lo, hi = clock or ("00:00", "24:00")
    return (minute >= seconds(lo)) & (minute < seconds(hi))


def subtimeframe_exits(trades: DataFrame, sub: DataFrame, parent_s: int) -> DataFrame:
    """First stop or target by sub-bars of each trade's bars, met on the parent's start;
    a sub-bar that holds both is a stop."""
    rows = sub.withColumn("parent_ts", floored(F.col("ts"), parent_s))
    long = F.col("direction") == "long"
    met = trades.join(rows.select("symbol", "parent_ts", F.col("ts").alias("sub_ts"), "low", "high"), ["symbol", "parent_ts"])
    sl = F.when(long, F.col("low") <= F.col("stop_price")).otherwise(F.col("high") >= F.col("stop_price"))
    tp = F.when(long, F.col("high") >= F.col("target_price")).otherwise(F.col("low") <= F.col("target_price"))
    kind = F.when(sl, "SL").when(tp, "TP")
    return met.withColumn("kind", kind).groupBy("symbol", "signal_id", "parent_ts").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("sub_ts"))).alias("resolved"))


__all__ = ["admit", "entries", "in_entry_window", "simulate", "sub_bars_of", "subtimeframe_exits"]
