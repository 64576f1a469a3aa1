"""Price levels by bar. Each value uses only bars up to its own; prior periods are
the previous ones that have bars. Frames come from ``sessionised``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.config import DEFAULT, Instrument, seconds
from tapewright.operators.bars import floored, indexed, micros, resample, session_brackets
from tapewright.operators.joins import asof_backward

RUN = (Window.unboundedPreceding, 0)
PERIODS = {"d": "session_date", "w": "week_key", "m": "month_key"}


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def with_keyed(bars: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Bars with columns that hold for a key; bars without it get nulls."""
    return bars.join(keyed, keys, "left")


def shifted(keyed: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """The columns of the previous key of each symbol, under new names."""
    w = Window.partitionBy("symbol").orderBy(key)
    return keyed.select("symbol", key, *[F.lag(c).over(w).alias(n) for c, n in columns.items()])


def current_opens(bars: DataFrame) -> DataFrame:
    first = lambda k: F.first("open", ignorenulls=True).over(Window.partitionBy("symbol", k).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bars.withColumns({f"{p}Open": first(k) for p, k in PERIODS.items()})


def prior_period(bars: DataFrame, period: str) -> DataFrame:
    """p{d,w,m}Open, High, Low and EQ of the previous day, week or month with bars."""
    key = PERIODS[period]
    agg = bars.groupBy("symbol", key).agg(F.min_by("open", "ts").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"))
    agg = agg.withColumn("e", (F.col("h") + F.col("l")) / 2)
    p = f"p{period}"
    return with_keyed(bars, shifted(agg, key, {"o": f"{p}Open", "h": f"{p}High", "l": f"{p}Low", "e": f"{p}EQ"}), ["symbol", key])


def session_facts(bars: DataFrame, inst: Instrument = DEFAULT) -> DataFrame:
    """By session: first regular bar, regular and overnight extremes, settlement."""
    rth = F.col("session") == "RTH"
    over = (F.col("session") == "ETH") & ((F.col("sod") >= seconds(inst.eth_start)) | (F.col("sod") < seconds(inst.rth_start)))
    pick = lambda f, c, on: f(F.when(on, F.col(c)))
    return bars.groupBy("symbol", "session_date").agg(
        pick(F.min, "ts", rth).alias("f_first_rth"), F.min_by("open", F.when(rth, F.col("ts"))).alias("f_rth_open"), pick(F.max, "high", rth).alias("f_rth_high"), pick(F.min, "low", rth).alias("f_rth_low"),
        F.max_by("close", F.when(rth, F.col("ts"))).alias("f_rth_close"), pick(F.max, "high", over).alias("f_onh"), pick(F.min, "low", over).alias("f_onl"),
    )


def session_levels(bars: DataFrame, inst: Instrument = DEFAULT) -> DataFrame:
    """RTH_Open, ONH, ONL (from the first regular bar on) and the prior session's pONH, pONL, pRTH_*, prevSettlement."""
    facts = session_facts(bars, inst)
    prior = shifted(facts, "session_date", {"f_onh": "pONH", "f_onl": "pONL", "f_rth_open": "pRTH_Open", "f_rth_high": "pRTH_High", "f_rth_low": "pRTH_Low", "f_rth_close": "prevSettlement"})
    out = with_keyed(with_keyed(bars, facts, ["symbol", "session_date"]), prior, ["symbol", "session_date"])
    seen = F.col("ts") >= F.col("f_first_rth")
    out = out.withColumns({"RTH_Open": F.when(seen, F.col("f_rth_open")), "ONH": F.when(seen, F.col("f_onh")), "ONL": F.when(seen, F.col("f_onl"))})
    return out.drop("f_first_rth", "f_rth_open", "f_rth_high", "f_rth_low", "f_rth_close", "f_onh", "f_onl")


def clock_window(bars: DataFrame, name: str, start: str, end: str, session: str = "ETH") -> DataFrame:
    """{name}High and {name}Low of a session's bars with local times in [start, end),
    visible by the clock from the end on. An end of 00:00 is the session date's midnight."""
    lo, hi = seconds(start), seconds(end)
    inside = (F.col("session") == session) & (F.col("sod") >= lo) & (F.col("sod") < (hi or 86400))
    agg = bars.groupBy("symbol", "session_date").agg(F.max(F.when(inside, F.col("high"))).alias("h"), F.min(F.when(inside, F.col("low"))).alias("l"))
    gate = F.col("local_ts") >= (F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(hi)))
    out = with_keyed(bars, agg, ["symbol", "session_date"])
    return out.withColumns({f"{name}High": F.when(gate, F.col("h")), f"{name}Low": F.when(gate, F.col("l"))}).drop("h", "l")


def opening_range(bars: DataFrame, minutes: int = 30, inst: Instrument = DEFAULT) -> DataFrame:
    if minutes not in (5, 15, 30):
        raise ValueError("the opening range has 5, 15 or 30 minutes")
    start = seconds(inst.rth_start)
    clock = lambda s: f"{s // 3600:02d}:{s % 3600 // 60:02d}"
    return clock_window(bars, "OR_", inst.rth_start, clock(start + 60 * minutes), "RTH")


#: Clock windows of the level frame: name, start, end, session.
CLOCK_WINDOWS = (("Asia", "20:00", "00:00", "ETH"), ("London", "02:00", "05:00", "ETH"))


def level_frame(bars: DataFrame, inst: Instrument = DEFAULT, windows=CLOCK_WINDOWS, opening_minutes: int = 30) -> DataFrame:
    """Bars with the opens, prior days, weeks and months, session, clock-window and
    opening-range levels: those of current_opens, prior_period, session_levels,
    clock_window and opening_range, from one grouping by session date.

    A week's and a month's facts are those of its days, so they are windows over the
    rows of days; another family is a few more columns of the grouping, and the bars
    come back by one join.
    """
    clock = lambda s: f"{s // 3600:02d}:{s % 3600 // 60:02d}"
    rth, start = F.col("session") == "RTH", seconds(inst.rth_start)
    over = (F.col("session") == "ETH") & ((F.col("sod") >= seconds(inst.eth_start)) | (F.col("sod") < start))
    spans = [*windows, ("OR_", inst.rth_start, clock(start + 60 * opening_minutes), "RTH")]
    at = lambda on: F.when(on, F.col("ts"))
    facts = {"open": F.min_by("open", at(F.col("open").isNotNull())), "o": F.min_by("open", "ts"), "h": F.max("high"), "l": F.min("low"), "rth": F.min(at(rth)), "ro": F.min_by("open", at(rth)), "rc": F.max_by("close", at(rth))}
    for name, on in {"r": rth, "n": over}.items():
        facts |= {f"{name}h": F.max(F.when(on, F.col("high"))), f"{name}l": F.min(F.when(on, F.col("low")))}
    for name, lo, hi, session in spans:
        inside = (F.col("session") == session) & (F.col("sod") >= seconds(lo)) & (F.col("sod") < (seconds(hi) or 86400))
        facts |= {f"{name}h": F.max(F.when(inside, F.col("high"))), f"{name}l": F.min(F.when(inside, F.col("low")))}
    days = bars.groupBy("symbol", *PERIODS.values()).agg(*[c.alias(f"f_{k}") for k, c in facts.items()])
    by_date = Window.partitionBy("symbol").orderBy("session_date")
    made = {}
    for p, key in PERIODS.items():
        whole = Window.partitionBy("symbol", key).orderBy("session_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        days = days.withColumns({f"{p}_o": F.first("f_o").over(whole), f"{p}_h": F.max("f_h").over(whole), f"{p}_l": F.min("f_l").over(whole), f"made_{p}Open": F.first("f_open", ignorenulls=True).over(whole)})
        prior = {n: F.first(F.col(f"__{c}")).over(whole) for n, c in ((f"made_p{p}Open", "o"), (f"made_p{p}High", "h"), (f"made_p{p}Low", "l"))}
        # the day before a period's first day has the values of the period before
        days = days.withColumns({f"__{c}": F.lag(f"{p}_{c}").over(by_date) for c in "ohl"}).withColumns(prior)
        days = days.withColumn(f"made_p{p}EQ", (F.col(f"made_p{p}High") + F.col(f"made_p{p}Low")) / 2)
        made |= {c: F.col(f"made_{c}") for c in (f"{p}Open", f"p{p}Open", f"p{p}High", f"p{p}Low", f"p{p}EQ")}
    for name, c in {"pONH": "nh", "pONL": "nl", "pRTH_Open": "ro", "pRTH_High": "rh", "pRTH_Low": "rl", "prevSettlement": "rc"}.items():
        days = days.withColumn(f"made_{name}", F.lag(f"f_{c}").over(by_date))
        made[name] = F.col(f"made_{name}")
    seen = F.col("ts") >= F.col("f_rth")
    made |= {"RTH_Open": F.when(seen, F.col("f_ro")), "ONH": F.when(seen, F.col("f_nh")), "ONL": F.when(seen, F.col("f_nl"))}
    for name, _, hi, _ in spans:
        gate = F.col("local_ts") >= (F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(seconds(hi))))
        made |= {f"{name}High": F.when(gate, F.col(f"f_{name}h")), f"{name}Low": F.when(gate, F.col(f"f_{name}l"))}
    keep = [c for c in days.columns if c.startswith(("f_", "made_"))]
    out = bars.join(days.select("symbol", "session_date", *keep), ["symbol", "session_date"])
    return out.select(*[c for c in bars.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def sma(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)
    return bars.withColumn(f"SMA_{n}", F.when(F.count("close").over(w) == n, F.avg("close").over(w)))


def ema(bars: DataFrame, n: int) -> DataFrame:
    """Exponential mean with factor 2/(n+1) from the first close on, null for the first n-1 bars.

    A symbol's bars are dealt out in blocks of max(n, 64). Within a block, the mean of its
    own closes is a running sum of closes weighted by growing powers of the decay, which
    stay small; a block hands on decay^length times what it got plus its own last mean, and
    what a block gets is folded over as many blocks before as still reach a double's last
    digit, about 46 / factor bars. Closes are not null.
    """
    alpha = 2.0 / (n + 1)
    if n == 1:
        return bars.withColumn("EMA_1", F.col("close"))
    size = max(n, 64)
    decay = 1 - alpha
    reach = max(1, math.ceil(math.log(1e-20) / (size * math.log(decay))))
    # numbers within a symbol by blocks of time, so that no task orders more than a day
    day = Window.partitionBy("symbol", "__day").orderBy("ts")
    rows = bars.withColumn("__day", F.to_date("ts")).withColumn("__k", F.row_number().over(day))
    before = rows.groupBy("symbol", "__day").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("symbol").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rows = rows.join(before, ["symbol", "__day"]).withColumn("__i", F.col("__before") + F.col("__k") - 1).drop("__day", "__k", "__before")
    rows = rows.withColumns({"__b": F.floor(F.col("__i") / size), "__at": (F.col("__i") % size).cast("int")})
    weight = F.when(F.col("__i") == 0, 1.0).otherwise(alpha)
    run = Window.partitionBy("symbol", "__b").orderBy("__at").rowsBetween(*RUN)
    rows = rows.withColumn("__own", F.sum(F.col("close") * weight * F.pow(F.lit(decay), -F.col("__at"))).over(run) * F.pow(F.lit(decay), F.col("__at")))
    last = rows.groupBy("symbol", "__b").agg(F.max_by("__own", "__at").alias("own"))
    held = F.collect_list("own").over(Window.partitionBy("symbol").orderBy("__b").rowsBetween(-reach, -1))
    got = last.select("symbol", "__b", F.aggregate(held, F.lit(0.0), lambda s, x: s * decay**size + x).alias("__got"))
    out = rows.join(got, ["symbol", "__b"])
    value = F.col("__own") + F.pow(F.lit(decay), F.col("__at") + 1) * F.col("__got")
    return out.withColumn(f"EMA_{n}", F.when(F.col("__i") >= n - 1, value)).drop("__i", "__b", "__at", "__own", "__got")


def higher_sma(bars: DataFrame, n: int, timeframe: str, inst: Instrument = DEFAULT) -> DataFrame:
    """SMA of coarser candles, known from each candle's close on."""
    return _higher(bars, sma, f"SMA_{n}", n, timeframe, inst)


def higher_ema(bars: DataFrame, n: int, timeframe: str, inst: Instrument = DEFAULT) -> DataFrame:
    """EMA of coarser candles, known from each candle's close on."""
    return _higher(bars, ema, f"EMA_{n}", n, timeframe, inst)


def _higher(bars: DataFrame, mean, made: str, n: int, timeframe: str, inst: Instrument) -> DataFrame:
    from tapewright.config import TIMEFRAMES

    name = f"{made}_{timeframe}"
    coarse = mean(resample(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), timeframe, inst), n)
    known = coarse.select("symbol", (F.col("ts") + F.make_dt_interval(secs=F.lit(TIMEFRAMES[timeframe]))).alias("known_at"), F.col(made).alias(name)).where(f"`{name}` is not null")
    return asof_backward(bars, known, ["symbol"], "ts", "known_at", [name])


def rolling_vwap(bars: DataFrame, secs: int, name: str) -> DataFrame:
    """Volume-weighted typical price over (t - window, t]."""
    w = Window.partitionBy("symbol").orderBy(micros(F.col("ts"))).rangeBetween(-(secs * 1_000_000 - 1), 0)
    v = F.sum("volume").over(w)
    return bars.withColumn(name, F.when(v != 0, F.sum(typical() * F.col("volume")).over(w) / v))


def session_vwaps(bars: DataFrame) -> DataFrame:
    """Cumulative VWAPs of the day, week, month and regular session."""
    out = bars
    for name, keys in {"dVWAP": ["session_date"], "wVWAP": ["week_key"], "mVWAP": ["month_key"], "dVWAP_RTH": ["session_date", "session"]}.items():
        w = Window.partitionBy("symbol", *keys).orderBy("ts").rowsBetween(*RUN)
        v = F.sum("volume").over(w)
        value = F.when(v != 0, F.sum(typical() * F.col("volume")).over(w) / v)
        out = out.withColumn(name, F.when(F.col("session") == "RTH", value) if name.endswith("RTH") else value)
    return out


def atr(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts")
    prev = F.lag("close").over(w)
    rows = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    return rows.withColumn(f"ATR_{n}", F.avg("tr").over(w.rowsBetween(-(n - 1), 0))).drop("tr")


def binned(price: Column, tick: float) -> Column:
    """Half-even rounding to the tick, as a number of ticks."""
    return F.rint(price / tick).cast("long")


def volume_bins(bars: DataFrame, keys: list[str], tick: float) -> DataFrame:
    rows = bars.where("volume > 0").withColumn("bin", binned(typical(), tick)).where("bin is not null")
    return rows.groupBy(*keys, "bin").agg(F.sum("volume").alias("v"))


def profiles(bars: DataFrame, keys: list[str], tick: float = DEFAULT.tick_size, share: float = 0.70) -> DataFrame:
    """POC, VAH and VAL by key.

    The POC is the bin of most volume, the lowest of equals. The value area grows
    from it by the larger neighbour, the lower of equals, until it holds the share.
    A key's bins, bounded by its price range in ticks, are folded in one array.
    """
    bins = volume_bins(bars, keys, tick).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "v"))).alias("b"), F.sum("v").alias("total"), F.max_by("bin", F.struct("v", -F.col("bin"))).alias("poc"))
    at = F.array_position(F.transform("b", lambda x: x["bin"]), F.col("poc")).cast("int") - 1
    bins = bins.withColumn("at", at)
    vol = lambda i: F.coalesce(F.get(F.col("b"), i)["v"], F.lit(-1.0))
    zero = F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"), vol(F.col("at")).alias("cum"))

    def step(s: Column, _: Column) -> Column:
        left, right = vol(s["lo"] - 1), vol(s["hi"] + 1)
        grown = F.when(right > left, F.struct(s["lo"].alias("lo"), (s["hi"] + 1).alias("hi"), (s["cum"] + right).alias("cum"))).otherwise(F.struct((s["lo"] - 1).alias("lo"), s["hi"].alias("hi"), (s["cum"] + left).alias("cum")))
        more = (s["cum"] < F.col("total") * share) & ((left >= 0) | (right >= 0))
        return F.when(more, grown).otherwise(s)

    area = F.aggregate(F.sequence(F.lit(1), F.size("b")), zero, step)
    out = bins.withColumn("area", area)
    price = lambda i: F.get(F.col("b"), i)["bin"] * tick
    return out.select(*keys, (F.col("poc") * tick).alias("POC"), price(F.col("area.hi")).alias("VAH"), price(F.col("area.lo")).alias("VAL"))


def prior_profiles(bars: DataFrame, period: str, tick: float = DEFAULT.tick_size, share: float = 0.70) -> DataFrame:
    key = PERIODS[period]
    keyed = bars.select("symbol", key).distinct().join(profiles(bars, ["symbol", key], tick, share), ["symbol", key], "left")
    return with_keyed(bars, shifted(keyed, key, {c: f"p{period}{c}" for c in ("VAH", "VAL", "POC")}), ["symbol", key])


def rolling_poc(bars: DataFrame, secs: int, name: str, tick: float = DEFAULT.tick_size) -> DataFrame:
    """POC over (t - window, t] for each bar: of the bins of most volume, the lowest.

    A bar puts its volume into its bin and takes it out one window later. Buckets of one
    window's length start with what the one before holds, so each is summed on its own.
    A bin's running sum holds from one change to the next; this span is cut into aligned
    blocks of 1, 2, 4, ... bars, two of a size at most, which keep the largest sum. A bar
    looks up the one block of each size that it lies in. Rows grow with the bars times
    the logarithm of a bucket's bars, and travel once. Volumes are summed as decimals of
    ten places, so that what goes in comes out exactly; those that are null, not finite
    or not above zero don't count.
    """
    size = secs * 1_000_000
    t = micros(F.col("ts"))
    start = t - F.pmod(t, F.lit(size))
    rows = bars.select("symbol", "ts", t.alias("t"), start.alias("start"), binned(typical(), tick).alias("bin"), F.col("volume").try_cast("decimal(28,10)").alias("v"))
    event = lambda bucket, at, b, v, ts: F.struct(bucket.alias("bucket"), at.alias("at"), b.cast("long").alias("bin"), v.cast("decimal(28,10)").alias("v"), ts.cast("timestamp_ntz").alias("ts"))
    none, own, later = F.lit(None), F.col("start"), F.col("start") + size
    seen = event(own, F.col("t"), none, F.lit(0), F.col("ts"))
    changes = [event(own, F.col("t"), F.col("bin"), F.col("v"), none), event(later, later, F.col("bin"), F.col("v"), none), event(later, F.col("t") + size, F.col("bin"), -F.col("v"), none)]
    counts = (F.col("v") > 0) & F.col("bin").isNotNull()
    rows = rows.select("symbol", F.explode(F.when(counts, F.array(seen, *changes)).otherwise(F.array(seen))).alias("e")).select("symbol", "e.*")
    # all that follows stays where this shuffle puts it
    rows = rows.repartition("symbol", "bucket")
    one = Window.partitionBy("symbol", "bucket")
    bar = F.count(F.when(F.col("bin").isNull(), 1))
    rows = rows.withColumns({"ord": bar.over(one.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)), "n": bar.over(one)}).where("n > 0")
    net = rows.groupBy("symbol", "bucket", "bin", "ord").agg(F.sum("v").alias("v"), F.first("n").alias("n"), F.first("ts").alias("ts"))
    by = Window.partitionBy("symbol", "bucket", "bin").orderBy("ord")
    spans = net.withColumns({"held": F.sum("v").over(by.rowsBetween(*RUN)), "to": F.coalesce(F.lead("ord").over(by), "n")}).where("bin is null or (held > 0 and to > ord)")
    around = F.expr("transform(sequence(0, length(bin(n)) - 1), k -> named_struct('k', k, 'node', shiftright(ord, k)))")
    sizes = "transform(sequence(0, length(bin(to - ord)) - 1), k -> named_struct('k', k, 'a', shiftright(ord + shiftleft(1L, k) - 1, k), 'b', shiftright(to, k)))"
    within = F.expr(f"flatten(transform(filter({sizes}, s -> s.a < s.b), s -> filter(array(IF(s.a % 2 = 1, named_struct('k', s.k, 'node', s.a), NULL), IF(s.b % 2 = 1, named_struct('k', s.k, 'node', s.b - 1), NULL)), x -> x IS NOT NULL)))")
    asks = F.col("bin").isNull()
    blocks = spans.select("symbol", "bucket", F.explode(F.when(asks, around).otherwise(within)).alias("x"), F.when(asks, F.col("ord")).alias("ord"), "ts", F.when(~asks, F.struct("held", (-F.col("bin")).alias("low"))).alias("top")).select("*", "x.*")
    most = blocks.withColumn("top", F.max("top").over(Window.partitionBy("symbol", "bucket", "k", "node"))).where("ord is not null")
    poc = most.groupBy("symbol", "bucket", "ord").agg(F.first("ts").alias("ts"), (-F.max("top")["low"] * tick).alias(name)).drop("bucket", "ord")
    return bars.join(poc, ["symbol", "ts"], "left")


def pivots(bars: DataFrame, secs: int, left: int = 2, right: int = 2, name: str = "Pivot", source: DataFrame | None = None) -> DataFrame:
    """The latest confirmed strict fractal high and low; one is known right+1 bars after its start.

    source: the bars of ``secs`` that are searched, if they aren't the bars themselves.
    """
    found = bars if source is None else source
    w = Window.partitionBy("symbol").orderBy("ts")
    out = bars
    for side, col, sign in (("High", "high", 1), ("Low", "low", -1)):
        ok = F.lit(True)
        for k in [*range(1, left + 1)]:
            ok = ok & F.coalesce(sign * F.col(col) > sign * F.lag(col, k).over(w), F.lit(False))
        for k in [*range(1, right + 1)]:
            ok = ok & F.coalesce(sign * F.col(col) > sign * F.lead(col, k).over(w), F.lit(False))
        label = f"{name}_{side}"
        events = found.withColumn("ok", ok).where("ok").select("symbol", (F.col("ts") + F.make_dt_interval(secs=F.lit((right + 1) * secs))).alias("known_at"), F.col(col).alias(label))
        out = asof_backward(out, events, ["symbol"], "ts", "known_at", [label])
    return out


def higher_pivots(bars: DataFrame, timeframe: str, left: int = 2, right: int = 2, inst: Instrument = DEFAULT) -> DataFrame:
    """Pivots of coarser candles, Pivot_{timeframe}_High and _Low, known right+1 candles after their start."""
    from tapewright.config import TIMEFRAMES

    coarse = resample(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), timeframe, inst)
    return pivots(bars, TIMEFRAMES[timeframe], left, right, f"Pivot_{timeframe}", coarse)


def _bracket_ticks(rth: DataFrame, tick: float) -> DataFrame:
    """The ticks that each half-hour bracket ``br`` of a regular session covers."""
    return rth.select("symbol", "session_date", "br", F.explode(F.sequence(binned(F.col("low"), tick), binned(F.col("high"), tick))).alias("k")).distinct()


def _regular(bars: DataFrame, inst: Instrument) -> DataFrame:
    return bars.where("session = 'RTH'").withColumn("br", F.floor((F.col("sod") - seconds(inst.rth_start)) / 1800))


def prior_single_prints(bars: DataFrame, tick: float = DEFAULT.tick_size, inst: Instrument = DEFAULT) -> DataFrame:
    """Nearest price above and below the close, on regular bars, that exactly one
    half-hour bracket of the previous regular session traded. Prices and closes of a
    session are sorted together, once upwards and once downwards, without a join of
    bars with prices."""
    rth = _regular(bars, inst)
    lone = _bracket_ticks(rth, tick).groupBy("symbol", "session_date", "k").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    dates = rth.select("symbol", "session_date").distinct().withColumn("next_date", F.lead("session_date").over(Window.partitionBy("symbol").orderBy("session_date")))
    prints = lone.join(dates, ["symbol", "session_date"]).where("next_date is not null").select("symbol", F.col("next_date").alias("session_date"), (F.col("k") * tick).alias("price"))
    near = _nearest(prints, rth, ["session_date"], "pSinglePrint_30m")
    return bars.join(near, ["symbol", "ts"], "left")


def _nearest(prints: DataFrame, asked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """By (symbol, ts) of ``asked``: the nearest price of ``prints`` above and below the
    close, within the keys. Prices and closes are sorted together, once upwards and once
    downwards; at equal prices closes come first, so that only lower (or higher) prices
    precede them."""
    both = prints.withColumn("ts", F.lit(None).cast(asked.schema["ts"].dataType)).select("symbol", *keys, "ts", "price").unionByName(asked.select("symbol", *keys, "ts", F.col("close").alias("price")))
    ways = {f"{name}_NearestAbove": F.desc("price"), f"{name}_NearestBelow": F.asc("price")}
    last = lambda way: F.last(F.when(F.col("ts").isNull(), F.col("price")), ignorenulls=True).over(Window.partitionBy("symbol", *keys).orderBy(way, F.col("ts").isNull()).rowsBetween(*RUN))
    return both.withColumns({c: last(way) for c, way in ways.items()}).where("ts is not null").select("symbol", "ts", *ways)


def single_prints(bars: DataFrame, tick: float = DEFAULT.tick_size, inst: Instrument = DEFAULT) -> DataFrame:
    """Nearest price above and below the close that exactly one completed 30-minute
    regular bracket of the session has traded. A tick stays single from its first
    bracket's end to its second's; it stands once in each bracket of that time, a dozen
    at most, where it is sorted with the closes."""
    rth = _regular(bars, inst)
    ticks = _bracket_ticks(rth, tick)
    first = Window.partitionBy("symbol", "session_date", "k").orderBy("br")
    life = ticks.withColumns({"n": F.row_number().over(first), "until": F.lead("br").over(first)}).where("n = 1")
    last = F.lit((seconds(inst.rth_end) - seconds(inst.rth_start) - 1) // 1800)
    life = life.withColumn("until", F.least(F.coalesce("until", last), last)).where("br < until")
    prints = life.select("symbol", "session_date", F.explode(F.sequence(F.col("br") + 1, F.col("until"))).alias("br"), (F.col("k") * tick).alias("price"))
    return bars.join(_nearest(prints, rth, ["session_date", "br"], "dSinglePrint_30m"), ["symbol", "ts"], "left")


def apoc(bars: DataFrame, tick: float = DEFAULT.tick_size, inst: Instrument = DEFAULT) -> DataFrame:
    """APOC: POC of the first half hour of the regular session, on regular bars from
    its end on; pAPOC: that of the previous session with regular bars, on all regular bars."""
    rth = F.col("session") == "RTH"
    start = seconds(inst.rth_start)
    early = bars.where(rth & (F.col("sod") < start + 1800))
    keyed = bars.where(rth).select("symbol", "session_date").distinct().join(profiles(early, ["symbol", "session_date"], tick).select("symbol", "session_date", F.col("POC").alias("a")), ["symbol", "session_date"], "left")
    keyed = keyed.withColumn("p", F.lag("a").over(Window.partitionBy("symbol").orderBy("session_date")))
    out = bars.join(keyed, ["symbol", "session_date"], "left")
    return out.withColumns({"APOC": F.when(rth & (F.col("sod") >= start + 1800), F.col("a")), "pAPOC": F.when(rth, F.col("p"))}).drop("a", "p")


def bracket_vwaps(bars: DataFrame, validity: int = 4, inst: Instrument = DEFAULT) -> DataFrame:
    """prev30mVWAP[_k]: VWAPs of the last completed half-hour brackets, newest first.

    A bracket's value holds for ``validity`` brackets. At a new session, values still
    valid after the last freeze of the one before are numbered -1, -2, ... backwards.
    """
    if not 1 <= validity <= 48:
        raise ValueError("validity must be between 1 and 48 brackets")
    rows = session_brackets(bars, inst)
    frozen = rows.groupBy("symbol", "session_date", "bracket").agg(F.sum(typical() * F.col("volume")).alias("pv"), F.sum("volume").alias("v")).where("v > 0 and bracket is not null").select("symbol", "session_date", F.col("bracket").alias("formed"), (F.col("pv") / F.col("v")).alias("value"))
    sessions = rows.select("symbol", "session_date").distinct().withColumn("next_date", F.lead("session_date").over(Window.partitionBy("symbol").orderBy("session_date")))
    last = Window.partitionBy("symbol", "session_date")
    seeds = frozen.withColumn("last", F.max("formed").over(last)).where(F.col("last") + 1 <= F.col("formed") + validity)
    seeds = seeds.withColumn("formed", -F.row_number().over(last.orderBy(F.desc("formed")))).join(sessions, ["symbol", "session_date"]).where("next_date is not null")
    pool = frozen.union(seeds.select("symbol", F.col("next_date").alias("session_date"), "formed", "value"))
    asked = rows.where("bracket is not null").select("symbol", "session_date", "bracket").distinct()
    met = asked.join(pool.withColumn("bracket", F.explode(F.sequence(F.col("formed") + 1, F.col("formed") + validity))), ["symbol", "session_date", "bracket"])
    held = met.groupBy("symbol", "session_date", "bracket").agg(F.reverse(F.sort_array(F.collect_list(F.struct("formed", "value")))).alias("h"))
    names = ["prev30mVWAP", *[f"prev30mVWAP_{k}" for k in range(2, validity + 1)]]
    held = held.select("symbol", "session_date", "bracket", *[F.get("h", F.lit(i))["value"].alias(n) for i, n in enumerate(names)])
    return rows.join(held, ["symbol", "session_date", "bracket"], "left")


def bracket_hits(bars: DataFrame, base_s: int, minutes: int = 5) -> DataFrame:
    """Whether the bracket's level was touched in its first minutes: null until they are over."""
    if minutes * 60 % base_s:
        return bars.withColumn(f"prev30mVWAP_hit_m{minutes}", F.lit(None).cast("double"))
    w = Window.partitionBy("symbol", "session_date", "bracket")
    level = F.first("prev30mVWAP").over(w.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    into = F.pmod(F.col("sod"), F.lit(1800))
    touch = (F.col("low") <= level) & (level <= F.col("high")) & (into < minutes * 60)
    hit = F.max(touch.cast("double")).over(w)
    return bars.withColumn(f"prev30mVWAP_hit_m{minutes}", F.when(level.isNotNull() & (into + base_s >= minutes * 60), hit))


def naked(bars: DataFrame, level: str, tolerance: float = 0.0) -> DataFrame:
    """{level}_naked: from a level's formation (its first or a new value) until a later bar touches it."""
    w = Window.partitionBy("symbol").orderBy("ts")
    value = F.col(f"`{level}`")
    rows = bars.withColumn("formed", value.isNotNull() & F.coalesce(value != F.lag(value).over(w), F.lit(True)))
    rows = rows.withColumn("life", F.sum((F.col("formed") | value.isNull()).cast("int")).over(w.rowsBetween(*RUN)))
    touched = (~F.col("formed")) & (F.col("low") <= value + tolerance) & (F.col("high") >= value - tolerance)
    gone = F.max(F.coalesce(touched, F.lit(False)).cast("int")).over(Window.partitionBy("symbol", "life").orderBy("ts").rowsBetween(*RUN))
    return rows.withColumn(f"{level}_naked", value.isNotNull() & (gone == 0)).drop("formed", "life")


__all__ = ["apoc", "atr", "bracket_vwaps", "floored", "indexed", "naked", "pivots", "profiles"]
