"""The first bar at which a fixed bracket is hit, by an index of blocks of bars.

Each level of the index groups ``FAN`` units of the level below (bars, at the bottom)
in one row, with the low and the high of each. A candidate looks through the rest of
its group; if nothing there is hit it goes on with the next group one level up, and
once a unit is hit, or holds the candidate's last bar, it opens this unit level by
level. So a candidate meets two rows a level, however long it lives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_BITS = 6
FAN = 1 << FAN_BITS


def levels_for(last_bar: int) -> int:
    """How many levels bring all bars into one group."""
    n = 1
    while last_bar >> (FAN_BITS * n):
        n += 1
    return n


def block_index(bars: DataFrame, n_levels: int) -> list[DataFrame]:
    """By level: (symbol, g, units), units in order, each with its number u, low and high; those of level 0 are the bars."""
    unit = F.struct(F.col("bar_index").alias("u"), "low", "high", "open", "close", "ts")
    out = [bars.groupBy("symbol", F.shiftright("bar_index", FAN_BITS).alias("g")).agg(F.array_sort(F.collect_list(unit)).alias("units"))]
    for _ in range(1, n_levels):
        one = F.struct(F.col("g").alias("u"), F.array_min(F.transform("units", lambda x: x["low"])).alias("low"), F.array_max(F.transform("units", lambda x: x["high"])).alias("high"))
        out.append(out[-1].select("symbol", F.shiftright("g", FAN_BITS).alias("g"), one.alias("unit")).groupBy("symbol", "g").agg(F.array_sort(F.collect_list("unit")).alias("units")))
    return out


def first_hits(cand: DataFrame, bars: DataFrame, last_bar: int) -> DataFrame:
    """Candidates with ``bar``, the first bar from ``pos`` to ``cap`` whose range reaches
    ``stop`` or ``target``, or else the bar ``cap``, and with the lowest low and highest
    high up to it (``lo``, ``hi``).

    cand: symbol, sign, stop, target, pos <= cap, and ``lo`` and ``hi`` of bars before
    pos, if any; ``settled`` candidates pass as they are. Bars are numbered without gaps.
    """
    index = block_index(bars, levels_for(last_bar))
    # level: of the unit reached, -1 before; u: its number
    rows = cand.withColumns({"level": F.lit(-1), "u": F.lit(-1), "bar": F.lit(None).cast(index[0].schema["units"].dataType.elementType)})
    aside = -1 - F.pmod(F.xxhash64("symbol", "pos", "cap", "stop"), F.lit(4096)).cast("int")  # a group that isn't there, so that rows without a question stay dealt out

    def look(rows: DataFrame, k: int, asks: Column, group: Column, start: Column) -> DataFrame:
        """Goes through units of one group of level k from ``start`` on to the first that is hit or holds the last bar."""
        last = F.shiftright("cap", FAN_BITS * k)
        side = index[k].select(F.col("symbol").alias("__s"), F.col("g").alias("__g"), "units")
        met = rows.withColumns({"__ask": asks, "__key": F.when(asks, group).otherwise(aside), "__from": start})
        met = met.join(side, (F.col("symbol") == F.col("__s")) & (F.col("__key") == F.col("__g")), "left")
        reach = lambda x: F.when(F.col("sign") > 0, (x["low"] <= F.col("stop")) | (x["high"] >= F.col("target"))).otherwise((x["high"] >= F.col("stop")) | (x["low"] <= F.col("target")))
        met = met.withColumn("__hit", F.get(F.filter("units", lambda x: (x["u"] >= F.col("__from")) & (reach(x) | (x["u"] >= last))), F.lit(0)))
        found = F.col("__ask") & F.col("__hit").isNotNull()
        # what lies before the unit found counts whole; so does the unit itself, if it is a bar
        upto = F.col("__hit.u") + (1 if k == 0 else 0)
        passed = F.filter("units", lambda x: (x["u"] >= F.col("__from")) & (F.col("__hit").isNull() | (x["u"] < upto)))
        met = met.withColumn("__passed", F.when(F.col("__ask"), passed))
        met = met.withColumns({
            "lo": F.least("lo", F.array_min(F.transform("__passed", lambda x: x["low"]))), "hi": F.greatest("hi", F.array_max(F.transform("__passed", lambda x: x["high"]))),
            "level": F.when(found, k).otherwise(F.col("level")), "u": F.when(found, F.col("__hit.u")).otherwise(F.col("u")),
            "pos": F.when(F.col("__ask") & ~found, F.shiftright("pos", FAN_BITS) + 1).otherwise(F.col("pos")),
        })
        if k == 0:
            met = met.withColumn("bar", F.when(found, F.col("__hit")).otherwise(F.col("bar")))
        return met.select(*rows.columns)

    for k in range(len(index)):  # up, until a unit is found
        rows = look(rows, k, ~F.col("settled") & (F.col("level") < 0), F.shiftright("pos", FAN_BITS), F.col("pos"))
    for k in range(len(index) - 2, -1, -1):  # down, into the unit found
        rows = look(rows, k, ~F.col("settled") & (F.col("level") == k + 1), F.col("u"), F.lit(0))
    return rows.drop("level", "u", "pos")
