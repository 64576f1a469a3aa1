"""Sources and sinks: vendor CSV profiles, Parquet tables, bundles, hashes, exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.config import DEFAULT

#: Header names that stand for canonical ones.
ALIASES = {"date time": "timestamp", "datetime": "timestamp", "time stamp": "timestamp", "last": "close", "vol": "volume", "total volume": "volume"}
CANONICAL = ("timestamp", "open", "high", "low", "close", "volume")
#: Timestamp forms in the order in which they are tried; day-first with dots.
PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "M/d/yyyy HH:mm:ss", "M/d/yyyy H:mm", "yyyyMMdd HHmmss")
BUNDLE_TABLES = ("bars", "levels", "zones", "signals", "trades", "skipped", "grid", "folds")


def normal_name(name: str) -> str:
    name = " ".join(name.replace("﻿", "").replace(" ", " ").strip().lower().split())
    return ALIASES.get(name, name)


def renamed(df: DataFrame) -> DataFrame:
    names = [normal_name(c) for c in df.columns]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"columns occur twice after renaming: {sorted(twice)}")
    return df.toDF(*names)


def parsed(text: Column) -> Column:
    """A naive timestamp by the first pattern that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in PATTERNS])


def to_utc(local: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local)


def clock_faults(df: DataFrame, column: str, tz: str) -> DataFrame:
    """Rows whose local time doesn't exist or occurs twice in the zone."""
    local = F.col(column)
    back = lambda utc: F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    utc = to_utc(local, tz)
    hour = F.make_dt_interval(hours=F.lit(1))
    fault = F.when(back(utc) != local, "nonexistent").when((back(utc + hour) == local) | (back(utc - hour) == local), "ambiguous")
    return df.withColumn("clock_fault", fault).where("clock_fault is not null")


def _text(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.csv(path, inferSchema=False, **options)


def _bars(df: DataFrame, symbol: str, tz: str) -> DataFrame:
    df = renamed(df)
    missing = [c for c in CANONICAL if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = df.select(F.lit(symbol).alias("symbol"), parsed(F.col("timestamp")).alias("local"), *[F.col(c).try_cast("double").alias(c) for c in CANONICAL[1:]])
    return out.withColumn("ts", to_utc(F.col("local"), tz)).drop("local")


def _ticks(df: DataFrame, symbol: str, ts: Column, price: Column, volume: Column) -> DataFrame:
    rows = df.select(F.lit(symbol).alias("symbol"), ts.alias("ts"), price.alias("price"), volume.alias("volume"))
    return rows.withColumn("tick_id", F.monotonically_increasing_id())


def read_bars(spark: SparkSession, path: str, symbol: str, profile: str = "canonical", tz: str = DEFAULT.exchange_tz) -> DataFrame:
    """Bars of a CSV in one of the profiles; tick profiles become one-minute bars.

    Times without a zone are in ``tz``. Values that aren't numbers become null.
    """
    from tapewright.operators.bars import bars_from_ticks

    if profile == "canonical":
        return _bars(_text(spark, path, header=True), symbol, tz)
    if profile == "quantower_history_exporter":
        return _bars(_text(spark, path, header=True, sep=";"), symbol, tz)
    if profile == "sierra_intraday":
        df = renamed(_text(spark, path, header=True, ignoreLeadingWhiteSpace=True))
        return _bars(df.withColumn("timestamp", F.concat_ws(" ", "date", "time")).drop("date", "time"), symbol, tz)
    if profile == "ninjatrader":
        df = _text(spark, path, sep=";")
        stamp = F.try_to_timestamp(F.col("_c0"), F.lit("yyyyMMdd HHmmss")).cast("timestamp_ntz")
        if len(df.columns) == 6:
            return df.select(F.lit(symbol).alias("symbol"), to_utc(stamp, tz).alias("ts"), *[F.col(f"_c{i + 1}").try_cast("double").alias(c) for i, c in enumerate(CANONICAL[1:])])
        return bars_from_ticks(_ticks(df, symbol, to_utc(stamp, tz), F.col("_c1").try_cast("double"), F.col(df.columns[-1]).try_cast("double")))
    if profile == "databento_trades":
        df = renamed(_text(spark, path, header=True)).where("upper(action) = 'T'")
        price = F.col("price").try_cast("double")
        scaled = F.when(F.abs(price) >= 1e7, price / 1e9).otherwise(price)
        ts = F.timestamp_micros(F.floor(F.col("ts_event").cast("decimal(20,0)") / 1000).cast("long")).cast("timestamp_ntz")
        return bars_from_ticks(_ticks(df, symbol, ts, scaled, F.col("size").try_cast("double")))
    if profile in ("tick_capture", "second_capture"):
        df = renamed(_text(spark, path, header=True))
        return bars_from_ticks(_ticks(df, symbol, to_utc(parsed(F.col("timestamp")), tz), F.col("price").try_cast("double"), F.col("volume").try_cast("double")))
    raise ValueError(f"no such profile: {profile}")


def write_table(df: DataFrame, path: str) -> None:
    """Parquet by symbol, so that readers of a symbol skip the others."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("symbol") if "symbol" in df.columns else writer).parquet(path)


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that doesn't depend on their order or partitions. A null
    counts in its place: the hash of values alone would skip it."""
    row = F.xxhash64(*[x for c in sorted(df.columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))])
    got = df.select(row.cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{got['n']}-{(got['s'] or 0)}"


def write_bundle(tables: dict[str, DataFrame], path: str, settings: dict) -> None:
    """A folder of Parquet members and their settings as JSON."""
    unknown = set(tables) - set(BUNDLE_TABLES)
    if unknown:
        raise ValueError(f"not members of a bundle: {sorted(unknown)}")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = [(json.dumps({"settings": settings, "members": {n: content_hash(df) for n, df in tables.items()}}, sort_keys=True),)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def read_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """A bundle's tables, checked against their hashes, and its settings."""
    head = json.loads(spark.read.text(f"{path}/settings").first()[0])
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in head["members"]}
    changed = [n for n, df in tables.items() if content_hash(df) != head["members"][n]]
    if changed:
        raise ValueError(f"members differ from their hashes: {changed}")
    return tables, head["settings"]


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
