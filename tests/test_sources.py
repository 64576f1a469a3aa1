"""Vendor files, bundles, the stream and whole experiments."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.operators import bars as B
from tapewright.operators import levels as L
from tapewright.plans.experiment import Setup, run_batch
from tapewright.sources import files
from tapewright.streaming.bars import stream_bars


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path}/{name}"


@pytest.mark.parametrize("profile,text", [
    ("canonical", "Date Time,Open,High,Low,Last,Volume\n2026-01-05 09:30:00,1,3,0.5,2,10\n05.01.2026 09:31:00,2,2,x,2,5\n"),
    ("quantower_history_exporter", "DateTime;Open;High;Low;Close;Volume\n2026-01-05 09:30:00;1;3;0.5;2;10\n2026-01-05 09:31:00;2;2;x;2;5\n"),
    ("sierra_intraday", "Date, Time, Open, High, Low, Last, Volume\n2026-01-05, 09:30:00, 1, 3, 0.5, 2, 10\n2026-01-05, 09:31:00, 2, 2, x, 2, 5\n"),
    ("ninjatrader", "20260105 093000;1;3;0.5;2;10\n20260105 093100;2;2;x;2;5\n"),
])
def test_bar_profiles(spark, tmp_path, profile, text):
    rows = files.read_bars(spark, write(tmp_path, "b.csv", text), "ES", profile).orderBy("ts").collect()
    assert [(r.ts, r.open, r.high, r.low, r.close, r.volume) for r in rows] == [(dt.datetime(2026, 1, 5, 14, 30), 1, 3, 0.5, 2, 10), (dt.datetime(2026, 1, 5, 14, 31), 2, 2, None, 2, 5)]


@pytest.mark.parametrize("profile,text", [
    ("tick_capture", "timestamp,price,volume\n2026-01-05 09:30:01,1,1\n2026-01-05 09:30:02,3,2\n2026-01-05 09:30:59,2,1\n"),
    ("databento_trades", "ts_event,action,price,size\n1767623401000000000,T,1000000000,1\n1767623402000000000,t,3,2\n1767623402500000000,A,9,9\n1767623459000000000,T,2000000000,1\n"),
])
def test_tick_profiles(spark, tmp_path, profile, text):
    (r,) = files.read_bars(spark, write(tmp_path, "t.csv", text), "ES", profile).collect()
    assert (r.ts, r.open, r.high, r.low, r.close, r.volume) == (dt.datetime(2026, 1, 5, 14, 30), 1, 3, 1, 2, 4)


def test_bad_files(spark, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        files.read_bars(spark, write(tmp_path, "m.csv", "timestamp,open\n1,2\n"), "ES")
    with pytest.raises(ValueError, match="twice"):
        files.read_bars(spark, write(tmp_path, "d.csv", "timestamp,last,close,open,high,low,volume\n1,2,3,4,5,6,7\n"), "ES")
    df = spark.createDataFrame([(dt.datetime(2026, 3, 8, 2, 30),), (dt.datetime(2026, 11, 1, 1, 30),), (dt.datetime(2026, 6, 1, 1, 0),)], "t timestamp_ntz")
    assert sorted(r.clock_fault for r in files.clock_faults(df, "t", "America/New_York").collect()) == ["ambiguous", "nonexistent"]


def test_bundle_round_trip(spark, tmp_path):
    bars = spark.createDataFrame([("a", 1, 2.0), ("b", 2, None)], "symbol string, bar_index int, close double")
    files.write_bundle({"bars": bars}, f"file://{tmp_path}/b", {"x": 1})
    tables, settings = files.read_bundle(spark, f"file://{tmp_path}/b")
    assert settings == {"x": 1} and sorted(tables["bars"].collect()) == sorted(bars.collect())
    assert files.content_hash(bars) == files.content_hash(bars.repartition(3)) != files.content_hash(bars.limit(1))
    bars.limit(1).write.mode("overwrite").parquet(f"file://{tmp_path}/b/bars")
    with pytest.raises(ValueError, match="hashes"):
        files.read_bundle(spark, f"file://{tmp_path}/b")


def test_stream_equals_batch(spark, tmp_path):
    ticks = spark.createDataFrame([("a", dt.datetime(2026, 1, 5, 14, 30) + dt.timedelta(seconds=7 * i), i, float(i % 5), 1.0) for i in range(100)], "symbol string, ts timestamp, tick_id long, price double, volume double")
    ticks.write.parquet(f"{tmp_path}/in")
    q = stream_bars(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("made").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.ts, r.open, r.high, r.low, r.close, r.volume) for r in spark.table("made").collect())
    want = sorted((r.ts, r.open, r.high, r.low, r.close, r.volume) for r in B.bars_from_ticks(ticks.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect())
    assert got == want


def test_level_frame_equals_its_families(spark):
    ticks = B.ticks_of(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    b = B.indexed(B.sessionised(B.bars_from_ticks(ticks, 1800)))
    got = L.level_frame(b)
    assert got._jdf.queryExecution().analyzed().collectLeaves().size() <= 10
    want = L.session_levels(L.current_opens(b))
    for p in L.PERIODS:
        want = L.prior_period(want, p)
        want = want.checkpoint()
    want = L.opening_range(L.clock_window(L.clock_window(want, "Asia", "20:00", "00:00"), "London", "02:00", "05:00"))
    assert set(got.columns) == set(want.columns)
    key = ["symbol", "bar_index"]
    cols = sorted(set(got.columns) - set(key))
    assert got.select(*key, *cols).sort(*key).collect() == want.select(*key, *cols).sort(*key).collect()
    assert got.select("pmHigh", "pwEQ", "AsiaHigh", "OR_Low", "ONH").dropna().count() >= 0 and got.where("pwHigh is not null and AsiaHigh is not null").count()


def test_experiments(spark):
    ticks = B.ticks_of(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    bars = B.bars_from_ticks(ticks, 1800)
    one = Setup("touch", ("pdHigh", "pdLow", "dOpen", "pdEQ"), tolerance=30.0, options={"stop_ticks": 200, "target_ticks": 400, "max_bars": 20})
    two = Setup("three", ("pdHigh",), trigger="3c", anchor="pdHigh", rules=(("pdEQ", 800, False),), options={"stop_ticks": 200, "target_ticks": 400, "max_bars": 20})
    assert {r.run_name for r in run_batch(bars, [one, two]).collect()} >= {"touch"}
    for wrong in ({"trigger": "x"}, {"max_confluences": 9}, {"levels": ()}):
        with pytest.raises(ValueError):
            Setup(**({"name": "n", "levels": ("dOpen",)} | wrong))


def test_content_hash_sees_nulls_in_their_place(spark):
    a = spark.createDataFrame([(None, "a")], "x string, y string")
    b = spark.createDataFrame([("a", None)], "x string, y string")
    assert files.content_hash(a) != files.content_hash(b)
