"""Streams with keyed state against the batch operators, late bars and restarts included."""

import datetime as dt
import random

import pytest

from tapewright.operators import levels as L
from tapewright.operators import simulate as S
from tapewright.streaming.state import stream_naked, stream_trades

T0 = dt.datetime(2026, 1, 5, 14, 30)
MINUTE = dt.timedelta(minutes=1)
KINDS = "symbol string, bar_index int, ts timestamp, open double, high double, low double, close double, lvl double"


def made(symbol, n, seed):
    r, out, p = random.Random(seed), [], 100.0
    for i in range(n):
        o, p = p, p + r.choice([-1, -0.5, 0, 0.5, 1])
        out.append((symbol, i, T0 + i * MINUTE, o, max(o, p) + r.choice([0, 0.25]), min(o, p) - r.choice([0, 0.25]), p, r.choice([None, 98.0, 101.0]) if i % 9 == 0 else out[-1][-1]))
    return out


def run(stream, path, name):
    """Append all that is there to a folder, from the last checkpoint on."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert not q.isActive and q.exception() is None


@pytest.fixture(scope="module")
def tape(spark, tmp_path_factory):
    """Bars in two parts that overlap in time: the second holds bars that come late."""
    path = str(tmp_path_factory.mktemp("tape"))
    rows = made("a", 120, 1) + made("b", 120, 2)
    late = [r for r in rows if 60 <= r[1] < 66 and r[1] % 2]
    first = [r for r in rows if r[1] < 66 and r not in late]
    # a bar long after ends the tape: the watermark passes all others
    end = [("z", 0, T0 + dt.timedelta(days=1), 1.0, 1.0, 1.0, 1.0, None)]
    parts = [first, late + [r for r in rows if r[1] >= 66], end]
    for i, part in enumerate(parts):
        random.Random(i).shuffle(part)
    return path, rows, parts


def steps(spark, tape, stream, name, extra=None):
    """Run the query anew for each part; each time it goes on from its checkpoint."""
    path, _, parts = tape
    src = f"{path}/{name}-in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, KINDS).write.mode("append").parquet(src)
        if extra:
            extra(i)
        run(stream(spark.readStream.schema(KINDS).parquet(src)), path, name)
        if i == 0:
            assert spark.read.parquet(f"{path}/{name}").count() > 0  # bars come out before the end
    return spark.read.parquet(f"{path}/{name}")


def test_naked_stream_equals_batch(spark, tape):
    out = steps(spark, tape, lambda b: stream_naked(b, "lvl", 0.25), "naked")
    got = sorted((r.symbol, r.ts, r.lvl, r.lvl_naked) for r in out.collect() if r.symbol != "z")
    batch = L.naked(spark.createDataFrame(tape[1], KINDS), "lvl", 0.25)
    want = sorted((r.symbol, r.ts, r.lvl, r.lvl_naked) for r in batch.collect())
    assert got == want and {x[3] for x in got} == {True, False}


@pytest.mark.parametrize("options", [{"breakeven_r": 0.5, "trail_r": 1.0, "trail_ticks": 3}, {"trail_r": 0.5, "trail_ticks": 6, "max_bars": 9}, {}])
def test_trade_stream_equals_batch(spark, tape, options):
    path, rows, _ = tape
    name = "trades_" + "_".join(options)
    kinds = "symbol string, bar_index int, ts timestamp, signal_id long, direction string"
    signals = [(s, i, T0 + i * MINUTE, k, d) for s in ("a", "b") for k, (i, d) in enumerate((i, d) for i in range(2, 110, 7) for d in ("long", "short"))]
    given = [[x for x in signals if x[1] < 62], [x for x in signals if x[1] >= 62], []]
    settings = {"stop_ticks": 6, "target_ticks": 12, "tick": 0.25} | options

    def extra(i):
        spark.createDataFrame(given[i], kinds).write.mode("append").parquet(f"{path}/{name}-signals")

    out = steps(spark, tape, lambda b: stream_trades(b, spark.readStream.schema(kinds).parquet(f"{path}/{name}-signals"), **settings), name, extra)
    what = lambda r: (r.symbol, r.signal_id, r.entry_ts, r.exit_ts, round(r.exit_price, 6), r.exit_reason, r.bars_held, round(r.r_multiple, 6), round(r.mae_points, 6), round(r.mfe_points, 6))
    got = sorted(what(r) for r in out.collect())
    batch = S.simulate(spark.createDataFrame(rows, KINDS).selectExpr("* except (ts)", "cast(ts as timestamp_ntz) as ts"), spark.createDataFrame(signals, kinds).drop("ts"), **settings)
    want = sorted(what(r) for r in batch.collect() if r.exit_reason != "DATA_END")
    assert got == want and {x[5] for x in got} >= ({"TRAIL", "TIME"} if "max_bars" in options else {"BE", "TRAIL"} if options else {"SL", "TP"})
