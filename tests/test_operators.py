"""Operators against hand-made cases and sequential versions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tapewright.config import format_interval, parse_interval
from tapewright.operators import bars as B
from tapewright.operators import levels as L
from tapewright.operators import simulate as S
from tapewright.operators import zones as Z
from tapewright.operators.admission import admissions
from tapewright.operators.firsthit import first_hits, levels_for
from tapewright.operators.joins import asof_backward, range_join
from tapewright.plans import diagnostics as D
from tapewright.plans import metrics as M
from tapewright.plans import research as R
from tapewright.plans import study as ST

T0 = dt.datetime(2026, 1, 5, 14, 30)


def frame(spark, rows, minutes=1):
    data = [("NQ", i, T0 + dt.timedelta(minutes=minutes * i), *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, bar_index int, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def walk(n, seed):
    r = random.Random(seed)
    out, p = [], 100.0
    for _ in range(n):
        o = p
        p = p + r.choice([-1, -0.5, 0, 0.5, 1])
        out.append((o, max(o, p) + r.choice([0, 0.25, 0.5]), min(o, p) - r.choice([0, 0.25, 0.5]), p, r.randint(0, 5)))
    return out


def test_golden_trades(spark):
    """Three sessions of six bars; a stopped long, a stopped short and a long at its target each."""
    deltas = [(0, 0.5, -0.5, 0.25), (0, 5, -3, 1), (1, 1.5, 0.5, 1.25), (1, 4, -5, 0), (0, 0.5, -0.5, 0.25), (0, 5, -1, 4)]
    data, signals = [], []
    for s in range(3):
        for b, d in enumerate(deltas):
            base = 21000 + 10 * s
            data.append(("NQ", 6 * s + b, T0 + dt.timedelta(days=s, minutes=b), *[float(base + x) for x in d], 1000.0 + 100 * s + b))
        signals += [("NQ", 3 * s + k + 1, 6 * s + 2 * k, way) for k, way in enumerate(("long", "short", "long"))]
    bars = spark.createDataFrame(data, "symbol string, bar_index int, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    sig = spark.createDataFrame(signals, "symbol string, signal_id long, bar_index int, direction string")
    got = S.simulate(bars, sig, stop_ticks=8, target_ticks=16, tick=0.25, point_value=20.0).orderBy("signal_id").collect()
    want = [("SL", -1.0, 3.0, 5.0), ("SL", -1.0, 3.0, 6.0), ("TP", 2.0, 1.0, 5.0)] * 3
    assert [(r.exit_reason, r.r_multiple, r.mae_points, r.mfe_points) for r in got] == want
    assert all(r.bars_held == 1 for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_cluster_zones_match_the_greedy_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, *[None if r.random() < 0.2 else float(r.randint(0, 12)) for _ in range(7)]) for i in range(120)]
    names = [f"l{k}" for k in range(7)]
    df = spark.createDataFrame(rows, "bar_index int, " + ", ".join(f"{n} double" for n in names)).withColumns({"symbol": F.lit("x"), "ts": F.lit(None).cast("timestamp_ntz")})
    got = {(z.bar_index, z.zone_seq): (z.zone_low, z.zone_high, tuple(z.level_names)) for z in Z.cluster_zones(df, names, 2.0, 2, 3).collect()}
    want = {}
    for i, *v in rows:
        p = sorted((x, k) for k, x in enumerate(v) if x is not None)
        j = seq = 0
        while j < len(p):
            near = [q for q in p[j:] if q[0] - p[j][0] <= 2.0]
            if len(near) >= 2:
                held = near[:3]
                want[i, seq] = (held[0][0], held[-1][0], tuple(names[k] for _, k in held))
                seq += 1
                j += len(near)
            else:
                j += 1
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_exit_management_matches_the_bar_loop(spark, seed):
    rows = walk(200, seed)
    bars = frame(spark, rows)
    sig = spark.createDataFrame([("NQ", i, i * 7, "long" if i % 2 else "short") for i in range(25)], "symbol string, signal_id long, bar_index int, direction string")
    got = {t.signal_id: (t.exit_bar_index, round(t.exit_price, 6)) for t in S.simulate(bars, sig, stop_ticks=8, target_ticks=20, max_bars=40, breakeven_r=0.5, trail_r=1.0, trail_ticks=4).collect()}
    for i in range(25):
        entry = i * 7 + 1
        long, fill = i % 2 == 1, rows[entry][0]
        sign = 1 if long else -1
        stop, target, best, be, out = fill - sign * 2, fill + sign * 5, 0.0, False, None
        for b in range(entry, min(len(rows) - 1, entry + 39) + 1):
            _, h, lo, c, _ = rows[b]
            if (lo <= stop) if long else (h >= stop):
                out = (b, round(stop, 6))
                break
            if (h >= target) if long else (lo <= target):
                out = (b, round(target, 6))
                break
            best = max(best, (h - fill) if long else (fill - lo))
            if best >= 1.0:
                be = True
            level = -2.0
            if be:
                level = max(level, 0.0)
            if best >= 2.0:
                level = max(level, best - 1.0)
            stop = fill + sign * max(level, (stop - fill) * sign)
            out = (b, round(c, 6))
        assert got[i] == out


def test_three_candle_matches_the_sequential_search(spark):
    rows = walk(300, 11)
    bars = frame(spark, rows)
    levels = [("NQ", i, "m", float(round(rows[i][2] * 4) / 4)) for i in range(0, 290)]
    got = {(r.arrival_bar_index, r.direction, r.level_price): (r.reversal_bar_index, r.entry_bar_index, r.variant) for r in Z.three_candle(bars, spark.createDataFrame(levels, "symbol string, bar_index int, source_mode string, level_price double"), look=4).collect()}
    want, until, arrival = {}, {}, {}
    for _, i, _, price in levels:
        _, h1, l1, c1, _ = rows[i]
        for way in ("long", "short"):
            key = (price, way)
            if key in until and i <= until[key] and i != arrival[key]:
                continue
            if not ((l1 <= price and c1 > price) if way == "long" else (h1 >= price and c1 < price)):
                continue
            j = i + 1
            while j < len(rows) and rows[j][1] <= h1 and rows[j][2] >= l1:
                j += 1
            if j == len(rows):
                continue
            _, h, lo, c, _ = rows[j]
            ok = c > h1 if way == "long" else c < l1
            end, fill = j, None
            if ok:
                trig = c - 0.25 if way == "long" else c + 0.25
                end = min(len(rows) - 1, j + 5)
                for k in range(j + 1, end + 1):
                    if (rows[k][2] <= trig) if way == "long" else (rows[k][1] >= trig):
                        fill = end = k
                        break
                sfp = lo < l1 if way == "long" else h > h1
                want[i, way, price] = (j, fill, "3c" + ("_sfp" if sfp else "") + f"_{way}" + ("_muted" if j > i + 1 else ""))
            if key not in until or end >= until[key]:
                until[key], arrival[key] = end, i
    assert got == want


def test_three_candle_on_trigger_bars_matches_the_sequential_search(spark):
    rows, size, wait = walk(400, 5), 4, 2
    start = dt.datetime(2024, 1, 1)
    data = [("NQ", start + dt.timedelta(minutes=i), i, *map(float, r)) for i, r in enumerate(rows)]
    bars = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, bar_index int, open double, high double, low double, close double, volume double")
    coarse = [(rows[i][0], max(r[1] for r in rows[i : i + size]), min(r[2] for r in rows[i : i + size]), rows[min(i + size, len(rows)) - 1][3]) for i in range(0, len(rows), size)]
    levels = [("NQ", g * size + 1, "m", float(round(c[2] * 4) / 4)) for g, c in enumerate(coarse)]
    got = Z.three_candle_on(bars, Z.trigger_bars(bars, size * 60), spark.createDataFrame(levels, "symbol string, bar_index int, source_mode string, level_price double"), size * 60, max_wait=wait, look=3)
    got = {(r.arrival_bar_index, r.direction, r.level_price): (r.reversal_bar_index, r.entry_bar_index, r.variant) for r in got.collect()}
    want, until, arrival = {}, {}, {}
    last = lambda g: min(g * size + size, len(rows)) - 1
    for g, (_, _, _, price) in enumerate(levels):
        _, h1, l1, c1 = coarse[g]
        for way in ("long", "short"):
            key = (price, way)
            if key in until and g <= until[key] and g != arrival[key]:
                continue
            if not ((l1 <= price and c1 > price) if way == "long" else (h1 >= price and c1 < price)):
                continue
            j = g + 1
            while j < len(coarse) and coarse[j][1] <= h1 and coarse[j][2] >= l1:
                j += 1
            if j == len(coarse):
                continue
            _, h, lo, c = coarse[j]
            end = j
            if c > h1 if way == "long" else c < l1:
                trig = c - 0.25 if way == "long" else c + 0.25
                over = (j + 1) * size  # the bar that starts as the reversal ends doesn't count
                hits = [k for k in range(over + 1, min(over + wait * size, len(rows) - 1) + 1) if (rows[k][2] <= trig if way == "long" else rows[k][1] >= trig)]
                sfp = lo < l1 if way == "long" else h > h1
                want[last(g), way, price] = (last(j), hits[0] if hits else None, "3c" + ("_sfp" if sfp else "") + f"_{way}" + ("_muted" if j > g + 1 else ""))
                end = j + wait
            if key not in until or end >= until[key]:
                until[key], arrival[key] = end, g
    assert want and got == want


@pytest.mark.parametrize("policy,cooldown", [("single_position", 0), ("single_direction", 2)])
def test_admission_matches_the_loop(spark, policy, cooldown):
    r = random.Random(4)
    rows = [("x", 0, i, r.choice(["long", "short"]), e, e + r.randint(0, 9)) for i, e in enumerate(sorted(r.randint(0, 200) for _ in range(80)))]
    df = spark.createDataFrame(rows, "symbol string, cell_id int, signal_id long, direction string, entry_bar_index int, exit_bar_index int")
    got = {t.signal_id for t in S.admit(df, policy, cooldown).where("admitted").collect()}
    last, want = {}, set()
    for _, _, i, way, e, x in rows:
        g = way if policy == "single_direction" else ""
        if e > last.get(g, -10**6) + cooldown:
            want.add(i)
            last[g] = max(last.get(g, -10**6), x)
    assert got == want


def test_future_bars_do_not_change_past_levels(spark):
    rows = walk(400, 5)
    shock = [(500, 600, 400, 550, 9)] * 60
    make = lambda d: B.indexed(B.sessionised(frame(spark, d, 30).drop("bar_index")))
    cols = ["dOpen", "pdHigh", "ONH", "SMA_5", "VW", "Pivot_High", "prev30mVWAP", "pdHigh_naked", "pdPOC"]

    def levels(b):
        b = L.prior_period(L.current_opens(b), "d")
        b = L.rolling_vwap(L.sma(L.session_levels(b), 5), 7200, "VW")
        b = L.naked(L.pivots(L.bracket_vwaps(b, 3), 1800), "pdHigh")
        return {r.ts: tuple(r[c] for c in cols) for r in L.prior_profiles(b, "d").select("ts", *cols).collect()}

    past, full = levels(make(rows)), levels(make(rows + shock))
    assert all(full[t] == v for t, v in past.items())


def test_dst_sessions(spark):
    ts = [dt.datetime(2026, 3, 8, h, 30) for h in range(4, 10)]
    df = spark.createDataFrame([("x", t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in ts], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    rows = B.session_brackets(B.sessionised(df)).orderBy("ts").collect()
    assert [r.local_ts.hour for r in rows] == [23, 0, 1, 3, 4, 5]
    assert [r.bracket for r in rows] == [11, 13, 15, 17, 19, 21]


def test_asof_and_range_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y")], "k string, u int, v string")
    assert {(r.k, r.t, r.v) for r in asof_backward(left, right, ["k"], "t", "u", ["v"]).collect()} == {("a", 5, "x"), ("a", 9, "y"), ("b", 1, None)}
    spans = spark.createDataFrame([("a", 0, 6, "p"), ("a", 6, 30, "q")], "k string, lo int, hi int, n string")
    assert {(r.t, r.n) for r in range_join(left, spans, ["k"], "t", "lo", "hi", 4).collect()} == {(5, "p"), (9, "q")}


def test_summary_edges(spark):
    df = spark.createDataFrame([("a", i, T0 + dt.timedelta(minutes=i), r) for i, r in enumerate([1.0, 2.0, 0.0])], "k string, trade_id long, exit_ts timestamp_ntz, r_multiple double")
    s = M.trade_summary(df, ["k"]).first()
    assert s.profit_factor == float("inf") and s.win_count == 2 and s.loss_count == 0 and s.max_drawdown_r == 0.0 and s.expectancy_r == s.avg_r
    assert M.trade_summary(df.limit(0), ["k"]).count() == 0


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("a", i, T0 + dt.timedelta(minutes=i % 50), float(i % 7 - 3)) for i in range(300)], "k string, trade_id long, exit_ts timestamp_ntz, r_multiple double")
    one = R.monte_carlo(df, ["k"], "block", 10).orderBy("sim").collect()
    assert one == R.monte_carlo(df.repartition(7), ["k"], "block", 10).orderBy("sim").collect()
    total = R.monte_carlo(df, ["k"], "reshuffle", 10).select("final_r").distinct().collect()
    assert {round(r.final_r, 6) for r in total} == {round(sum(float(i % 7 - 3) for i in range(300)), 6)}


def test_configuration():
    assert [parse_interval(x) for x in ("15s", "1min", "4h", "1D")] == [15, 60, 14400, 86400] and format_interval(14400) == "4h"
    with pytest.raises(ValueError):
        parse_interval("x")
    cells = ST.expand({"trigger": ["touch", "break"], "otf": ["no_otf", "otf_5m"]})
    assert len(cells) == 4 and len({c["fingerprint"] for c in cells}) == 4
    with pytest.raises(ValueError):
        ST.expand({"colour": [1]})
    with pytest.raises(ValueError):
        R.grid_cells([1.0] * 200, [1.0] * 200)


def test_walk_forward_reaches_the_last_bar(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        entry = rng.randrange(0, 1390)
        for cell in range(2):
            rows.append(("s", 2 * k + cell, f"2024-01-01 {entry // 60:02d}:{entry % 60:02d}:00", entry, entry + rng.randrange(0, 9), cell, 100.0 * (cell + 1), 300.0, "long", float(rng.randrange(-8, 9)) / 8))
    trades = spark.createDataFrame(rows, "symbol string, trade_id long, exit_ts string, entry_bar_index int, exit_bar_index int, cell_id int, stop_ticks double, target_ticks double, direction string, r_multiple double").withColumn("exit_ts", F.to_timestamp("exit_ts"))
    bars = spark.range(1400).select(F.lit("s").alias("symbol"), F.col("id").cast("int").alias("bar_index"))
    for anchored in (False, True):
        got = {(r.label, r.fold_id): r for r in R.walk_forward_all(trades, bars, [(400, 200, 200), (300, 150, 100)], anchored).collect()}
        want = {}
        for label, (train, test, step) in enumerate([(400, 200, 200), (300, 150, 100)]):
            for i, (a, b, c, d) in enumerate(R.folds(1400, train, test, step, anchored)):
                by = {cell: [x[9] for x in rows if x[5] == cell and x[3] >= a and x[4] < b] for cell in range(2)}
                best = max((0, 1), key=lambda cell: (sum(by[cell]) / len(by[cell]), -cell))
                want[label, i] = best, len(by[best]), sum(1 for x in rows if x[5] == best and x[3] >= c and x[4] < d)
        assert {k: (r.cell_id, r.train_trades, r.test_trades) for k, r in got.items()} == want
        assert (0, 4) in got and (1, 9) in got  # the folds that end at bar 1,400 and 1,350
    assert R.walk_forward_all(trades, bars.where("bar_index < 500"), [(400, 200, 200)]).count() == 0


def _spine(rows):
    import datetime as dt

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    at = dt.datetime(2024, 1, 2, 15, 0)
    return spark.createDataFrame([("A", i, at + dt.timedelta(minutes=30 * i), *map(float, r)) for i, r in enumerate(rows)], "symbol string, bar_index int, ts timestamp_ntz, open double, high double, low double, close double")


def test_unknown_intrabar_models_are_refused(spark):
    import pytest

    from tapewright.operators.simulate import simulate

    b = _spine([(100, 101, 99, 100)] * 3)
    s = spark.createDataFrame([("A", 0, "long", 1)], "symbol string, bar_index int, direction string, signal_id int")
    with pytest.raises(ValueError, match="intrabar model"):
        simulate(b, s, model="sl_frist")
    with pytest.raises(ValueError, match="needs sub"):
        simulate(b, s, model="subtimeframe")


def test_a_retrace_entrys_own_bar_counts_only_what_follows_the_entry(spark):
    from tapewright.operators.simulate import simulate

    # entry at 101 above the open: the low of 98 may lie before it, the high follows on either way
    b = _spine([(100, 100, 100, 100), (100, 103, 98, 102), (102, 102, 102, 102)])
    s = spark.createDataFrame([("A", 0, "long", 1, 1, 101.0)], "symbol string, bar_index int, direction string, signal_id int, entry_bar_index int, entry_price double")
    kind = lambda **o: simulate(b, s, tick=1.0, **o).first()
    assert kind(stop_ticks=2, target_ticks=5).exit_reason == "DATA_END"
    assert kind(stop_ticks=2, target_ticks=2).exit_reason == "TP"
    # here the way by the low first comes back through the entry only after it, and the close is beyond the stop
    low = _spine([(100, 100, 100, 100), (100, 103, 98, 98.5), (102, 102, 102, 102)])
    assert simulate(low, s, tick=1.0, stop_ticks=2, target_ticks=5).first().exit_reason == "SL"
    # the path model goes by the nearer extreme, the low, first: the target comes before the close
    assert simulate(low, s, tick=1.0, stop_ticks=2, target_ticks=2, model="path_open_proximity").first().exit_reason == "TP"


def test_sub_bars_decide_the_order_within_a_bar(spark):
    import pytest

    from tapewright.operators.simulate import simulate

    import datetime as dt

    b = _spine([(100, 100, 100, 100), (100, 104, 96, 100), (100, 100, 100, 100)])
    at = dt.datetime(2024, 1, 2, 15, 0)
    rows = [(0, 100, 100, 100, 100), (15, 100, 100, 100, 100), (30, 100, 104, 100, 101), (45, 101, 101, 96, 100), (60, 100, 100, 100, 100), (75, 100, 100, 100, 100)]
    sub = spark.createDataFrame([("A", at + dt.timedelta(minutes=m), *map(float, r)) for m, *r in rows], "symbol string, ts timestamp_ntz, open double, high double, low double, close double")
    s = spark.createDataFrame([("A", 0, "long", 1)], "symbol string, bar_index int, direction string, signal_id int")
    run = lambda x, model: simulate(b, s, tick=1.0, stop_ticks=3, target_ticks=3, model=model, sub=x, parent_s=1800, sub_s=900).first().exit_reason
    assert simulate(b, s, tick=1.0, stop_ticks=3, target_ticks=3).first().exit_reason == "SL"
    assert run(sub, "subtimeframe") == "TP" == run(sub, "subtimeframe_conservative")
    missing = sub.where("minute(ts) <> 45")
    with pytest.raises(ValueError, match="incomplete"):
        run(missing, "subtimeframe")
    assert run(missing, "subtimeframe_conservative") == "SL"
    with pytest.raises(ValueError, match="mismatch"):
        run(sub.where("high < 104").union(sub.where("high = 104").selectExpr("symbol", "ts", "open", "103.0D", "low", "close")), "subtimeframe_conservative")


@pytest.mark.parametrize("options", [{}, {"breakeven_r": 0.5, "trail_r": 1.0, "trail_ticks": 40}])
def test_steps_of_a_walk_make_the_trades_of_one_walk(spark, monkeypatch, options):
    from tapewright.operators import simulate as S

    bars = frame(spark, walk(120, 5))
    sig = spark.createDataFrame([("NQ", i, i * 4, "long" if i % 2 else "short") for i in range(25)], "symbol string, signal_id long, bar_index int, direction string")
    trades = lambda **o: sorted(map(str, S.simulate(bars, sig, stop_ticks=60, target_ticks=90, **options, **o).drop("exit_reason").collect()))
    whole = trades(max_bars=1000)  # in steps: the bound is above STEP
    monkeypatch.setattr(S, "STEP", 3)
    assert trades() == whole
    monkeypatch.setattr(S, "STEP", 1000)
    assert trades(max_bars=1000) == whole


@pytest.mark.parametrize("policy,cooldown,keys", [("single_position", 0, ()), ("single_position", 3, ()), ("single_direction", 1, ("direction",)), ("single_setup", 0, ("setup",))])
def test_admission_reasons(spark, policy, cooldown, keys):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        e = rng.randrange(300)
        rows.append((f"s{i % 3}", i % 2, e, e - rng.randrange(3), i, e + rng.randrange(12), rng.choice(["long", "short"]), rng.choice("ab"), 900 - i))
    df = spark.createDataFrame(rows, "symbol string, cell_id int, entry_bar_index int, bar_index int, n int, exit_bar_index int, direction string, setup string, signal_id long").repartition(5)
    got = {(r.signal_id): (r.admitted, r.skip_reason, r.blocking_signal_id, r.blocking_exit_bar_index) for r in admissions(df, policy, cooldown, "setup").collect()}
    taken, want = {}, {}
    for s, c, e, b, _, x, d, u, i in sorted(rows, key=lambda r: (r[2], r[3], r[8])):
        own = taken.setdefault((s, c, *({"direction": d, "setup": u}[k] for k in keys)), [])
        blockers = sorted((-xx, ii) for ii, xx in own if e <= xx + cooldown)
        if not blockers:
            own.append((i, x))
            want[i] = (True, None, None, None)
        else:
            reason = "cooldown_active" if e > -blockers[0][0] else {"single_position": "overlapping_position", "single_direction": "overlapping_direction", "single_setup": "overlapping_setup"}[policy]
            want[i] = (False, reason, blockers[0][1], -blockers[0][0])
    assert got == want and sum(not v[0] for v in want.values()) > 20
    assert admissions(df, "allow_all").where("admitted").count() == 400
    assert admissions(df.limit(0), policy, 0, "setup").count() == 0
    with pytest.raises(ValueError):
        admissions(df, "single_setup")


@pytest.mark.parametrize("span,anchored,mode", [((40, 20, 15), False, "all"), ((25, 10, 10), False, "any"), ((30, 20, 20), True, "all")])
def test_fold_verdicts_by_parts_alone(spark, span, anchored, mode):
    rng = random.Random(5)
    bars, signals = [], []
    for s in ("a", "b"):
        price = 100.0
        for i in range(130 if s == "a" else 71):
            price += rng.choice([-1, 0, 1, 2])
            bars.append((s, i, dt.datetime(2026, 1, 5) + dt.timedelta(minutes=30 * i), dt.date(2026, 1, 5) + dt.timedelta(days=i // 21), price + rng.randrange(3), price - rng.randrange(3)))
            if rng.random() < 0.6:
                signals.append((s, len(signals), i, rng.choice(["long", "short"])))
    b = spark.createDataFrame(bars, "symbol string, bar_index int, ts timestamp_ntz, session_date date, high double, low double")
    g = spark.createDataFrame(signals, "symbol string, signal_id int, bar_index int, direction string")

    def states(own, secs):
        out, last, runs = [], None, [0, 0, 0]
        cells = {}
        for r in own:
            at = r[2] - dt.timedelta(seconds=(r[2] - dt.datetime(2026, 1, 1)).total_seconds() % secs)
            cells.setdefault((r[3], at), []).append(r)
        for (day, at), rs in sorted(cells.items()):
            if len(rs) * 1800 != secs:
                continue
            high, low = max(r[4] for r in rs), min(r[5] for r in rs)
            if last is None or last[0] != day:
                runs = [0, 0, 1]
            else:
                runs = [runs[0] + 1 if low > last[2] else 0, runs[1] + 1 if high < last[1] else 0, runs[2] + 1]
            last = (day, high, low)
            up, down = runs[0] >= 1, runs[1] >= 1
            out.append((at + dt.timedelta(seconds=secs), "unknown" if runs[2] == 1 else "up" if up and not down else "down" if down and not up else "neutral"))
        return out

    train, test, step = span
    for policy in ("fold_local", "causal_prefix"):
        got = {(r.signal_id, r.part, r.start): r.accepted for r in R.fold_verdicts(g, b, span, 1800, [3600, 7200], 1, mode, policy, anchored).collect()}
        want = {}
        for s, i, at, d in signals:
            own = [r for r in bars if r[0] == s]
            for k in range(20):
                for part, lo, hi in (("train", 0 if anchored else k * step, k * step + train), ("test", k * step + train, k * step + train + test)):
                    if lo <= at < hi or (anchored and part == "train"):
                        seen = [r for r in own if (r[1] >= lo or policy == "causal_prefix") and r[1] <= at]
                        known = [[x for t, x in states(seen, secs) if t <= own[at][2]] for secs in (3600, 7200)]
                        fits = [bool(x) and x[-1] == {"long": "up", "short": "down"}[d] for x in known]
                        want[i, part, lo] = (all if mode == "all" else any)(fits)
        assert got == want and len(set(want.values())) == 2
    with pytest.raises(ValueError):
        R.fold_verdicts(g, b, span, 1800, [3600], policy="other")


def test_first_hits_against_a_walk(spark):
    rng = random.Random(3)
    bars, cand, want = [], [], {}
    for s, n in (("a", 700), ("b", 37), ("c", 1), ("d", 16)):
        p, own = 1000.0, []
        for i in range(n):
            p += rng.choice([-1.0, 0.0, 1.0])
            own.append((s, i, p - rng.randrange(3), p + rng.randrange(3), p, p, T0))
        bars += own
        for k in range(60):
            pos = rng.randrange(n)
            cap, width, sign = rng.choice([n - 1, rng.randrange(pos, n)]), rng.choice([3, 12, 60]), rng.choice([1.0, -1.0])
            stop, target = own[pos][4] - sign * width, own[pos][4] + sign * width * 2
            key = (s, k)
            cand.append((*key, sign, stop, target, cap, pos, False, None, None))
            lo, hi = float("inf"), float("-inf")
            for b in own[pos : cap + 1]:
                lo, hi = min(lo, b[2]), max(hi, b[3])
                if (b[2] <= stop or b[3] >= target) if sign > 0 else (b[3] >= stop or b[2] <= target):
                    break
            want[key] = (b[1], lo, hi)
    b = spark.createDataFrame(bars, "symbol string, bar_index int, low double, high double, open double, close double, ts timestamp_ntz")
    c = spark.createDataFrame(cand, "symbol string, k int, sign double, stop double, target double, cap int, pos int, settled boolean, lo double, hi double")
    got = {(r.symbol, r.k): (r.bar.u, r.lo, r.hi) for r in first_hits(c, b, 699).collect()}
    assert got == want and levels_for(0) == levels_for(63) == 1 and levels_for(64) == 2 and levels_for(4096) == 3


@pytest.mark.parametrize("n", [1, 2, 9, 150])
def test_ema_by_blocks_is_the_recursion(spark, n):
    rng = random.Random(n)
    rows, want = [], {}
    for s, m in (("a", 1500), ("b", 70), ("c", 1)):
        p, e = 5000.0, None
        for i in range(m):
            p += rng.uniform(-9, 9)
            ts = T0 + dt.timedelta(minutes=5 * i + (900 if i > 200 else 0))
            rows.append((s, ts, p))
            e = p if e is None else e + 2 / (n + 1) * (p - e)
            want[s, ts] = e if i >= n - 1 else None
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    out = L.ema(df, n)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.symbol, r.ts): r[f"EMA_{n}"] for r in out.collect()}
    assert got.keys() == want.keys() and all((g is None) == (want[k] is None) and (g is None or abs(g - want[k]) < 1e-8) for k, g in got.items())


def test_equity_by_blocks_is_the_whole_window(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("xy"), None if i % 97 == 0 else T0 + dt.timedelta(hours=rng.randrange(200)), None if i % 31 == 0 else rng.uniform(-2, 2)) for i in range(500)]
    t = spark.createDataFrame(rows, "trade_id int, k string, exit_ts timestamp_ntz, r_multiple double")
    for keys in ([], ["k"]):
        one = {r.trade_id: (r.cum_r, r.drawdown_r) for r in M.equity_curve(t.withColumn("one", F.lit(1)), keys or ["one"]).collect()}
        many = {r.trade_id: (r.cum_r, r.drawdown_r) for r in M.equity_curve(t, keys, "hour").collect()}
        assert one.keys() == many.keys() and all(abs(a - b) < 1e-9 for k in one for a, b in zip(one[k], many[k], strict=True))


def test_valid_prices_contract_column_and_display_zone(spark):
    good = frame(spark, [(1, 3, 0.5, 2, 1), (2, 2, 2, 2, 1)])
    B.assert_valid_ohlc(good)
    for bad, why in (((1, 3, 2, 2, 1), "hold"), ((1, 1.5, 0.5, 2, 1), "hold"), ((float("nan"), 3, 0, 2, 1), "finite"), ((1, float("inf"), 0, 2, 1), "finite")):
        with pytest.raises(ValueError, match=why):
            B.assert_valid_ohlc(frame(spark, [bad]))
    with pytest.raises(ValueError, match="finite"):
        B.assert_valid_ohlc(good.withColumn("low", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="lack"):
        B.assert_valid_ohlc(good.drop("open"))
    assert B.contract_column(good) == "symbol" and B.contract_column(good.withColumnRenamed("symbol", "Expiry").withColumn("Ticker", F.lit(1))) == "Ticker"
    assert B.contract_column(good.drop("symbol")) is None
    local = B.display_times(good.withColumn("at", F.col("ts").cast("timestamp")), "America/New_York").orderBy("bar_index").first()
    assert local.ts == local["at"] == T0 - dt.timedelta(hours=5)
    assert B.display_times(good, "Asia/Tokyo", ["ts"]).orderBy("bar_index").first().ts == T0 + dt.timedelta(hours=9)


def test_rolling_poc_equals_a_plain_count(spark):
    """Ties, repeated times, gaps longer than the window, tenths of lots, and volumes that don't count."""
    rng = random.Random(5)
    start, rows = dt.datetime(2026, 1, 5), []
    for s in ("a", "b"):
        at = 0
        for i in range(300):
            at += rng.choices([0, 60, 45, 7200], [5, 80, 13, 2])[0]
            price = float(rng.randrange(90, 96))
            rows.append((s, start + dt.timedelta(seconds=at), price, price, price, None if i % 41 == 0 else rng.randrange(4) / 10))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, high double, low double, close double, volume double").repartition(5)
    got = {(r.symbol, r.ts): r.p for r in L.rolling_poc(bars, 1800, "p", 1.0).collect()}
    for s, ts, *_ in rows:
        by: dict = {}
        for s2, t2, price, _, _, v in rows:
            if s2 == s and v and dt.timedelta() <= ts - t2 < dt.timedelta(seconds=1800):
                by[price] = by.get(price, 0) + round(v * 10)
        assert got[s, ts] == (min(by, key=lambda p: (-by[p], p)) if by else None)
    assert L.rolling_poc(bars, 1800, "p", 1.0).count() == len(rows)
    assert L.rolling_poc(bars.limit(0), 1800, "p", 1.0).count() == 0


def test_normal_distribution_and_deflation(spark):
    from statistics import NormalDist, mean, stdev

    n = NormalDist()
    ps = [0.001, 0.2, 0.5, 0.9, 0.9999]
    got = spark.range(1).select(*[D.normal_quantile(F.lit(p)) for p in ps], *[D.normal_probability(F.lit(n.inv_cdf(p))) for p in ps]).first()
    assert list(got) == pytest.approx([n.inv_cdf(p) for p in ps] + ps, abs=1e-9)
    rng = random.Random(3)
    cells = {c: [rng.gauss(0.1 * c, 1) for _ in range(size)] for c, size in enumerate((30, 40, 3, 25, 1))} | {9: [1.0] * 5}
    rows = spark.createDataFrame([(c, x) for c, xs in cells.items() for x in xs], "cell_id int, r_multiple double")
    out = {r.cell_id: r for r in D.deflated_sharpe(rows, ["cell_id"], 8).collect()}
    ratios = [mean(cells[c]) / stdev(cells[c]) for c in out]
    most = stdev(ratios) * ((1 - 0.5772156649015329) * n.inv_cdf(1 - 1 / 8) + 0.5772156649015329 * n.inv_cdf(1 - 1 / (8 * math.e)))
    assert set(out) == {0, 1, 2, 3} and out[2].psr is None and out[2].dsr is None
    for c in (0, 1, 3):
        m, s, k = mean(cells[c]), stdev(cells[c]), len(cells[c])
        g1, g2 = (mean([((x - m) / s) ** e for x in cells[c]]) for e in (3, 4))
        sr = m / s
        f = math.sqrt(k - 1) / math.sqrt(1 - g1 * sr + (g2 - 1) / 4 * sr * sr)
        assert [out[c].expected_max_sharpe, out[c].psr, out[c].dsr] == pytest.approx([most, n.cdf(sr * f), n.cdf((sr - most) * f)], abs=1e-9)
    alone = D.deflated_sharpe(rows.where("cell_id = 0"), ["cell_id"]).first()
    assert alone.psr is not None and alone.dsr is None and D.deflated_sharpe(rows.limit(0), ["cell_id"]).count() == 0


def test_random_benchmark_counts_replicas(spark):
    bars = frame(spark, walk(200, 4))
    signals = spark.createDataFrame([("NQ", i, k, "long" if k % 3 else "short") for k, i in enumerate(range(3, 180, 11))], "symbol string, bar_index int, signal_id long, direction string")
    rule = {"stop_ticks": 6, "target_ticks": 9, "max_bars": 20}
    trades = S.simulate(bars, signals, **rule)
    r = D.random_benchmark(bars, trades, 12, **rule).first()
    drawn = S.simulate(bars, D.random_entries(bars, trades, 12), **rule).groupBy("replica_id").agg(F.avg("r_multiple").alias("m")).collect()
    means, seen = [x.m for x in drawn], trades.agg(F.avg("r_multiple")).first()[0]
    assert (r.n_replicas, r.observed_expectancy_r, r.p_value) == (12, seen, pytest.approx((1 + sum(m >= seen for m in means)) / 13))
    assert r.null_expectancy_mean == pytest.approx(sum(means) / 12) and r.percentile == pytest.approx(100 * sum(m < seen for m in means) / 12)
    assert D.random_benchmark(bars, trades.limit(0), 3, **rule).count() == 0


def test_clock_issues_equal_a_walk(spark):
    """Bars by the half hour around New York's change of clock in spring, with holes, out of order."""
    rng = random.Random(8)
    rows, want = [], {}
    for s in ("a", "b", "c"):
        times = [dt.datetime(2026, 3, 8, 2) + dt.timedelta(minutes=30 * i) for i in range(24) if rng.random() < 0.5]
        order = times[:]
        rng.shuffle(order)
        rows += [(s, t, i) for i, t in enumerate(order)]
        change = [i for i in range(1, len(times)) if times[i - 1] < dt.datetime(2026, 3, 8, 7) <= times[i]]
        gaps = 0
        for at in change:
            near = times[max(1, at - 3) : at + 4]
            gaps += sum(b - a > dt.timedelta(minutes=30) for a, b in zip(near, near[1:]))
        want[s] = (sum(b < a for a, b in zip(order, order[1:])), gaps)
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, row_id long").repartition(3)
    got = {r.symbol: (r.non_monotonic_before_sort, r.dst_transition_gaps) for r in B.clock_issues(bars, 600, "America/New_York", "row_id").collect()}
    assert got == want and any(g for _, g in want.values())
    assert B.clock_issues(bars, 600, "UTC").agg(F.sum("dst_transition_gaps"), F.count("non_monotonic_before_sort")).first() == (0, 0)


def test_roll_assumptions(spark):
    rows = [("a", i, "H" if i < 3 else "M") for i in range(6)] + [("b", i, "H") for i in range(3)] + [("c", 0, None)]
    bars = spark.createDataFrame([(s, T0 + dt.timedelta(days=i), c, 1.0, 2.0) for s, i, c in rows], "symbol string, ts timestamp_ntz, contract string, open double, close double")
    got = lambda b, *a, **k: {r.symbol: (r.contract_count, r.roll_gap_count, r.valid, r.issues) for r in B.roll_assumptions(b, *a, **k).collect()}
    assert got(bars, "segmented_contracts") == {"a": (2, 1, True, ["unadjusted_gaps"]), "b": (1, 0, False, ["too_few_contracts", "unadjusted_gaps"]), "c": (0, 0, False, ["too_few_contracts", "unadjusted_gaps"])}
    assert got(bars, "single_contract") == {"a": (2, 0, False, ["several_contracts"]), "b": (1, 0, True, []), "c": (0, 0, True, [])}
    assert got(bars, "external_continuous", adjustment="panama ", rule="")["a"] == (2, 0, True, ["empty_rule", "several_contracts"])
    assert got(bars, "external_continuous", adjustment="x")["b"] == (1, 0, True, ["unknown_rule", "unrecognised_adjustment"])
    bare = bars.drop("contract")
    assert got(bare, "segmented_contracts")["a"] == (None, 0, False, ["no_contract_column", "unadjusted_gaps"])
    assert got(bare, "single_contract")["a"] == (None, 0, True, ["no_contract_column"])
    with pytest.raises(ValueError):
        B.roll_assumptions(bars, "other")


@pytest.mark.parametrize("cooldown", [0, 2])
def test_admission_sends_bars_not_trades_through_one_task(spark, cooldown):
    rng = random.Random(3)
    rows = [(i % 40, i, i % 40 + rng.randrange(-1 - cooldown, 6) if i % 50 else None, rng.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "entry_bar_index int, signal_id long, exit_bar_index int, bar_index int").repartition(6)
    out = admissions(df, "single_position", cooldown, by=[])
    got = {r.signal_id: (r.admitted, r.skip_reason, r.blocking_signal_id, r.blocking_exit_bar_index) for r in out.collect()}
    want, blocker, until = {}, None, None  # trades that leave before their own bar block none
    for e, s, x, b in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        if until is None or e > until + cooldown:
            blocker, until, want[s] = s, x, (True, None, None, None)
        else:
            want[s] = (False, "cooldown_active" if e > until else "overlapping_position", blocker, until)
    assert got == want and sum(v[0] for v in want.values()) > 5
    # the task that reads a group in order has a row for each bar, and no exchange is by the group alone but that of bars
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and [x for x in plan.splitlines() if "MapInArrow" in x and "__bar" in x and "bar_index" not in x.replace("entry_bar_index", "").replace("exit_bar_index", "")]


def test_event_trades_across_hours_and_without_times(spark, tmp_path):
    from tapewright import catalog

    rng = random.Random(4)
    rows = [(i, None if i in (3, 7) else T0 + dt.timedelta(minutes=rng.choice([1, 60, 200]) * rng.randrange(40)), 1, rng.choice(["a", "b", None]), float(i % 17), '{"k": 6}') for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    t = catalog.event_trades(spark, str(tmp_path))
    got = {r.trade_id: (r.symbol, r.entry_ts, r.exit_ts, round(r.r_multiple, 9), r.entry_bar_index, r.exit_bar_index) for r in t.collect()}
    want = {}
    for kind in ("a", "b", None):
        own = sorted((r for r in rows if r[3] == kind), key=lambda r: (r[1] is not None, r[1] or T0, r[0]))
        for n, (x, y) in enumerate(zip(own, own[1:]), 1):
            if y[1] is not None:
                want[x[0]] = (kind, x[1], y[1], round((y[4] - x[4]) / 50 * (1 if x[0] % 2 == 0 else -1), 9), n, n + x[0] % 23)
    assert got == want
    # no exchange of whole events is by the type alone
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(event_type" in x]


def simulated_paths(rows, method, n_sims, block=None):
    """{key: (R multiples in order of exit, a path for each simulation)}, trade by trade."""
    one = lambda sim, pos: ((sim * R.A + pos * R.C + 3 * R.B) % R.M * 48271 + R.B) % R.M
    groups = {}
    for i, k, ts, r in sorted((x for x in rows if x[3] is not None), key=lambda x: (x[2] is not None, x[2] or T0, x[0])):
        groups.setdefault(k, []).append(r)
    out = {}
    for k, rs in groups.items():
        n, size = len(rs), block or max(2, round(math.sqrt(len(rs))))
        if method == "reshuffle":
            paths = [[rs[p] for p in sorted(range(n), key=lambda p: (one(s, p), p))] for s in range(n_sims)]
        elif method == "skip":
            paths = [[rs[p] if one(s, p) >= int(0.1 * R.M) else 0.0 for p in range(n)] for s in range(n_sims)]
        else:
            paths = [[rs[(one(s, p // size) % n + p % size) % n] for p in range(n)] for s in range(n_sims)]
        out[k] = rs, paths
    return out


def resampling_trades(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["x", "y", None]), None if i % 53 == 0 else T0 + dt.timedelta(minutes=rng.randrange(60)), None if i % 31 == 0 else rng.randrange(-9, 10) / 8) for i in range(400)]
    return rows, spark.createDataFrame(rows, "trade_id int, k string, exit_ts timestamp_ntz, r_multiple double").repartition(5)


def makes_no_row_of_a_simulated_trade(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Generate" not in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("method", ["reshuffle", "skip", "block"])
def test_fan_of_groups_without_rows_of_simulated_trades(spark, method):
    rows, t = resampling_trades(spark)
    for keys in (["k"], []):
        fan = R.monte_carlo_fan(t, keys, method, 7)
        want = {}
        for k, (rs, paths) in simulated_paths(rows if keys else [(i, None, ts, r) for i, _, ts, r in rows], method, 7).items():
            for i in range(len(rs)):
                cums = sorted(sum(p[: i + 1]) for p in paths)  # eighths: exact sums
                want[k, i + 1] = (sum(rs[: i + 1]), cums[3], cums[1] + (cums[2] - cums[1]) * 0.5)
        got = {(r["k"] if keys else None, r.trade_index): (r.observed_cum_r, r.p50, r.p25) for r in fan.collect()}
        assert got == want and makes_no_row_of_a_simulated_trade(fan)
    assert R.monte_carlo_fan(t.limit(0), ["k"], method, 7).count() == 0
    with pytest.raises(ValueError):
        R.monte_carlo_fan(t, ["k"], "x", 7)


@pytest.mark.parametrize("method", ["reshuffle", "skip", "block"])
def test_loss_streaks_without_rows_of_simulated_trades(spark, method):
    rows, t = resampling_trades(spark)
    rows += [(1000, "none", T0, 1.0), (1001, "all", T0, -1.0), (1002, "all", T0, -2.0)]
    t = t.union(spark.createDataFrame(rows[-3:], t.schema))
    got = R.monte_carlo_streaks(t, ["k"], method, 6)
    longest = lambda p: max(len(x) for x in "".join("L" if r < 0 else " " for r in p).split(" "))
    want = {(k, s): longest(p) for k, (_, paths) in simulated_paths(rows, method, 6).items() for s, p in enumerate(paths)}
    assert {(r.k, r.sim): r.max_loss_streak for r in got.collect()} == want and makes_no_row_of_a_simulated_trade(got)


@pytest.mark.parametrize("method,block", [("block", None), ("block", 4), ("reshuffle", None), ("skip", None)])
def test_ends_of_paths_without_rows_of_simulated_trades(spark, method, block):
    rows, t = resampling_trades(spark)
    got, want = R.monte_carlo(t, ["k"], method, 6, block=block), {}
    for k, (_, paths) in simulated_paths(rows, method, 6, block).items():
        for s, p in enumerate(paths):
            cum = high = worst = 0.0
            for r in p:
                cum += r
                high = max(high, cum)
                worst = max(worst, high - cum)
            want[k, s] = (cum, worst)
    assert {(r.k, r.sim): (r.final_r, r.max_drawdown_r) for r in got.collect()} == want and makes_no_row_of_a_simulated_trade(got)


def test_bootstrap_draws_within_its_group(spark):
    rows, t = resampling_trades(spark)
    got, want = R.bootstrap_ci(t, ["k"], 11), {}
    for k, (rs, _) in simulated_paths(rows, "skip", 1).items():
        n = len(rs)
        means = sorted(sum(rs[(((s * R.A + p * R.C + R.B) % R.M * 48271 + R.B) % R.M) % n] for p in range(n)) / n for s in range(11))
        at = lambda q: means[math.floor(q * 10)] + (means[math.ceil(q * 10)] - means[math.floor(q * 10)]) * (q * 10 - math.floor(q * 10))
        want[k] = (at(0.025), at(0.975), sum(means) / 11, sum(m > 0 for m in means) / 11)
    assert {r.k: tuple(round(x, 9) for x in r[1:]) for r in got.collect()} == {k: tuple(round(x, 9) for x in v) for k, v in want.items()}
    assert makes_no_row_of_a_simulated_trade(got)


def test_marginal_contributions_by_blocks(spark):
    from tapewright.plans import portfolio as P

    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "b", "c", None]), None if i % 61 == 0 else T0 + dt.timedelta(minutes=rng.randrange(900)), None if i % 37 == 0 else rng.randrange(-9, 9) / 8) for i in range(500)]
    df = spark.createDataFrame(rows, "trade_id int, setup_id string, exit_ts timestamp_ntz, r_multiple double").repartition(5)

    def ends(left_out, rows=rows):
        cum = high = worst = 0.0
        for _, s, _, r in sorted((x for x in rows if x[3] is not None), key=lambda x: (x[2] is not None, x[2] or T0, x[0])):
            if s is not None and s != left_out:
                cum += r
                high = max(high, cum)
                worst = max(worst, high - cum)
        return cum, worst

    got = P.marginal_contributions(df, ["a", "b", "d"])
    base = ends("(none)")
    assert {r.setup_id: (r.marginal_total_r, r.marginal_max_drawdown_r) for r in got.collect()} == {s: tuple(x - y for x, y in zip(base, ends(s), strict=True)) for s in ("a", "b", "d")}
    plan = got._jdf.queryExecution().executedPlan().toString()  # no sort of all trades for a setup
    assert not [x for x in plan.splitlines() if "Sort [without" in x and "trade_id" in x]
    alone = P.marginal_contributions(df.where("setup_id = 'a'"), ["a", "b"]).collect()
    assert [r.setup_id for r in alone] == ["b"] and alone[0].marginal_total_r == 0  # without a there is no trade
