"""DuckDB SQL for the registered queries."""

BARS = """
ticks AS (SELECT event_type AS symbol, ts AS tts, event_id AS tick_id, value AS price FROM events),
b0 AS (SELECT symbol, time_bucket(INTERVAL 30 MINUTE, tts) AS ts, arg_min(price, tts) AS open, max(price) AS high, min(price) AS low, arg_max(price, tts) AS close, count(*)::DOUBLE AS volume FROM ticks GROUP BY ALL),
b1 AS (SELECT *, ts - INTERVAL 5 HOUR AS local_ts FROM b0),
b2 AS (SELECT *, (hour(local_ts) * 3600 + minute(local_ts) * 60 + second(local_ts))::INT AS sod FROM b1),
b3 AS (SELECT *, CASE WHEN sod >= 34200 AND sod < 57600 THEN 'RTH' ELSE 'ETH' END AS session, local_ts::DATE + (sod >= 64800)::INT AS session_date FROM b2),
bars AS (SELECT *, date_trunc('week', session_date)::DATE AS week_key, date_trunc('month', session_date)::DATE AS month_key, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::INT AS bar_index FROM b3)
"""


def prior(p: str, key: str) -> str:
    return f"""{p}_agg AS (SELECT symbol, {key}, arg_min(open, ts) AS o, max(high) AS h, min(low) AS l FROM bars GROUP BY ALL),
{p}_prev AS (SELECT symbol, {key}, lag(o) OVER w AS p{p}Open, lag(h) OVER w AS p{p}High, lag(l) OVER w AS p{p}Low, (lag(h) OVER w + lag(l) OVER w) / 2 AS p{p}EQ FROM {p}_agg WINDOW w AS (PARTITION BY symbol ORDER BY {key}))"""


LEVELED = BARS + "," + prior("d", "session_date") + """,
leveled AS (SELECT b.*, pdOpen, pdHigh, pdLow, pdEQ,
  first_value(open) OVER (PARTITION BY b.symbol, b.session_date ORDER BY ts) AS dOpen, first_value(open) OVER (PARTITION BY b.symbol, b.week_key ORDER BY ts) AS wOpen, first_value(open) OVER (PARTITION BY b.symbol, b.month_key ORDER BY ts) AS mOpen,
  lag(close) OVER (PARTITION BY b.symbol ORDER BY ts) AS prev_close
  FROM bars b LEFT JOIN d_prev p ON b.symbol = p.symbol AND b.session_date = p.session_date)"""

BREAKS = LEVELED + """,
sig0 AS (SELECT symbol, bar_index, 'long' AS direction FROM leveled WHERE prev_close <= pdHigh AND close > pdHigh UNION ALL SELECT symbol, bar_index, 'short' FROM leveled WHERE prev_close >= pdHigh AND close < pdHigh),
sig AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_index, direction) AS signal_id FROM sig0)"""


SUBS = ", s0 AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, tts) AS sts, max(price) AS high, min(price) AS low, arg_max(price, tts) AS close FROM ticks GROUP BY ALL)"


def reach(low: str, high: str) -> tuple[str, str]:
    return f"(CASE WHEN sign > 0 THEN {low} <= stop ELSE {high} >= stop END)", f"(CASE WHEN sign > 0 THEN {high} >= target ELSE {low} <= target END)"


def leg(a: str, b: str) -> str:
    s, t = (f"({x} BETWEEN least({a}, {b}) AND greatest({a}, {b}))" for x in ("stop", "target"))
    return f"CASE WHEN {s} AND {t} THEN CASE WHEN abs(stop - {a}) <= abs(target - {a}) THEN 'SL' ELSE 'TP' END WHEN {s} THEN 'SL' WHEN {t} THEN 'TP' END"


def way(x: str, y: str) -> str:
    at = "CASE WHEN {} THEN 'SL' WHEN {} THEN 'TP' END".format(*reach("entry_price", "entry_price"))
    on = lambda a, b: f"entry_price BETWEEN least({a}, {b}) AND greatest({a}, {b})"
    return f"CASE WHEN {on('open', x)} THEN coalesce({at}, {leg('entry_price', x)}, {leg(x, y)}, {leg(y, 'close')}) WHEN {on(x, y)} THEN coalesce({at}, {leg('entry_price', y)}, {leg(y, 'close')}) WHEN {on(y, 'close')} THEN coalesce({at}, {leg('entry_price', 'close')}) END"


LO, HI = (f"least({', '.join(x)})" if k else f"greatest({', '.join(x)})" for k, x in ((1, ("entry_price", "close")), (0, ("entry_price", "close"))))
# the two ways through the bar from the entry on: by the high first, and by the low first
UP = reach(f"(CASE WHEN entry_price BETWEEN open AND high THEN low ELSE least(entry_price, low, close) END)", f"(CASE WHEN entry_price BETWEEN open AND high THEN high ELSE {HI} END)")
DOWN = reach(f"(CASE WHEN entry_price BETWEEN low AND open THEN low ELSE {LO} END)", "(CASE WHEN entry_price BETWEEN low AND open THEN high ELSE greatest(entry_price, high, close) END)")
OWN = f"CASE WHEN NOT entry_price BETWEEN low AND high THEN NULL WHEN {UP[0]} AND {DOWN[0]} THEN 'SL' WHEN {UP[1]} AND {DOWN[1]} THEN 'TP' END"
OWN_PATH = f"CASE WHEN high - open < open - low THEN {way('high', 'low')} WHEN high - open > open - low THEN {way('low', 'high')} WHEN coalesce({way('high', 'low')}, '') = 'SL' OR coalesce({way('low', 'high')}, '') = 'SL' THEN 'SL' ELSE coalesce({way('high', 'low')}, {way('low', 'high')}) END"


def simulated(cells: str = "(0, 400.0, 600.0)", model: str = "sl_first", slip: float = 0.0, commission: float = 0.0, close: bool = False, be: bool = False, retrace: bool = False, sub: str = "", hold: int | None = 50) -> str:
    at_most = f"entry_bar_index + {hold - 1}" if hold else "NULL::INT"
    stop = "stop0" if not be else "fill + sign * lvl"
    label = "'SL'" if not be else "CASE WHEN tr IS NOT NULL AND tr > greatest(-risk, coalesce(be, -risk)) THEN 'TRAIL' WHEN be IS NOT NULL AND lvl = 0 THEN 'BE' ELSE 'SL' END"
    moving = "walk1 AS (SELECT *, NULL AS be, NULL AS tr, 0 AS lvl FROM walk0)" if not be else """walkb AS (SELECT *, coalesce(max(greatest(CASE WHEN sign > 0 THEN high - fill ELSE fill - low END, 0)) OVER (PARTITION BY symbol, signal_id, cell_id ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM walk0),
walkc AS (SELECT *, CASE WHEN best >= 0.5 * risk THEN 0.0 END AS be, CASE WHEN best >= 1.0 * risk THEN best - 300 * 0.25 END AS tr FROM walkb),
walk1 AS (SELECT *, greatest(-risk, be, tr) AS lvl FROM walkc)"""
    hit = "CASE WHEN sl THEN 'SL' WHEN tp THEN 'TP' END" if model == "sl_first" else """coalesce(CASE WHEN sign > 0 THEN CASE WHEN open <= stop THEN 'SL' WHEN open >= target THEN 'TP' END ELSE CASE WHEN open >= stop THEN 'SL' WHEN open <= target THEN 'TP' END END,
      CASE WHEN sl AND tp THEN CASE WHEN (sign > 0 AND high - open >= open - low) OR (sign < 0 AND high - open <= open - low) THEN 'SL' ELSE 'TP' END WHEN sl THEN 'SL' WHEN tp THEN 'TP' END)"""
    if retrace:
        hit = f"CASE WHEN bar_index = entry_bar_index THEN {OWN_PATH if model == 'path' else OWN} ELSE {hit} END"
    subs, sub_join, sub_kind = "", "", ""
    if sub:
        subs = SUBS + (""", sb AS (SELECT b.symbol, b.bar_index, b.ts + k * INTERVAL 5 MINUTE AS sts, coalesce(s.low, last_value(s.close IGNORE NULLS) OVER w, b.open) AS slow, coalesce(s.high, last_value(s.close IGNORE NULLS) OVER w, b.open) AS shigh
  FROM bars b CROSS JOIN range(6) t(k) LEFT JOIN s0 s ON s.symbol = b.symbol AND s.sts = b.ts + k * INTERVAL 5 MINUTE WINDOW w AS (PARTITION BY b.symbol, b.bar_index ORDER BY k))""" if sub == "filled" else """, sb AS (SELECT b.symbol, b.bar_index, s.sts, s.low AS slow, s.high AS shigh FROM bars b JOIN s0 s ON s.symbol = b.symbol AND time_bucket(INTERVAL 30 MINUTE, s.sts) = b.ts QUALIFY count(*) OVER (PARTITION BY b.symbol, b.bar_index) = 6)""")
        sub_kind = f"""walk4 AS (SELECT symbol, signal_id, cell_id, bar_index, arg_min(CASE WHEN ssl THEN 'SL' ELSE 'TP' END, sts) FILTER (ssl OR stp) AS skind, true AS has FROM (
  SELECT x.*, sb.sts, CASE WHEN sign > 0 THEN slow <= stop ELSE shigh >= stop END AS ssl, CASE WHEN sign > 0 THEN shigh >= target ELSE slow <= target END AS stp FROM walk3 x JOIN sb ON sb.symbol = x.symbol AND sb.bar_index = x.bar_index) GROUP BY ALL),
walk5 AS (SELECT x.*, skind, has FROM walk3 x LEFT JOIN walk4 y USING (symbol, signal_id, cell_id, bar_index)),"""
        hit = f"CASE WHEN has THEN skind ELSE {hit} END"
    entry = "(b.high + b.low) / 2" if retrace else "b.open"
    ends = ", ends AS (SELECT symbol, session_date, max(bar_index) FILTER (session = 'RTH') AS close_bar FROM bars WHERE sod <= 57600 GROUP BY ALL)" if close else ""
    join = "LEFT JOIN ends e ON e.symbol = b.symbol AND e.session_date = b.session_date" if close else ""
    where = "WHERE (close_bar IS NULL OR close_bar >= b.bar_index) AND b.sod <= 54000" if close else ""
    close_bar = "close_bar" if close else "NULL::INT"
    return BREAKS + ends + subs + f""",
cells AS (SELECT * FROM (VALUES {cells}) v(cell_id, stop_ticks, target_ticks)),
lasts AS (SELECT symbol, max(bar_index) AS last_bar FROM bars GROUP BY ALL),
cand0 AS (SELECT s.*, c.*, b.bar_index AS entry_bar_index, CASE direction WHEN 'long' THEN 1.0::DOUBLE ELSE -1.0 END AS sign, {entry} AS open, last_bar, {close_bar} AS close_bar
  FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_index = s.bar_index + 1 JOIN lasts l ON l.symbol = s.symbol {join}, cells c {where}),
cand1 AS (SELECT * EXCLUDE (open, bar_index), open + sign * {slip} * 0.25 AS fill, open AS entry_price, stop_ticks * 0.25::DOUBLE AS risk, least(last_bar, {at_most}, close_bar) AS cap FROM cand0),
cand AS (SELECT *, fill - sign * risk AS stop0, fill + sign * target_ticks * 0.25 AS target, CASE WHEN cap = {at_most} THEN 'TIME' WHEN cap = close_bar THEN 'SESSION_CLOSE' ELSE 'DATA_END' END AS cap_reason FROM cand1),
walk0 AS (SELECT c.*, b.bar_index, b.ts, b.open, b.high, b.low, b.close FROM cand c JOIN bars b ON b.symbol = c.symbol AND b.bar_index BETWEEN c.entry_bar_index AND c.cap),
{moving},
walk2 AS (SELECT *, {stop} AS stop, {label} AS stop_label FROM walk1),
walk3 AS (SELECT *, CASE WHEN sign > 0 THEN low <= stop ELSE high >= stop END AS sl, CASE WHEN sign > 0 THEN high >= target ELSE low <= target END AS tp FROM walk2),
{sub_kind}
walk AS (SELECT *, {hit} AS kind, max(CASE WHEN sign > 0 THEN fill - low ELSE high - fill END) OVER w AS mae, max(CASE WHEN sign > 0 THEN high - fill ELSE fill - low END) OVER w AS mfe FROM {'walk5' if sub else 'walk3'}
  WINDOW w AS (PARTITION BY symbol, signal_id, cell_id ORDER BY bar_index ROWS UNBOUNDED PRECEDING)),
exits AS (SELECT *, row_number() OVER (PARTITION BY symbol, signal_id, cell_id ORDER BY kind IS NULL, CASE WHEN kind IS NULL THEN -bar_index ELSE bar_index END) AS rn FROM walk),
trades AS (SELECT symbol, signal_id, cell_id, stop_ticks, target_ticks, direction, entry_bar_index, bar_index AS exit_bar_index, ts AS exit_ts, stop0 AS stop_price, target AS target_price,
  CASE kind WHEN 'TP' THEN 'TP' WHEN 'SL' THEN stop_label ELSE cap_reason END AS exit_reason,
  (((CASE kind WHEN 'TP' THEN target WHEN 'SL' THEN stop ELSE close END - sign * {slip} * 0.25 - fill) * sign) * 50 - {2 * commission}) / (risk * 50) AS r_multiple,
  greatest(mae, 0) AS mae_points, greatest(mfe, 0) AS mfe_points, bar_index - entry_bar_index + 1 AS bars_held FROM exits WHERE rn = 1)"""


TRADE = "symbol, signal_id, direction, entry_bar_index, exit_bar_index, exit_reason, round(r_multiple + 3.7e-10, 7) AS r_multiple, round(mae_points + 3.7e-10, 7) AS mae_points, round(mfe_points + 3.7e-10, 7) AS mfe_points, bars_held"

ET = """
ev AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, lead(ts) OVER w AS nts, lead(value) OVER w AS nvalue, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
trades AS (SELECT event_id AS trade_id, event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, ts AS entry_ts, nts AS exit_ts,
  (nvalue - value) / 50 * (CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS r_multiple, (event_id % 23 + 1)::INT AS bars_held, (event_id % 11)::DOUBLE * 0.5::DOUBLE AS mae_points, (event_id % 13)::DOUBLE * 0.75::DOUBLE AS mfe_points, 8.0::DOUBLE AS stop_ticks,
  concat_ws('|', CASE WHEN k % 2 = 0 THEN 'dOpen' END, CASE WHEN k % 3 = 0 THEN 'pdHigh' END, CASE WHEN k % 5 = 0 THEN 'VWAP' END, CASE WHEN k % 7 = 0 THEN 'pdLow' END) AS level_names,
  rn AS entry_bar_index, rn + event_id % 23 AS exit_bar_index FROM ev WHERE nts IS NOT NULL)"""
LOCAL = "(entry_ts - INTERVAL 5 HOUR)"
SEGMENT = f"""CASE WHEN hour({LOCAL}) * 60 + minute({LOCAL}) < 570 THEN 'pre_rth' WHEN hour({LOCAL}) * 60 + minute({LOCAL}) < 600 THEN 'rth_open_30m' WHEN hour({LOCAL}) * 60 + minute({LOCAL}) < 690 THEN 'rth_morning'
 WHEN hour({LOCAL}) * 60 + minute({LOCAL}) < 810 THEN 'rth_midday' WHEN hour({LOCAL}) * 60 + minute({LOCAL}) < 900 THEN 'rth_afternoon' WHEN hour({LOCAL}) * 60 + minute({LOCAL}) < 960 THEN 'rth_power_hour' ELSE 'post_rth' END"""


def stats(keys: str, more: str = "", warn: int | None = 30, source: str = "trades", bars: bool = False) -> str:
    held = ", round(avg(bars_held) + 3.7e-10, 7) AS avg_bars_held" if bars else ""
    warned = f", count(*) < {warn} AS sample_warning" if warn is not None else ""
    return f"SELECT {keys}, count(*) AS trade_count, round(avg((r_multiple > 0)::INT::DOUBLE) + 3.7e-10, 7) AS win_rate, round(avg(r_multiple) + 3.7e-10, 7) AS avg_r, round(quantile_cont(r_multiple, 0.5) + 3.7e-10, 7) AS median_r, round(sum(r_multiple) + 3.7e-10, 7) AS total_r{held}{more}{warned} FROM {source} GROUP BY {keys}"


EXC = "x AS (SELECT *, mae_points / (stop_ticks * 0.25) AS mae_r, mfe_points / (stop_ticks * 0.25) AS mfe_r, mfe_points / (stop_ticks * 0.25) - r_multiple AS giveback_r, CASE WHEN mae_points > 0 THEN mfe_points / mae_points END AS edge_ratio FROM trades)"
HOURLY = "h AS (SELECT event_id AS row_id, event_type AS symbol, date_trunc('hour', ts) AS ts, floor(value / 100) AS p, json_extract_string(props, '$.k')::INT % 4 AS volume FROM events)"
TYP = "((high + low + close) / 3)"
DRAW = lambda sim, pos, seed: f"((({sim}::BIGINT * 1103515245 + {pos}::BIGINT * 134775813 + {seed * 12345}) % 2147483647) * 48271 + 12345) % 2147483647"
NUM = ET + ", num AS (SELECT symbol, exit_ts::DATE AS day, trade_id, exit_ts, r_multiple, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol, exit_ts::DATE) AS n FROM trades WINDOW w AS (PARTITION BY symbol, exit_ts::DATE ORDER BY exit_ts, trade_id))"
SUMMARY = """SELECT {k}, count(*) AS trade_count, avg((r_multiple > 0)::INT::DOUBLE) AS win_rate, sum(r_multiple) AS total_r, avg(r_multiple) AS expectancy_r,
  CASE WHEN sum(r_multiple) FILTER (r_multiple < 0) < 0 THEN coalesce(sum(r_multiple) FILTER (r_multiple > 0), 0) / -sum(r_multiple) FILTER (r_multiple < 0) WHEN count(*) FILTER (r_multiple > 0) > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS profit_factor FROM {t} GROUP BY {k}"""
CELLS = "(0, 200.0, 300.0), (1, 200.0, 600.0), (2, 200.0, 900.0), (3, 400.0, 300.0), (4, 400.0, 600.0), (5, 400.0, 900.0)"


def w(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip().lstrip(',')} {body}"


ORACLES: dict[str, str] = {
    "scan_bars_from_ticks": w(BARS, "SELECT symbol, ts, bar_index, open, high, low, close, volume FROM bars"),
    "one_minute_bars": "SELECT event_type AS symbol, time_bucket(INTERVAL 1 MINUTE, e.ts) AS ts, arg_min(value, e.ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, e.ts) AS close, count(*)::DOUBLE AS volume FROM events e GROUP BY ALL",
    "resample_4h_local": w(BARS, "SELECT symbol, time_bucket(INTERVAL 4 HOUR, b.ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume FROM bars b GROUP BY ALL"),
    "resample_daily_local": w(BARS, "SELECT symbol, date_trunc('day', b.ts - INTERVAL 5 HOUR)::TIMESTAMP + INTERVAL 5 HOUR AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume FROM bars b GROUP BY ALL"),
    "infer_interval": w(BARS, ", g AS (SELECT symbol, epoch_us(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / 1e6 AS gap FROM bars), c AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL) SELECT symbol, arg_max(gap, (n, -gap)) AS interval_s FROM c GROUP BY symbol"),
    "validate_ohlcv": "WITH h AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, value, json_extract_string(props, '$.k')::DOUBLE AS volume FROM events), g AS (SELECT *, count(*) OVER (PARTITION BY symbol, ts) AS copies, epoch_us(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / 1e6 AS gap FROM h) SELECT symbol, count(*) FILTER (copies > 1) AS duplicate_timestamps, sum((value IS NULL)::INT * 4 + (volume IS NULL)::INT)::BIGINT AS missing_values, 0::BIGINT AS high_below_low, 0::BIGINT AS open_close_outside_range, count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (gap > 10800) AS significant_gaps FROM g GROUP BY symbol",
    "duplicate_report": w(HOURLY, ", r AS (SELECT row_id, count(*) OVER d AS group_size, row_number() OVER (PARTITION BY symbol, ts ORDER BY row_id) AS position, min(p) OVER d = max(p) OVER d AS same_p, min(volume) OVER d = max(volume) OVER d AS same_v FROM h WINDOW d AS (PARTITION BY symbol, ts)) SELECT row_id, group_size, position, same_p AND same_v AS exact_duplicate_group, same_p AS ohlc_identical_group, same_p AND NOT same_v AS volume_conflict FROM r WHERE group_size > 1"),
    "dedupe_lowest_volume": w(HOURLY, "SELECT row_id, symbol, ts, volume FROM h QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY volume, row_id) = 1"),
    "tag_session": w(BARS, "SELECT symbol, ts, sod, session, session_date, week_key, month_key FROM bars"),
    "session_brackets": w(BARS, "SELECT symbol, ts, floor(epoch(local_ts - (session_date::TIMESTAMP - INTERVAL 6 HOUR)) / 1800)::INT AS bracket FROM bars"),
    "time_buckets": w(ET, f"SELECT trade_id, {LOCAL}::DATE AS entry_date, hour({LOCAL})::INT AS hour, minute({LOCAL})::INT AS minute, strftime({LOCAL}, '%H') || ':00' AS hour_bucket, strftime({LOCAL}, '%H') || CASE WHEN minute({LOCAL}) < 30 THEN ':00' ELSE ':30' END AS half_hour_bucket, {SEGMENT} AS rth_segment FROM trades"),
    "contract_segments": w(BARS, ", c AS (SELECT *, 'C' || strftime(week_key, '%m%d') AS contract FROM bars), d AS (SELECT *, (contract IS DISTINCT FROM lag(contract, 1, contract) OVER (PARTITION BY symbol ORDER BY ts))::INT AS chg FROM c), s AS (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY ts)::BIGINT AS segment_id FROM d) SELECT symbol, segment_id, contract, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_bars FROM s GROUP BY symbol, segment_id, contract"),
    "roll_gaps": w(BARS, ", c AS (SELECT *, 'C' || strftime(week_key, '%m%d') AS contract FROM bars), d AS (SELECT symbol, ts, lag(contract) OVER (PARTITION BY symbol ORDER BY ts) AS from_contract, contract AS to_contract, open - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM c) SELECT symbol, ts, from_contract, to_contract, round(g + 3.7e-10, 7) AS gap_points, round(g / 0.25 + 3.7e-10, 7) AS gap_ticks FROM d WHERE from_contract <> to_contract"),
    "derive_parents": w(BARS, "SELECT symbol, time_bucket(INTERVAL 2 HOUR, b.ts) AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume, count(*) AS n_sub, count(*) = 4 AS complete FROM bars b GROUP BY symbol, time_bucket(INTERVAL 2 HOUR, b.ts)"),
    "parent_volume_match": w(BARS, ", q AS (SELECT symbol, time_bucket(INTERVAL 30 MINUTE, tts) AS ts, count(*) AS v, count(DISTINCT time_bucket(INTERVAL 15 MINUTE, tts)) AS n_lower FROM ticks GROUP BY ALL) SELECT b.symbol, b.ts, n_lower, CASE WHEN q.v IS NULL THEN 'lower_group_unavailable' WHEN q.v = b.volume THEN 'matched_one' ELSE 'no_primary_volume_match' END AS status FROM bars b LEFT JOIN q ON b.symbol = q.symbol AND b.ts = q.ts"),
    "current_opens": w(LEVELED, "SELECT symbol, ts, dOpen, wOpen, mOpen FROM leveled"),
    "prior_period_levels": w(BARS + "," + prior("d", "session_date") + "," + prior("w", "week_key") + "," + prior("m", "month_key"), "SELECT b.symbol, b.ts, " + ", ".join(f"p{p}{c}" for p in "dwm" for c in ("Open", "High", "Low", "EQ")) + " FROM bars b JOIN d_prev d USING (symbol, session_date) JOIN w_prev w USING (symbol, week_key) JOIN m_prev m USING (symbol, month_key)"),
    "session_levels": w(BARS, """, f AS (SELECT symbol, session_date, min(ts) FILTER (session = 'RTH') AS fr, arg_min(open, ts) FILTER (session = 'RTH') AS ro, max(high) FILTER (session = 'RTH') AS rh, min(low) FILTER (session = 'RTH') AS rl, arg_max(close, ts) FILTER (session = 'RTH') AS rc,
      max(high) FILTER (session = 'ETH' AND (sod >= 64800 OR sod < 34200)) AS onh, min(low) FILTER (session = 'ETH' AND (sod >= 64800 OR sod < 34200)) AS onl FROM bars GROUP BY ALL),
      p AS (SELECT *, lag(onh) OVER w AS pONH, lag(onl) OVER w AS pONL, lag(ro) OVER w AS pRTH_Open, lag(rh) OVER w AS pRTH_High, lag(rl) OVER w AS pRTH_Low, lag(rc) OVER w AS prevSettlement FROM f WINDOW w AS (PARTITION BY symbol ORDER BY session_date))
      SELECT b.symbol, b.ts, CASE WHEN b.ts >= fr THEN ro END AS RTH_Open, CASE WHEN b.ts >= fr THEN onh END AS ONH, CASE WHEN b.ts >= fr THEN onl END AS ONL, pONH, pONL, pRTH_Open, pRTH_High, pRTH_Low, prevSettlement FROM bars b JOIN p USING (symbol, session_date)"""),
    "asia_london_levels": w(BARS, """, f AS (SELECT symbol, session_date, max(high) FILTER (session = 'ETH' AND sod >= 72000) AS ah, min(low) FILTER (session = 'ETH' AND sod >= 72000) AS al, max(high) FILTER (session = 'ETH' AND sod >= 7200 AND sod < 18000) AS lh, min(low) FILTER (session = 'ETH' AND sod >= 7200 AND sod < 18000) AS ll FROM bars GROUP BY ALL)
      SELECT b.symbol, b.ts, CASE WHEN local_ts >= session_date THEN ah END AS AsiaHigh, CASE WHEN local_ts >= session_date THEN al END AS AsiaLow, CASE WHEN local_ts >= session_date::TIMESTAMP + INTERVAL 5 HOUR THEN lh END AS LondonHigh, CASE WHEN local_ts >= session_date::TIMESTAMP + INTERVAL 5 HOUR THEN ll END AS LondonLow FROM bars b JOIN f USING (symbol, session_date)"""),
    "opening_range": w(BARS, ", f AS (SELECT symbol, session_date, max(high) FILTER (sod >= 34200 AND sod < 36000) AS h, min(low) FILTER (sod >= 34200 AND sod < 36000) AS l FROM bars GROUP BY ALL) SELECT b.symbol, b.ts, CASE WHEN local_ts >= session_date::TIMESTAMP + INTERVAL 10 HOUR THEN h END AS OR_High, CASE WHEN local_ts >= session_date::TIMESTAMP + INTERVAL 10 HOUR THEN l END AS OR_Low FROM bars b JOIN f USING (symbol, session_date)"),
    "sma": w(BARS, "SELECT symbol, ts, round(CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END + 3.7e-10, 7) AS SMA_20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)"),
    "ema": w(BARS.replace("ticks AS", "RECURSIVE ticks AS", 1), ", r AS (SELECT symbol, bar_index, ts, close AS e FROM bars WHERE bar_index = 0 UNION ALL SELECT b.symbol, b.bar_index, b.ts, r.e * (1 - 2.0::DOUBLE / 21) + b.close * (2.0::DOUBLE / 21) FROM r JOIN bars b ON b.symbol = r.symbol AND b.bar_index = r.bar_index + 1) SELECT symbol, ts, round(CASE WHEN bar_index >= 19 THEN e END + 3.7e-10, 7) AS EMA_20 FROM r"),
    "htf_sma_asof": w(BARS, ", h AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, b.ts) AS hts, arg_max(close, b.ts) AS c FROM bars b GROUP BY ALL), s AS (SELECT symbol, hts + INTERVAL 1 HOUR AS known, CASE WHEN count(*) OVER w = 5 THEN avg(c) OVER w END AS v FROM h WINDOW w AS (PARTITION BY symbol ORDER BY hts ROWS 4 PRECEDING)) SELECT b.symbol, b.ts, round(s.v + 3.7e-10, 7) AS SMA_5_1h FROM bars b ASOF LEFT JOIN (SELECT * FROM s WHERE v IS NOT NULL) s ON b.symbol = s.symbol AND b.ts >= s.known"),
    "rolling_vwap": w(BARS, f"SELECT symbol, ts, round(sum({TYP} * volume) OVER w / sum(volume) OVER w + 3.7e-10, 7) AS VWAP_rolling_4h FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '14399.999999 seconds' PRECEDING AND CURRENT ROW)"),
    "session_vwap": w(BARS, "SELECT symbol, ts, " + ", ".join(f"round(sum({TYP} * volume) OVER {n} / sum(volume) OVER {n} + 3.7e-10, 7) AS {c}" for n, c in (("d", "dVWAP"), ("w", "wVWAP"), ("m", "mVWAP"))) + f", round(CASE WHEN session = 'RTH' THEN sum({TYP} * volume) OVER r / sum(volume) OVER r END + 3.7e-10, 7) AS dVWAP_RTH FROM bars WINDOW d AS (PARTITION BY symbol, session_date ORDER BY ts ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY symbol, week_key ORDER BY ts ROWS UNBOUNDED PRECEDING), m AS (PARTITION BY symbol, month_key ORDER BY ts ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY symbol, session_date, session ORDER BY ts ROWS UNBOUNDED PRECEDING)"),
    "atr": w(BARS, ", t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, ts, round(avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) + 3.7e-10, 7) AS ATR_14 FROM t"),
    "value_area": w(BARS.replace("ticks AS", "RECURSIVE ticks AS", 1), f""", bins AS (SELECT symbol, session_date, round_even({TYP} / 25, 0)::BIGINT AS bin, sum(volume) AS v FROM bars GROUP BY ALL),
      k AS (SELECT symbol, session_date, list(bin ORDER BY bin) AS b, list(v ORDER BY bin) AS v, sum(v) AS total, arg_max(bin, (v, -bin)) AS poc FROM bins GROUP BY ALL),
      r AS (SELECT *, list_position(b, poc) AS lo, list_position(b, poc) AS hi, v[list_position(b, poc)] AS cum FROM k UNION ALL
        SELECT symbol, session_date, b, v, total, poc, CASE WHEN up THEN lo ELSE lo - 1 END, CASE WHEN up THEN hi + 1 ELSE hi END, cum + CASE WHEN up THEN rv ELSE lv END FROM (SELECT *, rv > lv AS up FROM (SELECT *, CASE WHEN lo > 1 THEN v[lo - 1] ELSE -1 END AS lv, CASE WHEN hi < len(b) THEN v[hi + 1] ELSE -1 END AS rv FROM r)) WHERE cum < total * 0.7::DOUBLE AND (lv >= 0 OR rv >= 0))
      SELECT symbol, session_date, any_value(poc) * 25.0::DOUBLE AS POC, b[max(hi)] * 25.0::DOUBLE AS VAH, b[min(lo)] * 25.0::DOUBLE AS VAL FROM r GROUP BY symbol, session_date, b"""),
    "prior_profile_levels": w(BARS, f", bins AS (SELECT symbol, session_date, round_even({TYP} / 25, 0)::BIGINT AS bin, sum(volume) AS v FROM bars GROUP BY ALL), k AS (SELECT symbol, session_date, arg_max(bin, (v, -bin)) * 25.0::DOUBLE AS poc FROM bins GROUP BY ALL), p AS (SELECT symbol, session_date, lag(poc) OVER (PARTITION BY symbol ORDER BY session_date) AS pdPOC FROM k) SELECT b.symbol, b.ts, pdPOC FROM bars b JOIN p USING (symbol, session_date)"),
    "rolling_poc": w(BARS, f", m AS (SELECT a.symbol, a.ts, round_even((b.high + b.low + b.close) / 3 / 25, 0)::BIGINT AS bin, sum(b.volume) AS v FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 6 HOUR GROUP BY ALL) SELECT symbol, ts, arg_max(bin, (v, -bin)) * 25.0::DOUBLE AS POC_rolling_6h FROM m GROUP BY symbol, ts"),
    "pivots": w(BARS, """, f AS (SELECT symbol, ts, high, low, high > lag(high, 1) OVER w AND high > lag(high, 2) OVER w AND high > lead(high, 1) OVER w AND high > lead(high, 2) OVER w AS ph, low < lag(low, 1) OVER w AND low < lag(low, 2) OVER w AND low < lead(low, 1) OVER w AND low < lead(low, 2) OVER w AS pl FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      h AS (SELECT symbol, ts + INTERVAL 90 MINUTE AS known, high FROM f WHERE ph), l AS (SELECT symbol, ts + INTERVAL 90 MINUTE AS known, low FROM f WHERE pl)
      SELECT b.symbol, b.ts, h.high AS Pivot_High, l.low AS Pivot_Low FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.known ASOF LEFT JOIN l ON b.symbol = l.symbol AND b.ts >= l.known"""),
    "single_prints": w(BARS, """, r AS (SELECT *, floor((sod - 34200) / 1800)::INT AS br FROM bars WHERE session = 'RTH'), t AS (SELECT DISTINCT symbol, session_date, br, unnest(generate_series(round_even(low, 0)::BIGINT, round_even(high, 0)::BIGINT)) AS k FROM r),
      l AS (SELECT symbol, session_date, k, br AS since, lead(br) OVER w AS until, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY symbol, session_date, k ORDER BY br)),
      m AS (SELECT r.symbol, r.ts, min(k) FILTER (k > close)::DOUBLE AS a, max(k) FILTER (k < close)::DOUBLE AS d FROM r JOIN l ON r.symbol = l.symbol AND r.session_date = l.session_date AND n = 1 AND since < br AND (until IS NULL OR until >= br) GROUP BY ALL)
      SELECT b.symbol, b.ts, a AS dSinglePrint_30m_NearestAbove, d AS dSinglePrint_30m_NearestBelow FROM bars b LEFT JOIN m ON b.symbol = m.symbol AND b.ts = m.ts"""),
    "apoc": w(BARS, f", bins AS (SELECT symbol, session_date, round_even({TYP}, 0)::BIGINT AS bin, sum(volume) AS v FROM bars WHERE sod >= 34200 AND sod < 36000 GROUP BY ALL), k AS (SELECT symbol, session_date, arg_max(bin, (v, -bin))::DOUBLE AS a FROM bins GROUP BY ALL), s AS (SELECT DISTINCT symbol, session_date FROM bars WHERE session = 'RTH'), j AS (SELECT s.*, a, lag(a) OVER (PARTITION BY s.symbol ORDER BY s.session_date) AS p FROM s LEFT JOIN k USING (symbol, session_date)) SELECT b.symbol, b.ts, CASE WHEN session = 'RTH' AND sod >= 36000 THEN a END AS APOC, CASE WHEN session = 'RTH' THEN p END AS pAPOC FROM bars b LEFT JOIN j USING (symbol, session_date)"),
    "naked_flags": w(LEVELED, ", f AS (SELECT *, pdHigh IS NOT NULL AND coalesce(pdHigh <> lag(pdHigh) OVER (PARTITION BY symbol ORDER BY ts), true) AS formed FROM leveled), g AS (SELECT *, sum((formed OR pdHigh IS NULL)::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS life FROM f) SELECT symbol, ts, pdHigh, pdHigh IS NOT NULL AND max(coalesce(NOT formed AND low <= pdHigh AND high >= pdHigh, false)::INT) OVER (PARTITION BY symbol, life ORDER BY ts ROWS UNBOUNDED PRECEDING) = 0 AS pdHigh_naked FROM g"),
    "anchor_zones": w(LEVELED, """, v AS (SELECT symbol, bar_index, pdEQ, coalesce(abs(dOpen - pdEQ) / 0.25 <= 200 + 1e-9, false) AS a, coalesce(abs(wOpen - pdEQ) / 0.25 <= 400 + 1e-9, false) AS b, coalesce(abs(pdOpen - pdEQ) / 0.25 <= 400 + 1e-9, false) AS c, dOpen, wOpen, pdOpen FROM leveled WHERE pdEQ IS NOT NULL)
      SELECT symbol, bar_index, least(pdEQ, CASE WHEN a THEN dOpen END, CASE WHEN b THEN wOpen END, CASE WHEN c THEN pdOpen END) AS zone_low, greatest(pdEQ, CASE WHEN a THEN dOpen END, CASE WHEN b THEN wOpen END, CASE WHEN c THEN pdOpen END) AS zone_high, a::INT + b::INT + c::INT AS valid_count,
      concat_ws('|', 'pdEQ', CASE WHEN a THEN 'dOpen' END, CASE WHEN b THEN 'wOpen' END, CASE WHEN c THEN 'pdOpen' END) AS level_names FROM v WHERE a OR b OR c"""),
    "trigger_timeframe_bars": w(LEVELED, "SELECT symbol, time_bucket(INTERVAL 2 HOUR, l.ts) AS ts, arg_min(open, bar_index) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_index) AS close, sum(volume) AS volume, min(bar_index) AS base_start_bar_index, max(bar_index) AS base_end_bar_index, arg_max(pdHigh, bar_index) FILTER (pdHigh IS NOT NULL) AS pdHigh FROM leveled l GROUP BY symbol, time_bucket(INTERVAL 2 HOUR, l.ts)"),
    "simulate_fixed_bracket": w(simulated(), f"SELECT {TRADE} FROM trades"),
    "simulate_unlimited": w(simulated(hold=None), f"SELECT {TRADE} FROM trades"),
    "simulate_trailing_unlimited": w(simulated("(0, 1600.0, 2400.0)", be=True, hold=None), f"SELECT {TRADE} FROM trades"),
    "simulate_costs_session_close": w(simulated(slip=1.0, commission=2.5, close=True), f"SELECT {TRADE} FROM trades"),
    "simulate_path_model": w(simulated(model="path"), f"SELECT {TRADE} FROM trades"),
    "simulate_trailing": w(simulated(be=True), f"SELECT {TRADE} FROM trades"),
    "simulate_retrace_entry": w(simulated("(0, 40.0, 60.0)", retrace=True), f"SELECT {TRADE} FROM trades"),
    "simulate_retrace_path": w(simulated("(0, 40.0, 60.0)", model="path", retrace=True), f"SELECT {TRADE} FROM trades"),
    "simulate_subtimeframe_strict": w(simulated(sub="filled"), f"SELECT {TRADE} FROM trades"),
    "simulate_subtimeframe_conservative": w(simulated(sub="whole"), f"SELECT {TRADE} FROM trades"),
    "simulate_subtimeframe": w(simulated(), """, sub AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, tts) AS sts, max(price) AS high, min(price) AS low FROM ticks GROUP BY ALL),
      m AS (SELECT t.symbol, t.signal_id, s.sts, CASE WHEN CASE direction WHEN 'long' THEN low <= stop_price ELSE high >= stop_price END THEN 'SL' WHEN CASE direction WHEN 'long' THEN high >= target_price ELSE low <= target_price END THEN 'TP' END AS kind FROM trades t JOIN sub s ON s.symbol = t.symbol AND time_bucket(INTERVAL 30 MINUTE, s.sts) = t.exit_ts)
      SELECT symbol, signal_id, arg_min(kind, sts) FILTER (kind IS NOT NULL) AS resolved FROM m GROUP BY symbol, signal_id"""),
    "entry_window_filter": w(ET, f"SELECT trade_id, symbol, (hour({LOCAL}) * 3600 + minute({LOCAL}) * 60 + second({LOCAL}))::INT AS sod FROM trades WHERE {SEGMENT} IN ('rth_open_30m', 'rth_morning')"),
    "direction_summary": w(ET, stats("direction", warn=None, bars=True)),
    "group_summary": w(ET + f", t AS (SELECT *, {SEGMENT} AS rth_segment FROM trades)", stats("symbol, rth_segment", source="t", bars=True)),
    "pivot_heatmap": w(ET + f", t AS (SELECT *, {SEGMENT} AS rth_segment FROM trades)", "SELECT symbol, " + ", ".join(f"round(avg(r_multiple) FILTER (rth_segment = '{x}') + 3.7e-10, 7) AS {x}" for x in ("pre_rth", "rth_morning", "post_rth")) + " FROM t GROUP BY symbol"),
    "equity_curve": w(ET, ", c AS (SELECT symbol, trade_id, exit_ts, sum(r_multiple) OVER (PARTITION BY symbol ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS c FROM trades) SELECT symbol, trade_id, round(c + 3.7e-10, 7) AS cum_r, round(greatest(max(c) OVER (PARTITION BY symbol ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING), 0) - c + 3.7e-10, 7) AS drawdown_r FROM c"),
    "streaks": w(ET, ", i AS (SELECT symbol, sign(r_multiple) AS s, row_number() OVER (PARTITION BY symbol ORDER BY exit_ts, trade_id) - row_number() OVER (PARTITION BY symbol, sign(r_multiple) ORDER BY exit_ts, trade_id) AS g FROM trades), n AS (SELECT symbol, s, g, count(*) AS n FROM i GROUP BY ALL) SELECT symbol, coalesce(max(n) FILTER (s = 1), 0) AS max_consecutive_wins, coalesce(max(n) FILTER (s = -1), 0) AS max_consecutive_losses FROM n GROUP BY symbol"),
    "trade_count_diagnostics": w(ET, "SELECT symbol, level_names, count(*) AS trade_count, CASE WHEN count(*) < 30 THEN 'insufficient' WHEN count(*) < 100 THEN 'limited' ELSE 'reasonable' END AS status FROM trades GROUP BY symbol, level_names"),
    "worst_losers": w(ET, "SELECT trade_id, round(r_multiple + 3.7e-10, 7) AS r_multiple FROM (SELECT trade_id, r_multiple FROM trades WHERE r_multiple < 0 ORDER BY r_multiple, trade_id LIMIT 20)"),
    "combo_attribution": w(ET + ", t AS (SELECT *, array_to_string(list_sort(string_split(level_names, '|')), '|') AS combo FROM trades WHERE level_names <> '')", stats("combo, direction", ", arg_min(level_names, (exit_ts, trade_id)) AS example", source="t")),
    "level_membership": w(ET + ", t AS (SELECT *, unnest(string_split(level_names, '|')) AS level FROM trades WHERE level_names <> '')", stats("level", source="t")),
    "level_count_buckets": w(ET + ", t AS (SELECT *, CASE WHEN level_names = '' THEN '(unknown)' ELSE len(string_split(level_names, '|'))::VARCHAR END AS bucket FROM trades)", stats("bucket", source="t")),
    "level_pairs": w(ET + ", u AS (SELECT *, unnest(string_split(level_names, '|')) AS a FROM trades WHERE level_names <> ''), t AS (SELECT x.*, x.a || '|' || y.a AS pair FROM u x JOIN u y ON x.trade_id = y.trade_id AND x.a < y.a)", stats("pair", source="t")),
    "anchor_pairs": w(ET + ", u AS (SELECT *, unnest(string_split(level_names, '|')) AS a FROM trades WHERE list_contains(string_split(level_names, '|'), 'dOpen')), t AS (SELECT *, 'dOpen|' || a AS pair FROM u WHERE a <> 'dOpen')", stats("pair", source="t")),
    "excursion_distribution": w(ET + "," + EXC, "SELECT symbol, direction, count(*) AS trade_count, " + ", ".join(f"round(avg({c}) + 3.7e-10, 7) AS mean_{c}, " + ", ".join(f"round(quantile_cont({c}, {q}) + 3.7e-10, 7) AS {n}_{c}" for n, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95))) for c in ("mae_r", "mfe_r", "giveback_r")) + " FROM x GROUP BY symbol, direction"),
    "excursion_quadrants": w(ET + "," + EXC, "SELECT CASE WHEN mfe_r >= 1 THEN 'high_mfe_' ELSE 'low_mfe_' END || CASE WHEN mae_r >= 0.5 THEN 'high_mae' ELSE 'low_mae' END AS quadrant, count(*) AS trade_count, round(avg(r_multiple) + 3.7e-10, 7) AS avg_r FROM x GROUP BY 1"),
    "sl_tp_probability_grid": w(ET + "," + EXC, "SELECT s::DOUBLE AS stop_r, t::DOUBLE AS target_r, count(*) AS evaluated, count(*) FILTER (mae_r >= s AND mfe_r < t) AS stop_only, count(*) FILTER (mae_r < s AND mfe_r >= t) AS target_only, count(*) FILTER (mae_r >= s AND mfe_r >= t) AS ambiguous, count(*) FILTER (mae_r < s AND mfe_r < t) AS unresolved, round(count(*) FILTER (mae_r < s AND mfe_r >= t) / count(*) + 3.7e-10, 7) AS target_probability FROM x, (VALUES (0.5), (1.0), (1.5)) a(s), (VALUES (1.0), (2.0), (3.0)) b(t) GROUP BY s, t"),
    "edge_ratio": w(ET + "," + EXC, "SELECT CASE WHEN bars_held <= 1 THEN '(0,1]' WHEN bars_held <= 3 THEN '(1,3]' WHEN bars_held <= 5 THEN '(3,5]' WHEN bars_held <= 10 THEN '(5,10]' WHEN bars_held <= 20 THEN '(10,20]' ELSE '>20' END AS bucket, count(*) AS trade_count, round(avg(edge_ratio) + 3.7e-10, 7) AS avg_edge_ratio, round(avg(r_multiple) + 3.7e-10, 7) AS avg_r FROM x GROUP BY 1"),
    "grid_search": w(simulated(CELLS) + ", s AS (" + SUMMARY.format(k="cell_id, stop_ticks, target_ticks", t="trades") + ")", "SELECT cell_id, stop_ticks::DOUBLE AS stop_ticks, target_ticks::DOUBLE AS target_ticks, trade_count, round(win_rate + 3.7e-10, 7) AS win_rate, round(expectancy_r + 3.7e-10, 7) AS expectancy_r, round(total_r + 3.7e-10, 7) AS total_r, round(profit_factor + 3.7e-10, 7) AS profit_factor FROM s"),
    "best_grid_cell": w(simulated(CELLS) + ", s AS (" + SUMMARY.format(k="cell_id, stop_ticks, target_ticks", t="trades") + ")", "SELECT cell_id, stop_ticks::DOUBLE AS stop_ticks, target_ticks::DOUBLE AS target_ticks, trade_count, round(expectancy_r + 3.7e-10, 7) AS expectancy_r FROM s ORDER BY s.expectancy_r DESC, s.stop_ticks, s.target_ticks LIMIT 1"),
    "sensitivity_oat": w(simulated("(0, 400.0, 600.0), (1, 300.0, 600.0), (2, 350.0, 600.0), (3, 450.0, 600.0), (4, 500.0, 600.0), (5, 400.0, 450.0), (6, 400.0, 525.0), (7, 400.0, 675.0), (8, 400.0, 750.0)"), "SELECT cell_id, stop_ticks::DOUBLE AS stop_ticks, target_ticks::DOUBLE AS target_ticks, count(*) AS trade_count, round(avg(r_multiple) + 3.7e-10, 7) AS expectancy_r FROM trades GROUP BY ALL"),
    "walk_forward_all": w(simulated(CELLS) + """, folds AS (SELECT i AS fold_id, 200 * i AS a, 200 * i + 400 AS b, 200 * i + 600 AS d FROM (SELECT unnest(generate_series(0, (SELECT CASE WHEN max(bar_index) + 1 < 600 THEN -1 ELSE (max(bar_index) + 1 - 600) // 200 END FROM bars))) AS i) t),
      tr AS (SELECT fold_id, cell_id, stop_ticks, target_ticks, count(*) AS n, avg(r_multiple) AS m FROM trades, folds WHERE entry_bar_index >= a AND exit_bar_index < b GROUP BY ALL),
      best AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY m DESC, stop_ticks, target_ticks) = 1),
      te AS (SELECT fold_id, cell_id, count(*) AS n, avg(r_multiple) AS m FROM trades, folds WHERE entry_bar_index >= b AND exit_bar_index < d GROUP BY ALL)""", "SELECT b.fold_id::INT AS fold_id, b.cell_id, b.n AS train_trades, round(b.m + 3.7e-10, 7) AS train_metric, te.n AS test_trades, round(te.m + 3.7e-10, 7) AS test_metric FROM best b LEFT JOIN te ON b.fold_id = te.fold_id AND b.cell_id = te.cell_id"),
    "wfa_matrix_all": w(simulated(CELLS) + """, folds AS (SELECT 0 AS matrix_id, i AS fold_id, 150 * i AS a, 150 * i + 300 AS b, 150 * i + 450 AS d FROM (SELECT unnest(generate_series(0, (SELECT CASE WHEN max(bar_index) + 1 < 450 THEN -1 ELSE (max(bar_index) + 1 - 450) // 150 END FROM bars))) AS i) t UNION ALL SELECT 1, i, 300 * i, 300 * i + 300, 300 * i + 600 FROM (SELECT unnest(generate_series(0, (SELECT CASE WHEN max(bar_index) + 1 < 600 THEN -1 ELSE (max(bar_index) + 1 - 600) // 300 END FROM bars))) AS i) t UNION ALL SELECT 2, i, 150 * i, 150 * i + 600, 150 * i + 750 FROM (SELECT unnest(generate_series(0, (SELECT CASE WHEN max(bar_index) + 1 < 750 THEN -1 ELSE (max(bar_index) + 1 - 750) // 150 END FROM bars))) AS i) t),
      tr AS (SELECT matrix_id, fold_id, cell_id, stop_ticks, target_ticks, avg(r_multiple) AS m FROM trades, folds WHERE entry_bar_index >= a AND exit_bar_index < b GROUP BY ALL),
      best AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY matrix_id, fold_id ORDER BY m DESC, stop_ticks, target_ticks) = 1),
      te AS (SELECT matrix_id, fold_id, cell_id, sum(r_multiple) AS s, avg(r_multiple) AS m FROM trades, folds WHERE entry_bar_index >= b AND exit_bar_index < d GROUP BY ALL)""", "SELECT b.matrix_id, count(*) AS folds, round(avg(te.m) + 3.7e-10, 7) AS mean_test, round(sum(te.s) + 3.7e-10, 7) AS oos_total_r FROM best b LEFT JOIN te ON b.matrix_id = te.matrix_id AND b.fold_id = te.fold_id AND b.cell_id = te.cell_id GROUP BY b.matrix_id"),
    "permutation_test": w(NUM, f", p AS (SELECT symbol, day, sim, avg(CASE WHEN (({DRAW('sim', 'pos', 2)}) % 1009) % 2 = 0 THEN r_multiple ELSE -r_multiple END) AS m, avg(r_multiple) AS o FROM num, range(50) s(sim) GROUP BY ALL) SELECT symbol, day, round(max(o) + 3.7e-10, 7) AS observed_mean, round(avg((round(m + 3.7e-10, 7) >= round(o + 3.7e-10, 7))::INT::DOUBLE) + 3.7e-10, 7) AS p_value FROM p GROUP BY symbol, day"),
    "mc_block": w(NUM, f", q AS (SELECT symbol, day, sim, pos, ((({DRAW('sim', 'floor(pos / 4)', 3)}) % n) + pos % 4) % n AS pick FROM num, range(20) s(sim)), p AS (SELECT q.symbol, q.day, q.sim, q.pos, num.r_multiple AS r FROM q JOIN num ON q.symbol = num.symbol AND q.day = num.day AND q.pick = num.pos), c AS (SELECT *, sum(r) OVER (PARTITION BY symbol, day, sim ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM p), e AS (SELECT *, greatest(max(cum) OVER (PARTITION BY symbol, day, sim ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM c) SELECT symbol, day, sim::INT AS sim, round(sum(r) + 3.7e-10, 7) AS final_r, round(max(dd) + 3.7e-10, 7) AS max_drawdown_r FROM e GROUP BY symbol, day, sim"),
    "trade_summary": w(ET, """, c AS (SELECT *, sum(r_multiple) OVER (PARTITION BY symbol ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM trades), d AS (SELECT *, greatest(max(cum) OVER (PARTITION BY symbol ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM c),
      s AS (SELECT symbol, count(*) AS trade_count, avg(r_multiple) AS avg_r, median(r_multiple) AS median_r, sum(r_multiple) AS total_r, stddev_samp(r_multiple) AS std_r, skewness(r_multiple) AS skew_r, kurtosis(r_multiple) AS kurtosis_r, max(dd) AS max_drawdown_r, sqrt(avg(dd * dd)) AS ulcer_index_r FROM d GROUP BY symbol)
      SELECT symbol, trade_count, round(avg_r + 3.7e-10, 7) AS avg_r, round(median_r + 3.7e-10, 7) AS median_r, round(total_r + 3.7e-10, 7) AS total_r, round(std_r + 3.7e-10, 7) AS std_r, round(skew_r + 3.7e-10, 7) AS skew_r, round(kurtosis_r + 3.7e-10, 7) AS kurtosis_r, round(max_drawdown_r + 3.7e-10, 7) AS max_drawdown_r, round(ulcer_index_r + 3.7e-10, 7) AS ulcer_index_r, round(avg_r / std_r + 3.7e-10, 7) AS sharpe_r FROM s"""),
    "otf_state": w(BARS, """, a AS (SELECT symbol, session_date, time_bucket(INTERVAL 1 HOUR, b.ts) AS ts, max(high) AS high, min(low) AS low, count(*) AS n FROM bars b GROUP BY symbol, session_date, time_bucket(INTERVAL 1 HOUR, b.ts)),
      f AS (SELECT *, coalesce(low > lag(low) OVER w, false) AS up, coalesce(high < lag(high) OVER w, false) AS down, row_number() OVER w AS i FROM a WHERE n = 2 WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts)),
      s AS (SELECT symbol, ts, i, i - coalesce(max(CASE WHEN NOT up THEN i END) OVER w, 0) AS up_run, i - coalesce(max(CASE WHEN NOT down THEN i END) OVER w, 0) AS down_run FROM f WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts ROWS UNBOUNDED PRECEDING))
      SELECT symbol, ts, up_run, down_run, CASE WHEN i = 1 THEN 'unknown' WHEN up_run >= 2 AND down_run < 2 THEN 'up' WHEN down_run >= 2 AND up_run < 2 THEN 'down' ELSE 'neutral' END AS state FROM s"""),
    "prev30m_vwap": w(BARS, f""", r AS (SELECT symbol, ts, session_date, floor(epoch(local_ts - (session_date::TIMESTAMP - INTERVAL 6 HOUR)) / 1800)::INT AS br, {TYP} AS tp, volume FROM bars),
      z AS (SELECT symbol, session_date, br AS formed, sum(tp * volume) / sum(volume) AS v FROM r GROUP BY ALL), s AS (SELECT symbol, session_date, lead(session_date) OVER (PARTITION BY symbol ORDER BY session_date) AS nd FROM (SELECT DISTINCT symbol, session_date FROM r)),
      q AS (SELECT z.*, max(formed) OVER (PARTITION BY symbol, session_date) AS lastf FROM z), seeds AS (SELECT q.symbol, nd AS session_date, -row_number() OVER (PARTITION BY q.symbol, q.session_date ORDER BY formed DESC) AS formed, v FROM q JOIN s USING (symbol, session_date) WHERE lastf + 1 <= formed + 3 AND nd IS NOT NULL),
      pool AS (SELECT symbol, session_date, formed, v FROM z UNION ALL SELECT * FROM seeds), m AS (SELECT DISTINCT r.symbol, r.session_date, r.br, formed, v FROM r JOIN pool p ON r.symbol = p.symbol AND r.session_date = p.session_date AND p.formed < r.br AND r.br <= p.formed + 3),
      h AS (SELECT symbol, session_date, br, list(v ORDER BY formed DESC) AS l FROM m GROUP BY ALL)
      SELECT r.symbol, r.ts, round(l[1] + 3.7e-10, 7) AS "prev30mVWAP", round(l[2] + 3.7e-10, 7) AS "prev30mVWAP_2", round(l[3] + 3.7e-10, 7) AS "prev30mVWAP_3" FROM r LEFT JOIN h USING (symbol, session_date, br)"""),
    "bootstrap_ci": w(NUM, f", d AS (SELECT symbol, day, sim, (({DRAW('sim', 'pos', 1)}) % n) AS pick FROM num, range(50) s(sim)), m AS (SELECT d.symbol, d.day, d.sim, avg(r_multiple) AS m FROM d JOIN num ON d.symbol = num.symbol AND d.day = num.day AND d.pick = num.pos GROUP BY ALL) SELECT symbol, day, round(quantile_cont(m, 0.025) + 3.7e-10, 7) AS ci_low, round(quantile_cont(m, 0.975) + 3.7e-10, 7) AS ci_high, round(avg(m) + 3.7e-10, 7) AS mean_of_means, round(avg((m > 0)::INT::DOUBLE) + 3.7e-10, 7) AS prob_positive FROM m GROUP BY symbol, day"),
    "mc_skip": w(NUM, f", p AS (SELECT symbol, day, sim, pos, CASE WHEN {DRAW('sim', 'pos', 3)} >= 214748364 THEN r_multiple ELSE 0 END AS r FROM num, range(20) s(sim)), c AS (SELECT *, sum(r) OVER (PARTITION BY symbol, day, sim ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM p), e AS (SELECT *, greatest(max(cum) OVER (PARTITION BY symbol, day, sim ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM c) SELECT symbol, day, sim::INT AS sim, round(sum(r) + 3.7e-10, 7) AS final_r, round(max(dd) + 3.7e-10, 7) AS max_drawdown_r FROM e GROUP BY symbol, day, sim"),
    "mc_reshuffle": w(NUM, f", p AS (SELECT symbol, day, sim, pos, {DRAW('sim', 'pos', 3)} AS o, r_multiple AS r FROM num, range(20) s(sim)), c AS (SELECT *, sum(r) OVER (PARTITION BY symbol, day, sim ORDER BY o, pos ROWS UNBOUNDED PRECEDING) AS cum FROM p), e AS (SELECT *, greatest(max(cum) OVER (PARTITION BY symbol, day, sim ORDER BY o, pos ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM c) SELECT symbol, day, sim::INT AS sim, round(sum(r) + 3.7e-10, 7) AS final_r, round(max(dd) + 3.7e-10, 7) AS max_drawdown_r FROM e GROUP BY symbol, day, sim"),
    "noise_bars": w(BARS, ", n AS (SELECT symbol, bar_index, rep, " + ", ".join(f"{c} + (({DRAW('rep', 'bar_index', 5 + i)}) / 2147483647::DOUBLE * 2 - 1) * ((high - low) * 0.1::DOUBLE) AS n{c}" for i, c in enumerate(("open", "high", "low", "close"))) + " FROM bars, range(3) r(rep)) SELECT symbol, bar_index, rep::INT AS replica_id, round(nopen + 3.7e-10, 7) AS open, round(greatest(nopen, nhigh, nlow, nclose) + 3.7e-10, 7) AS high, round(least(nopen, nhigh, nlow, nclose) + 3.7e-10, 7) AS low, round(nclose + 3.7e-10, 7) AS close FROM n"),
    "sharpe_psr": w(ET, ", m AS (SELECT symbol, count(*) AS n, avg(r_multiple) AS mu, stddev_samp(r_multiple) AS sd FROM trades GROUP BY symbol), g AS (SELECT t.symbol, any_value(n) AS n, any_value(mu / sd) AS sharpe, avg(pow((r_multiple - mu) / sd, 3)) AS g1, avg(pow((r_multiple - mu) / sd, 4)) AS g2 FROM trades t JOIN m USING (symbol) GROUP BY t.symbol) SELECT symbol, n, round(sharpe + 3.7e-10, 7) AS sharpe, round(sharpe * sqrt(n - 1) / sqrt(1 - g1 * sharpe + (g2 - 1) / 4 * sharpe * sharpe) + 3.7e-10, 7) AS z FROM g"),
    "portfolio_correlation": w(ET, ", h AS (SELECT date_trunc('hour', exit_ts) AS x, " + ", ".join(f"coalesce(sum(r_multiple) FILTER (symbol = '{s}'), 0) AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM trades GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{a}' AS setup_a, '{b}' AS setup_b, round(corr({a}, {b}) + 3.7e-10, 7) AS correlation FROM h" for i, a in enumerate(("click", "error", "purchase", "signup", "view")) for b in ("click", "error", "purchase", "signup", "view")[i + 1 :])),
    "study_group_summary": w(ET, ", r AS (SELECT symbol AS core_level, direction, CASE WHEN bars_held > 12 THEN 'otf_5m' ELSE 'no_otf' END AS otf, count(*) AS n, avg(r_multiple) AS a FROM trades GROUP BY ALL) SELECT core_level, count(*) AS cell_count, round(avg(a) + 3.7e-10, 7) AS mean_metric, round(quantile_cont(a, 0.5) + 3.7e-10, 7) AS median_metric, round(avg(n) + 3.7e-10, 7) AS mean_trade_count FROM r WHERE n >= 10 GROUP BY core_level"),
    "otf_delta": w(ET, ", r AS (SELECT symbol AS core_level, direction, CASE WHEN bars_held > 12 THEN 'otf_5m' ELSE 'no_otf' END AS otf, count(*) AS n, avg(r_multiple) AS a FROM trades GROUP BY ALL) SELECT x.core_level, x.direction, x.otf AS variant, round(x.a - y.a + 3.7e-10, 7) AS delta, least(x.n, y.n) >= 10 AS meets_min_trades FROM r x JOIN r y ON x.core_level = y.core_level AND x.direction = y.direction AND x.otf <> 'no_otf' AND y.otf = 'no_otf'"),
    "study_ranking": w(ET, ", r AS (SELECT symbol || '_' || direction || '_' || CASE WHEN bars_held > 12 THEN 'otf_5m' ELSE 'no_otf' END AS run_name, count(*) AS trade_count, avg(r_multiple) AS a FROM trades GROUP BY 1), s AS (SELECT *, CASE WHEN trade_count < 50 THEN 'low_n' ELSE 'ranked' END AS status FROM r) SELECT run_name, status, CASE WHEN status = 'ranked' THEN row_number() OVER (PARTITION BY status ORDER BY a DESC, run_name) END::INT AS rank, trade_count FROM s"),
}

ZONED = LEVELED + ", z AS (SELECT symbol, bar_index, least(pdEQ, pdOpen) AS lo, greatest(pdEQ, pdOpen) AS hi FROM leveled WHERE abs(pdOpen - pdEQ) / 0.25 <= 400 + 1e-9), tb AS (SELECT symbol, time_bucket(INTERVAL 2 HOUR, l.ts) AS ts, max(high) AS high, min(low) AS low, arg_max(close, bar_index) AS close, min(bar_index) AS b0, max(bar_index) AS b1 FROM leveled l GROUP BY symbol, time_bucket(INTERVAL 2 HOUR, l.ts))"
for _name, _long, _short in (
    ("touch", "low <= hi AND high >= lo", "low <= hi AND high >= lo"), ("reject", "low <= hi AND high >= lo AND close > hi", "low <= hi AND high >= lo AND close < lo"),
    ("break", "prev_close <= hi AND close > hi", "prev_close >= lo AND close < lo"), ("reclaim", "low < lo AND close > hi", "high > hi AND close < lo"),
):
    ORACLES[f"trigger_{_name}"] = w(LEVELED, f", z AS (SELECT *, least(pdEQ, pdOpen) AS lo, greatest(pdEQ, pdOpen) AS hi FROM leveled WHERE abs(pdOpen - pdEQ) / 0.25 <= 400 + 1e-9), s AS (SELECT symbol, bar_index, 'long' AS direction, lo, hi FROM z WHERE {_long} UNION ALL SELECT symbol, bar_index, 'short', lo, hi FROM z WHERE {_short}) SELECT symbol, bar_index, direction, row_number() OVER (PARTITION BY symbol ORDER BY bar_index, direction)::INT AS signal_id, lo AS zone_low, hi AS zone_high FROM s")
    ORACLES[f"trigger_{_name}_2h"] = w(ZONED, f", tp AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev_close FROM tb), zt AS (SELECT tp.*, lo, hi FROM tp JOIN z ON z.symbol = tp.symbol AND z.bar_index = b1), s AS (SELECT *, 'long' AS direction FROM zt WHERE {_long} UNION ALL SELECT *, 'short' FROM zt WHERE {_short}) SELECT symbol, b1 AS bar_index, direction, row_number() OVER (PARTITION BY symbol ORDER BY b1, direction)::INT AS signal_id, ts + INTERVAL 2 HOUR AS trigger_ts, lo AS zone_low, hi AS zone_high FROM s")

ORACLES |= {
    "recent_bars": w(BARS, "SELECT symbol, ts, bar_index FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 25"),
    "sub_bar_faults": w(BARS, ", q AS (SELECT symbol, time_bucket(INTERVAL 30 MINUTE, tts) AS ts, count(DISTINCT time_bucket(INTERVAL 15 MINUTE, tts)) AS n FROM ticks GROUP BY ALL) SELECT b.symbol, b.ts, CASE WHEN q.n <> 2 THEN 'incomplete_coverage' END AS fault FROM bars b JOIN q ON b.symbol = q.symbol AND b.ts = q.ts"),
    "trades_at_level": w(ET, "SELECT trade_id, level_names FROM trades WHERE list_contains(string_split(level_names, '|'), 'VWAP')"),
    "grid_overfit": w(simulated(CELLS) + ", s AS (SELECT cell_id, avg(r_multiple) AS m FROM trades GROUP BY cell_id), t AS (SELECT count(*) AS n, max(m) AS b, median(m) AS d, avg(m) AS a, (SELECT avg(m) FROM (SELECT m FROM s ORDER BY m DESC LIMIT 5)) AS k FROM s)", "SELECT n AS valid_cell_count, round(b + 3.7e-10, 7) AS best_metric, round(d + 3.7e-10, 7) AS median_metric, round(a + 3.7e-10, 7) AS mean_metric, round(k + 3.7e-10, 7) AS top_n_mean_metric, round(b - d + 3.7e-10, 7) AS best_vs_median_delta, CASE WHEN n <= 1 THEN 'none' ELSE 'low' END AS risk_level FROM t"),
    "trade_windows": w(simulated(), ", s AS (SELECT symbol, signal_id, unnest(generate_series(greatest(0, entry_bar_index - 3), exit_bar_index + 3)) AS bar_index FROM trades) SELECT b.symbol, s.signal_id AS trade_id, b.bar_index FROM s JOIN bars b ON b.symbol = s.symbol AND b.bar_index = s.bar_index"),
    "random_entries": w(BREAKS, f", need AS (SELECT symbol, count(*) AS need, avg((direction = 'long')::INT::DOUBLE) AS share FROM sig GROUP BY symbol), r AS (SELECT b.symbol, rep, bar_index, {DRAW('rep', 'bar_index', 9)} AS d, ({DRAW('rep', 'bar_index', 10)}) / 2147483647.0::DOUBLE AS u, need, share FROM bars b JOIN need n ON b.symbol = n.symbol, range(5) s(rep)) SELECT symbol, rep::INT AS replica_id, bar_index, CASE WHEN u < share THEN 'long' ELSE 'short' END AS direction FROM r QUALIFY row_number() OVER (PARTITION BY symbol, rep ORDER BY d, bar_index) <= need"),
    "trigger_confirm_3bar": w(LEVELED, """, r AS (SELECT *, lead(close, 1) OVER w AS c1, lead(low, 2) OVER w AS l2, lead(high, 2) OVER w AS h2 FROM leveled WINDOW w AS (PARTITION BY symbol ORDER BY bar_index)), s AS (
      SELECT symbol, bar_index, 'long' AS direction, pdEQ AS level_price, c1 AS entry_price, CASE WHEN coalesce(l2 <= c1, false) THEN 'filled' ELSE 'void' END AS status FROM r WHERE low <= pdEQ AND close > pdEQ AND (open > pdEQ OR coalesce(prev_close > pdEQ, false)) AND c1 > high
      UNION ALL SELECT symbol, bar_index, 'short', pdEQ, c1, CASE WHEN coalesce(h2 >= c1, false) THEN 'filled' ELSE 'void' END FROM r WHERE high >= pdEQ AND close < pdEQ AND (open < pdEQ OR coalesce(prev_close < pdEQ, false)) AND c1 < low) SELECT * FROM s"""),
}
ORACLES["walk_forward"], ORACLES["wfa_matrix"] = ORACLES["walk_forward_all"], ORACLES["wfa_matrix_all"]


def splits(blocks: int) -> str:
    """Cells by split: their rank out of sample and place in sample; splits in the order of their training blocks."""
    return simulated(CELLS) + f""", st AS (SELECT exit_ts, floor((row_number() OVER (ORDER BY exit_ts) - 1) * {blocks} / count(*) OVER ())::INT AS block FROM (SELECT DISTINCT exit_ts FROM trades)),
      bl AS (SELECT cell_id, block, sum(r_multiple) AS s, count(r_multiple) AS k FROM trades JOIN st USING (exit_ts) GROUP BY ALL),
      sp AS (SELECT row_number() OVER (ORDER BY train) - 1 AS split_id, train FROM (SELECT list_filter(range({blocks}), lambda b: (m >> b) & 1 = 1) AS train FROM range(1 << {blocks}) t(m)) WHERE len(train) = {blocks // 2}),
      si AS (SELECT split_id, cell_id, sum(s) FILTER (list_contains(train, block)) / sum(k) FILTER (list_contains(train, block)) AS ins, sum(s) FILTER (NOT list_contains(train, block)) / sum(k) FILTER (NOT list_contains(train, block)) AS oos FROM bl, sp GROUP BY ALL),
      rk AS (SELECT *, (rank() OVER (PARTITION BY split_id ORDER BY oos) + (count(*) OVER (PARTITION BY split_id, oos) - 1) / 2) / (count(*) OVER (PARTITION BY split_id) + 1) AS omega, row_number() OVER (PARTITION BY split_id ORDER BY ins DESC, cell_id) AS best FROM si WHERE ins IS NOT NULL AND oos IS NOT NULL),
      om AS (SELECT split_id, cell_id, omega, ln(omega / (1 - omega)) AS logit FROM rk WHERE best = 1)"""


ORACLES["pbo_cscv"] = w(splits(4), "SELECT split_id::INT AS split_id, cell_id, round(omega + 3.7e-10, 7) AS omega, round(logit + 3.7e-10, 7) AS logit FROM om")
ORACLES["pbo"] = w(splits(8), "SELECT count(*) AS n_splits, round(avg((logit <= 0)::INT::DOUBLE) + 3.7e-10, 7) AS pbo, round(avg(logit) + 3.7e-10, 7) AS mean_logit FROM om")


def wound(source: str = "trades") -> str:
    """Best cell by fold on the training span (a to b) and its result on the test span (b to d)."""
    return f"""tr AS (SELECT fold_id, cell_id, stop_ticks, target_ticks, count(*) AS n, avg(r_multiple) AS m FROM {source}, folds WHERE entry_bar_index >= a AND exit_bar_index < b GROUP BY ALL),
      best AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY m DESC, stop_ticks, target_ticks) = 1),
      te AS (SELECT fold_id, cell_id, count(*) AS n, avg(r_multiple) AS m FROM {source}, folds WHERE entry_bar_index >= b AND exit_bar_index < d GROUP BY ALL)"""


def folds(train: int, test: int, step: int, table: str = "bars") -> str:
    return f"folds AS (SELECT i AS fold_id, {step} * i AS a, {step} * i + {train} AS b, {step} * i + {train + test} AS d FROM (SELECT unnest(generate_series(0, (SELECT CASE WHEN max(bar_index) + 1 < {train + test} THEN -1 ELSE (max(bar_index) + 1 - {train + test}) // {step} END FROM {table}))) AS i) t)"


def states(p: str, minutes: int, least: int = 3) -> str:
    """One-time-framing states of a time frame's own bars, with the time from which they are known."""
    t = f"time_bucket(INTERVAL {minutes} MINUTE, tts)"
    local = f"({t} - INTERVAL 5 HOUR)"
    return f""", {p}a AS (SELECT symbol, {t} AS ts, {local}::DATE + (hour({local}) >= 18)::INT AS sd, max(price) AS high, min(price) AS low FROM ticks GROUP BY ALL),
  {p}f AS (SELECT *, coalesce(low > lag(low) OVER w, false) AS up, coalesce(high < lag(high) OVER w, false) AS down, row_number() OVER w AS i FROM {p}a WINDOW w AS (PARTITION BY symbol, sd ORDER BY ts)),
  {p}r AS (SELECT symbol, ts, i, i - coalesce(max(CASE WHEN NOT up THEN i END) OVER w, 0) AS u, i - coalesce(max(CASE WHEN NOT down THEN i END) OVER w, 0) AS d FROM {p}f WINDOW w AS (PARTITION BY symbol, sd ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  {p} AS (SELECT symbol, ts + INTERVAL {minutes} MINUTE AS known, CASE WHEN i = 1 THEN 'unknown' WHEN u >= {least} AND d < {least} THEN 'up' WHEN d >= {least} AND u < {least} THEN 'down' ELSE 'neutral' END AS state FROM {p}r)"""


def prior_areas(key: str, p: str) -> str:
    head, tail = ORACLES["value_area"].split(BARS.replace("ticks AS", "RECURSIVE ticks AS", 1).strip(), 1)
    inner = head + BARS.replace("ticks AS", "RECURSIVE ticks AS", 1).strip() + tail.replace("session_date", key)
    return f"SELECT symbol, {key}, lag(POC) OVER w AS p{p}POC, lag(VAH) OVER w AS p{p}VAH, lag(VAL) OVER w AS p{p}VAL FROM ({inner}) x WINDOW w AS (PARTITION BY symbol ORDER BY {key})"


NOISED = BREAKS.replace(BARS, BARS.replace("\nbars AS (SELECT *, date_trunc", "\nclean AS (SELECT *, date_trunc").rstrip() + ", moved AS (SELECT clean.*, rep, " + ", ".join(f"{c} + (({DRAW('rep', 'bar_index', 5 + i)}) / 2147483647::DOUBLE * 2 - 1) * ((high - low) * 0.1::DOUBLE) AS n{c}" for i, c in enumerate(("open", "high", "low", "close"))) + " FROM clean, range(3) r(rep)), bars AS (SELECT * EXCLUDE (rep, nopen, nhigh, nlow, nclose) REPLACE (symbol || '#' || rep AS symbol, nopen AS open, greatest(nopen, nhigh, nlow, nclose) AS high, least(nopen, nhigh, nlow, nclose) AS low, nclose AS close) FROM moved)\n", 1)
NOISY_TRADES = "WITH " + simulated().replace(BREAKS, NOISED, 1).strip().lstrip(",") + " SELECT split_part(symbol, '#', 1) AS symbol, split_part(symbol, '#', 2)::INT AS replica_id, entry_bar_index, direction, r_multiple FROM trades"
REPLICAS = w(simulated(), f""", nt AS ({NOISY_TRADES}), base AS (SELECT DISTINCT symbol, entry_bar_index, direction FROM trades),
  g AS (SELECT replica_id, count(*) AS n, avg(r_multiple) AS e, coalesce(sum(r_multiple) FILTER (r_multiple > 0), 0) AS won, coalesce(-sum(r_multiple) FILTER (r_multiple < 0), 0) AS lost FROM nt GROUP BY ALL),
  k AS (SELECT replica_id, count(DISTINCT (symbol, entry_bar_index, direction)) AS kept FROM nt SEMI JOIN base USING (symbol, entry_bar_index, direction) GROUP BY ALL)
  SELECT rep::INT AS replica_id, coalesce(n, 0) AS trade_count, e AS expectancy_r, CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 'Infinity'::DOUBLE WHEN n > 0 THEN 0 END AS profit_factor, CASE WHEN (SELECT count(*) FROM base) > 0 THEN coalesce(kept, 0) / (SELECT count(*) FROM base) END AS persistence_rate
  FROM range(3) r(rep) LEFT JOIN g ON g.replica_id = rep LEFT JOIN k ON k.replica_id = rep""")
OTF_KNOWN = BREAKS + ", sg AS (SELECT s.*, b.ts FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_index = s.bar_index)"
BEST = "b.fold_id::INT AS fold_id, b.cell_id, b.n AS train_trades, round(b.m + 3.7e-10, 7) AS train_metric, te.n AS test_trades, round(te.m + 3.7e-10, 7) AS test_metric FROM best b LEFT JOIN te ON b.fold_id = te.fold_id AND b.cell_id = te.cell_id"
RUN_NAME = "symbol || '_' || direction || '_' || CASE WHEN bars_held > 12 THEN 'otf_5m' ELSE 'no_otf' END"

ORACLES |= {
    "prior_profile_areas": w(BARS, f", d AS ({prior_areas('session_date', 'd')}), wk AS ({prior_areas('week_key', 'w')}) SELECT b.symbol, b.ts, pdPOC, pdVAH, pdVAL, pwPOC, pwVAH, pwVAL FROM bars b LEFT JOIN d USING (symbol, session_date) LEFT JOIN wk ON wk.symbol = b.symbol AND wk.week_key = b.week_key"),
    "pivots_4h": w(BARS, """, c AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, b.ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS cts, max(high) AS high, min(low) AS low FROM bars b GROUP BY ALL),
      f AS (SELECT symbol, cts, high, low, high > lag(high, 1) OVER w AND high > lag(high, 2) OVER w AND high > lead(high, 1) OVER w AND high > lead(high, 2) OVER w AS ph, low < lag(low, 1) OVER w AND low < lag(low, 2) OVER w AND low < lead(low, 1) OVER w AND low < lead(low, 2) OVER w AS pl FROM c WINDOW w AS (PARTITION BY symbol ORDER BY cts)),
      h AS (SELECT symbol, cts + INTERVAL 12 HOUR AS known, high FROM f WHERE ph), l AS (SELECT symbol, cts + INTERVAL 12 HOUR AS known, low FROM f WHERE pl)
      SELECT b.symbol, b.ts, h.high AS Pivot_4h_High, l.low AS Pivot_4h_Low FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.known ASOF LEFT JOIN l ON b.symbol = l.symbol AND b.ts >= l.known"""),
    "prior_single_prints": w(BARS, """, r AS (SELECT *, floor((sod - 34200) / 1800)::INT AS br FROM bars WHERE session = 'RTH'), t AS (SELECT DISTINCT symbol, session_date, br, unnest(generate_series(round_even(low, 0)::BIGINT, round_even(high, 0)::BIGINT)) AS k FROM r),
      l AS (SELECT symbol, session_date, k FROM t GROUP BY ALL HAVING count(*) = 1), s AS (SELECT symbol, session_date, lag(session_date) OVER (PARTITION BY symbol ORDER BY session_date) AS before FROM (SELECT DISTINCT symbol, session_date FROM r)),
      m AS (SELECT r.symbol, r.ts, min(k) FILTER (k > close)::DOUBLE AS a, max(k) FILTER (k < close)::DOUBLE AS d FROM r JOIN s ON s.symbol = r.symbol AND s.session_date = r.session_date JOIN l ON l.symbol = s.symbol AND l.session_date = s.before GROUP BY ALL)
      SELECT b.symbol, b.ts, a AS pSinglePrint_30m_NearestAbove, d AS pSinglePrint_30m_NearestBelow FROM bars b LEFT JOIN m ON b.symbol = m.symbol AND b.ts = m.ts"""),
    "trigger_timeframe_zones": w(ZONED, "SELECT z.symbol, b1 AS bar_index, bar_index AS base_bar_index, lo AS zone_low, hi AS zone_high FROM z JOIN tb ON tb.symbol = z.symbol AND bar_index BETWEEN b0 AND b1"),
    "otf_filter": w(OTF_KNOWN, """, a AS (SELECT symbol, session_date, time_bucket(INTERVAL 1 HOUR, b.ts) AS ts, max(high) AS high, min(low) AS low, count(*) AS n FROM bars b GROUP BY symbol, session_date, time_bucket(INTERVAL 1 HOUR, b.ts)),
      f AS (SELECT *, coalesce(low > lag(low) OVER w, false) AS up, coalesce(high < lag(high) OVER w, false) AS down, row_number() OVER w AS i FROM a WHERE n = 2 WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts)),
      s AS (SELECT symbol, ts + INTERVAL 1 HOUR AS known, CASE WHEN i = 1 THEN 'unknown' WHEN up AND NOT down THEN 'up' WHEN down AND NOT up THEN 'down' ELSE 'neutral' END AS state FROM f)
      SELECT x.symbol, signal_id, direction, state AS otf_0, coalesce(state = CASE direction WHEN 'long' THEN 'up' ELSE 'down' END, false) AS accepted FROM sg x ASOF LEFT JOIN s ON x.symbol = s.symbol AND x.ts >= s.known"""),
    "otf_validation_matrix": w(simulated(), states("o5", 5) + states("o15", 15) + states("o30", 30) + """, sg AS (SELECT s.*, b.ts FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_index = s.bar_index),
      k AS (SELECT x.symbol, signal_id, coalesce(o5.state = w, false) AS a, coalesce(o15.state = w, false) AS b, coalesce(o30.state = w, false) AS c FROM (SELECT *, CASE direction WHEN 'long' THEN 'up' ELSE 'down' END AS w FROM sg) x ASOF LEFT JOIN o5 ON x.symbol = o5.symbol AND x.ts >= o5.known ASOF LEFT JOIN o15 ON x.symbol = o15.symbol AND x.ts >= o15.known ASOF LEFT JOIN o30 ON x.symbol = o30.symbol AND x.ts >= o30.known),
      t AS (SELECT r_multiple, CASE WHEN entry_bar_index < 500 THEN 'train' ELSE 'oos' END AS period, unnest(list_filter(['no_otf', CASE WHEN b THEN 'otf_15m' END, CASE WHEN c THEN 'otf_30m' END, CASE WHEN b AND c THEN 'otf_15m_30m' END, CASE WHEN a AND b AND c THEN 'otf_5m_15m_30m' END], lambda v: v IS NOT NULL)) AS config FROM trades JOIN k USING (symbol, signal_id)),
      g AS (SELECT config, period, count(*) AS n, avg(r_multiple) AS e FROM t GROUP BY ALL) SELECT x.config, x.period, x.n AS trade_count, round(x.e + 3.7e-10, 7) AS expectancy_r, x.n - y.n AS delta_trades, round(x.e - y.e + 3.7e-10, 7) AS delta_expectancy, CASE WHEN x.period = 'train' THEN rank() OVER (PARTITION BY x.period ORDER BY x.e DESC) END::INT AS train_rank FROM g x JOIN g y ON x.period = y.period AND y.config = 'no_otf'"""),
    "walk_forward_sessions": w(simulated(CELLS), ", ses AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS bar_index FROM (SELECT DISTINCT session_date FROM bars)), bs AS (SELECT symbol, b.bar_index, ses.bar_index AS no FROM bars b JOIN ses USING (session_date)), tn AS (SELECT t.* REPLACE (e.no AS entry_bar_index, x.no AS exit_bar_index) FROM trades t JOIN bs e ON e.symbol = t.symbol AND e.bar_index = t.entry_bar_index JOIN bs x ON x.symbol = t.symbol AND x.bar_index = t.exit_bar_index), " + folds(10, 5, 5, "ses") + ", " + wound("tn") + " SELECT " + BEST),
    "walk_forward_stitched": w(simulated(CELLS), ", " + folds(400, 300, 200) + ", " + wound() + """, o AS (SELECT f.fold_id, t.* FROM trades t, folds f JOIN best USING (fold_id) WHERE best.cell_id = t.cell_id AND entry_bar_index >= b AND exit_bar_index < d QUALIFY row_number() OVER (PARTITION BY symbol, entry_bar_index, signal_id ORDER BY f.fold_id) = 1),
      c AS (SELECT *, symbol || '#' || signal_id AS trade_id FROM o), e AS (SELECT *, sum(r_multiple) OVER (ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM c)
      SELECT fold_id::INT AS fold_id, cell_id, trade_id, round(cum + 3.7e-10, 7) AS cum_r, round(greatest(max(cum) OVER (ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING), 0) - cum + 3.7e-10, 7) AS drawdown_r FROM e"""),
    "noise_replicas": f"SELECT replica_id, trade_count, round(expectancy_r + 3.7e-10, 7) AS expectancy_r, round(profit_factor + 3.7e-10, 7) AS profit_factor, round(persistence_rate + 3.7e-10, 7) AS persistence_rate FROM ({REPLICAS}) x",
    "noise_summary": "SELECT count(*) AS n_replicas, " + ", ".join(f"round(quantile_cont({c}, {p / 100}) + 3.7e-10, 7) AS {c}_p{p}" for c in ("expectancy_r", "profit_factor", "persistence_rate") for p in (5, 50, 95)) + f" FROM ({REPLICAS}) x",
    "study_promotion": f"SELECT run_name, rank FROM ({ORACLES['study_ranking']}) x WHERE status = 'ranked' AND rank <= 3",
    "study_rollup": w(ET, f", r AS (SELECT {RUN_NAME} AS run_name, count(*) AS trade_count, count(*) FILTER (r_multiple < -5) AS n, min(r_multiple) FILTER (r_multiple < -5) AS m FROM trades GROUP BY 1) SELECT run_name, trade_count, CASE WHEN n > 0 THEN 'present' ELSE 'not_run' END AS losses_status, nullif(n, 0) AS losses_number, round(m + 3.7e-10, 7) AS losses_worst_r FROM r"),
    "study_admit_bucket": w(ET, f", g AS (SELECT symbol, {SEGMENT} AS rth_segment, count(*) AS trade_count, avg(r_multiple) AS avg_r FROM trades GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS i, lead(trade_count < 30) OVER w AS nt, lead(avg_r) OVER w AS nr FROM g WINDOW w AS (PARTITION BY symbol ORDER BY trade_count < 30, avg_r DESC, rth_segment)) SELECT symbol, rth_segment, trade_count, round(avg_r + 3.7e-10, 7) AS avg_r, CASE WHEN coalesce(nt = (trade_count < 30) AND nr = avg_r, false) THEN 'tie' WHEN trade_count < 30 THEN 'thin' ELSE 'ok' END AS status FROM r WHERE i = 1"),
    "mc_summary": "SELECT symbol, " + ", ".join(f"round(quantile_cont({c}, {p / 100}) + 3.7e-10, 7) AS {c}_p{p}" for c in ("final_r", "max_drawdown_r") for p in (5, 50, 95)) + ", " + ", ".join(f"round(avg((max_drawdown_r > {t})::INT::DOUBLE) + 3.7e-10, 7) AS prob_dd_over_{t}" for t in (3, 5, 10)) + " FROM (" + ORACLES["mc_reshuffle"].replace("round(sum(r) + 3.7e-10, 7)", "sum(r)").replace("round(max(dd) + 3.7e-10, 7)", "max(dd)") + ") x GROUP BY symbol",
}


def exposed(source: str, keys: str, cooldown: int, overlap: str) -> str:
    """Verdicts (ad): the chain of admitted trades of each group, one after the other."""
    return f""", o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY entry_bar_index, signal_id) AS pos FROM {source}),
      nx AS MATERIALIZED (SELECT {keys}, o.pos, (SELECT min(b.pos) FROM o b WHERE {" AND ".join(f"b.{k} = o.{k}" for k in keys.split(", "))} AND b.entry_bar_index > o.exit_bar_index + {cooldown}) AS nxt FROM o),
      ch AS (SELECT {keys}, pos FROM o WHERE pos = 1 UNION ALL SELECT {keys}, nxt AS pos FROM ch JOIN nx USING ({keys}, pos) WHERE nxt IS NOT NULL),
      am AS (SELECT o.*, ch.pos IS NOT NULL AS admitted FROM o LEFT JOIN ch USING ({keys}, pos)),
      bl AS (SELECT *, last_value(CASE WHEN admitted THEN signal_id END IGNORE NULLS) OVER x AS bid, last_value(CASE WHEN admitted THEN exit_bar_index END IGNORE NULLS) OVER x AS bx FROM am WINDOW x AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      ad AS (SELECT *, CASE WHEN admitted THEN NULL WHEN entry_bar_index > bx THEN 'cooldown_active' ELSE '{overlap}' END AS skip_reason, CASE WHEN NOT admitted THEN bid END AS blocking_signal_id, CASE WHEN NOT admitted THEN bx END AS blocking_exit_bar_index FROM bl)"""


VERDICT = "symbol, signal_id, admitted, skip_reason, blocking_signal_id, blocking_exit_bar_index"
CLOCKED = simulated() + """, ct AS (SELECT t.*, CASE WHEN b.sod // 60 < 480 OR b.sod // 60 >= 960 THEN 'outside_entry_window' WHEN b.sod > 54000 THEN 'after_entry_cutoff' END AS reason FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.bar_index = t.entry_bar_index),
  free AS (SELECT * FROM ct WHERE reason IS NULL)""" + exposed("free", "symbol", 2, "overlapping_position") + """, skips AS (SELECT symbol, signal_id, skip_reason, blocking_signal_id, blocking_exit_bar_index FROM ad WHERE NOT admitted UNION ALL SELECT symbol, signal_id, reason, NULL, NULL FROM ct WHERE reason IS NOT NULL)"""


def recursive(ctes: str, body: str) -> str:
    return w(ctes, body).replace("WITH", "WITH RECURSIVE", 1)


def fold_otf(history: str) -> str:
    """Walk-forward on signals that fit hourly states, which are made anew for each part of each fold."""
    return w(simulated(CELLS), ", " + folds(400, 200, 150) + f""", pt AS (SELECT fold_id, 'train' AS part, a AS lo, b AS hi FROM folds UNION ALL SELECT fold_id, 'test', b, d FROM folds),
      pb AS (SELECT pt.fold_id, pt.part, bars.* FROM pt JOIN bars ON bar_index < hi {history}),
      oa AS (SELECT fold_id, part, symbol, session_date, time_bucket(INTERVAL 1 HOUR, pb.ts) AS ts, max(high) AS high, min(low) AS low, count(*) AS n FROM pb GROUP BY fold_id, part, symbol, session_date, time_bucket(INTERVAL 1 HOUR, pb.ts)),
      ob AS (SELECT *, coalesce(low > lag(low) OVER x, false) AS up, coalesce(high < lag(high) OVER x, false) AS down, row_number() OVER x AS i FROM oa WHERE n = 2 WINDOW x AS (PARTITION BY fold_id, part, symbol, session_date ORDER BY ts)),
      os AS (SELECT fold_id, part, symbol, ts + INTERVAL 1 HOUR AS known, CASE WHEN i = 1 THEN 'unknown' WHEN up AND NOT down THEN 'up' WHEN down AND NOT up THEN 'down' ELSE 'neutral' END AS state FROM ob),
      sp AS (SELECT s.*, b.ts, pt.fold_id, pt.part FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_index = s.bar_index JOIN pt ON s.bar_index >= lo AND s.bar_index < hi),
      sv AS (SELECT x.symbol, x.signal_id, x.fold_id, x.part, coalesce(state = CASE direction WHEN 'long' THEN 'up' ELSE 'down' END, false) AS ok FROM sp x ASOF LEFT JOIN os ON x.symbol = os.symbol AND x.fold_id = os.fold_id AND x.part = os.part AND x.ts >= os.known),
      cn AS (SELECT fold_id, count(*) FILTER (part = 'train') AS train_signals, count(*) FILTER (part = 'train' AND NOT ok) AS train_rejected, count(*) FILTER (part = 'test') AS test_signals, count(*) FILTER (part = 'test' AND NOT ok) AS test_rejected FROM sv GROUP BY ALL),
      tk AS (SELECT t.*, v.fold_id, v.part FROM trades t JOIN sv v ON v.symbol = t.symbol AND v.signal_id = t.signal_id AND ok),
      tr AS (SELECT fold_id, cell_id, stop_ticks, target_ticks, count(*) AS n, avg(r_multiple) AS m FROM tk JOIN folds USING (fold_id) WHERE part = 'train' AND entry_bar_index >= a AND exit_bar_index < b GROUP BY ALL),
      best AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY m DESC, stop_ticks, target_ticks) = 1),
      te AS (SELECT fold_id, cell_id, count(*) AS n, avg(r_multiple) AS m FROM tk JOIN folds USING (fold_id) WHERE part = 'test' AND entry_bar_index >= b AND exit_bar_index < d GROUP BY ALL)
      SELECT """ + BEST.replace(" FROM best b ", ", coalesce(train_signals, 0) AS train_signals, coalesce(train_rejected, 0) AS train_rejected, coalesce(test_signals, 0) AS test_signals, coalesce(test_rejected, 0) AS test_rejected FROM best b LEFT JOIN cn ON cn.fold_id = b.fold_id "))


ORACLES |= {
    "exposure_single_position": recursive(simulated() + exposed("trades", "symbol", 2, "overlapping_position"), "SELECT symbol, signal_id, admitted FROM ad"),
    "exposure_single_direction": recursive(simulated() + exposed("trades", "symbol, direction", 0, "overlapping_direction"), "SELECT symbol, signal_id, admitted FROM ad"),
    "exposure_reasons": recursive(simulated() + exposed("trades", "symbol", 2, "overlapping_position"), f"SELECT {VERDICT} FROM ad"),
    "exposure_direction_reasons": recursive(simulated() + exposed("trades", "symbol, direction", 1, "overlapping_direction"), f"SELECT {VERDICT} FROM ad"),
    "skipped_signals": recursive(CLOCKED, "SELECT * FROM skips"),
    "skip_counts": recursive(CLOCKED, "SELECT symbol, count(*) AS total, count(*) FILTER (skip_reason = 'outside_entry_window') AS outside_entry_window, count(*) FILTER (skip_reason = 'after_entry_cutoff') AS after_entry_cutoff, count(*) FILTER (skip_reason NOT IN ('outside_entry_window', 'after_entry_cutoff')) AS other FROM skips GROUP BY ALL"),
    "exit_diagnostics": w(simulated(), """, r AS (SELECT t.*, exit_reason IN ('SL', 'TP', 'BE', 'TRAIL') AS bracket, CASE direction WHEN 'long' THEN b.low <= stop_price AND b.high >= target_price ELSE b.high >= stop_price AND b.low <= target_price END AS reached FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.bar_index = t.exit_bar_index),
      c AS (SELECT symbol, count(*) AS trade_count, count(*) FILTER (bracket) AS bracket_exit_trade_count, count(*) FILTER (bracket AND reached) AS same_bar_both_hit_count, count(DISTINCT exit_bar_index) FILTER (bracket AND reached) AS bars_affected_count, count(*) FILTER (exit_reason = 'BE') AS be_exit_count, count(*) FILTER (exit_reason = 'TRAIL') AS trail_exit_count FROM r GROUP BY ALL)
      SELECT *, round(coalesce(same_bar_both_hit_count / nullif(bracket_exit_trade_count, 0), 0) + 3.7e-10, 7) AS same_bar_both_hit_pct FROM c"""),
    "portfolio_exposure": recursive(ET + ", pt AS (SELECT *, trade_id AS signal_id, entry_ts::DATE AS day FROM trades)" + exposed("pt", "day", 0, "overlapping_position"), "SELECT trade_id, admitted FROM ad"),
    "portfolio_exposure_whole": recursive(ET + ", pt AS (SELECT * REPLACE (floor(epoch(entry_ts) / 1800)::INT AS entry_bar_index, floor(epoch(exit_ts) / 1800)::INT AS exit_bar_index), trade_id AS signal_id, 1 AS one FROM trades)" + exposed("pt", "one", 1, "overlapping_position"), "SELECT trade_id, admitted, skip_reason, blocking_signal_id, blocking_exit_bar_index FROM ad"),
    "walk_forward_fold_local": fold_otf("AND bar_index >= lo"),
    "walk_forward_causal_prefix": fold_otf(""),
    "grid_search_otf": w(simulated(CELLS), """, oa AS (SELECT symbol, session_date, time_bucket(INTERVAL 1 HOUR, b.ts) AS ts, max(high) AS high, min(low) AS low, count(*) AS n FROM bars b GROUP BY symbol, session_date, time_bucket(INTERVAL 1 HOUR, b.ts)),
      ob AS (SELECT *, coalesce(low > lag(low) OVER x, false) AS up, coalesce(high < lag(high) OVER x, false) AS down, row_number() OVER x AS i FROM oa WHERE n = 2 WINDOW x AS (PARTITION BY symbol, session_date ORDER BY ts)),
      os AS (SELECT symbol, ts + INTERVAL 1 HOUR AS known, CASE WHEN i = 1 THEN 'unknown' WHEN up AND NOT down THEN 'up' WHEN down AND NOT up THEN 'down' ELSE 'neutral' END AS state FROM ob),
      sg AS (SELECT s.*, b.ts FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_index = s.bar_index),
      ok AS (SELECT x.symbol, x.signal_id FROM sg x ASOF LEFT JOIN os ON x.symbol = os.symbol AND x.ts >= os.known WHERE state = CASE direction WHEN 'long' THEN 'up' ELSE 'down' END)
      SELECT cell_id, stop_ticks, target_ticks, count(*) AS trade_count, round(avg((r_multiple > 0)::INT::DOUBLE) + 3.7e-10, 7) AS win_rate, round(avg(r_multiple) + 3.7e-10, 7) AS expectancy_r, round(sum(r_multiple) + 3.7e-10, 7) AS total_r FROM trades JOIN ok USING (symbol, signal_id) GROUP BY ALL"""),
}

PATHS = f", p AS (SELECT symbol, day, sim, pos, {DRAW('sim', 'pos', 3)} AS o, r_multiple AS r FROM num, range(20) s(sim))"
FAN = ", ".join(f"round(quantile_cont(cum, {p / 100}) + 3.7e-10, 7) AS p{p}" for p in (5, 25, 50, 75, 95))
ORACLES |= {
    "mc_fan": w(NUM, PATHS + f""", c AS (SELECT symbol, day, sum(r) OVER x AS cum, row_number() OVER x AS trade_index FROM p WINDOW x AS (PARTITION BY symbol, day, sim ORDER BY o, pos ROWS UNBOUNDED PRECEDING)),
      f AS (SELECT symbol, day, trade_index, {FAN} FROM c GROUP BY ALL), s AS (SELECT symbol, day, pos + 1 AS trade_index, sum(r_multiple) OVER (PARTITION BY symbol, day ORDER BY pos ROWS UNBOUNDED PRECEDING) AS v FROM num)
      SELECT f.* REPLACE (f.trade_index::INT AS trade_index), round(v + 3.7e-10, 7) AS observed_cum_r FROM f JOIN s USING (symbol, day, trade_index)"""),
    "mc_loss_streaks": w(NUM, PATHS + ", q AS (SELECT symbol, day, sim, r, sum((r >= 0)::INT) OVER (PARTITION BY symbol, day, sim ORDER BY o, pos ROWS UNBOUNDED PRECEDING) AS g FROM p), n AS (SELECT symbol, day, sim, g, count(*) FILTER (r < 0) AS n FROM q GROUP BY ALL) SELECT symbol, day, sim::INT AS sim, max(n) AS max_loss_streak FROM n GROUP BY ALL"),
    "equity_curve_whole": w(ET, ", c AS (SELECT trade_id, exit_ts, sum(r_multiple) OVER (ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM trades) SELECT trade_id, round(cum + 3.7e-10, 7) AS cum_r, round(greatest(max(cum) OVER (ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING), 0) - cum + 3.7e-10, 7) AS drawdown_r FROM c"),
    "htf_ema_asof": w(BARS.replace("ticks AS", "RECURSIVE ticks AS", 1), """, cb AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, b.ts) AS ts, arg_max(close, b.ts) AS close FROM bars b GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, b.ts)),
      cn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM cb), r AS (SELECT symbol, i, ts, close AS e FROM cn WHERE i = 0 UNION ALL SELECT c.symbol, c.i, c.ts, r.e * (1 - 2.0::DOUBLE / 6) + c.close * (2.0::DOUBLE / 6) FROM r JOIN cn c ON c.symbol = r.symbol AND c.i = r.i + 1),
      k AS (SELECT symbol, ts + INTERVAL 1 HOUR AS known, e FROM r WHERE i >= 4)
      SELECT b.symbol, b.ts, round(e + 3.7e-10, 7) AS EMA_5_1h FROM bars b ASOF LEFT JOIN k ON b.symbol = k.symbol AND b.ts >= k.known"""),
}


def session_matrix(spans: list[tuple[int, int, int]]) -> str:
    """The walk-forward matrix with folds counted in sessions."""
    ses = ORACLES["walk_forward_sessions"].split(", ses AS ", 1)[1].split(", folds AS ", 1)[0]
    every = " UNION ALL ".join(f"SELECT {i} AS matrix_id, k AS fold_id, {st} * k AS a, {st} * k + {tr} AS b, {st} * k + {tr + te} AS d FROM (SELECT unnest(generate_series(0, (SELECT CASE WHEN max(bar_index) + 1 < {tr + te} THEN -1 ELSE (max(bar_index) + 1 - {tr + te}) // {st} END FROM ses))) AS k) t" for i, (tr, te, st) in enumerate(spans))
    tail = ORACLES["wfa_matrix_all"].split("tr AS (SELECT matrix_id", 1)[1].replace("FROM trades, folds", "FROM tn, folds")
    return w(simulated(CELLS), f", ses AS {ses}, folds AS ({every}), tr AS (SELECT matrix_id{tail}")


ORACLES["wfa_matrix_sessions"] = session_matrix([(6, 3, 3), (10, 5, 5), (10, 2, 4)])


def against_random(replicas: int) -> str:
    """The simulator's text twice: on the breaks, and on entries drawn for each replica."""
    plain = simulated()
    signals = plain[plain.index("sig AS (SELECT *, row_number()") :].split("\n")[0]
    drawn = f"""obs AS (WITH {plain.strip().lstrip(',')} SELECT symbol, direction, r_multiple FROM trades),
need AS (SELECT symbol, count(*) AS need, avg((direction = 'long')::INT::DOUBLE) AS share FROM obs GROUP BY symbol),
sig AS (SELECT symbol, bar_index, CASE WHEN u < share THEN 'long' ELSE 'short' END AS direction, rep * 10000000 + bar_index AS signal_id FROM (
  SELECT b.symbol, rep, bar_index, {DRAW('rep', 'bar_index', 9)} AS d, ({DRAW('rep', 'bar_index', 10)}) / 2147483647.0::DOUBLE AS u, need, share FROM bars b JOIN need n ON b.symbol = n.symbol, range({replicas}) s(rep))
  QUALIFY row_number() OVER (PARTITION BY symbol, rep ORDER BY d, bar_index) <= need)"""
    assert signals.endswith("),") and plain.count(signals) == 1
    ctes = plain.replace(signals, drawn + ",") + f""", means AS (SELECT rep, coalesce(m, 0) AS m FROM range({replicas}) s(rep) LEFT JOIN (SELECT signal_id // 10000000 AS r, avg(r_multiple) AS m FROM trades GROUP BY ALL) t ON r = rep),
      o AS (SELECT avg(r_multiple) AS observed FROM obs)"""
    return w(ctes, "SELECT round(any_value(observed) + 3.7e-10, 7) AS observed_expectancy_r, count(*) AS n_replicas, round(avg(m) + 3.7e-10, 7) AS null_expectancy_mean, round(stddev_samp(m) + 3.7e-10, 7) AS null_expectancy_std, round(100 * avg((m < observed)::INT::DOUBLE) + 3.7e-10, 7) AS percentile, round((1 + count(*) FILTER (m >= observed)) / (count(*) + 1)::DOUBLE + 3.7e-10, 7) AS p_value FROM means, o")


def normal(z: str) -> str:
    """The normal distribution function by Simpson's rule from 0."""
    h = f"(({z}) / 2000)"
    return f"(0.5 + {h} / 3 * list_sum(list_transform(range(2001), lambda j: (CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * exp(-(j * {h}) * (j * {h}) / 2))) / sqrt(2 * pi()))"


def newton(x: str, p: str) -> str:
    """A quantile x of p, made exact by one step."""
    return f"{x} - ({normal(x)} - {p}) * sqrt(2 * pi()) * exp({x} * {x} / 2)"


ORACLES["random_benchmark"] = against_random(20)
# the quantiles come from a table of the distribution function
ORACLES["deflated_sharpe"] = w(simulated(CELLS) + f""", m AS (SELECT cell_id, count(*) AS n, avg(r_multiple) AS mu, stddev_samp(r_multiple) AS sd FROM trades GROUP BY ALL HAVING count(*) > 2 AND stddev_samp(r_multiple) > 0),
  g AS (SELECT cell_id, any_value(n) AS n, any_value(mu / sd) AS sr, avg(pow((r_multiple - mu) / sd, 3)) AS g1, avg(pow((r_multiple - mu) / sd, 4)) AS g2 FROM trades JOIN m USING (cell_id) GROUP BY cell_id),
  k AS (SELECT count(*) AS tried, stddev_samp(sr) AS sigma FROM g),
  grid AS (SELECT i / 4000.0::DOUBLE AS x, {normal('i / 4000.0::DOUBLE')} AS p FROM range(-8000, 16001, 16) t(i)),
  q AS (SELECT p AS p0, lead(p) OVER (ORDER BY x) AS p1, x AS x0, lead(x) OVER (ORDER BY x) AS x1 FROM grid),
  asked AS (SELECT 1 - 1 / tried::DOUBLE AS a, 1 - 1 / (tried * exp(1)) AS b, tried, sigma FROM k),
  x AS (SELECT tried, sigma, a, b, q1.x0 + (a - q1.p0) / (q1.p1 - q1.p0) * (q1.x1 - q1.x0) AS xa, q2.x0 + (b - q2.p0) / (q2.p1 - q2.p0) * (q2.x1 - q2.x0) AS xb
    FROM asked JOIN q q1 ON a >= q1.p0 AND a < q1.p1 JOIN q q2 ON b >= q2.p0 AND b < q2.p1),
  l AS (SELECT tried, sigma * ((1 - 0.5772156649015329::DOUBLE) * ({newton('xa', 'a')}) + 0.5772156649015329::DOUBLE * ({newton('xb', 'b')})) AS most FROM x),
  z AS (SELECT cell_id, n, sr, tried, most, sqrt(n - 1) / sqrt(1 - g1 * sr + (g2 - 1) / 4 * sr * sr) AS f FROM g, l)""", f"SELECT cell_id, n, round(sr + 3.7e-10, 7) AS sharpe, tried AS tested_trials, tried AS effective_trials, round(most + 3.7e-10, 7) AS expected_max_sharpe, round({normal('sr * f')} + 3.7e-10, 7) AS psr, round({normal('(sr - most) * f')} + 3.7e-10, 7) AS dsr FROM z")
ORACLES["roll_assumptions"] = w(BARS + ", c AS (SELECT *, 'C' || strftime(week_key, '%m%d') AS contract FROM bars), d AS (SELECT symbol, contract, contract <> lag(contract) OVER w AND open - lag(close) OVER w IS NOT NULL AS roll FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts))", "SELECT symbol, count(DISTINCT contract) AS contract_count, count(*) FILTER (roll) AS roll_gap_count, count(DISTINCT contract) >= 2 AS valid, CASE WHEN count(DISTINCT contract) < 2 THEN 'too_few_contracts,' ELSE '' END || 'unadjusted_gaps' AS issues FROM d GROUP BY symbol")
# New York's summer time: from the second Sunday of March, 7:00 UTC, to the first Sunday of November, 6:00 UTC
ORACLES["clock_issues"] = w("""e AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, -max(event_id) AS row_id FROM events GROUP BY ALL),
  y AS (SELECT *, make_date(year(ts), 3, 8) AS m, make_date(year(ts), 11, 1) AS n FROM e),
  z AS (SELECT symbol, ts, row_id, (ts >= m + ((7 - isodow(m)) % 7)::INT + INTERVAL 7 HOUR AND ts < n + ((7 - isodow(n)) % 7)::INT + INTERVAL 6 HOUR) AS summer FROM y),
  g AS (SELECT symbol, epoch(ts - lag(ts) OVER w) > 1800 AND row_number() OVER w > 2 AS big, coalesce(summer <> lag(summer) OVER w, false)::INT AS changed, ts, ts < lag(ts) OVER (PARTITION BY symbol ORDER BY row_id) AS back FROM z WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  h AS (SELECT *, CASE WHEN big THEN sum(changed) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) ELSE 0 END AS near FROM g)""", "SELECT symbol, count(*) FILTER (back) AS non_monotonic_before_sort, sum(near)::BIGINT AS dst_transition_gaps FROM h GROUP BY symbol")
# bars of five minutes against the newest VWAP of the half hours before
ORACLES["prev30m_hits"] = w(BARS.replace("INTERVAL 30 MINUTE", "INTERVAL 5 MINUTE") + f""", r AS (SELECT symbol, ts, low, high, sod, session_date, floor(epoch(local_ts - (session_date::TIMESTAMP - INTERVAL 6 HOUR)) / 1800)::INT AS br, {TYP} AS tp, volume FROM bars),
  z AS (SELECT symbol, session_date, br AS formed, sum(tp * volume) / sum(volume) AS v FROM r GROUP BY ALL), s AS (SELECT symbol, session_date, lead(session_date) OVER (PARTITION BY symbol ORDER BY session_date) AS nd FROM (SELECT DISTINCT symbol, session_date FROM r)),
  q AS (SELECT z.*, max(formed) OVER (PARTITION BY symbol, session_date) AS lastf FROM z), seeds AS (SELECT q.symbol, nd AS session_date, -row_number() OVER (PARTITION BY q.symbol, q.session_date ORDER BY formed DESC) AS formed, v FROM q JOIN s USING (symbol, session_date) WHERE lastf + 1 <= formed + 4 AND nd IS NOT NULL),
  pool AS (SELECT symbol, session_date, formed, v FROM z UNION ALL SELECT * FROM seeds),
  h AS (SELECT r.symbol, r.session_date, r.br, arg_max(v, formed) AS v FROM r JOIN pool p ON r.symbol = p.symbol AND r.session_date = p.session_date AND p.formed < r.br AND r.br <= p.formed + 4 GROUP BY ALL)""", 'SELECT r.symbol, r.ts, CASE WHEN v IS NOT NULL THEN max((low <= v AND v <= high AND sod % 1800 < 300)::INT) OVER (PARTITION BY r.symbol, session_date, br)::DOUBLE END AS "prev30mVWAP_hit_m5" FROM r LEFT JOIN h USING (symbol, session_date, br)')
ORACLES["marginal_contribution"] = w(ET + """, x AS (SELECT without, trade_id, exit_ts, r_multiple FROM trades, (VALUES ('(none)'), ('click'), ('error'), ('purchase'), ('signup'), ('view')) s(without) WHERE without <> symbol AND r_multiple IS NOT NULL),
  c AS (SELECT *, sum(r_multiple) OVER w AS cum FROM x WINDOW w AS (PARTITION BY without ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, greatest(max(cum) OVER w, 0) - cum AS dd FROM c WINDOW w AS (PARTITION BY without ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT without, sum(r_multiple) AS r, max(dd) AS dd FROM d GROUP BY without)""", "SELECT s.without AS setup_id, round(b.r - s.r + 3.7e-10, 7) AS marginal_total_r, round(b.dd - s.dd + 3.7e-10, 7) AS marginal_max_drawdown_r FROM s, s b WHERE b.without = '(none)' AND s.without <> '(none)'")
