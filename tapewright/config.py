"""Instruments, sessions and the fixed vocabularies of the engine."""

from __future__ import annotations

from dataclasses import dataclass


def seconds(clock: str) -> int:
    """Seconds of the day of HH:MM or HH:MM:SS."""
    h, m, *s = map(int, clock.split(":"))
    total = h * 3600 + m * 60 + (s[0] if s else 0)
    if not 0 <= total <= 86400:
        raise ValueError(f"not a time of day: {clock}")
    return total


@dataclass(frozen=True)
class Instrument:
    symbol: str
    tick_size: float = 0.25
    point_value: float = 50.0
    exchange_tz: str = "America/New_York"
    rth_start: str = "09:30"
    rth_end: str = "16:00"
    eth_start: str = "18:00"
    asia: tuple[str, str] = ("20:00", "00:00")
    london: tuple[str, str] = ("02:00", "05:00")


# Point value of each instrument.
POINT_VALUES = {"ES": 50.0, "NQ": 20.0, "MES": 5.0, "MNQ": 2.0}
INSTRUMENTS = {s: Instrument(s, point_value=v) for s, v in POINT_VALUES.items()}
DEFAULT = INSTRUMENTS["ES"]

# Names of the parts of a trading day and the minutes at which they start.
SEGMENTS = (("pre_rth", 0), ("rth_open_30m", 570), ("rth_morning", 600), ("rth_midday", 690), ("rth_afternoon", 810), ("rth_power_hour", 900), ("post_rth", 960))
# Bar lengths in seconds, and the names of triggers, directions, exposure policies and intrabar models.
TIMEFRAMES = {"1min": 60, "5min": 300, "15min": 900, "30min": 1800, "1h": 3600, "4h": 14400, "1D": 86400}
TRIGGERS = ("touch", "reject", "break", "reclaim", "3c")
DIRECTIONS = ("long", "short", "both")
EXPOSURE_POLICIES = ("allow_all", "single_position", "single_direction", "single_setup")
INTRABAR_MODELS = ("sl_first", "path_open_proximity", "subtimeframe", "subtimeframe_conservative")
GAP_FACTOR = 3
SIGNIFICANT = {"duplicate_timestamps", "missing_values", "high_below_low", "open_close_outside_range", "negative_volume"}


def choose(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}: {value!r}")
    return value


def parse_interval(label: str) -> int:
    """Seconds of a label such as 15s, 1min, 4h or 1D."""
    for unit, size in (("min", 60), ("s", 1), ("h", 3600), ("D", 86400)):
        if label.endswith(unit) and label[: -len(unit)].isdigit():
            return int(label[: -len(unit)]) * size
    raise ValueError(f"not an interval: {label!r}")


def format_interval(secs: int) -> str:
    for unit, size in (("D", 86400), ("h", 3600), ("min", 60)):
        if secs % size == 0:
            return f"{secs // size}{unit}"
    return f"{secs}s"
