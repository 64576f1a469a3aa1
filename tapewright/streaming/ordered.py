"""Keyed state that sees the bars of a symbol in their order, late ones included."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor


class Ordered(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then hands them on by time.

    ``buffered`` names the columns to keep, with types; the rows also have ``at``, their
    time in milliseconds, and ``tag``, which tells rows of one time apart and orders
    them. A row with the time and tag of one still held replaces it. A symbol has one
    timer, at its earliest row held. Subclasses define ``open_state(handle)`` and
    ``settle(key, rows)``, which yields the rows that come out. Maps of state and timers
    need the RocksDB state store, which ``get_session`` sets.
    """

    buffered: str

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at long, tag string", self.buffered)
        self.timer = handle.getValueState("timer", "at long")
        self.names = [c.split()[0] for c in self.buffered.split(", ")]
        self.open_state(handle)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for r in rows:
            self.held.updateValue((r["at"], r["tag"]), tuple(r[c] for c in self.names))
            first = r["at"] if first is None else min(first, r["at"])
        if first is not None:
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        due, later = [], None
        for k, v in self.held.iterator():
            if k[0] <= now:
                due.append((k[0], k[1], tuple(v)))
            else:
                later = k[0] if later is None else min(later, k[0])
        self.timer.clear()
        if later is not None:
            self._wake(later)
        due.sort(key=lambda d: d[:2])
        for at, tag, _ in due:
            self.held.removeKey((at, tag))
        return iter(list(self.settle(key, [Row(at=at, tag=tag, **dict(zip(self.names, v, strict=True))) for at, tag, v in due])))

    def _wake(self, at: int) -> None:
        known = self.timer.get() if self.timer.exists() else None
        if known is None or at < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass
