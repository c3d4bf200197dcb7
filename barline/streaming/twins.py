"""Streaming twins: each gives the rows of its batch operator when run to the end of its input."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

LATE = "10 days"


def stream_bars(events: DataFrame) -> DataFrame:
    """Daily bars of events(ts, key, event_id, price, volume) by tumbling windows; rows later than the watermark drop."""
    place = F.struct("ts", "event_id")
    rows = events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day"), "key").agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"), F.sum("volume").alias("volume")
    )
    return rows.select(F.col("key").cast("string").alias("ticker"), F.to_date("window.start").alias("date"), "open", "high", "low", "close", "volume")


def countdown_step(state: dict, c: float) -> tuple[int, int]:
    """Setup and countdown after one more close; state keeps the last four closes, the run and both counters."""
    last = state["last"]
    side = 0 if len(last) < 4 else int(c < last[0]) - int(c > last[0])  # a NaN is neither
    state["run"] = 0 if side == 0 else (state["run"] + side if state["run"] * side > 0 else side)
    if abs(state["run"]) == 9:
        mine = "buy" if state["run"] > 0 else "sell"
        other = "sell" if mine == "buy" else "buy"
        state[mine], state[other] = 0, -1  # -1: not armed
    out = 0
    for name, sign in (("buy", 1), ("sell", -1)):
        if state[name] >= 0 and len(last) >= 2 and (last[-2] - c) * sign > 0:
            state[name] += 1
            out = sign * state[name]
            if state[name] == 13:
                state[name] = -1
    state["last"] = [*last, c][-4:]
    return state["run"], out


class _Countdown(StatefulProcessor):
    """Holds a ticker's rows until the watermark has passed them, then counts them in date order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._counted = handle.getValueState("counted", "last array<double>, run int, buy int, sell int, upto long")
        self._held = handle.getListState("held", "ms long, date date, c double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        upto = self._counted.get()[4] if self._counted.exists() else None
        held = {ms: (date, c) for ms, date, c in self._held.get()}
        for frame in rows:
            # from the frame's own dates, as timestamps come in the session's time zone
            times = pd.to_datetime(frame["date"]).astype("datetime64[ms]").astype("int64")
            for ms, date, c in zip(times.tolist(), frame["date"], frame["c"].tolist(), strict=True):
                if upto is None or ms > upto:
                    held[ms] = (date, c)
        return self._count(key, held, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._count(key, {ms: (date, c) for ms, date, c in self._held.get()}, timerValues)

    def _count(self, key: tuple, held: dict, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """Rows up to the watermark; the others are held, with a timer for the first of them."""
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = sorted((ms, *value) for ms, value in held.items())
        due, rest = [r for r in rows if r[0] <= watermark], [r for r in rows if r[0] > watermark]
        for ms in list(self._handle.listTimers()):
            self._handle.deleteTimer(ms)
        self._held.clear()
        if rest:
            self._held.put(rest)
            self._handle.registerTimer(rest[0][0])
        if not due:
            return iter(())
        now = {"last": [], "run": 0, "buy": -1, "sell": -1}
        if self._counted.exists():
            last, now["run"], now["buy"], now["sell"], _ = self._counted.get()
            now["last"] = list(last)
        counted = [countdown_step(now, c) for _, _, c in due]
        self._counted.update((now["last"], now["run"], now["buy"], now["sell"], due[-1][0]))
        rows = {"ticker": key[0], "date": [d for _, d, _ in due], "c": [c for *_, c in due], "setup": [a for a, _ in counted], "countdown": [b for _, b in counted]}
        return iter([pd.DataFrame(rows)])

    def close(self) -> None:
        pass


def stream_countdown(series: DataFrame, late: str = LATE) -> DataFrame:
    """Setup and countdown of a stream (ticker, date, c) whose rows may come in any order within the watermark.

    A row is given once the watermark has passed its date; rows behind it drop, and a date that comes again while it is held replaces the earlier
    row. State holds a ticker's rows of the last days and its counters. It wants the RocksDB state store.
    """
    timed = series.withColumn("ts", F.to_timestamp("date")).withWatermark("ts", late)
    return timed.groupBy("ticker").transformWithStateInPandas(_Countdown(), "ticker string, date date, c double, setup int, countdown int", "Append", "EventTime")


def stream_hedge(ratios: DataFrame, on: float = 1.0, off: float = 0.95) -> DataFrame:
    """On/off state of a stream (key, date, ratio), one boolean of state a key."""

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hedged = bool(state.get[0]) if state.exists else False
        rows, out = pd.concat(list(frames)).sort_values("date"), []
        for r in rows["ratio"]:
            hedged = r >= on if not hedged else r > off
            out.append(int(hedged))
        state.update((hedged,))
        yield pd.DataFrame({"key": key[0], "date": rows["date"], "hedged": out})

    return ratios.groupBy("key").applyInPandasWithState(run, "key string, date date, hedged int", "hedged boolean", "append", GroupStateTimeout.NoTimeout)


def stream_notices(notices: DataFrame) -> DataFrame:
    """Notices of a stream (ts, ann_id, ...) once each within the watermark."""
    return notices.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["ann_id"])
