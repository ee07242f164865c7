"""The streaming readings of batch rules: windows and sessions with watermarks, retries, and entries with a time to live.

Each takes a streaming (or batch) DataFrame with an event time and gives what its batch twin gives on the same rows, once the watermark
has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def tumbling_profile(rows: DataFrame, time: str, label: str, size: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Counts of each label in windows that don't overlap."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), label).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), label, "n")


def sliding_profile(rows: DataFrame, time: str, value: str, size: str = "60 seconds", slide: str = "30 seconds", late: str = "5 minutes") -> DataFrame:
    """Count and mean of a value in overlapping windows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size, slide)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def session_regions(rows: DataFrame, time: str, key: str, gap: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Stretches of a key's events not more than the gap apart, with their count."""
    return rows.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"), F.max(time).alias("last")).select(key, F.col("session_window.start").alias("start"), "last", "n")


class Spacing(StatefulProcessor):
    """Of a key: the times that the watermark hasn't passed yet, and the last time that was kept."""

    def __init__(self, key: str, time: str, within: float) -> None:
        self.key, self.time, self.within_us = key, time, round(within * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending, self.kept = handle.getListState("pending", "at long"), handle.getValueState("kept", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        times = sorted(r.at_us for r in rows)
        self.pending.appendList([(t,) for t in times])
        for ms in sorted({-(-t // 1000) for t in times}):
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """Times up to the timer's are all there is before them, and are decided in their order."""
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        times = sorted(x[0] for x in self.pending.get())
        last, out = self.kept.get()[0] if self.kept.exists() else None, []
        for t in (t for t in times if t <= until):
            if last is None or t - last >= self.within_us:
                last = t
                out.append(t)
        left = [(t,) for t in times if t > until]
        self.pending.put(left) if left else self.pending.clear()
        if last is not None:
            self.kept.update((last,))
        return iter([Row(**{self.key: key[0], "at_us": t}) for t in out])

    def close(self) -> None:
        pass


def suppress_retries(rows: DataFrame, time: str, key: str, within: float = 600.0, late: str = "10 minutes") -> DataFrame:
    """The first event of a key, and then each that comes `within` seconds or more after the last one kept: key, time.

    Events wait until the watermark, `late` behind the newest, has passed them, and are then taken in order of time, so that their order of arrival doesn't matter. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass). The batch twin is `min_spacing_filter`.
    """
    timed = rows.withWatermark(time, late).select(key, time, F.unix_micros(time).alias("at_us"))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, at_us long"
    kept = timed.groupBy(key).transformWithState(Spacing(key, time, within), schema, "append", "eventTime")
    return kept.select(key, F.timestamp_micros("at_us").alias(time))


def ttl_lookups(rows: DataFrame, key: str, seconds: float) -> DataFrame:
    """From rows (key, at seconds, is_read) the reads with the entry saved last, if it is still valid: key, at, saved_at.

    Rows of a micro-batch are taken in order of time; an entry's state goes when nothing of its key came for twice its life.
    """
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, at double, saved_at double"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        saved = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(batches).sort_values(["at", "is_read"]).itertuples():
            if r.is_read:
                out.append((k[0], r.at, saved if saved is not None and r.at - saved <= seconds else None))
            else:
                saved = r.at
        if saved is not None:
            state.update((saved,))
            state.setTimeoutDuration(int(2000 * seconds))
        yield pd.DataFrame(out, columns=[key, "at", "saved_at"]).astype({"at": float, "saved_at": float})

    return rows.select(key, "at", "is_read").groupBy(key).applyInPandasWithState(run, schema, "saved double", "append", GroupStateTimeout.ProcessingTimeTimeout)
