"""A limiter on a stream: fixed windows that open at a key's first event, with the cost used so far.

State for each key: the open window's start and what it has used, and the events that may still be overtaken by earlier ones.  Events come
in any order within the watermark's delay; a timer takes those that the watermark has passed, in order of time and id, and gives each
its window as the batch operators ``rollup.limit_windows`` and ``over_limit`` do.  A window whose end the watermark has passed is forgotten when
nothing waits.  The state lives in the checkpoint, so a restarted stream goes on where it was.

What waits for one key is what comes for it within the delay; later events than that are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMITED = "event_id bigint, window_start bigint, used bigint, limited boolean"


class Limiter(StatefulProcessor):
    def __init__(self, key: str, key_type: str, width_us: int, limit: int):
        self.key, self.key_type, self.width, self.limit = key, key_type, width_us, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, used bigint")
        self.waiting = handle.getListState("waiting", "t bigint, event_id bigint, cost bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            self.waiting.appendList([(int(t), int(i), int(c)) for t, i, c in zip(frame["t"], frame["event_id"], frame["cost"], strict=True)])
            first = min(filter(lambda x: x is not None, (first, int(frame["t"].min()))))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame({self.key: [], "event_id": [], "window_start": [], "used": [], "limited": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(map(int, r)) for r in self.waiting.get())
        ready = [e for e in events if e[0] < passed]
        rest = events[len(ready) :]
        start, used = map(int, self.window.get()) if self.window.exists() else (None, 0)
        told = []
        for t, event_id, cost in ready:
            if start is None or t >= start + self.width:
                start, used = t, 0
            used += max(cost, 1)
            told.append((key[0], event_id, start, used, used > self.limit))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(rest[0][0] // 1000, passed // 1000) + 1)
        else:
            self.waiting.clear()
        if start is not None and not rest and passed >= start + self.width:
            self.window.clear()
        elif start is not None:
            self.window.update((start, used))
            if not rest:
                self.handle.registerTimer((start + self.width) // 1000 + 1)
        yield pd.DataFrame(told, columns=[self.key, "event_id", "window_start", "used", "limited"])

    def close(self) -> None:
        pass


def limited_stream(stream: DataFrame, key: str, ts: str, event_id: str, cost: Column, width_s: int, limit: int, delay: str) -> DataFrame:
    """``key`` and the columns of ``LIMITED`` for each event that the watermark has passed.

    The session needs a state store with lists and timers: ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB one.
    """
    kind = dict(stream.dtypes)[key]
    at = F.col(ts).cast("timestamp")
    rows = stream.select(
        key, at.alias("_ts"), F.unix_micros(at).alias("t"), F.col(event_id).cast("bigint").alias("event_id"), F.coalesce(cost.cast("bigint"), F.lit(0)).alias("cost")
    )
    rows = rows.filter(F.col("_ts").isNotNull()).withWatermark("_ts", delay)
    processor = Limiter(key, kind, width_s * 1_000_000, limit)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {LIMITED}", "Append", "EventTime")
