"""ST11 by the clock of the cluster: a feed that falls silent is reported although no event of any feed follows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "last_ms bigint, last_event bigint, events bigint"


class SilenceProcessor(StatefulProcessor):
    """Keeps the newest event of a feed and one processing-time timer behind its last arrival."""

    def __init__(self, keys: Sequence[str], silent_ms: int):
        self.keys, self.silent_ms = list(keys), silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feed = handle.getValueState("feed", f"{OUT}, timer_ms bigint, silent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, event, n, timer, _ = self.feed.get() if self.feed.exists() else (None, None, 0, None, False)
        for frame in rows:
            ms, ids = frame["at_ms"].astype("int64"), frame["event_id"].astype("int64")
            n += len(frame)
            newest = max(zip(ms.tolist(), ids.tolist(), strict=True))
            if last is None or newest > (last, event):
                last, event = newest
        due = timerValues.getCurrentProcessingTimeInMs() + self.silent_ms
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.feed.update((last, event, n, due, False))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, event, n, timer, silent = self.feed.get()
        # a timer that a later event replaced says nothing, and a silence is told once
        if silent or expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        self.feed.update((last, event, n, timer, True))
        frame = pd.DataFrame({"last_ms": [last], "last_event": [event], "events": [n]}, dtype="int64")
        for name, value in zip(self.keys, key, strict=True):
            frame[name] = value
        yield frame[[*self.keys, "last_ms", "last_event", "events"]]

    def close(self) -> None:
        pass


def stream_silence(events: DataFrame, keys: Sequence[str], silent_ms: int) -> DataFrame:
    """Keys, ``last_ms, last_event, events``: once per silence of ``silent_ms`` of processing time.

    events: keys, at_ms, event_id. Needs the state store of ``ownership.map_state``, and a trigger that goes on:
    timers fire with a micro-batch, which Spark also runs without new data.
    """
    schema = T.StructType([*[events.schema[k] for k in keys], *T.StructType.fromDDL(OUT).fields])
    slim = events.select(*keys, *[F.col(c).cast("bigint").cast("string").alias(c) for c in ("at_ms", "event_id")])
    return slim.groupBy(*keys).transformWithStateInPandas(SilenceProcessor(keys, silent_ms), schema, "Append", "ProcessingTime")


def drain_silence(stream: DataFrame, root: str, feeds: int, timeout_s: float = 120) -> DataFrame:
    """Run ``stream`` until ``feeds`` silences have been told or ``timeout_s`` is over; what was told."""
    import time

    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(processingTime="300 milliseconds").start()
    told = spark.read.schema(stream.schema)
    try:
        until = time.monotonic() + timeout_s
        while time.monotonic() < until and q.exception() is None:
            if q.lastProgress is not None and told.parquet(f"{root}/out").count() >= feeds:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    if q.exception() is not None:
        raise q.exception()
    return told.parquet(f"{root}/out")
