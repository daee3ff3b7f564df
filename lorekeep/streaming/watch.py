"""Keyed state with timers over a stream of change events (survey Z1, Z2, Z5).

For each path the state holds the change that waits to be given out and the newest one that was.  A change is given out when its path has been
still for ``settle`` of event time (a file that is being written gives many events; the last one counts), by a timer that each newer event
sets anew.  What is older than the newest change of its path, given out or not, is dropped, however late it comes: an unlink leaves a tombstone
that holds its place in the order.  Tombstones go ``keep`` after the unlink, by a timer too, so the state is bounded by the paths that exist and the
deletions of that time; events later than that are the watermark's business.

The order of a path's changes is that of ``seq``.  Defined results: events without a path, a seq or a time are dropped; of events with equal seq the
first that came counts; an unlink of a path that was never given out is given out as well (the index may have it from elsewhere).

The state store must be able to hold timers and several variables: set ``PROVIDER`` before the query starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGES = "path string, kind string, seq long, mtime timestamp, content string, at timestamp"
_WAITING = "seq long, kind string, mtime long, content string, at long, due long"
_GIVEN = "seq long, gone boolean, expires long"


class _Settle(StatefulProcessor):
    def __init__(self, settle_ms: int, keep_ms: int) -> None:
        self.settle_ms, self.keep_ms = settle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", _WAITING)
        self.given = handle.getValueState("given", _GIVEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.waiting.get()) if self.waiting.exists() else None
        newest = max(held[0] if held else -(2**63), self.given.get()[0] if self.given.exists() else -(2**63))
        best = None
        for frame in rows:
            frame = frame[frame["seq"] > newest]
            if len(frame):
                r = frame.loc[frame["seq"].idxmax()]
                newest = int(r["seq"])
                best = r
        if best is not None:
            if held:
                self.handle.deleteTimer(held[5])
            at = int(best["at_ms"])
            due = at + self.settle_ms
            text = None if best["content"] is None or best["kind"] == "unlink" else str(best["content"])
            self.waiting.update((newest, str(best["kind"]), None if pd.isna(best["mtime_us"]) else int(best["mtime_us"]), text, at, due))
            self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.exists() and self.waiting.get()[5] <= now:
            seq, kind, mtime, content, at, _ = self.waiting.get()
            self.waiting.clear()
            gone = kind == "unlink"
            expires = now + self.keep_ms if gone else 0
            self.given.update((seq, gone, expires))
            if gone:
                self.handle.registerTimer(expires)
            yield pd.DataFrame({"path": [key[0]], "kind": [kind], "seq": pd.array([seq], dtype="int64"), "mtime_us": pd.array([mtime], dtype="Int64"), "content": [content], "at_ms": pd.array([at], dtype="int64")})
        elif self.given.exists() and self.given.get()[1] and self.given.get()[2] <= now and not self.waiting.exists():
            self.given.clear()

    def close(self) -> None:
        pass


def settled(events: DataFrame, settle_ms: int = 250, keep_ms: int = 7 * 24 * 3600 * 1000, late: str = "1 minute") -> DataFrame:
    """From a stream of ``CHANGES`` (``at`` is the time of the event) the changes that count, once each."""
    check(events.sparkSession)
    usable = events.where("path is not null and seq is not null and at is not null and kind in ('add', 'change', 'unlink')")
    timed = usable.select("path", "kind", "seq", F.unix_micros("mtime").alias("mtime_us"), "content", F.unix_millis("at").alias("at_ms"), "at").withWatermark("at", late)
    out = timed.groupBy("path").transformWithStateInPandas(_Settle(settle_ms, keep_ms), "path string, kind string, seq long, mtime_us long, content string, at_ms long", "Append", "EventTime")
    return out.select("path", "kind", "seq", F.timestamp_micros("mtime_us").alias("mtime"), "content", F.timestamp_millis("at_ms").alias("at"))


def check(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get(PROVIDER[0], ""):
        raise ValueError(f"set {PROVIDER[0]} to {PROVIDER[1]} before the query starts")
