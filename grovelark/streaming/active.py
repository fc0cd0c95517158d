"""Active nodes as a stateful stream operator with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .progress import FILE_DONE

OUT = "task_id bigint, file_path string, state string, seconds double"
_COLUMNS = ["task_id", "file_path", "state", "seconds"]


class ActiveNodes(StatefulProcessor):
    """Keeps the latest start and end of each node; forgets both when the node ends.

    Input is taken chunk by chunk in any order, so a node with very many events
    needs no more memory than one. A node that never ends is reported as
    ``expired`` after ``ttl_ms`` and its state is dropped; a later end event of
    such a node has no effect.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "at double, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.start.get()) if self.start.exists() else None
        start, end = known, None
        for chunk in rows:
            order = pd.Series(list(zip(chunk["ts"].map(pd.Timestamp.timestamp), chunk["seq"])), index=chunk.index)
            begun, ended = order[chunk["type"] == "analysis_file_started"], order[chunk["type"].isin(FILE_DONE)]
            start = max([*begun, *([start] if start else [])], default=None)
            end = max([*ended, *([end] if end else [])], default=None)
        out = []
        if start is not None and (end is None or start > end):
            if start != known:
                out.append((*key, "active", 0.0))
                self._watch(start)
        elif start is not None:
            out.append((*key, "done", end[0] - start[0]))
            self._watch(None)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _watch(self, start: tuple[float, int] | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if start is None:
            self.start.clear()
        else:
            self.start.update((start[0], int(start[1])))
            self.handle.registerTimer(int(start[0] * 1000) + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.start.clear()
        yield pd.DataFrame([(*key, "expired", self.ttl_ms / 1000)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def track_active(events: DataFrame, ttl_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Stream of state changes per ``(task_id, file_path)``; needs the RocksDB state store."""
    slim = events.withWatermark("ts", delay).select("task_id", "file_path", "ts", "seq", "type")
    return slim.groupBy("task_id", "file_path").transformWithStateInPandas(
        ActiveNodes(ttl_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime"
    )
