"""Timers of keyed streams: items that are due at a time come out when that time has passed, in order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class DueItems(StatefulProcessor):
    """Holds the items of a key by their due time (a map in state, one entry a time) and registers a timer for each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "due long", "items array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        late = []
        for frame in rows:
            for due, item in zip(frame["due_ms"], frame["item"]):
                if pd.isna(due) or item is None:
                    continue
                due = int(due)
                if due <= now:  # its time has passed: at once
                    late.append((due, item))
                    continue
                held = list(self.items.getValue((due,))[0]) if self.items.containsKey((due,)) else []
                if not held:
                    self.handle.registerTimer(due)
                self.items.updateValue((due,), (held + [item],))
        if late:  # and before them what is due already, or between them
            passed = [d for (d,) in self.items.keys() if d <= now]
            rows_due = [(d, x, False) for d in passed for x in self._popped(d)]
            for d in passed:
                self.handle.deleteTimer(d)
            yield self._frame(key, sorted(rows_due + [(d, x, True) for d, x in late]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = int(expiredTimerInfo.getExpiryTimeInMs())
        if self.items.containsKey((due,)):
            yield self._frame(key, [(due, x, False) for x in sorted(self._popped(due))])

    def close(self) -> None:
        pass

    def _popped(self, due: int) -> list[str]:
        held = list(self.items.getValue((due,))[0])
        self.items.removeKey((due,))
        return held

    def _frame(self, key: Any, rows: list[tuple[int, str, bool]]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(rows), "due_ms": [r[0] for r in rows], "item": [r[1] for r in rows], "late": [r[2] for r in rows]})


def due_items(items: DataFrame, ts: str, delay: str) -> DataFrame:
    """(key, due_ms, item, late) of a stream of (key string, due_ms long, item string) with the event time ``ts``.

    An item comes out once the watermark (``delay`` behind the newest ``ts``) has passed its due time, the items of a key in the
    order of their times, those of one time by item; one that arrives when its time has passed comes at once, marked late.
    Items without a time are left out. The session must keep state in RocksDB.
    """
    kept = items.withWatermark(ts, delay).select("key", "due_ms", "item", ts)
    return kept.groupBy("key").transformWithStateInPandas(DueItems(), "key string, due_ms long, item string, late boolean", "Append", "EventTime")
