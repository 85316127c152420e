"""Opening and closing of stories as keyed state with event-time timers (R6, T10). Needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``), which keeps state beside the JVM heap and in the query's checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "cluster_id long, change string, at_us long, articles long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Spans(StatefulProcessor):
    """The open spans of one story: few, as a span goes when the watermark is a gap behind its last article."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "first_us long, last_us long, articles long, opened boolean")

    def _merged(self, spans: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for first, last, n, opened in sorted(spans):
            if out and first - out[-1][1] <= self.gap:
                f, l, m, o = out[-1]
                out[-1] = (f, max(l, last), m + n, o or opened)
            else:
                out.append((first, last, n, opened))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = [tuple(s) for s in self.spans.get()]
        for part in rows:  # a part at a time, so that a story of any size is a few spans in memory
            t = np.sort(part["published_us"].to_numpy(np.int64))
            cut = np.append(0, np.flatnonzero(np.diff(t) > self.gap) + 1) if len(t) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(t))
            spans = self._merged(spans + [(int(t[a]), int(t[b - 1]), int(b - a), False) for a, b in zip(cut, ends, strict=True)])
        self._keep(spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, left = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for first, last, n, opened in (tuple(s) for s in self.spans.get()):
            if not opened and first <= now:  # nothing earlier can come, so the span begins here
                out.append((key[0], "opened", first, None))
                opened = True
            if opened and last + self.gap <= now:
                out.append((key[0], "closed", last + self.gap, n))
            else:
                left.append((first, last, n, opened))
        self._keep(left)
        if out:
            frame = pd.DataFrame(out, columns=["cluster_id", "change", "at_us", "articles"])
            yield frame.astype({"articles": "Int64"})

    def _keep(self, spans: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if spans:
            self.spans.put(spans)
            for t in {-(-(last + self.gap) // 1000) if opened else -(-first // 1000) for first, last, _, opened in spans}:
                self.handle.registerTimer(t)
        else:
            self.spans.clear()

    def close(self) -> None:
        pass


def story_changes_stream(assigned: DataFrame, gap_us: int, lateness: str = "48 hours") -> DataFrame:
    """``partials.story_changes`` over a stream of articles with their stories (cluster_id, published_us), in append mode: a change is given out once the
    watermark has passed its time, so batches in any order within ``lateness`` give the changes of the whole table. Articles behind the watermark
    change nothing, by Spark's rule for stateful operators; ``cluster_stream`` marks them. Rows without a story or a time are left out."""
    rows = assigned.where("cluster_id is not null and published_us is not null").select("cluster_id", "published_us", F.timestamp_micros("published_us").alias("published_at"))
    keyed = rows.withWatermark("published_at", lateness).groupBy("cluster_id")
    return keyed.transformWithStateInPandas(_Spans(gap_us), CHANGES, "Append", "EventTime")
