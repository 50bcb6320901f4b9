"""Polls that end: for each event, one result a direction of view as soon as a track has a scene after it, until enough directions are done."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_RESULT = "event long, direction string, path int, frame int, pre long, post long, n_pre long, coherence boolean, ended string"


class TrackWatch(StatefulProcessor):
    """State by event: what each track (path, frame) has, the directions done, and how the watch ended. An event whose watch has ended gives
    no more rows, however often its scenes are polled again. A timer in event time ends a watch that waits for too long."""

    def __init__(self, directions: int, patience_ms: int):
        self.directions, self.patience_ms = directions, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scenes = handle.getMapState("scenes", "path int, frame int, acquired long", "direction string")
        self.done = handle.getMapState("done", "direction string", "post long")
        self.ended = handle.getValueState("ended", "how string")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        if self.ended.exists():
            return
        polled = pd.concat(parts)
        happened = int(polled.happened_ms.iloc[0])
        scenes = {k: d for k, (d,) in self.scenes.iterator()}
        seen = zip(polled.path.tolist(), polled.frame.tolist(), polled.acquired_ms.tolist())
        fresh = {k: d for k, d in zip(seen, polled.direction) if k not in scenes}  # a scene polled again is the same scene
        if not self.due.exists():
            self.due.update((happened + self.patience_ms,))
            self.handle.registerTimer(happened + self.patience_ms)
        tracks: dict[tuple, list[int]] = {}
        for (path, frame, at), direction in (scenes | fresh).items():
            tracks.setdefault((path, frame, direction), []).append(at)
        ready = []
        for (path, frame, direction), times in tracks.items():
            before, after = [t for t in times if t <= happened], [t for t in times if t > happened]
            if before and after:
                ready.append((min(after), path, frame, direction, max(before), len(before)))
        done, out = {k[0] for k in self.done.keys()}, []
        for post, path, frame, direction, pre, n in sorted(ready):
            if direction in done or len(done) == self.directions:
                continue
            done.add(direction)
            self.done.updateValue((direction,), (post,))
            out.append((key[0], direction, path, frame, pre, post, n, n >= 2, None))
        if len(done) == self.directions:
            self._end("done")
        else:
            for scene, direction in fresh.items():
                self.scenes.updateValue(scene, (direction,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ended.exists():
            self._end("gave up")
            yield pd.DataFrame([(key[0], None, None, None, None, None, None, None, "gave up")], columns=[c.split()[0] for c in _RESULT.split(", ")])

    def _end(self, how: str) -> None:
        self.ended.update((how,))
        self.scenes.clear()
        self.done.clear()
        if how == "done":
            self.handle.deleteTimer(self.due.get()[0])
        self.due.clear()

    def close(self) -> None:
        pass


def watched_tracks(polls: DataFrame, event: str, happened: str, acquired: str, directions: int = 2, patience: str = "60 days", late: str = "30 days") -> DataFrame:
    """(event, direction, path, frame, pre, post, n_pre, coherence, ended): from polls of scenes (event, its time, path, frame, direction, acquired), for
    each event and direction the first track with a scene before and after it; coherence: two scenes before allow it as well. After `directions` of
    them the watch ends; where that hasn't come about when the watermark is `patience` past the event, one row says so. The session's
    state store must be RocksDB (session.py)."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = polls.withWatermark(acquired, late).select(F.col(event).cast("long").alias("event"), ms(happened).alias("happened_ms"), F.col("path").cast("int"), F.col("frame").cast("int"), "direction", ms(acquired).alias("acquired_ms"), F.col(acquired))
    patience_ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    found = rows.groupBy("event").transformWithStateInPandas(TrackWatch(directions, patience_ms), _RESULT, "Append", "EventTime")
    return found.withColumns({c: F.timestamp_millis(c) for c in ("pre", "post")})
