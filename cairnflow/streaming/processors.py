"""State machines over unbounded input with ``transformWithState``: value and map state, event-time timers, state that goes when it is no longer needed.

Each processor takes rows of a key in the order of time within a trigger; between triggers rows may come late, up to the watermark. Spark
keeps their state in RocksDB, so ``spark.sql.streaming.stateStore.providerClass`` must name it (``with_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _sorted(parts: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(list(by), kind="stable")


def _ms(t) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


class Cooldown(StatefulProcessor):
    """A row fires if it comes ``minutes`` or more after the row that fired before; the mark goes when that time has passed."""

    def __init__(self, key: str, ts: str, tie: str, minutes: int):
        self.key, self.ts, self.tie, self.gap = key, ts, tie, pd.Timedelta(minutes=minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, out = (pd.Timestamp(self.mark.get()[0]) if self.mark.exists() else None), []
        frame = _sorted(rows, self.ts, self.tie)
        for at, tie in zip(frame[self.ts], frame[self.tie]):
            if mark is None or at >= mark + self.gap:
                mark = at
                out.append((key[0], at, tie))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.mark.update((mark.to_pydatetime(),))
        self.handle.registerTimer(_ms(mark + self.gap))
        yield pd.DataFrame(out, columns=[self.key, self.ts, self.tie])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.mark.clear()
        yield pd.DataFrame(columns=[self.key, self.ts, self.tie])


class Hits(StatefulProcessor):
    """Hits by kind and the last time of a key, after each trigger; forgotten ``days`` after its last row."""

    def __init__(self, key: str, ts: str, kind: str, days: int):
        self.key, self.ts, self.kind, self.days = key, ts, kind, pd.Timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getMapState("hits", "kind string", "n long")
        self.last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        for kind, n in frame[self.kind].value_counts().items():
            before = self.hits.getValue((kind,))[0] if self.hits.containsKey((kind,)) else 0
            self.hits.updateValue((kind,), (before + int(n),))
        last = max([frame[self.ts].max(), *([pd.Timestamp(self.last.get()[0])] if self.last.exists() else [])])
        self.last.update((last.to_pydatetime(),))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(_ms(last + self.days))
        held = sorted((k[0], n[0]) for k, n in self.hits.iterator())
        yield pd.DataFrame({self.key: [key[0]], "kinds": [",".join(f"{k}:{n}" for k, n in held)], "hits": [sum(n for _, n in held)], "last_at": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        self.last.clear()
        yield pd.DataFrame(columns=[self.key, "kinds", "hits", "last_at"])


class Phases(StatefulProcessor):
    """The phase of a key (its last row's kind by time, then ``tie``), the last score that is not null, and the rows so far, after each trigger. ``start``
    clears the score and the count."""

    def __init__(self, key: str, ts: str, tie: str, kind: str, score: str, start: str | None = None):
        self.key, self.ts, self.tie, self.kind, self.score, self.start = key, ts, tie, kind, score, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "phase string, at timestamp, tie long, score double, scored timestamp, scored_tie long, steps long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        phase, at, tie, score, scored, scored_tie, steps = self.now.get() if self.now.exists() else (None,) * 6 + (0,)
        for t, i, kind, value in _sorted(rows, self.ts, self.tie)[[self.ts, self.tie, self.kind, self.score]].itertuples(index=False):
            here = (t.to_pydatetime(), int(i))
            if kind == self.start and (at is None or here > (at, tie)):
                score, scored, scored_tie, steps = None, None, None, 0
            if at is None or here > (at, tie):
                phase, (at, tie) = kind, here
            if pd.notna(value) and (scored is None or here > (scored, scored_tie)):
                score, (scored, scored_tie) = float(value), here
            steps += 1
        self.now.update((phase, at, tie, score, scored, scored_tie, steps))
        yield pd.DataFrame({self.key: [key[0]], "phase": [phase], "score": pd.Series([score], dtype="float64"), "steps": [steps]})


class Overdue(StatefulProcessor):
    """Keys from which nothing came for ``minutes`` although their last row does not say ``finished``, said when the time is up."""

    def __init__(self, key: str, ts: str, tie: str, kind: str, finished: tuple[str, ...], minutes: int):
        self.key, self.ts, self.tie, self.kind, self.finished, self.wait = key, ts, tie, kind, finished, pd.Timedelta(minutes=minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, tie long, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, self.ts, self.tie)
        last = (frame[self.ts].iloc[-1].to_pydatetime(), int(frame[self.tie].iloc[-1]), frame[self.kind].iloc[-1])
        if not self.last.exists() or tuple(self.last.get())[:2] < last[:2]:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            if last[2] in self.finished:
                self.last.clear()
            else:
                self.last.update(last)
                self.handle.registerTimer(_ms(last[0] + self.wait))
        yield pd.DataFrame(columns=[self.key, "since"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({self.key: [key[0]], "since": [since]})


def processed(rows: DataFrame, processor: StatefulProcessor, columns: str, late: str, mode: str = "append", timers: bool = True) -> DataFrame:
    """A processor over a stream's keys; ``columns``: what it returns. ``late``: how far a row may come behind the latest one."""
    with_rocksdb(rows.sparkSession)
    held = rows.withWatermark(processor.ts, late).groupBy(processor.key)
    return held.transformWithStateInPandas(processor, columns, mode, "EventTime" if timers else "None")
