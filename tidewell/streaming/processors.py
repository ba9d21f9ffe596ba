"""Stateful processors that emit a row for every input row, in order, and the streams built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.streaming.ordering import Columns, in_order
from tidewell.streaming.state import DequeAccessor, MapAccessor, ValueAccessor


class Ordered(StatefulProcessor):
    """Rows of a key come in any order within a micro-batch: they are sorted first, on the disk if there are many.

    Frames come and go a few thousand rows at a time, as a micro-batch may be a whole table. Order over several
    micro-batches is the order of the source.
    """

    def __init__(self, columns: Columns):
        self.columns = columns

    def in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = [f"k{i}" for i in range(len(self.columns.keys))]
        return in_order((frame.drop(columns=keys) for frame in rows), self.columns.by)

    def out(self, key: Any, frame: pd.DataFrame, **more: Any) -> pd.DataFrame:
        return frame[[c + str(i) for i in range(self.columns.n_order) for c in "cn"]].assign(**{f"k{i}": k for i, k in enumerate(key)}, **more)

    def close(self) -> None:
        pass


class RunningCount(Ordered):
    """(key, order columns, n) after each row, or after every ``every``-th."""

    def __init__(self, columns: Columns, every: int = 1):
        super().__init__(columns)
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = ValueAccessor(handle, "cnt", "bigint", 0)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = self.count.value()
        for frame in self.in_order(rows):
            counts = np.arange(n + 1, n + len(frame) + 1)
            n += len(frame)
            shown = np.full(len(counts), True) if self.every == 1 else counts % self.every == 1
            yield self.out(key, frame[shown], n=counts[shown])
        self.count.update(n)


class SlidingSum(Ordered):
    """(key, order columns, total of the last ``size`` values) after each row. Nulls add nothing; only nulls give null."""

    def __init__(self, columns: Columns, value: str, size: int):
        super().__init__(columns)
        self.at, self.size = columns.columns.index(value), size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = DequeAccessor(handle, "last", "double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.last.value()
        values, there = np.array([0.0 if v is None else v for v in held], float), np.array([v is not None for v in held], bool)
        seen = len(held)
        for frame in self.in_order(rows):
            before, n = self.size - 1, len(frame)
            seen += n
            missing = max(0, before - len(values))
            there = np.concatenate([np.zeros(missing, bool), there[len(there) + missing - before :], ~frame[f"n{self.at}"].to_numpy(bool)])
            values = np.concatenate([np.zeros(missing), values[len(values) + missing - before :], frame[f"c{self.at}"].to_numpy(float)])
            total, found = np.zeros(n), np.zeros(n, bool)
            for i in range(self.size):
                total += values[i : i + n]
                found |= there[i : i + n]
            yield self.out(key, frame, total=pd.arrays.FloatingArray(total, ~found))
        self.last.update([float(v) if t else None for v, t in zip(values[-min(self.size, seen) :], there[-min(self.size, seen) :], strict=True)])


class TriggeredWindow(Ordered):
    """A window of ``size`` moved by ``slide`` past records outside it; user functions decide when to emit and what.

    ``trigger(row)`` says whether to emit; ``emit(row, rows)`` gives the emitted number from the row and all rows in
    the window. A record outside moves the window by as many slides as it takes, and the rows before it are let go.
    """

    def __init__(self, columns: Columns, names: tuple[str, ...], time: str, size: int, slide: int, trigger: Callable[[Row], bool], emit: Callable[[Row, list], float]):
        super().__init__(columns)
        self.names, self.time, self.size, self.slide, self.trigger, self.emit = names, time, size, slide, trigger, emit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start = ValueAccessor(handle, "start", "bigint")
        self.kept = DequeAccessor(handle, "kept", "bigint")

    def rows(self, frame: pd.DataFrame) -> Iterator[Row]:
        columns = self.columns.columns
        made = Row(*self.names)
        return (made(*values) for values in zip(*[self.columns.values(frame, columns.index(c)) for c in self.names], strict=True))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        start, kept = self.start.value(), self.kept.value()
        for frame in self.in_order(rows):
            places, emitted = [], []
            for place, row in enumerate(self.rows(frame)):
                t = row[self.time]
                start = t if start is None else start
                if t > start + self.size:
                    start += -(-(t - start - self.size) // self.slide) * self.slide
                    kept = [x for x in kept if x >= start]
                kept.append(t)
                if start <= t and self.trigger(row):
                    places.append(place)
                    emitted.append(float(self.emit(row, kept)))
            yield self.out(key, frame.iloc[places], emitted=np.array(emitted, float))
        self.start.update(start)
        self.kept.update(kept)


class AtWatermark(StatefulProcessor):
    """Something is added up for each window of ``size_ms``, and the hook is called when the watermark passes its end.

    ``add(total, row)`` gives the new total, which begins with 0; ``expire(key, end_ms, total)`` the number to emit. Rows of
    windows that are over are dropped.
    """

    def __init__(self, keys: tuple[str, ...], time: str, size_ms: int, add: Callable[[float, Row], float], expire: Callable[[Any, int, float], float]):
        self.keys, self.time, self.size, self.add, self.expire = keys, time, size_ms, add, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.totals = handle, MapAccessor(handle, "totals", "double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            end = (row[self.time] // self.size + 1) * self.size
            if end <= passed:
                continue
            if not self.totals.contains(str(end)):
                self.handle.registerTimer(end)
            self.totals.put(str(end), float(self.add(self.totals.get(str(end), 0.0), row)))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        total = self.totals.get(str(end), 0.0)
        self.totals.remove(str(end))
        yield Row(**dict(zip(self.keys, key, strict=True)), window_end_ms=int(end), emitted=float(self.expire(key, end, total)))

    def close(self) -> None:
        pass


def schema_of(df: DataFrame, columns: list[str], last: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns) + f", {last}"


def ordered(df: DataFrame, columns: Columns, processor: Ordered, last: str) -> DataFrame:
    keys = [f"k{i}" for i in range(len(columns.keys))]
    out = columns.encoded(df).groupBy(*keys).transformWithStateInPandas(processor, f"{columns.schema}, {last}", "Append", "None")
    return columns.decoded(out, last.split()[0])


def running_count(df: DataFrame, keys: list[str], order: list[str], every: int = 1) -> DataFrame:
    """The exact changelog of counts of a stream."""
    columns = Columns.of(df, keys, order)
    return ordered(df, columns, RunningCount(columns, every), "n bigint")


def sliding_sum(df: DataFrame, keys: list[str], value: str, size: int, order: list[str]) -> DataFrame:
    columns = Columns.of(df, keys, order, value)
    return ordered(df, columns, SlidingSum(columns, value, size), "total double")


def triggered_window(df: DataFrame, keys: list[str], order: list[str], time: str, size: int, slide: int, trigger: Callable[[Row], bool], emit: Callable[[Row, list], float]) -> DataFrame:
    columns = Columns.of(df, keys, order, *df.columns)
    return ordered(df, columns, TriggeredWindow(columns, tuple(df.columns), time, size, slide, trigger, emit), "emitted double")


def at_watermark(df: DataFrame, keys: list[str], time_ms: str, size_ms: int, add: Callable[[float, Row], float], expire: Callable[[Any, int, float], float]) -> DataFrame:
    """What ``expire`` gives for every key and window once the watermark of ``df`` is past the window."""
    return df.groupBy(*keys).transformWithState(AtWatermark(tuple(keys), time_ms, size_ms, add, expire), schema_of(df, keys, "window_end_ms bigint, emitted double"), "Append", "EventTime")


def with_grace(df: DataFrame, time: str, grace: str | None = "2 seconds") -> DataFrame:
    """Event time with a watermark; rows later than ``grace`` are dropped by aggregations. None keeps all."""
    stamped = df.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, grace) if grace else stamped
