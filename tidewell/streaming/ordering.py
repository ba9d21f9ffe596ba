"""Rows in order, in bounded memory, and columns in forms that pass through pandas unchanged."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is sorted in memory at once. Runs of it lie on the disk; so many rows of each, and so many runs, are merged at once.
RUN_BYTES = 16 << 20
HEAD = 10_000
FAN = 16

_MICROS = (T.TimestampType, T.TimestampNTZType)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _plain(c: Column, kind: T.DataType) -> Column:
    """The column as a number, a string or what it is, without nulls where it can be ordered."""
    if isinstance(kind, _MICROS):
        return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(0))
    if isinstance(kind, T.DateType):
        return F.coalesce(F.unix_date(c).cast("bigint"), F.lit(0))
    if isinstance(kind, _INTEGERS):
        return F.coalesce(c.cast("bigint"), F.lit(0))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(c, F.lit("").cast(kind))
    if isinstance(kind, T.DecimalType):
        return F.coalesce(c, F.lit(0).cast(kind))
    return c


def _spark(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, _MICROS):
        return F.timestamp_micros(c).cast(kind)
    return F.date_from_unix_date(c.cast("int")) if isinstance(kind, T.DateType) else c.cast(kind)


@dataclass(frozen=True)
class Columns:
    """A stream's keys and those of its columns that are needed, the ones of the order first.

    In pandas, integers with nulls become inexact and null keys unequal. So column ``i`` goes as ``c<i>`` and, where it is
    null, ``n<i>``; key ``i`` goes as ``k<i>``, a string.
    """

    keys: tuple[str, ...]
    columns: tuple[str, ...]
    kinds: tuple[T.DataType, ...]
    key_kinds: tuple[T.DataType, ...]
    n_order: int

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], order: list[str], *more: str) -> Columns:
        names = tuple(dict.fromkeys([*order, *more]))
        kind = lambda c: df.select(c).schema[0].dataType
        return cls(tuple(keys), names, tuple(map(kind, names)), tuple(map(kind, keys)), len(dict.fromkeys(order)))

    @property
    def by(self) -> list[str]:
        """What to sort by: nulls are last, as in the SQL."""
        return [x for i in range(self.n_order) for x in (f"n{i}", f"c{i}")]

    @property
    def schema(self) -> str:
        """Of what a processor gives: keys, columns of the order."""
        plain = {f"c{i}": "bigint" if isinstance(k, (*_MICROS, T.DateType, *_INTEGERS)) else "double" if isinstance(k, T.FloatType) else k.simpleString() for i, k in enumerate(self.kinds[: self.n_order])}
        return ", ".join([*[f"k{i} string" for i in range(len(self.keys))], *[f"{c} {k}, n{c[1:]} boolean" for c, k in plain.items()]])

    def encoded(self, df: DataFrame) -> DataFrame:
        keys = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(self.keys)]
        return df.select(*keys, *[x for i, (c, k) in enumerate(zip(self.columns, self.kinds, strict=True)) for x in (_plain(F.col(c), k).alias(f"c{i}"), F.col(c).isNull().alias(f"n{i}"))])

    def decoded(self, df: DataFrame, *more: str) -> DataFrame:
        keys = [F.col(f"k{i}").cast(kind).alias(k) for i, (k, kind) in enumerate(zip(self.keys, self.key_kinds, strict=True))]
        order = [F.when(~F.col(f"n{i}"), _spark(F.col(f"c{i}"), kind)).alias(c) for i, (c, kind) in enumerate(zip(self.columns[: self.n_order], self.kinds, strict=False))]
        return df.select(*keys, *order, *more)

    def values(self, frame: pd.DataFrame, i: int) -> list[Any]:
        """A column's values as Python has them."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind, held, null = self.kinds[i], frame[f"c{i}"], frame[f"n{i}"].to_numpy(bool)
        to = to_arrow_type(kind)
        if isinstance(kind, (*_MICROS, T.DateType, *_INTEGERS, T.FloatType, T.DoubleType)):
            numbers = pa.array(held.to_numpy(), mask=null)
            return (numbers.cast("int32") if isinstance(kind, T.DateType) else numbers).cast(to).to_pylist()
        return pa.array([None if n else x for x, n in zip(held, null, strict=True)], to).to_pylist()


def in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of all frames, sorted, in frames of up to ``HEAD`` rows.

    Up to ``RUN_BYTES`` are sorted in memory. More go to temporary files as sorted runs; ``FAN`` runs of a level are merged
    to one of the next, so memory and open files do not grow with the rows but by the logarithm.
    """
    levels: list[list[Iterator[pd.DataFrame]]] = []
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += int(frame.memory_usage(index=False, deep=True).sum())
        if size >= RUN_BYTES:
            _add(levels, _spilled(_pieces(_sorted(held, by))), by)
            held, size = [], 0
    last = _pieces(_sorted(held, by)) if held else iter(())
    held = []
    yield from _merged([*[run for level in levels for run in level], last], by) if levels else last


def _add(levels: list[list], run: Iterator[pd.DataFrame], by: list[str], level: int = 0) -> None:
    if level == len(levels):
        levels.append([])
    levels[level].append(run)
    if len(levels[level]) == FAN:
        runs, levels[level] = levels[level], []
        _add(levels, _spilled(_merged(runs, by)), by, level + 1)


def _sorted(frames: list[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    rows = pd.concat(frames, ignore_index=True)
    return rows.take(np.lexsort([rows[c].to_numpy() for c in reversed(by)])).reset_index(drop=True)


def _pieces(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for i in range(0, len(rows), HEAD):
        yield rows.iloc[i : i + HEAD]


def _spilled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same frames, from a file without a name in Spark's local folder, which is gone once it is read or let go."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
    n = 0
    for n, frame in enumerate(frames, 1):
        pickle.dump(frame, file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)

    def read() -> Iterator[pd.DataFrame]:
        with file:
            for _ in range(n):
                yield pickle.load(file)

    return read()


def _merged(runs: list[Iterator[pd.DataFrame]], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted runs as one. Of each run a few rows are held; what is not beyond the last one held of any run can go."""
    left, pool = dict(enumerate(runs)), []
    counts = np.zeros(len(runs), int)
    while True:
        for k in list(left):
            while k in left and counts[k] < max(1, HEAD // 2):
                piece = next(left[k], None)
                if piece is None:
                    del left[k]
                else:
                    pool.append(piece.assign(run=k))
                    counts[k] += len(piece)
        if not pool:
            return
        rows = _sorted(pool, by)
        of = rows["run"].to_numpy()
        cut = min((int(np.flatnonzero(of == k)[-1]) + 1 for k in left), default=len(rows))
        yield from _pieces(rows.iloc[:cut].drop(columns="run"))
        pool = [rows.iloc[cut:]] if cut < len(rows) else []
        counts = np.bincount(of[cut:], minlength=len(runs))
