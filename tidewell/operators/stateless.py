"""Row-by-row transforms: they stay inside code generation unless a Python function is given."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true, whole."""
    return df.where(condition)


def not_every_fourth(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id, null as 0, is not divisible by 4; negative ids keep the sign of the remainder."""
    return df.where(F.coalesce(F.col(id_col), F.lit(0)) % 4 != 0)


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in columns.items()])


def flat_map(df: DataFrame, items: Column, into: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each item of an array; null and empty arrays give none."""
    return df.select(*keep, F.explode(items).alias(into))


def flat_map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any function of a batch of rows, for what columns can't express."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(function, batches)

    return df.mapInPandas(run, schema)


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all inputs, matched by column name."""
    for other in others:
        first = first.unionByName(other)
    return first


def key_by(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def round_robin(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts)


def fan_out(df: DataFrame, n: int, into: str = "branch") -> DataFrame:
    """``n`` numbered copies of each row, made without a shuffle."""
    return df.withColumn(into, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def busy(df: DataFrame, milliseconds: float) -> DataFrame:
    """Rows unchanged, after so much work for each. For benchmarks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            end = time.perf_counter() + len(batch) * milliseconds / 1000
            while time.perf_counter() < end:
                pass
            yield batch

    return df.mapInPandas(run, df.schema)
