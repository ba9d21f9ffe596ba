"""Windows of the last rows and of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.counting import numbered

BLOCK = 100_000


def sliding_sum(df: DataFrame, keys: list[str], value: str, size: int, order: list[str], piece: Column, into: str = "total") -> DataFrame:
    """The sum of a key's last ``size`` values at each row.

    Rows are numbered and dealt to blocks by number; the last rows of a block also go to the next one, where they fill
    windows and are dropped again. No task holds all rows of a key.
    """
    block = max(BLOCK, size)
    at = F.floor((F.col("_n") - 1) / block)
    rows = numbered(df, keys, order, piece, "_n").withColumn("_block", at)
    late = (F.col("_n") - 1) % block >= block - (size - 1)
    spread = rows.withColumn("_in", F.explode(F.when(late, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array(F.col("_block")))))
    w = Window.partitionBy(*keys, "_in").orderBy("_n").rowsBetween(1 - size, 0)
    return spread.withColumn(into, F.sum(value).over(w)).where("_in = _block").drop("_n", "_block", "_in")


def time_windows(df: DataFrame, time: str, size: str, slide: str | None, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by key over epoch-aligned windows that hold their start and not their end; one row counts in several
    windows if they overlap. Without ``slide`` windows tumble."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = df.groupBy(w.alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in grouped.columns if c != "w"])


def in_window(time: Column, start: Column, end: Column) -> Column:
    """Closed membership, both ends included."""
    return time.between(start, end)


def anchored_windows(df: DataFrame, keys: list[str], time: str, size: int, slide: int, order: list[str]) -> DataFrame:
    """Windows anchored at the first record of a key, moved by one slide whenever a record is outside, late or early.

    Adds ``window_start``, ``window_end`` and ``inside``; only rows inside would be emitted. The state of a key depends on
    all of its earlier rows, so they are replayed in order by one task, which holds one batch of them at a time: a partition
    is sorted, spilling if need be, and read through. Use ``time_windows`` where this is not required. Times are numbers.
    """
    import pyarrow as pa

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", window_start long, window_end long, inside boolean"

    def replay(batches):
        last, start = None, 0
        for batch in batches:
            starts, inside = [], []
            for *key, t in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*keys, time]], strict=True):
                if key != last:
                    last, start = key, t
                inside.append(start <= t <= start + size)
                start += 0 if inside[-1] else slide
                starts.append(start)
            ends = pa.array([x + size for x in starts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64()), ends, pa.array(inside)], names=[*batch.schema.names, "window_start", "window_end", "inside"])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(replay, schema)
