"""Counts and sums by key, as they are after each row and at the end.

A running count needs the rows of a key in order. A key may hold a third of all rows, so rows are numbered within slices
of their order (such as hours), and a slice's numbers start at the sum of the counts of those before it. These sums
have one row for each key and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.serde import count_text


def numbered(df: DataFrame, keys: list[str], order: list[str], piece: Column, into: str = "n") -> DataFrame:
    """Add each row's number, from 1, among the rows of its key in the given order.

    ``piece`` must not decrease along the order. Null keys are a key. Ties are numbered in any order. Without keys all
    rows are one sequence.
    """
    keyed = df.withColumns({"_piece": piece, **{f"_k{i}": F.col(k) for i, k in enumerate(keys)}})
    by = [*[f"_k{i}" for i in range(len(keys))], "_piece"]
    sizes = keyed.groupBy(*by).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*by[:-1]).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    local = keyed.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    names = {b: f"{b}r" for b in by}
    joined = local.join(starts.withColumnsRenamed(names), [F.col(b).eqNullSafe(F.col(r)) for b, r in names.items()])
    return joined.withColumn(into, (F.col("_start") + F.col("_at")).cast("long")).drop(*by, *names.values(), "_start", "_at")


def running_count(df: DataFrame, keys: list[str], order: list[str], piece: Column, every: int = 1) -> DataFrame:
    """The count of each key after each row; with ``every`` over 1, after its first, (every + 1)-th and so on."""
    out = numbered(df, keys, order, piece)
    return out if every == 1 else out.where(F.col("n") % every == 1)


def server_count(df: DataFrame, key: str, order: list[str], piece: Column, every: int = 1) -> DataFrame:
    """The running count with its text."""
    return running_count(df, [key], order, piece, every).withColumn("text", count_text(F.col(key).cast("string"), F.col("n")))


def single_count(df: DataFrame, order: list[str], piece: Column, keys: list[str] | None = None) -> DataFrame:
    return running_count(df, keys or [], order, piece).withColumn("text", F.format_string("Count: %d", "n"))


def frequency(df: DataFrame, element: str, order: list[str], piece: Column) -> DataFrame:
    return running_count(df, [element], order, piece).withColumn("text", F.format_string("Element: %s, Frequency: %d", F.col(element).cast("string"), F.col("n")))


def final_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def summed(df: DataFrame, value: str, *keys: str, into: str = "total") -> DataFrame:
    """Sums of partial counts or values by key."""
    return df.groupBy(*keys).agg(F.sum(value).alias(into))


def reduced(df: DataFrame, aggregate: Column, *keys: str) -> DataFrame:
    """Any aggregate by key."""
    return df.groupBy(*keys).agg(aggregate)
