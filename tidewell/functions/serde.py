"""Text to records and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIKI_INFO = "id bigint, server_name string"
RECENT_CHANGE = "type string, timestamp string, user string, server_name string"
LATENCY = "ts_ms bigint, latency_ms double"


def parse_json(df: DataFrame, schema: str, value: str = "value", strict: bool = False, keep: bool = False) -> DataFrame:
    """Columns of ``schema`` from a JSON column. Malformed lines fail the query if ``strict``, else they are dropped.

    With ``keep`` they stay as rows of nulls. Fields that are not in the schema are ignored.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    names = [part.split()[0] for part in schema.split(",")]
    parsed = F.from_json(F.col(value), f"{schema}, _bad string" if not strict else schema, {"mode": mode, "columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("_parsed", parsed)
    if not strict and not keep:
        out = out.where("_parsed is not null and _parsed._bad is null and trim(" + value + ") <> ''")
    return out.select(*[F.col(f"_parsed.{n}").alias(n) for n in names])


def wiki_info(df: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """``(id, server_name)``; a missing or null id counts as 0."""
    return parse_json(df, WIKI_INFO, value, strict).select(F.coalesce("id", F.lit(0).cast("long")).alias("id"), "server_name")


def recent_change(df: DataFrame, value: str = "value") -> DataFrame:
    """The four text fields of a change; missing ones are empty and malformed lines are dropped."""
    return parse_json(df, RECENT_CHANGE, value).na.fill("")


def to_text(df: DataFrame, into: str = "value") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(into))


def count_text(key: Column, n: Column) -> Column:
    return F.format_string("Count for server-name: <%s>: [%d]", key, n)
