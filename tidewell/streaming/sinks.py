"""Sinks for data and latency, and what is measured of a query."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewell.session import Settings


def latency(df: DataFrame, ingest: str = "ingest_ts") -> DataFrame:
    """Time of output and milliseconds since ingest, by row."""
    now = F.current_timestamp()
    return df.select(F.unix_millis(now).alias("ts_ms"), ((F.unix_micros(now) - F.unix_micros(ingest)) / 1000.0).alias("latency_ms"))


def to_files(df: DataFrame, path: str, checkpoint: str, latency_path: str | None = None, ingest: str = "ingest_ts", mode: str = "append", once: bool = True, settings: Settings = Settings(), name: str | None = None) -> StreamingQuery:
    """Write a stream's rows, and its latency log if asked, batch by batch. A batch that is run again replaces its files.

    The query ends with what is there (``once``), or goes on with a batch every ``trigger_seconds``.
    """

    def write(batch: DataFrame, number: int) -> None:
        if latency_path:
            held = batch.persist()
            latency(held, ingest).write.mode("overwrite").parquet(f"{latency_path}/batch={number}")
            held.drop(ingest).write.mode("overwrite").parquet(f"{path}/batch={number}")
            held.unpersist()
        else:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{settings.trigger_seconds} seconds")).start()


def to_lines(df: DataFrame, tell: Callable[[str], None] = print, text: str = "text", checkpoint: str | None = None) -> StreamingQuery:
    """Hand each text of a stream to a function on the driver, such as ``print``: for looking at small outputs.

    Rows of a micro-batch are fetched a partition at a time.
    """

    def show(batch: DataFrame, number: int) -> None:
        for row in batch.select(text).toLocalIterator():
            tell(row[0])

    writer = df.writeStream.foreachBatch(show).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def summary(log: DataFrame) -> DataFrame:
    """Rows, mean, quantiles (nearest rank), extremes, and rows a second of a latency log by ``run``."""
    ranks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return log.groupBy("run").agg(
        F.count("*").alias("n"),
        F.round(F.avg("latency_ms"), 4).alias("mean_ms"),
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)").alias(f"{k}_ms") for k, p in ranks.items()],
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.round((F.count("*") - 1) / ((F.max("ts_ms") - F.min("ts_ms")) / 1000.0), 4).alias("rows_per_s"),
    )


def timeline(log: DataFrame, longest_ms: float | None = None, highest_ms: float | None = None, marks: dict[str, int] | None = None) -> DataFrame:
    """Samples by time since the first of their run, without those past the limits, and whether a run's mark is past."""
    first = log.groupBy("run").agg(F.min("ts_ms").alias("first_ms"))
    out = log.join(first, "run").withColumn("elapsed_ms", F.col("ts_ms") - F.col("first_ms"))
    if longest_ms is not None:
        out = out.where(F.col("elapsed_ms") < longest_ms)
    if highest_ms is not None:
        out = out.where(F.col("latency_ms") < highest_ms)
    mark = F.lit(None).cast("bigint")
    for run, at in (marks or {}).items():
        mark = F.when(F.col("run") == run, F.lit(at)).otherwise(mark)
    return out.withColumn("after_mark", F.coalesce(F.col("ts_ms") >= mark, F.lit(False))).drop("first_ms")


def gauge(name: str, value: float, **labels: str) -> str:
    inside = ",".join(f'{k}="{v}"' for k, v in sorted(labels.items()))
    return f"# TYPE {name} gauge\n{name}{'{' + inside + '}' if inside else ''} {value}\n"


def push(gateway: str, job: str, text: str) -> None:
    urllib.request.urlopen(urllib.request.Request(f"{gateway.rstrip('/')}/metrics/job/{job}", text.encode(), method="PUT"), timeout=5).close()


class Progress(StreamingQueryListener):
    """Hands each batch's rows, duration and watermark to a function, such as one that pushes gauges."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "duration_ms": p.batchDuration, "watermark": dict(p.eventTime or {}).get("watermark")})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watch(spark: SparkSession, settings: Settings, job: str = "tidewell") -> Progress | None:
    """Push the rows and the duration of each batch of every query to the gateway, if the settings name one.

    A gateway that does not answer stops nothing.
    """
    if not settings.push_gateway:
        return None

    def tell(p: dict) -> None:
        name = p["name"] or "query"
        try:
            push(settings.push_gateway, job, gauge("batch_rows", p["rows"], query=name) + gauge("batch_duration_ms", p["duration_ms"], query=name))
        except OSError:
            pass

    listener = Progress(tell)
    spark.streams.addListener(listener)
    return listener


def status(query: StreamingQuery) -> dict:
    last = query.lastProgress or {}
    return {"active": query.isActive, "rows": last.get("numInputRows"), "watermark": dict(last.get("eventTime") or {}).get("watermark"), **query.status}
