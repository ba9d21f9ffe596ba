"""Sources of lines: files, paced replay, server-sent events, generated work."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidewell.session import Settings


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of one or several files, with the file each is from."""
    return spark.read.text(list(paths)).select("value", F.input_file_name().alias("file"))


def stamped(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows of a stream with the time they were read, which is also what the watermark goes by, less the grace."""
    return df.withColumn("ingest_ts", F.current_timestamp()).withWatermark("ingest_ts", f"{settings.watermark_grace_seconds} seconds")


def stream_lines(spark: SparkSession, directory: str, settings: Settings = Settings()) -> DataFrame:
    """Lines of files as they come, stamped."""
    return stamped(spark.readStream.option("maxFilesPerTrigger", settings.max_files_per_trigger).text(directory), settings)


def count_lines(df: DataFrame, parsed: str, file: str = "file") -> DataFrame:
    """Lines of each file that were parsed to something, and errors."""
    return df.groupBy(file).agg(F.count(parsed).alias("events"), F.count(F.when(F.col(parsed).isNull(), 1)).alias("errors"))


def stream_parquet(spark: SparkSession, path: str, files_per_trigger: int = Settings.max_files_per_trigger) -> DataFrame:
    """A table of Parquet files, or a single one, as a stream of bounded micro-batches."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


class _PacedReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, period_ms: float):
        self.path, self.period, self.began = path, period_ms / 1000, time.time()

    def _lines(self) -> list[str]:
        with open(self.path, encoding="utf-8") as f:
            return f.read().splitlines()

    def initialOffset(self) -> dict:
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        lines = self._lines()
        due = len(lines) if self.period <= 0 else int((time.time() - self.began) / self.period) + 1
        end = min(len(lines), max(start["line"], due))
        return iter([(n, lines[n]) for n in range(start["line"], end)]), {"line": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        lines = self._lines()
        return iter([(n, lines[n]) for n in range(start["line"], end["line"])])

    def commit(self, end: dict) -> None:
        pass


class PacedLines(DataSource):
    """One line of a small file per period (option ``period_ms``, none if 0 or less). The driver reads the file."""

    @classmethod
    def name(cls) -> str:
        return "paced_lines"

    def schema(self) -> str:
        return "line bigint, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PacedReader(self.options["path"], float(self.options.get("period_ms", "0")))


def sse_events(url: str, seconds: float, after: str | None = None) -> Iterator[tuple[str | None, str]]:
    """Id and data of server-sent events, those after an id, until the stream ends or the time is over."""
    end, data, last = time.time() + seconds, [], after
    request = urllib.request.Request(url, headers={"Last-Event-ID": after} if after else {})
    with urllib.request.urlopen(request, timeout=seconds) as answer:
        for raw in answer:
            line = raw.decode("utf-8").rstrip("\r\n")
            if line.startswith("data:"):
                data.append(line[5:].removeprefix(" "))
            elif line.startswith("id:"):
                last = line[3:].strip()
            elif not line and data:
                yield last, "\n".join(data)
                data = []
            if time.time() > end:
                return
    if data:
        yield last, "\n".join(data)


class _SseReader(SimpleDataSourceStreamReader):
    """Events are written to a log before their offsets are known to Spark, and stay until a batch is committed.

    So a batch that was planned is read again after a restart as it was, and the next one asks for what came after it.
    """

    def __init__(self, url: str, seconds: float, log: str):
        self.url, self.seconds, self.log = url, seconds, log
        os.makedirs(log, exist_ok=True)

    def initialOffset(self) -> dict:
        return {"event": 0, "last": None}

    def _file(self, start: int, end: int) -> str:
        return os.path.join(self.log, f"{start}-{end}.json")

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        got = list(sse_events(self.url, self.seconds, start["last"]))
        if not got:
            return iter([]), start
        first, end = start["event"], start["event"] + len(got)
        part = self._file(first, end) + ".part"
        with open(part, "w", encoding="utf-8") as f:
            json.dump([text for _, text in got], f)
        os.replace(part, self._file(first, end))
        return iter([(first + i, text) for i, (_, text) in enumerate(got)]), {"event": end, "last": got[-1][0]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = {}
        for name in os.listdir(self.log):
            if name.endswith(".json"):
                first, last = map(int, name.removesuffix(".json").split("-"))
                if first < end["event"] and last > start["event"]:
                    with open(os.path.join(self.log, name), encoding="utf-8") as f:
                        rows |= {first + i: text for i, text in enumerate(json.load(f))}
        return iter([(i, rows[i]) for i in range(start["event"], end["event"])])

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.log):
            if name.endswith(".json") and int(name.removesuffix(".json").split("-")[1]) <= end["event"]:
                os.remove(os.path.join(self.log, name))


class ServerSentEvents(DataSource):
    """Events of an HTTP stream (options ``url``, ``seconds`` for each micro-batch, and ``log``, a folder the driver can write to)."""

    @classmethod
    def name(cls) -> str:
        return "server_sent_events"

    def schema(self) -> str:
        return "event bigint, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _SseReader(self.options["url"], float(self.options.get("seconds", "1")), self.options["log"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PacedLines)
    spark.dataSource.register(ServerSentEvents)


def generated_work(spark: SparkSession, n: int = 10_000, ids: int = 100, servers: int = 100_000, seed: int = 1) -> DataFrame:
    """``n`` JSON lines with a uniform id and server name, the same for equal seeds."""
    digest = lambda salt: F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), F.lit(salt)))
    draw = lambda salt, k: F.conv(F.substring(digest(salt), 1, 15), 16, 10).cast("long") % k + 1
    return spark.range(n).select(F.to_json(F.struct(draw("id", ids).alias("id"), F.concat(F.lit("server-"), draw("server", servers).cast("string")).alias("server_name"))).alias("value"))


def to_json_line(record: dict) -> str:
    return json.dumps(record, ensure_ascii=False)
