"""Sessions with the settings that streaming state and time need."""

from __future__ import annotations

import json
import tempfile
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Settings:
    """Options of a deployment; ``load`` reads them from a JSON file and ignores keys it does not know.

    ``sources.lines.stream_lines`` takes the grace and the files of a micro-batch, ``streaming.sinks.to_files`` the trigger,
    ``streaming.sinks.watch`` the gateway, and ``build`` the rest.
    """

    shuffle_partitions: int | None = None
    watermark_grace_seconds: float = 2.0
    watermark_policy: str = "min"
    state_provider: str = ROCKSDB
    trigger_seconds: float = 1.0
    max_files_per_trigger: int = 100
    push_gateway: str | None = None

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(Path(path).read_text()).items() if k in known})


def build(master: str | None = None, settings: Settings = Settings()) -> SparkSession:
    builder = SparkSession.builder.appName("tidewell").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if settings.shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(settings.shuffle_partitions))
    return ready(builder.getOrCreate(), settings)


def ready(spark: SparkSession, settings: Settings = Settings()) -> SparkSession:
    """Put a given session's clock, state store and watermarks right for streaming queries.

    A query of several inputs goes by the least of their watermarks, unless the settings say ``max``.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", settings.state_provider)
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", settings.watermark_policy)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, ``spark.checkpoint.dir``; a temporary one only where there is one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return "file://" + tempfile.mkdtemp(prefix="tidewell-stream-")
