"""What the operators of this subpackage share: tables, shared storage, row keys, Arrow maps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python workers get at most so many bytes and rows at a time, whatever a text's length.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a worker's memory doesn't follow the row count."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, or a folder of our own where it is unset.

    The fallback serves sessions of one machine, such as tests; on a cluster the setting has to be there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewell-"))
    return sc.getCheckpointDir().rstrip("/")


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Shuffle files of the actions inside go when each action ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone, and nothing can be cleared any more
        pass


class Stash:
    """Written tables in the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/stash-{uuid.uuid4().hex}"
        with tidy_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        atexit.register(_delete, self.spark, path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later result reads."""
        path = self.paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)


def row_key(*columns: str | Column) -> list[Column]:
    """Two longs that name a row by its contents, so that null and repeated ids can be joined on.

    Equal rows get equal keys; callers treat these as one row of several copies.
    """
    parts: list[Column] = []
    for c in columns:
        col = F.col(c) if isinstance(c, str) else c
        parts += [F.isnull(col), col]
    return [F.xxhash64(F.lit(17), *parts).alias("k1"), F.xxhash64(F.lit(8191), *reversed(parts)).alias("k2")]


def sorted_side(df: DataFrame) -> DataFrame:
    """A side that grows with the corpus: it is joined by a shuffle at any size, never broadcast.

    The plan is then the same for small and large inputs, and a hot key's partition can be split.
    """
    return df.hint("merge")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with one state per task: ``make()`` runs once on the worker and returns the batch function."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
