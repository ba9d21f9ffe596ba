"""Sharding by extendible hashing.

Each row has a hash of 60 bits; a bucket is a prefix of these. All rows start in the bucket of no bits. A bucket over
the byte limit splits on its next bit, and only such buckets do, until every one fits. The directory, indexed by the
bits of the global depth, has an entry for each slot; several slots share a bucket of smaller local depth.

Bytes are summed once per slot of a directory fine enough for most buckets; the tree above it follows from those sums.
Slots that are still too large, because a few rows are very long, get more bits in further rounds, which touch the
rows of these slots alone. Rows equal in id and text share a hash, which no bit can split: they are dealt to numbered
pages of their bucket that hold as many rows as fit. A row longer than the limit is a shard of its own, ``fits`` false.

All of it is DataFrame operations. What is joined to the rows is the list of slots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm import common

SHARD_BYTES = 1 << 20
#: Bits beyond the number of shards that a perfect deal would need.
SLACK_BITS = 4
STEP_BITS = 16
HASH_BITS = 60


def hash_bits(id_col: str, text_col: str) -> Column:
    """The first 60 bits of an MD5 digest of id and text, as a string of 0 and 1."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.lpad(F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def directory(sums: DataFrame, root: int, depth: int, limit: int) -> DataFrame:
    """From bytes by slot of ``depth`` bits to the bucket of each slot; all buckets above split from ``root`` bits on.

    A bucket is the shortest prefix of at least ``root`` bits that fits; a slot that doesn't fit stays whole.
    """
    levels = sums.select("slot", "bytes", F.explode(F.sequence(F.lit(root), F.lit(depth))).alias("bits")).withColumn("prefix", F.expr("substr(slot, 1, bits)"))
    sizes = levels.groupBy("prefix").agg(F.sum("bytes").alias("size"))
    fitting = levels.join(sizes, "prefix").where((F.col("size") <= limit) | (F.col("bits") == depth))
    return fitting.groupBy("slot").agg(F.min_by("prefix", "bits").alias("bucket"), F.min_by("size", "bits").alias("bucket_bytes"))


def shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Id, bytes, shard, local depth, page, the shard's bytes and whether it fits, for every row.

    A null text has no bytes; null ids hash as the empty string. An empty table gives no rows. Repeated rows are dealt to
    pages where their bucket is too large for them. A row over the limit is alone on a page, marked as not fitting.
    """
    spark = df.sparkSession
    stash = common.Stash(spark)
    # The text is read once; id, hash and length are all that later steps need.
    rows = stash(df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(id_col, text_col).alias("h")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(HASH_BITS, math.ceil(math.log2(max(1, total / limit))) + SLACK_BITS)
    done, open_rows, root = [], rows, 0
    while True:
        slot = F.substring("h", 1, depth)
        slots = stash(directory(open_rows.groupBy(slot.alias("slot")).agg(F.sum("n_bytes").alias("bytes")), root, depth, limit))
        dealt = open_rows.withColumn("slot", slot).join(slots, "slot").drop("slot")
        done.append(dealt.where(F.col("bucket_bytes") <= limit))
        if depth == HASH_BITS or slots.where(F.col("bucket_bytes") > limit).isEmpty():
            break
        open_rows = stash(dealt.where(F.col("bucket_bytes") > limit).drop("bucket", "bucket_bytes"))
        root, depth = depth, min(HASH_BITS, depth + STEP_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    whole = out.withColumns({"page": F.lit("0"), "shard_bytes": F.col("bucket_bytes")})
    left = dealt.where(F.col("bucket_bytes") > limit)
    return whole.union(pages(left, limit)).select(F.col("id").alias(id_col), "n_bytes", F.col("bucket").alias("prefix"), F.length("bucket").alias("depth"), "page", "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """Deal rows that share all bits of their hash to pages, each of as many rows as fit.

    Rows are numbered within each input partition, and the numbers of the partitions before are added, so that a third of
    all rows being equal does not bring them to one task. As such rows are alike, pages do not follow the layout of files.
    """
    w = Window.partitionBy("bucket", "part").orderBy("n_bytes")
    numbered = common.Stash(rows.sparkSession)(rows.withColumn("part", F.spark_partition_id()).withColumn("no", F.row_number().over(w).cast("long") - 1))
    counts = numbered.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.max("n_bytes").alias("most"))
    bucket = Window.partitionBy("bucket")
    before = F.coalesce(F.sum("n").over(bucket.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("bucket", "part", before.alias("before"), F.max("most").over(bucket).alias("most")).withColumn("per_page", F.greatest(F.lit(1), F.expr(f"{limit} div most")))
    paged = numbered.join(placed, ["bucket", "part"]).withColumn("page", F.expr("(before + no) div per_page").cast("string"))
    return paged.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("bucket", "page"))).select("id", "n_bytes", "h", "bucket", "bucket_bytes", "page", "shard_bytes")


def op2_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shards(common.read(spark, sf_dir, "documents").select("doc_id", "text"))


def sql(limit: int) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
  right(to_binary(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT + 1152921504606846976), 60) AS h FROM documents),
e AS (SELECT r, n_bytes, CAST(bits AS INTEGER) AS bits, substr(h, 1, bits) AS prefix FROM d, range(61) AS s(bits)),
p AS (SELECT prefix, sum(n_bytes) AS size FROM e GROUP BY prefix),
m AS (SELECT r, min(bits) AS depth FROM e JOIN p USING (prefix) WHERE size <= {limit} GROUP BY r),
q AS (SELECT r, (row_number() OVER (PARTITION BY h) - 1) // greatest(1, {limit} // max(n_bytes) OVER (PARTITION BY h)) AS page FROM d WHERE r NOT IN (SELECT r FROM m)),
a AS (SELECT doc_id, n_bytes, substr(h, 1, coalesce(depth, 60)) AS prefix, coalesce(depth, 60) AS depth, CAST(coalesce(page, 0) AS VARCHAR) AS page FROM d LEFT JOIN m USING (r) LEFT JOIN q USING (r))
SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY prefix, page) AS BIGINT) AS shard_bytes, sum(n_bytes) OVER (PARTITION BY prefix, page) <= {limit} AS fits FROM a
"""


OP2_SQL = sql(SHARD_BYTES)
