"""Quality rules: cross-document line frequency, over base counts of words.

Lines are normalised (ASCII white space collapsed, A-Z lower-cased), hashed, and the distinct documents of each host
that have them counted. Two choices keep text from being lost altogether: copies of one text are one document, as it is
for later steps to take out copies; and a line on more than ``max_docs`` documents of a host is removed from all of them
but the one of least digest. A document is depleted, and rejected, if less than ``min_share`` of its words are left.

Every step is an aggregation with partial sums or a join that can split a hot side: a line found in a third of all
documents is one row of counts for each task.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import common

MAX_DOCS = 10
MIN_SHARE = (1, 5)
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines with a word, words in repeated windows of three."""
    raw = text.encode()
    words = raw.split()  # at 0x20 and 0x09-0x0D
    n = len(words)
    blank = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(raw.count(c) for c in SYMBOLS)
    lines = Counter(line for line in raw.split(b"\n") if line.split(None, 1))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, len(text) - blank, symbols, sum(lines.values()) - len(lines), repeated


def with_base(df: DataFrame, text_col: str, names: tuple[str, ...]) -> DataFrame:
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [base_counts(t or "") for t in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], names=schema.names)

        return run

    return common.arrow_map(df, make, schema)


def worded(line: Column) -> Column:
    """Whether a raw line has a word."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def normalised(line: Column) -> Column:
    """Lower-cased A-Z, white space collapsed and trimmed; empty for a line without words.

    The general functions are kept for the lines that need them: ASCII is lower-cased as bytes, and single spaces stay.
    """
    ascii_only = F.octet_length(line) == F.length(line)
    low = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    uneven = F.contains(line, F.lit("  "))
    for c in "\t\n\x0b\x0c\r":
        uneven |= F.contains(line, F.lit(c))
    return F.trim(F.when(uneven, F.regexp_replace(low, r"[\x20\x09-\x0D]+", " ")).otherwise(low))


def n_words(line: Column) -> Column:
    """Words of a normalised line."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1)


def line_key(host: Column, line: Column) -> Column:
    """The name of a normalised line of a host."""
    return F.xxhash64(F.coalesce(host, F.lit("")), line)


def lines_of(df: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """One row for each line with a word of each row: key of the row, text digest, hash of host and line, words."""
    rows = df.select(*common.row_key(host_col, text_col), F.col(host_col).alias("host"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("raw"))
    rows = rows.where(worded(F.col("raw"))).select("k1", "k2", "host", F.expr("cast(conv(substr(digest, 1, 15), 16, 10) as bigint)").alias("doc"), normalised(F.col("raw")).alias("line"))
    return rows.select("k1", "k2", "doc", line_key(F.col("host"), F.col("line")).alias("h"), n_words(F.col("line")).cast("long").alias("w"))


def over_limit(lines: DataFrame, max_docs: int) -> DataFrame:
    """Hosts' lines on more than ``max_docs`` distinct documents, with the document that keeps them."""
    return lines.groupBy("h").agg(F.countDistinct("doc").alias("n"), F.min("doc").alias("keeper")).where(F.col("n") > max_docs).select("h", "keeper")


def removed_lines(df: DataFrame, text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """Row keys with the hashes of lines to remove and the number of words these have; copies share a row."""
    lines = common.Stash(df.sparkSession)(lines_of(df, text_col, host_col))  # texts are split and normalised once
    frequent = over_limit(lines, max_docs)
    # Equal rows have equal keys, so occurrences are counted by line and then shared out among the copies of the row.
    copies = df.groupBy(*common.row_key(host_col, text_col)).agg(F.count("*").alias("copies"))
    hit = lines.join(frequent, "h").where("doc <> keeper").groupBy("k1", "k2").agg(F.sum("w").alias("w"), F.collect_set("h").alias("removed"))
    return hit.join(copies, ["k1", "k2"]).select("k1", "k2", "removed", F.expr("w div copies").alias("n_removed_words"))


def rules(df: DataFrame, text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_share: tuple[int, int] = MIN_SHARE) -> DataFrame:
    """Counts and verdict for every row, with all its columns.

    Null and empty texts have no words and fail the base rule. A null host is the host named by the empty string. Repeated rows are
    each judged, alike. Long texts are read whole. New columns whose names the table has already get a leading underscore.
    """
    names = common.fresh(df, *COUNTS, "base_failed", "n_removed_words", "removed_lines", "kept")
    n, _, _, _, repeat = names[:5]
    failed, gone, hashes, kept = names[5:]
    k1, k2 = common.fresh(df, "k1", "k2")
    removed = removed_lines(df, text_col, host_col, max_docs).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("n_removed_words").alias(gone), F.col("removed").alias(hashes))
    a, b = common.row_key(host_col, text_col)
    base = with_base(df, text_col, tuple(names[:5])).withColumns({k1: a, k2: b})
    return (
        base.join(common.sorted_side(removed), [k1, k2], "left")
        .withColumn(gone, F.coalesce(gone, F.lit(0).cast("long")))
        .withColumn(failed, (F.col(n) < 50) | (100 * F.col(repeat) > 50 * F.col(n)))
        .withColumn(kept, ~F.col(failed) & (min_share[1] * (F.col(n) - F.col(gone)) >= min_share[0] * F.col(n)))
        .drop(k1, k2)
    )


def filtered(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows that pass, without the lines above the limit, in the columns of ``df``."""
    names = common.fresh(df, *COUNTS, "base_failed", "n_removed_words", "removed_lines", "kept")
    judged = rules(df, text_col, host_col).where(F.col(names[-1]))
    gone = F.col(names[7])
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(gone, line_key(F.col(host_col), normalised(x)))), "\n"))
    return judged.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in df.columns])


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # The verdict needs the text no more: the join carries counts only.
    a, b = common.row_key("source", "text")
    base = with_base(docs.withColumns({"k1": a, "k2": b}), "text", COUNTS).drop("text", "source")
    removed = removed_lines(docs).select("k1", "k2", "n_removed_words")
    share = MIN_SHARE
    return (
        base.join(removed, ["k1", "k2"], "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (share[1] * (F.col("n_words") - F.col("n_removed_words")) >= share[0] * F.col("n_words")))
        .select("doc_id", *COUNTS, "base_failed", "n_removed_words", "kept")
    )


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT r, doc_id, host, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols FROM d),
l AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS raw FROM d),
n AS (SELECT r, host, ('0x' || substr(md5(t), 1, 15))::BIGINT AS doc, raw, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM l),
q AS (SELECT * FROM n WHERE line <> ''),
dup AS (SELECT r, CAST(count(*) - count(DISTINCT raw) AS BIGINT) AS n FROM q GROUP BY r),
win AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT r, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1) GROUP BY r),
f AS (SELECT host, line, min(doc) AS keeper FROM q GROUP BY host, line HAVING count(DISTINCT doc) > {MAX_DOCS}),
g AS (SELECT r, CAST(sum(length(line) - length(replace(line, ' ', '')) + 1) AS BIGINT) AS n FROM q JOIN f USING (host, line) WHERE doc <> keeper GROUP BY r),
x AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_removed_words
  FROM c LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN g USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {MIN_SHARE[1]} * (n_words - n_removed_words) >= {MIN_SHARE[0]} * n_words AS kept FROM x
"""
