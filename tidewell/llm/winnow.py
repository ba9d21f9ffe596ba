"""Benchmark decontamination by winnowing.

Words are hashed, runs of six words are hashed, and of each eight successive runs (13 words) the least hash is kept as
a fingerprint. Equal spans of 13 words have equal fingerprints, so every shared span of that length is found. Documents'
fingerprints are matched with those of the benchmark; each match is extended to the words of its window and compared.
Items of fewer words are windows of their own length and are looked up by the hash of all their words.

A benchmark of up to ``INDEX_BYTES`` is broadcast as an index, which takes some five times its text, and windows are
compared word by word. A larger one is joined by shuffles: first the fingerprints of both sides, then, for documents with
a shared one, the windows of shared fingerprints, by 128 bits of hashes. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import common, vector

WINDOW = 13
GRAM = 6
#: Benchmark text that is indexed and broadcast; more is joined by shuffles.
INDEX_BYTES = 16 << 20

WORD_BYTES = vector.byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
OTHER_VALUES = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) | vector.U(1)
OTHER_VALUES[65:91] = OTHER_VALUES[97:123]
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The least hash of a run of GRAM words in each window of WINDOW words."""
    return vector.sliding_min(vector.Rolling(hashes).grams(GRAM), WINDOW - GRAM + 1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    return vector.Rolling(hashes).grams(n)


class Index:
    """The windows of benchmark items, as positions in their words."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [item for item, _ in items]
        raw = [text.encode().translate(LOWER) for _, text in items]
        self.low = b"".join(raw)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64)
        starts, ends, rows, hashes = vector.words(np.frombuffer(self.low, np.uint8), offs, WORD_BYTES)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        count = np.bincount(rows, minlength=len(items))
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(np.minimum(count, WINDOW)).tolist():
            if not n:
                continue
            # Windows of n words: all of an item that has more, the only one of an item that has n.
            own = count >= WINDOW if n == WINDOW else count == n
            at = np.arange(len(rows) - n + 1)
            at = at[(rows[at] == rows[at + n - 1]) & own[rows[at]]]
            key = grams(hashes, n)[at]
            order = np.lexsort((at, rows[at], key))
            key, at = key[order], at[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (rows[at[1:]] != rows[at[:-1]])])  # each item once
            prints = np.unique(fingerprints(hashes)[at]) if n == WINDOW else None
            self.tables[n] = (key[new], rows[at[new]].astype(np.int32), at[new].astype(np.int32), prints)

    def candidates(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """First word, number of words, and the range in its table, of each window that may be in the index."""
        for n, (key, _, _, prints) in self.tables.items():
            if len(hashes) < n:
                continue
            at = np.arange(len(hashes) - n + 1)
            if prints is not None:
                got = fingerprints(hashes)
                at = at[prints[np.minimum(np.searchsorted(prints, got), len(prints) - 1)] == got]
            got = grams(hashes, n)[at]
            low, high = np.searchsorted(key, got), np.searchsorted(key, got, "right")
            hit = (high > low) & (rows[at] == rows[at + n - 1])
            yield from zip(at[hit].tolist(), [n] * int(hit.sum()), low[hit].tolist(), high[hit].tolist(), strict=True)

    def search(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[tuple[list[tuple[int, int]], list[str]]]]:
        """The words of each row; for each row the windows hit, in words from its first, and the items found."""
        starts, ends, rows, hashes = vector.words(data, offs, WORD_BYTES)
        counts = np.bincount(rows, minlength=len(offs) - 1)
        first = np.cumsum(counts) - counts
        out: list[tuple[list, set]] = [([], set()) for _ in counts]
        for i, n, low, high in self.candidates(hashes, rows):
            words = [data[a:b].tobytes().translate(LOWER) for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)]
            _, items, places, _ = self.tables[n]
            row = int(rows[i])
            for k in range(low, high):
                j = int(places[k])
                if words == [self.low[a:b] for a, b in zip(self.starts[j : j + n].tolist(), self.ends[j : j + n].tolist(), strict=True)]:
                    out[row][1].add(self.names[items[k]])
                    if not out[row][0] or out[row][0][-1] != (i - first[row], i + n - first[row]):
                        out[row][0].append((int(i - first[row]), int(i + n - first[row])))
        return counts, [(windows, sorted(items)) for windows, items in out]


def merged(windows: list[tuple[int, int]]) -> list[dict]:
    """Sorted spans without overlaps."""
    out: list[dict] = []
    for a, b in sorted(windows):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"first": a, "end": b})
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
SPANS_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def found_columns(counts: list, hits: list) -> list[pa.Array]:
    return [pa.array(counts, pa.int64()), pa.array([merged(w) for w, _ in hits], SPANS_ARROW), pa.array([i for _, i in hits], pa.list_(pa.string()))]


def by_index(df: DataFrame, items: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
    """Look up all windows in a broadcast index. ``items`` has the columns i and t, of at most INDEX_BYTES."""
    shared = df.sparkSession.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in items.toLocalIterator()]))
    at = df.columns.index(text_col)

    def make():
        index = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offs = vector.buffers(batch.column(at))
            counts, hits = [], []
            for a, b in vector.pieces(offs):
                c, h = index.search(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                counts += c.tolist()
                hits += h
            return pa.RecordBatch.from_arrays([*batch.columns, *found_columns(counts, hits)], names=schema.names)

        return run

    return common.arrow_map(df, make, schema)


def _rolled(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and two hashes of each word."""
    _, _, rows, hashes = vector.words(data, offs, WORD_BYTES)
    _, _, _, others = vector.words(data, offs, WORD_BYTES, OTHER_VALUES)
    return rows, hashes, others


def prints_of(texts: DataFrame, lengths: list[int], items: bool) -> DataFrame:
    """``k1``, ``k2``, ``n`` and ``print`` of the texts in column t: fingerprints, or hashes of windows of fewer words.

    Documents (``items`` false) have those of every length in ``lengths``; items only those of their own windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = vector.buffers(batch.column(2))
            for a, b in vector.pieces(offs):
                rows, hashes, _ = _rolled(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                count = np.bincount(rows, minlength=b - a)
                for n in lengths:
                    if len(hashes) < n:
                        continue
                    got = fingerprints(hashes) if n == WINDOW else grams(hashes, n)
                    at = np.arange(len(got))
                    at = at[rows[at] == rows[at + n - 1]]
                    if items:
                        at = at[count[rows[at]] >= WINDOW if n == WINDOW else count[rows[at]] == n]
                    pairs = np.unique(np.stack([rows[at].astype(np.uint64), got[at]]), axis=1)
                    take = pa.array(pairs[0].astype(np.int64) + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(take), n, np.int32)), pa.array(pairs[1].view(np.int64))], names=["k1", "k2", "n", "print"])

    common.bounded_batches(texts.sparkSession)
    return texts.mapInArrow(run, "k1 long, k2 long, n int, print long")


def windows_of(texts: DataFrame, items: bool) -> DataFrame:
    """``k1``, ``k2``, ``n``, first word and two hashes of the windows whose prints are in the column ``prints``, structs of n and print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = vector.buffers(batch.column(2))
            for i, wanted in enumerate(batch.column(3).to_pylist()):
                rows, hashes, others = _rolled(data[offs[i] : offs[i + 1]], offs[i : i + 2] - offs[i])
                for n in sorted({w["n"] for w in wanted}):
                    if len(hashes) < n or items and n != min(WINDOW, len(hashes)):
                        continue
                    got = fingerprints(hashes) if n == WINDOW else grams(hashes, n)
                    at = np.flatnonzero(np.isin(got, np.array([w["print"] for w in wanted if w["n"] == n], np.int64).view(np.uint64)))
                    take = pa.array(np.full(len(at), i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(at), n, np.int32)), pa.array(at), pa.array(grams(hashes, n)[at].view(np.int64)), pa.array(grams(others, n)[at].view(np.int64))], names=["k1", "k2", "n", "at", "h1", "h2"])

    common.bounded_batches(texts.sparkSession)
    return texts.mapInArrow(run, "k1 long, k2 long, n int, at long, h1 long, h2 long")


def by_join(df: DataFrame, items: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
    """The same for a benchmark of any size. What comes to the driver is which of the 13 window lengths there are."""
    stash = common.Stash(df.sparkSession)
    t = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    docs = df.select(*common.row_key(t(text_col)), t(text_col).alias("t"))
    bench = items.select(*common.row_key("i", "t"), "t", "i")
    every = stash(prints_of(bench.select("k1", "k2", "t"), list(range(1, WINDOW + 1)), True))
    lengths = [r["n"] for r in every.select("n").distinct().collect()]
    own = stash(prints_of(docs, lengths, False).distinct())
    known = own.join(common.sorted_side(every.select("n", "print").distinct()), ["n", "print"], "left_semi")
    known = stash(known)
    met = every.join(common.sorted_side(known.select("n", "print").distinct()), ["n", "print"], "left_semi")
    listed = lambda d: d.groupBy("k1", "k2").agg(F.collect_set(F.struct("n", "print")).alias("prints"))
    ours = windows_of(docs.join(common.sorted_side(listed(known)), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "t", "prints"), False)
    theirs = windows_of(bench.join(common.sorted_side(listed(met)), ["k1", "k2"]).select("k1", "k2", "t", "prints"), True)
    theirs = theirs.join(common.sorted_side(bench.select("k1", "k2", "i")), ["k1", "k2"]).select("n", "h1", "h2", "i").distinct()
    hits = stash(ours.join(common.sorted_side(theirs), ["n", "h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("n")).alias("end"))).alias("windows"), F.collect_set("i").alias("items")))
    k1, k2, windows, names = common.fresh(df, "k1", "k2", "windows", "items")
    a, b = common.row_key(t(text_col))
    joined = df.withColumns({k1: a, k2: b}).join(common.sorted_side(hits.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("windows").alias(windows), F.array_sort("items").alias(names))), [k1, k2], "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in df.columns], windows, names)
    at = df.columns.index(text_col)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offs = vector.buffers(batch.column(at))
            _, _, rows, _ = vector.words(data, offs, WORD_BYTES)
            hits = [([(x["first"], x["end"]) for x in w or ()], i or []) for w, i in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[:-2], *found_columns(np.bincount(rows, minlength=len(offs) - 1).tolist(), hits)], names=schema.names)

        return run

    return common.arrow_map(joined, make, schema)


def find_shared(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items")) -> DataFrame:
    """Add the number of words, the spans of words inside any shared window, and the items shared, to each row.

    Null and empty texts have no words. Equal items count once by id; a null id is the empty string. An empty benchmark
    gives no hits. Repeated rows get equal results. Texts of any length are searched whole. New columns whose names the
    table has already get a leading underscore.
    """
    n_words, spans, items = common.fresh(df, *names)
    schema = T.StructType([*df.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(spans, SPANS), T.StructField(items, T.ArrayType(T.StringType()))])
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 64).alias("n")).first()["n"] or 0
    return (by_index if size <= INDEX_BYTES else by_join)(df, rows, text_col, schema)


def n_hit(spans: str):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])


def decontaminate(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows without benchmark text, columns as they were.

    A row goes if ``WINDOW`` words in a row are shared, in a document of any length, or if a twentieth of its words is,
    which is for items that are shorter than a window. Rows without words, and all rows if no item has words, stay.
    """
    n_words, spans, items = common.fresh(df, "n_words", "hit_spans", "hit_items")
    found = find_shared(df, benchmark, names=(n_words, spans, items))
    passage = F.exists(spans, lambda s: s["end"] - s["first"] >= WINDOW)
    much = (n_hit(spans) > 0) & (20 * n_hit(spans) >= F.col(n_words))
    return found.where(~(passage | much)).select(*[F.col(f"`{c}`") for c in df.columns])


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared windows of every document with every benchmark item."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_shared(docs, common.read(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")
    return found.select(
        "doc_id",
        "n_words",
        n_hit("hit_spans").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        ((n_hit("hit_spans") > 0) & (20 * n_hit("hit_spans") >= F.col("n_words"))).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, k)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
