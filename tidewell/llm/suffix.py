"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Each such string is named by the
least hash of its ``GRAM``-byte grams, its anchor, so equal strings have equal anchors. Successive strings of one anchor
make a segment. Counting segments by contents settles most of them at once: what occurs twice goes, whole, and an anchor
of one contents needs no further look, unless the segment repeats in itself. What is left are segments that share an anchor and differ, such as those at the
edges of copied passages. These are sharded by anchor, one row for each contents, and every shard gets a suffix array:

* suffixes are classified, and the leftmost-smaller (LMS) substrings sorted by induction, a bucket at a time;
* the suffixes of the string of their names are sorted by pairs of names, then pairs of pairs, and so on, until all differ;
* the array is induced from the sorted LMS suffixes, in time linear in the shard;
* permuted common prefixes are computed where they are irreducible and follow elsewhere.

A string goes if its suffix shares ``LENGTH`` bytes with a neighbour in the array. An anchor with more than ``MANY``
contents is not brought to one shard: its strings are counted by their hashes, which gives the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import common, vector

LENGTH = 200
GRAM = 40
SPLIT = 256
MANY = 2048
SHARD_BYTES = 1 << 20


def segments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first start, number of strings, anchor, hash of contents, and whether the anchor's gram is there twice.

    A string that is found twice within a segment has its anchor's gram at two places.
    """
    n, width = len(data) - length + 1, length - gram + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    roll = vector.Rolling(vector.BYTE_VALUES[data])
    grams = roll.grams(gram)
    anchor = vector.sliding_min(grams, width)
    valid = np.zeros(len(data) + 1, np.int8)
    full = np.diff(offs) >= length
    np.add.at(valid, offs[:-1][full], 1)
    np.add.at(valid, offs[1:][full] - length + 1, -1)
    inside = np.cumsum(valid[:n]) > 0
    at = np.flatnonzero(inside)
    rows = np.searchsorted(offs, at, "right") - 1
    new = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (rows[1:] != rows[:-1])]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(since % SPLIT == 0)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    # A gram is an anchor if it equals the largest of the minima over the windows that hold it.
    pad = np.zeros(width - 1, np.uint64)
    spots = np.flatnonzero(grams == ~vector.sliding_min(~np.concatenate([pad, anchor, pad]), width))
    values, rank = np.unique(grams[spots], return_inverse=True)
    places = np.sort((rank.astype(np.int64) << 40) + spots)
    own = np.searchsorted(values, anchor[start]).astype(np.int64) << 40
    loops = np.searchsorted(places, own + start + count - 1 + width) - np.searchsorted(places, own + start) > 1
    return rows[first], start - offs[rows[first]], count, anchor[start], roll(start, start + count - 1 + length), loops


# --- suffix arrays ---------------------------------------------------------------------------------------------------


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. ``t`` ends with its only least symbol."""
    n = len(t)
    last = np.flatnonzero(np.append(t[1:] != t[:-1], True))  # of each run of equal symbols
    smaller = np.zeros(len(last), bool)
    smaller[:-1] = t[last[:-1]] < t[last[1:]]
    smaller[-1] = True
    return smaller[np.searchsorted(last, np.arange(n))]


def _deal(ch: np.ndarray, at: np.ndarray, into: dict[int, list[np.ndarray]]) -> None:
    """Append positions to the buckets of their symbols, in order."""
    if not len(at):
        return
    order = np.argsort(ch, kind="stable")
    ch, at = ch[order], at[order]
    cuts = np.flatnonzero(ch[1:] != ch[:-1]) + 1
    for c, part in zip(ch[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
        into.setdefault(c, []).append(part)


def induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS positions in order (of suffixes, or at first of their symbols only)."""
    symbols = np.unique(t).tolist()
    none = np.zeros(0, np.int64)
    seeds: dict[int, list[np.ndarray]] = {}
    _deal(t[lms], lms, seeds)
    larger: dict[int, list[np.ndarray]] = {}
    done_l: dict[int, np.ndarray] = {}
    for c in symbols:
        front, parts = np.concatenate(larger[c]) if c in larger else none, []
        while len(front):
            parts.append(front)
            before = front[front > 0] - 1
            before = before[~smaller[before]]
            ch = t[before]
            same = ch == c
            _deal(ch[~same], before[~same], larger)
            front = before[same]
        done_l[c] = np.concatenate(parts) if parts else none
        if c in seeds:
            before = np.concatenate(seeds[c])
            before = before[before > 0] - 1
            before = before[~smaller[before]]
            _deal(t[before], before, larger)
    pending: dict[int, list[np.ndarray]] = {}
    out: list[np.ndarray] = []
    for c in reversed(symbols):
        front, parts = np.concatenate(pending[c]) if c in pending else none, []
        if c == symbols[0]:
            front = np.array([len(t) - 1])
        while len(front):
            parts.append(front)
            before = front[front > 0] - 1
            before = before[smaller[before]]
            ch = t[before]
            same = ch == c
            _deal(ch[~same], before[~same], pending)
            front = before[same]
        before = done_l[c][::-1]
        before = before[before > 0] - 1
        before = before[smaller[before]]
        _deal(t[before], before, pending)
        out += [*parts, done_l[c][::-1]]
    return np.concatenate(out)[::-1]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of ``t`` in order. ``t`` ends with its only least symbol."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = classify(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        rank = np.full(n, -1, np.int64)
        rank[lms] = np.arange(len(lms))
        order = induce(t, smaller, lms)
        order = order[rank[order] >= 0]
        # Substrings reach to the next LMS position, inclusive; neighbours in this order are named alike if equal.
        roll = vector.Rolling(t.astype(np.uint64) * vector.U(0xD1342543DE82EF95) + vector.U(1))
        end = np.append(lms[1:] + 1, n)
        hashes, sizes = roll(lms, end), end - lms
        k = rank[order]
        new = np.concatenate([[0], (hashes[k[1:]] != hashes[k[:-1]]) | (sizes[k[1:]] != sizes[k[:-1]])])
        names = np.empty(len(lms), np.int64)
        names[k] = np.cumsum(new)
        lms = lms[sort_names(names)]
    return induce(t, smaller, lms)


def sort_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of the name string in order: pairs of names are named again, over twice the length each time."""
    n, step = len(names), 1
    rank = names
    while True:
        if rank.max() == n - 1:
            out = np.empty(n, np.int64)
            out[rank] = np.arange(n)
            return out
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        _, rank = np.unique(key, return_inverse=True)
        step *= 2


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the one before it in order (itself for the first), and the length of their common prefix.

    Lengths are found by comparing hashes where the symbols before the two suffixes differ. Elsewhere they are one less
    than at the position before. None is longer than ``most``.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]], phi[sa[0]] = sa[:-1], sa[0]
    at = np.arange(n)
    before = (at > 0) & (phi > 0) & (phi != at)
    irreducible = np.ones(n, bool)
    irreducible[before] = t[at[before] - 1] != t[phi[before] - 1]
    own = np.flatnonzero(irreducible)
    roll = vector.Rolling(t.astype(np.uint64) * vector.U(0xD1342543DE82EF95) + vector.U(1))
    low, other = np.zeros(len(own), np.int64), phi[own]
    step = 1 << max(0, most.bit_length() - 1)
    while step:
        size = low + step
        fits = (np.maximum(own, other) + size <= n) & (own != other)
        ok = np.zeros(len(own), bool)
        a, b, s = own[fits], other[fits], size[fits]
        ok[fits] = roll(a, a + s) == roll(b, b + s)
        low = np.where(ok, size, low)
        step >>= 1
    prefix = np.zeros(n, np.int64)
    prefix[own] = low
    source = np.maximum.accumulate(np.where(irreducible, at, 0))
    return phi, np.maximum(prefix[source] - (at - source), 0)


def repeated_in_shard(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of several different strings, whether the string of ``length`` bytes at each place is found elsewhere."""
    m = len(contents)
    sizes = np.array([len(c) for c in contents])
    ends = np.cumsum(sizes + 1)
    t = np.empty(int(ends[-1]), np.int64)
    mark = ends - 1
    body = np.ones(len(t), bool)
    body[mark] = False
    t[body] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int64) + m
    t[mark] = np.arange(m)[::-1]  # each end has a symbol of its own, the last the least
    sa = suffix_array(t)
    phi, prefix = permuted_prefixes(t, sa, int(sizes.max()))
    found = prefix >= length
    twice = found.copy()
    twice[phi[found]] = True
    return [twice[e - 1 - s : e - 1 - s + max(0, s - length + 1)] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def ranges(flags: np.ndarray) -> list[dict]:
    """Runs of true places, as first and number."""
    turns = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"first": int(a), "n": int(b - a)} for a, b in zip(turns[::2], turns[1::2], strict=True)]


# --- tables ----------------------------------------------------------------------------------------------------------

RANGE = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))


def segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """Segments of all texts: keys of the document, anchor, hash of contents, first start and number of strings."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offs = vector.buffers(batch.column(2))
            parts = [[], [], [], [], [], []]
            for a, b in vector.pieces(offs):
                for part, x in zip(parts, segments(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], length, min(GRAM, length)), strict=True):
                    part.append(x + a if part is parts[0] else x)
            rows, start, count, anchor, contents, loops = (np.concatenate(p) for p in parts)
            take = pa.array(rows)
            return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor.view(np.int64)), pa.array(contents.view(np.int64)), pa.array(start), pa.array(count), pa.array(loops)], names=["k1", "k2", "anchor", "contents", "start", "n", "loops"])

        return run

    return common.arrow_map(docs, make, "k1 long, k2 long, anchor long, contents long, start long, n long, loops boolean")


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Starts of strings to remove, as keys of the document, first and number. ``docs`` has k1, k2 and text.

    Null and empty texts, and those shorter than ``length``, have none. Equal keys are copies of one text, whose strings are
    then found elsewhere. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stash = common.Stash(spark)
    rows = stash(segment_rows(docs, length))  # texts are hashed once
    counts = stash(rows.groupBy("anchor", "contents").agg(F.count("*").alias("copies"), F.max("loops").alias("loops")))
    mixed = counts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = stash(counts.join(mixed, "anchor", "left").where("copies > 1 or kinds > 1 or loops"))
    stash.drop(counts)
    found = stash(rows.drop("loops").join(wanted, ["anchor", "contents"]))
    stash.drop(rows)
    whole = found.where("copies > 1").select("k1", "k2", F.col("start").alias("first"), "n")
    # One occurrence of each contents is fetched where an anchor has several, or one that may repeat in itself.
    chosen = found.where("kinds > 1 or (loops and copies = 1)").withColumn("kinds", F.coalesce("kinds", F.lit(1).cast("long"))).groupBy("anchor", "contents", "kinds", "n").agg(F.min(F.struct("k1", "k2", "start")).alias("at"))
    chosen = chosen.select("anchor", "contents", "kinds", "n", "at.*")
    text = docs.select("k1", "k2", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    fetched = stash(chosen.join(text, ["k1", "k2"]).select("anchor", "contents", "kinds", F.substring("bytes", F.col("start").cast("int") + 1, (F.col("n") - 1 + length).cast("int")).alias("bytes")).dropDuplicates(["anchor", "contents"]))
    total = fetched.where(F.col("kinds") <= MANY).agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def in_shard(table: pa.Table) -> pa.Table:
        flags = repeated_in_shard(table.column("bytes").to_pylist(), length)
        return pa.table([table.column("anchor"), table.column("contents"), pa.array([ranges(f) for f in flags], RANGE)], names=["anchor", "contents", "ranges"])

    few = fetched.where(F.col("kinds") <= MANY).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    partly = few.groupBy("shard").applyInArrow(in_shard, "anchor long, contents long, ranges array<struct<first:bigint,n:bigint>>").select("anchor", "contents", F.explode("ranges").alias("r"))
    many = fetched.where(F.col("kinds") > MANY)
    if not many.isEmpty():
        partly = partly.union(by_hash(many, length))
    partly = stash(partly)
    single = found.where("copies = 1").select("k1", "k2", "anchor", "contents", "start")
    return stash(whole.union(single.join(partly, ["anchor", "contents"]).select("k1", "k2", (F.col("start") + F.col("r.first")).alias("first"), F.col("r.n").alias("n"))))


def by_hash(many: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many contents: strings counted by anchor and hash."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offs = vector.buffers(batch.column(2))
            roll = vector.Rolling(vector.BYTE_VALUES[data])
            back = vector.Rolling(vector.BYTE_VALUES[::-1][data])
            count = np.maximum(np.diff(offs) - length + 1, 0)
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = offs[row] + place
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(place), pa.array(roll(at, at + length).view(np.int64)), pa.array(back(at, at + length).view(np.int64))], names=["anchor", "contents", "place", "h1", "h2"])

        return run

    strings = common.arrow_map(many.select("anchor", "contents", "bytes"), make, "anchor long, contents long, place long, h1 long, h2 long")
    strings = common.Stash(many.sparkSession)(strings)
    twice = strings.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    return strings.join(twice, ["h1", "h2"], "left_semi").select("anchor", "contents", F.struct(F.col("place").alias("first"), F.lit(1).cast("long").alias("n")).alias("r"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Id, bytes, removed spans (first byte and end) and the kept bytes of every row.

    Null and empty texts have no bytes, and texts shorter than ``length`` lose none. Repeated rows are copies of each other,
    so both lose what they share. An empty table gives no rows. Memory is in proportion to the longest text.
    """
    docs = df.select(*common.row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gone = repeated_ranges(docs.select("k1", "k2", "text"), length).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("ranges"))
    joined = docs.join(gone, ["k1", "k2"], "left").select("id", "text", "ranges")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, spans, kept = [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                merged: list[dict] = []
                for a, b in sorted((r["first"], r["first"] + r["n"] - 1 + length) for r in own or ()):
                    if merged and a <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], b)
                    else:
                        merged.append({"first": a, "end": b})
                cuts = [0, *(x for s in merged for x in (s["first"], s["end"])), len(raw)]
                sizes.append(len(raw))
                spans.append(merged)
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "removed_spans", "kept"])

        return run

    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("removed_spans", span), T.StructField("kept", T.BinaryType())])
    return common.arrow_map(joined, make, schema)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and keeps."""
    out = without_repeats(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"]).alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
