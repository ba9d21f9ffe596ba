"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

A shingle is five words; its weight in a document is its count times ``ln(1 + N / df)``, with ``df`` at least
``COMMON`` of the N documents, so only shingles found in more documents than that need to be known by name. There are
at most (shingles of a mean document) / COMMON of these, whatever the size of the corpus. They are found exactly: counts
by hash bucket leave few buckets that can hold one, and the shingles of those are counted one by one.

Consistent weighted sampling draws, for each of ``BANDS * ROWS`` seeds, a shingle and a level so that two documents agree
with the probability of their weighted Jaccard similarity. Texts that agree on all rows of a band share a bucket.
Equal texts are one node throughout. In a bucket of up to ``PAIRED`` texts each is compared with each; in a larger one
all are compared with one of them, drawn by hash, and the bucket is split by the next band, again and again. Candidates
become links if their exact weighted Jaccard similarity reaches ``SIMILAR``.

Where a larger bucket still holds several classes, all its texts are compared with its hub, the one that shares buckets
with the most others, which joins what random leaders leave apart. Texts of classes that are still apart are then joined
through an index of their rarest shingles, which misses no pair that is similar enough. So every similar pair of a
bucket is in one class, though pairs within a class are not all compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import common, vector
from tidewell.llm.components import components, merged

WORDS = 5
SIMILAR = 0.8
COMMON = 0.05
BANDS, ROWS = 10, 4
PAIRED = 12
BUCKETS = 1 << 16
#: Counters by which shingles are ordered from rare to common in the prefix index; any order gives the same pairs.
RARITY_BITS = 18
WORD = vector.byte_table(lambda b: b not in (9, 10, 11, 12, 13, 32))

_random = np.random.default_rng(77)
_LEVELS = 1 << 16
#: Tables of Gamma(2, 1) variates: the rate r, and the logarithm of c.
GAMMA = np.sort(_random.gamma(2.0, 1.0, _LEVELS))[_random.permutation(_LEVELS)]
LOG_C = np.log(np.sort(_random.gamma(2.0, 1.0, _LEVELS)))[_random.permutation(_LEVELS)]
SEEDS = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles of each text, by row. A text of fewer words is one shingle."""
    n = len(offs) - 1
    _, _, rows, hashes = vector.words(data, offs, WORD)
    roll = vector.Rolling(hashes)
    many = len(hashes) >= WORDS
    inside = (rows[: len(rows) - WORDS + 1] == rows[WORDS - 1 :]) if many else np.zeros(0, bool)
    got = roll.grams(WORDS)[inside] if many else hashes[:0]
    of = rows[: len(inside)][inside]
    count = np.bincount(rows, minlength=n)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        got, of = np.concatenate([got, roll(first[short], first[short] + count[short])]), np.concatenate([of, short])
    order = np.lexsort((got, of))
    got, of = got[order], of[order]
    if not len(got):
        return of, got, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (got[1:] != got[:-1]) | (of[1:] != of[:-1])]))
    return of[new], got[new], np.diff(np.append(new, len(got)))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offs = vector.buffers(column)
    for a, b in vector.pieces(offs):
        yield a, b, *shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


class Weights:
    """Weights of shingles in a corpus of ``n`` documents, from the counts of the common ones."""

    def __init__(self, n: int, common_df: dict[int, int]):
        floor = max(COMMON * n, 1.0)
        keys = sorted(common_df)
        self.keys = np.array(keys, np.uint64)
        self.idf = np.array([math.log1p(n / max(common_df[k], floor)) for k in keys])
        self.most = math.log1p(n / floor)

    def __call__(self, got: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.full(len(got), self.most)
        if len(self.keys) and len(got):
            at = np.minimum(np.searchsorted(self.keys, got), len(self.keys) - 1)
            idf = np.where(self.keys[at] == got, self.idf[at], idf)
        return idf * counts


def _counted(df: DataFrame, text_col: str, wanted: np.ndarray | None) -> DataFrame:
    """Documents by hash bucket of their shingles, or by shingle in the wanted buckets, summed in each task."""
    at = df.columns.index(text_col)
    common.bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, got, _ in chunks(batch.column(at)):
                bucket = (got >> vector.U(48)).astype(np.int64)
                if wanted is None:
                    sums += np.bincount(bucket, minlength=BUCKETS)
                    continue
                keys, counts = np.unique(got[wanted[bucket]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])
        if wanted is None:
            full = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["key", "n"])

    return df.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def weigh(df: DataFrame, text_col: str = "text") -> Weights:
    """Count documents and common shingles over all of ``df``. What comes to the driver has the bounds given above."""
    n = df.count()
    floor = max(COMMON * n, 1.0)
    texts = df.select(text_col)
    wanted = np.zeros(BUCKETS, bool)
    wanted[[r["key"] for r in _counted(texts, text_col, None).where(F.col("n") > floor).collect()]] = True
    found = _counted(texts, text_col, wanted).where(F.col("n") > floor).collect() if wanted.any() else []
    return Weights(n, {r["key"] % (1 << 64): r["n"] for r in found})


def samples(rows: np.ndarray, got: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A sample for each text that has shingles and each seed: the hash of shingle and level that is least."""
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sizes = np.diff(np.append(starts, len(rows)))
    log_w = np.log(weight)
    out = np.empty((len(starts), len(SEEDS)), np.uint64)
    for k, seed in enumerate(SEEDS):
        x = vector.mix(got ^ seed)
        r = GAMMA[(x & vector.U(0xFFFF)).astype(np.int64)]
        beta = (x >> vector.U(32)).astype(np.float64) * 2.0**-32
        level = np.floor(log_w / r + beta)
        log_a = LOG_C[((x >> vector.U(16)) & vector.U(0xFFFF)).astype(np.int64)] - r * (level - beta + 1)
        least = np.minimum.reduceat(log_a, starts)
        hits = np.flatnonzero(log_a == np.repeat(least, sizes))
        pick = hits[np.searchsorted(hits, starts)]
        with np.errstate(over="ignore"):
            out[:, k] = vector.mix(got[pick] + level[pick].astype(np.int64).view(np.uint64) * vector.U(0x9E3779B97F4A7C15))
    return out


def banded(df: DataFrame, text_col: str, node_col: str, weights: Weights) -> DataFrame:
    """``node`` and ``bands``, the bucket of each band, for every text with a word."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    text_at, node_at = df.columns.index(text_col), df.columns.index(node_col)

    def make():
        weigher = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, bands = [], []
            for a, _, rows, got, counts in chunks(batch.column(text_at)):
                if len(rows):
                    found = samples(rows, got, weigher(got, counts))
                    key = np.zeros((len(found), BANDS), np.uint64)
                    for r in range(ROWS):
                        key = vector.mix(key * vector.U(31) + found[:, r::ROWS][:, :BANDS] + np.arange(BANDS, dtype=np.uint64))
                    bands.append(key)
                    nodes.append(np.unique(rows) + a)
            if not nodes:
                return pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.list_(pa.int64()))], names=["node", "bands"])
            flat = np.concatenate(bands).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            return pa.RecordBatch.from_arrays([batch.column(node_at).take(pa.array(np.concatenate(nodes))), lists], names=["node", "bands"])

        return run

    return common.arrow_map(df, make, "node binary, bands array<bigint>")


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes to compare, ``u`` before ``v``. ``nodes`` has a row for each text."""
    stash = common.Stash(nodes.sparkSession)
    rows = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    pairs, depth = [], 1
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node"))["node"].alias("leader")).where("size > 1")
        full = stash(rows.join(sizes, "key"))
        few = full.where(F.col("size") <= PAIRED)
        pairs.append(few.select("key", F.col("node").alias("u")).join(few.select("key", F.col("node").alias("v")), "key").where("u < v").select("u", "v"))
        many = full.where(F.col("size") > PAIRED)
        pairs.append(many.where("node <> leader").select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")))
        if depth == BANDS or many.isEmpty():
            break
        rows = many.select("node", "band", "key").join(nodes, "node").select("node", "band", F.xxhash64("key", F.get("bands", (F.col("band") + depth) % BANDS)).alias("key"))
        depth += 1
    out = pairs[0]
    for more in pairs[1:]:
        out = out.union(more)
    return out.distinct()


def crowded(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``key``, ``size``, ``node`` and ``root`` of the texts in buckets of more than ``PAIRED`` that hold more than one class."""
    stash = common.Stash(nodes.sparkSession)
    rows = nodes.select("node", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > PAIRED)
    full = stash(rows.join(sizes, "key").join(common.sorted_side(roots), "node", "left").select("key", "size", "node", F.coalesce("root", "node").alias("root")))
    mixed = full.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return stash(full.join(mixed, "key", "left_semi"))


def hub_pairs(crowd: DataFrame) -> DataFrame:
    """Pairs of the texts of a bucket and its hub, where they are of different classes."""
    score = crowd.groupBy("node").agg(F.sum("size").alias("score"))
    known = crowd.join(common.sorted_side(score), "node")
    hubs = known.groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("hub"), F.col("root").alias("hub_root")), F.struct("score", "node")).alias("best")).select("key", "best.*")
    return crowd.join(hubs, "key").where("root <> hub_root").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def rarity(texts: DataFrame) -> np.ndarray:
    """How many texts have a shingle of each of 2 ** RARITY_BITS ranges of hashes."""
    common.bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for _, _, _, got, _ in chunks(batch.column(0)):
                sums += np.bincount((got >> vector.U(64 - RARITY_BITS)).astype(np.int64), minlength=len(sums))
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["key", "n"])

    out = np.zeros(1 << RARITY_BITS, np.int64)
    found = texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out


def prefixes(texts: DataFrame, weights: Weights, counts: np.ndarray, similar: float) -> DataFrame:
    """The first shingles of each text, rare ones first, until less than ``similar`` of its weight is left.

    ``left`` is the weight from the shingle on; ``rare`` says whether it is 2 s / (1 + s) of the ``total``. Shingles that no
    other text has count, and are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast((weights, counts))
    node_at, root_at, text_at = (texts.columns.index(c) for c in ("node", "root", "text"))
    common.bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher, counts = shared.value
        for batch in batches:
            for a, b, rows, got, times in chunks(batch.column(text_at)):
                if not len(rows):
                    continue
                n = counts[(got >> vector.U(64 - RARITY_BITS)).astype(np.int64)]
                order = np.lexsort((got, n, rows))
                rows, got, n, weight = rows[order], got[order], n[order], weigher(got, times)[order]
                total = np.bincount(rows, weight, minlength=b - a)
                left = total[rows] + (np.cumsum(total) - total)[rows] - np.cumsum(weight) + weight
                share = left / total[rows] + 1e-9
                keep = (n > 1) & (share >= similar)
                at = pa.array(rows[keep] + a)
                columns = [batch.column(node_at).take(at), batch.column(root_at).take(at), pa.array(got[keep].view(np.int64)), pa.array(total[rows][keep]), pa.array(left[keep]), pa.array(share[keep] >= 2 * similar / (1 + similar))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "shingle", "total", "left", "rare"])

    return texts.mapInArrow(run, "node binary, root binary, shingle long, total double, left double, rare boolean")


def indexed_pairs(texts: DataFrame, weights: Weights, similar: float) -> DataFrame:
    """Pairs of ``node`` of different ``root`` that may be similar enough: all that are, and few others.

    What two texts share is at most what either has from their first common shingle on, in any order of shingles. Similar
    texts share at least s / (1 + s) of the weight of both; so do the rest of either from that shingle on, and that rest
    is at least ``similar`` of the heavier text and 2 s / (1 + s) of the lighter one.
    """
    first = common.Stash(texts.sparkSession)(prefixes(texts, weights, rarity(texts), similar))
    light = first.where("rare").select("shingle", F.col("node").alias("u"), F.col("root").alias("root_u"), F.col("total").alias("total_u"), F.col("left").alias("left_u"))
    heavy = first.select("shingle", F.col("node").alias("v"), F.col("root").alias("root_v"), F.col("total").alias("total_v"), F.col("left").alias("left_v"))
    ordered = F.struct("total_u", "u") < F.struct("total_v", "v")
    enough = F.least("left_u", "left_v") >= (similar / (1 + similar) - 1e-9) * (F.col("total_u") + F.col("total_v"))
    met = light.join(common.sorted_side(heavy), "shingle").where((F.col("root_u") != F.col("root_v")) & ordered & enough)
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similarity(pairs: DataFrame, weights: Weights, left: str = "text_u", right: str = "text_v", into: str = "similarity") -> DataFrame:
    """Exact weighted Jaccard similarity of two text columns, which it replaces."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    l_at, r_at = pairs.columns.index(left), pairs.columns.index(right)
    kept = [(i, f) for i, f in enumerate(pairs.schema.fields) if i not in (l_at, r_at)]

    def make():
        weigher = shared.value

        def of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            out = []
            for a, b, rows, got, counts in chunks(column):
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                weight = weigher(got, counts)
                out += [(got[x:y], weight[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            return out

        def jaccard(x: tuple, y: tuple) -> float:
            _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
            both = np.minimum(x[1][i], y[1][j]).sum()
            total = x[1].sum() + y[1].sum() - both
            return float(both / total) if total else 0.0

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = [jaccard(x, y) for x, y in zip(of(batch.column(l_at)), of(batch.column(r_at)), strict=True)]
            return pa.RecordBatch.from_arrays([*[batch.column(i) for i, _ in kept], pa.array(values, pa.float64())], names=[*[f.name for _, f in kept], into])

        return run

    return common.arrow_map(pairs, make, T.StructType([*[f for _, f in kept], T.StructField(into, T.DoubleType())]))


def node_of(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def groups(df: DataFrame, text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``node`` and ``root``, its class, of the texts, named by their MD5 digests, that have similar ones.

    Rows of one text count once; null is the empty text, which is similar to none.
    """
    stash = common.Stash(df.sparkSession)
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", node_of("text"))
    weights = weigh(docs)
    signed = banded(docs, "text", "node", weights)
    nodes = stash(signed.groupBy("node").agg(F.first("bands").alias("bands")))  # equal texts have equal bands
    pairs = stash(candidates(nodes))
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    known = stash(docs.join(common.sorted_side(wanted), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))

    def verified(some: DataFrame) -> DataFrame:
        joined = some.join(common.sorted_side(known.select(F.col("node").alias("u"), F.col("text").alias("text_u"))), "u").join(common.sorted_side(known.select(F.col("node").alias("v"), F.col("text").alias("text_v"))), "v")
        return stash(similarity(joined, weights).where(F.col("similarity") >= similar - 1e-9).select("u", "v"))

    roots = components(verified(pairs))
    crowd = crowded(nodes, roots)
    if not crowd.isEmpty():
        # Members of a bucket are candidates, so their texts are known.
        roots = merged(roots, verified(hub_pairs(crowd)))
        crowd = crowded(nodes, roots)
        if not crowd.isEmpty():
            apart = stash(known.join(common.sorted_side(crowd.select("node", "root").distinct()), "node"))
            roots = merged(roots, verified(indexed_pairs(apart, weights, similar)))
    stash.drop(known)
    stash.drop(nodes)
    return roots


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Id and class of every row. A class is a connected component of links, named by its least id.

    Equal texts are one node, so they share a class; null is the empty text. Texts without words are
    alike only if equal. A class whose ids are all null has a null name. Repeated rows are copies. Texts of any length
    are compared whole.
    """
    stash = common.Stash(df.sparkSession)
    known = groups(df, text_col, similar)
    members = stash(df.select(F.col(id_col).alias("id"), node_of(text_col).alias("node")).join(common.sorted_side(known), "node", "left").select("id", F.coalesce("root", "node").alias("root")))
    names = members.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    return members.join(common.sorted_side(names.where("size > 1")), "root", "left").select(F.col("id").alias(id_col), F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of each class, in the columns of ``df``: that of the least id, nulls last, then of the least digest."""
    stash = common.Stash(df.sparkSession)
    known = groups(df, text_col, similar)
    others = [F.to_json(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)]))]
    k1, k2 = common.fresh(df, "k1", "k2")
    a, b = common.row_key(id_col, text_col, *others)
    keyed = df.withColumns({k1: a, k2: b})
    # The choice is made on narrow rows; texts are shuffled once, to take out the rows that go.
    narrow = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(id_col).alias("id"), node_of(text_col).alias("node"))
    placed = stash(narrow.join(common.sorted_side(known), "node", "left").select("k1", "k2", "id", "node", F.coalesce("root", "node").alias("root")))
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("node"), F.col("k1"), F.col("k2"))
    first = placed.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1")
    judged = placed.join(common.sorted_side(first), "root").groupBy("k1", "k2").agg(F.max((F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))).alias("wins"), F.count("*").alias("copies"))
    judged = stash(judged.where("not wins or copies > 1").withColumnsRenamed({"k1": k1, "k2": k2}))
    rest = keyed.join(common.sorted_side(judged.select(k1, k2)), [k1, k2], "left_anti")
    repeated = keyed.join(judged.where("wins").select(k1, k2), [k1, k2], "left_semi").dropDuplicates([k1, k2])  # equal rows that win
    return rest.union(repeated).select(*[F.col(f"`{c}`") for c in df.columns])


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id")
