"""Quality classifier by hierarchical empirical Bayes.

A logistic model over a document's own features gives its evidence. Evidence is summed for each host and each path of a
host, by grouped aggregation. Sites differ, and by how much is taken from the corpus: moments of the hosts' means give a
beta prior for hosts, moments of the paths' means around their hosts one for paths. A host's posterior is its sums
shrunk towards the global mean, a path's posterior its sums shrunk towards its host, so a site of few documents says
little more than the level above. A document's verdict adds to its own evidence what its path says beyond the whole.

Toxicity is judged from words, which shape says nothing of: a second logistic model has the words, and beginnings of words,
that toxic documents have far more often than others. A document is kept if it is good enough and not toxic.

The tables give documents a host (``source``) and no URL (``pages`` has URLs, but nothing that ties a page to a document);
the section of a host, its language, stands for the path.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import common, vector

#: Labelled documents that the model is fitted on, at most: those whose ids have the least hashes.
TRAINING_ROWS = 20_000
SITE_WEIGHT = 0.5
KEEP = 0.5
#: Words and their first so many bytes are counted in buckets. One needs so many toxic documents, this share of them, as
#: words of a few copied texts are in none other either, and odds beyond what chance explains.
WORD_BITS = 20
STEMS = (2, 3, 4, 5, 6, 8)
LEAST_TOXIC = 5
LEAST_SHARE = 0.01
LEAST_LOG_ODDS = 1.0
#: The model has this many buckets at most, those with the highest odds.
LEXICON = 400

WORD = vector.byte_table(lambda b: b not in (9, 10, 11, 12, 13, 32))
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>{}[]\\^~=_@+", "stop": b".", "comma": b",", "bang": b"!?", "letter": b"abcdefghijklmnopqrstuvwxyz"}
FEATURES = ("log_words", "word_bytes", *(f"{k}_share" for k in CLASSES), "wide_share", "distinct_share", "repeat_pairs", "same_next", "line_words", "repeat_lines")


def document_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of features for each text of a column given as bytes and offsets."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    starts, ends, rows, hashes = vector.words(data, offs, WORD)
    count = np.bincount(rows, minlength=n)
    many = np.maximum(count, 1)

    def per_row(where: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(where)])
        return total[offs[1:]] - total[offs[:-1]]

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(n)
        order = np.lexsort((values, of))
        v, r = values[order], of[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])])
        return np.bincount(r[new], minlength=n)

    columns = [np.log1p(count), np.bincount(rows, ends - starts, minlength=n) / many / 10]
    for chars in CLASSES.values():
        table = vector.byte_table(lambda b, c=chars: b in c)
        columns.append(per_row(table[data]) / size)
    columns.append(per_row(data >= 128) / size)
    columns.append(distinct(hashes, rows) / many)
    inside = rows[1:] == rows[:-1]
    pairs = vector.Rolling(hashes).grams(2)[inside] if len(hashes) > 1 else hashes[:0]
    pair_rows = rows[:-1][inside] if len(rows) > 1 else rows[:0]
    n_pairs = np.bincount(pair_rows, minlength=n)
    columns.append((n_pairs - distinct(pairs, pair_rows)) / np.maximum(n_pairs, 1))
    same = (hashes[1:] == hashes[:-1])[inside] if len(hashes) > 1 else np.zeros(0, bool)
    columns.append(np.bincount(pair_rows[same], minlength=n) / np.maximum(n_pairs, 1))
    lines_at, lines_end, line_rows, line_hashes = vector.words(data, offs, vector.byte_table(lambda b: b != 10))
    n_lines = np.bincount(line_rows, minlength=n)
    columns.append(np.log1p(count / np.maximum(n_lines, 1)) / 3)
    columns.append((n_lines - distinct(line_hashes, line_rows)) / np.maximum(n_lines, 1))
    return np.stack(columns, axis=1)


def expanded(x: np.ndarray) -> np.ndarray:
    """Features, their square roots and squares, so that a linear model can bend."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Intercept and weights by Newton steps."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Logistic regression on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        x = expanded(x)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.w = logistic(np.clip((x - self.mean) / self.scale, -8, 8), y)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-odds, within what a finite sample can tell."""
        z = np.c_[np.ones(len(x)), np.clip((expanded(x) - self.mean) / self.scale, -8, 8)]
        return np.clip(z @ self.w, -9, 9)


TERM = vector.byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def word_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each different word of a row, and the buckets of the word and its stems; a short word stands for these.

    A-Z count as a-z, and anything but letters, digits and bytes over 127 parts words.
    """
    starts, ends, rows, hashes = vector.words(data, offs, TERM)
    with np.errstate(over="ignore"):
        _, one = np.unique(vector.mix(hashes + rows.astype(np.uint64) * vector.U(0x9E3779B97F4A7C15)), return_index=True)
    starts, ends, rows, hashes = starts[one], ends[one], rows[one], hashes[one]
    roll = vector.Rolling(vector.LOWER_VALUES[data])
    of = [hashes, *(vector.mix(roll(starts, np.minimum(starts + k, ends)) + vector.U(k)) if len(rows) else hashes for k in STEMS)]
    for k, stem in zip(STEMS, of[1:], strict=True):
        stem[ends - starts <= k] = hashes[ends - starts <= k]
    return rows, (np.stack(of) >> vector.U(64 - WORD_BITS)).astype(np.int64)


class Toxicity:
    """Log-odds of toxicity: an intercept, and what each bucket adds whose words a document has."""

    def __init__(self, intercept: float = -9.0, added: dict[int, float] | None = None):
        self.intercept = intercept
        self.known = np.array(sorted(added or {}), np.int64)
        self.added = np.array([added[k] for k in self.known.tolist()]) if added else np.zeros(0)

    def found(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number in ``known`` of the buckets that rows have, each once."""
        rows, buckets = word_buckets(data, offs)
        if not len(self.known) or not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, buckets), len(self.known) - 1)
        _, of = hit = np.nonzero(self.known[at] == buckets)
        pairs = np.unique(rows[of] * len(self.known) + at[hit])
        return pairs // len(self.known), pairs % len(self.known)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows, k = self.found(data, offs)
        return np.clip(self.intercept + np.bincount(rows, self.added[k], minlength=len(offs) - 1), -9, 9)


def per_text(df: DataFrame, text_col: str, names: list[str], kinds: list[T.DataType], make_one: Callable) -> DataFrame:
    """Replace the text by columns that ``make_one()`` computes from bytes and offsets."""
    at = df.columns.index(text_col)
    kept = [f for f in df.schema.fields if f.name != text_col]

    def make():
        compute = make_one()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offs = vector.buffers(batch.column(at))
            parts = [compute(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in vector.pieces(offs)]
            columns = [pa.array(list(np.concatenate(p))) for p in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], *columns], names=[*[f.name for f in kept], *names])

        return run

    return common.arrow_map(df, make, T.StructType([*kept, *map(T.StructField, names, kinds)]))


def with_features(df: DataFrame, text_col: str, into: str) -> DataFrame:
    return per_text(df, text_col, [into], [T.ArrayType(T.DoubleType())], lambda: lambda data, offs: (document_features(data, offs),))


def labelled(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, those of least hashes; null labels and ids are left out."""
    return labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    """Fit on a sample bounded by ``rows``. Without both labels all evidence is 0."""
    chosen = labelled(labels, id_col, label_col, rows)
    got = with_features(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col), text_col, "x").select("y", "x").toPandas()
    if got["y"].nunique() < 2:
        model = Model(np.zeros((2, len(FEATURES))), np.array([0.0, 1.0]))
        model.w[:] = 0
        return model
    return Model(np.stack(got["x"].to_numpy()), got["y"].to_numpy())


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> Toxicity:
    """Count the documents of both labels by bucket of words, over a sample bounded by ``rows``, and fit what stands out.

    Buckets come to the driver, at most 2 ** WORD_BITS of them; of documents only which of LEXICON buckets they have. Without
    both labels nothing is toxic.
    """
    stash = common.Stash(docs.sparkSession)
    chosen = labelled(labels, id_col, label_col, rows)
    sample = stash(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select("y", F.col(text_col).alias("text")))
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last place counts documents.
        sums = np.zeros((2, (1 << WORD_BITS) + 1), np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False) > 0
            data, offs = vector.buffers(batch.column(1))
            for a, b in vector.pieces(offs):
                rows, buckets = word_buckets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                found = np.unique((rows << WORD_BITS) + buckets)  # of every row, each bucket once
                for k in (0, 1):
                    own = found[y[a + (found >> WORD_BITS)] == k] & ((1 << WORD_BITS) - 1)
                    sums[k][:-1] += np.bincount(own, minlength=1 << WORD_BITS)
            sums[:, -1] += (~y).sum(), y.sum()
        full = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[0][full]), pa.array(sums[1][full])], names=["bucket", "clean", "toxic"])

    counts = stash(sample.mapInArrow(run, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    whole = counts.where(F.col("bucket") == 1 << WORD_BITS).first()
    if whole is None or not whole["clean"] or not whole["toxic"]:
        return Toxicity()
    odds = {}
    for r in counts.where((F.col("bucket") < 1 << WORD_BITS) & (F.col("toxic") >= max(LEAST_TOXIC, LEAST_SHARE * whole["toxic"]))).collect():
        x, y = r["toxic"] + 0.5, r["clean"] + 0.5
        least = math.log(x / (whole["toxic"] + 1)) - math.log(y / (whole["clean"] + 1)) - 2 * math.sqrt(1 / x + 1 / y)
        if least > LEAST_LOG_ODDS:
            odds[r["bucket"]] = least
    lexicon = Toxicity(0.0, {k: 0.0 for k in sorted(odds, key=lambda k: (-odds[k], k))[:LEXICON]})
    n = len(lexicon.known)

    def presence(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray]:
        out = np.zeros((len(offs) - 1, n), np.int8)
        out[lexicon.found(data, offs)] = 1
        return (out,)

    got = per_text(sample, "text", ["x"], [T.ArrayType(T.ByteType())], lambda: presence).toPandas()
    w = logistic(np.stack(got["x"].to_numpy()).astype(np.float64).reshape(len(got), n), got["y"].to_numpy(), ridge=0.1)
    return Toxicity(float(w[0]), dict(zip(lexicon.known.tolist(), w[1:].tolist(), strict=True)))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def posteriors(evidence: DataFrame) -> DataFrame:
    """Sums for each (host, path) of column ``p``, and the posterior means of both levels.

    ``host`` and ``path`` are not null. Repeated rows each count; a null ``p`` counts as a row without evidence. Of a single
    site, or of none, the levels tell nothing of their spread, so sites shrink to what is above them.
    """
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    both = paths.join(hosts, "host")
    whole = hosts.agg(F.sum("hn").alias("gn"), F.sum("hs").alias("gs"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("q"), F.sum(F.col("hn") * F.col("hn")).alias("nn"), F.count("*").alias("k")).first()
    gn, gs = whole["gn"] or 0, whole["gs"] or 0.0
    mean = min(max(gs / gn, 1e-6), 1 - 1e-6) if gn else 0.5
    host_strength = strength(mean, gn, whole["q"], gs, whole["nn"], whole["k"])
    inner = both.agg(F.sum(F.col("s") * F.col("s") / F.col("n") - F.col("n") / F.col("hn") * F.col("hs") / F.col("hn") * F.col("hs")).alias("q"), F.sum(F.col("n") * F.col("n") / F.col("hn")).alias("nn"), F.count("*").alias("k"), F.countDistinct("host").alias("h")).first()
    free = (inner["k"] or 0) - (inner["h"] or 0)
    variance = ((inner["q"] or 0.0) - free * mean * (1 - mean)) / max(gn - (inner["nn"] or 0.0), 1e-9) if free > 0 else 0.0
    path_strength = clamp(mean * (1 - mean) / variance - 1) if variance > 0 else 1e6
    host_mean = (F.col("hs") + mean * host_strength) / (F.col("hn") + host_strength)
    return both.withColumn("host_mean", host_mean).withColumn("path_mean", (F.col("s") + F.col("host_mean") * path_strength) / (F.col("n") + path_strength)).withColumn("global_mean", F.lit(mean))


def clamp(x: float) -> float:
    return min(max(x, 1.0), 1e6)


def strength(mean: float, n: float, q: float | None, s: float, nn: float | None, k: int) -> float:
    """Prior observations of a beta prior, from the variance between groups beyond what sampling explains."""
    if k < 2 or not n:
        return 1e6
    between = (q or 0.0) - s * s / n - (k - 1) * mean * (1 - mean)
    variance = between / (n - (nn or 0.0) / n)
    return clamp(mean * (1 - mean) / variance - 1) if variance > 0 and math.isfinite(variance) else 1e6


def judge(docs: DataFrame, model: Model, toxicity: Toxicity | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """Evidence, posteriors, score, probability of toxicity and verdict for every row.

    Null hosts and paths are sites of their own, named by the empty string. Null and empty texts have the features of no
    words. Repeated rows are each judged and each counted. An empty table gives no rows. The table of sites is joined
    by host and path; a site with a third of all documents is one row there, and the documents' side can be split.
    """
    stash = common.Stash(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model, toxicity or Toxicity()))

    def make_one():
        model, toxicity = shared.value
        return lambda data, offs: (model(document_features(data, offs)), toxicity(data, offs))

    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    evidence = stash(per_text(text, "text", ["evidence", "toxic"], [T.DoubleType()] * 2, make_one).withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))))
    sites = posteriors(evidence).select("host", "path", "host_mean", "path_mean", "global_mean")
    joined = evidence.join(sites, ["host", "path"])
    score = 1 / (1 + F.exp(-(F.col("evidence") + SITE_WEIGHT * (logit(F.col("path_mean")) - logit(F.col("global_mean"))))))
    return joined.select(
        F.col("id").alias(id_col),
        F.round("evidence", 6).alias("evidence"),
        F.round("host_mean", 6).alias("host_mean"),
        F.round("path_mean", 6).alias("path_mean"),
        F.round(score, 6).alias("score"),
        F.round(1 / (1 + F.exp(-F.col("toxic"))), 6).alias("toxicity"),
        ((score >= KEEP) & (F.col("toxic") < 0)).alias("kept"),
    )


def op4_hierarchical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality and toxicity of every document, from models fitted on the labelled ones."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return judge(docs, fit(docs, labels), fit_toxicity(docs, labels))
