"""Secret scans with a random forest that removes false positives.

Candidates are long runs of token characters. Their features come from SQL functions: length, transitions between
character classes, the share of the candidate that words of a dictionary cover, and that common syllables do, the path or
host of the document, and the words beside the candidate. The dictionary is that of the corpus: words that stand alone
in several documents, counted over all of them and joined with the parts of the candidates. A forest, trained from labelled findings, gives the probability that a candidate is a
secret. There is no Python on the executors: extraction, features and the forest all run in the JVM, the forest as a
sum of CASE expressions made from its trees.

No table holds labelled findings, so ``labelled_findings`` makes them: secrets of public formats, and the look-alikes that
scanners report wrongly (digests, UUIDs, identifiers, paths, placeholders, long words), with the words found beside each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm import common

WORDED = r"(?:secret|token|passw(?:or)?d|pwd|api[_-]?key|apikey|access[_-]?key|credential|bearer|authorization|private[ _-]?key|auth)"
CUES = rf"(?i){WORDED}\W{{0,8}}$"
#: Shorter runs are candidates where a cue is assigned to; the first lookbehind is only there to fail early.
CUED = rf"(?<=[=:]|[=:][\"'`]|[=:]\s{{1,2}}[\"'`]?)(?<=(?i:{WORDED})[\"'`]?\s{{0,2}}[=:]\s{{0,2}}[\"'`]?)"
#: Over 512 times one character is filling. A run is no candidate if a value is assigned to it, so names stay beside their values.
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?!([A-Za-z0-9+/_-])\1{{512,}}+(?![A-Za-z0-9+/_-]))(?:[A-Za-z0-9+/_-]{{16,}}+|{CUED}[A-Za-z0-9+/_-]{{1,15}}+)={{0,2}}(?!=*[A-Za-z0-9+/_-])"
MAYBE = rf"[A-Za-z0-9+/_-]{{16}}|(?i:{WORDED})[\"'`]?\s{{0,2}}[=:]"
INNOCENT = r"(?i)(?:sha1|sha256|sha512|md5|commit|checksum|digest|uuid|guid|etag|integrity|build|revision|hash|example|sample|placeholder)\W{0,8}$"
SYLLABLES = "(?i)tion|ing|the|ent|and|ion|ment|con|ver|ter|ist|able|ness|ity|der|ein|ich|sch|ung|heit|keit|eau|oux|que|ado|ción|mente|os|er|en|an|re|at|on|or|es|ed|th|st|nd|ha|ea|ou|in|le|de|al"
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,})"
TRAINING_FINDINGS = 12_000
CUT = 0.5
CONTEXT = 40

#: A word of the dictionary stands alone in so many documents; made findings use the most common of them.
WORD_DOCS = 3
COMMON_WORDS = 200
WORD = r"(?<!\S)[\"'(]?([A-Za-z][a-z]{2,19})[.,;:!?)\"']*(?!\S)"
PART = r"[A-Z]?[a-z]{2,}|[A-Z]{3,}"

FEATURES = ("words", "length", "classes", "transitions", "digits", "uppers", "coverage", "repeats", "known", "cue", "innocent", "quoted", "assigned", "path_kind", "hexlike", "uuid")


def share(text: Column, pattern: str) -> Column:
    """Share of the candidate's characters that the pattern matches."""
    return 1 - F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def dictionary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` and ``n``, the documents it stands alone in, of all words that do so in ``WORD_DOCS`` of them, in lower case."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(1)), F.lower))
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= WORD_DOCS)


def with_words(df: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Add ``covered``, the letters of parts of ``candidate`` that are words. ``keys`` name a row; words are joined by shuffle."""
    parts = df.select(*keys, F.explode(F.transform(F.regexp_extract_all("candidate", F.lit(PART), F.lit(0)), F.lower)).alias("word"))
    covered = parts.join(common.sorted_side(known.select("word")), "word").groupBy(*keys).agg(F.sum(F.length("word")).alias("covered"))
    return df.join(common.sorted_side(covered), list(keys), "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def features(candidate: Column, before: Column, after: Column, path: Column, covered: Column) -> dict[str, Column]:
    """``before`` and ``after`` are what stands beside the candidate, ``covered`` its letters in words; nulls count as empty."""
    candidate, before, after, path = (F.coalesce(c, F.lit("")) for c in (candidate, before, after, path))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.regexp_replace(shape, r"(.)\1+", "$1")
    has = [F.when(F.contains(shape, F.lit(c)), 1).otherwise(0) for c in "aA0"]
    flag = lambda col: F.when(col, 1.0).otherwise(0.0)
    return {
        "words": F.coalesce(covered, F.lit(0)) / F.greatest(F.length(candidate), F.lit(1)),
        "length": F.length(candidate).cast("double"),
        "classes": (has[0] + has[1] + has[2]).cast("double"),
        "transitions": (F.length(runs) - 1) / F.greatest(F.length(candidate), F.lit(1)),
        "digits": share(candidate, "[0-9]"),
        "uppers": share(candidate, "[A-Z]"),
        "coverage": share(candidate, SYLLABLES),
        "repeats": share(candidate, r"(.)\1+"),
        "known": flag(F.rlike(candidate, F.lit(KNOWN))),
        "cue": flag(F.rlike(before, F.lit(CUES))),
        "innocent": flag(F.rlike(before, F.lit(INNOCENT))),
        "quoted": flag(F.rlike(before, F.lit("[\"'`]$")) & F.rlike(after, F.lit("^[\"'`]"))),
        "assigned": flag(F.rlike(before, F.lit(r"[=:]\s{0,2}[\"'`]?$"))),
        "path_kind": F.when(F.rlike(path, F.lit(r"(?i)test|example|fixture|doc|sample|mock")), 2.0).when(F.rlike(path, F.lit(r"(?i)\.(?:env|ya?ml|json|ini|conf|cfg|properties|tf|pem)$|config|deploy")), 1.0).otherwise(0.0),
        "hexlike": flag(F.rlike(candidate, F.lit("^[0-9a-fA-F]+$"))),
        "uuid": flag(F.rlike(candidate, F.lit("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"))),
    }


def labelled_findings(spark: SparkSession, n: int = TRAINING_FINDINGS, words: tuple[str, ...] = ()) -> DataFrame:
    """``n`` findings with label 1 for a secret, made from a counter and common words: the same rows in every session."""
    digest = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 512)
    pick = lambda salt, k: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(k)).cast("int")
    base = F.translate(F.base64(F.unhex(digest("a"))), "+/=", "xyz")
    upper = F.upper(F.translate(F.base64(F.unhex(digest("b"))), "+/=", "QRS"))
    syllables = ["tion", "the", "ing", "er", "and", "heit", "ment", "eau", "que", "ado", "in", "or"]
    word = F.concat(*[F.element_at(F.array(*map(F.lit, syllables)), pick(f"w{i}", len(syllables)) + 1) for i in range(7)])
    one = lambda salt, *options: F.element_at(F.array(*options), pick(salt, len(options)) + 1)
    terms = [one(f"t{i}", *map(F.lit, words)) if words else F.lit(syllables[i]) for i in range(4)]
    named = one("named", F.concat_ws("_", *terms), F.concat_ws("-", *terms), F.concat_ws("/", *terms), F.concat(*map(F.initcap, terms)), F.upper(F.concat_ws("_", *terms)))
    secret = one("s", F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.substring(digest("h"), 1, 40), F.substring(base, 1, 40), F.concat(F.lit("ghp_"), F.substring(base, 1, 36)), F.concat(F.lit("sk-"), F.substring(base, 1, 48)), F.substring(digest("i"), 1, 64), F.substring(base, 1, 24), F.substring(base, 1, 64))
    hexes = F.substring(digest("j"), 1, 32)
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    innocent = one("n", named, named, named, word, F.upper(word), F.concat(F.initcap(word), F.lit("_"), F.reverse(word)), uuid, F.substring(digest("k"), 1, 40), F.substring(digest("l"), 1, 64), F.repeat(one("r", F.lit("0"), F.lit("x"), F.lit("-"), F.lit("="), F.lit("ab")), pick("q", 20) + 16), F.concat_ws("/", F.substring(word, 1, 8), F.lit("src"), F.substring(word, 5, 9)), F.concat(F.lit("2024"), F.rpad(F.col("id").cast("string"), 14, "0")))
    # A bare hexadecimal digest is no finding unless something near it says so.
    known = F.rlike(secret, F.lit(KNOWN))
    secret_before = F.when(~known & (F.col("c") == "the and "), F.lit("token = ")).otherwise(F.col("c"))
    innocent_before = one("d", F.lit("commit "), F.lit("sha256: "), F.lit("the and "), F.lit("etag="), F.lit(". "), F.lit("uuid: "), F.lit("build "), F.lit(" | "))
    rows = spark.range(0, n, 1, 4).withColumn("label", F.when(pick("label", 2) == 0, 1.0).otherwise(0.0))
    rows = rows.withColumn("c", one("c", F.lit('token = "'), F.lit("api_key: "), F.lit("password='"), F.lit("secret="), F.lit("Authorization: Bearer "), F.lit("the and "), F.lit("access_key = "), F.lit("-----BEGIN RSA PRIVATE KEY-----\n")))
    is_secret = F.col("label") == 1.0
    # Short values are only looked at after a cue, so both labels have one.
    short = pick("short", 8) == 0
    short_secret = F.concat(F.substring(base, 1, 5), F.substring(digest("m"), 1, 2), F.expr("substring(sha2(cast(id as string), 256), 1, cast(pmod(id, 8) as int))"))
    short_word = F.expr("substring(w, 1, cast(2 + pmod(id, 13) as int))")
    short_before = one("sb", F.lit("password: "), F.lit("token = "), F.lit("secret="), F.lit("pwd="), F.lit('api_key: "'))
    rows = rows.withColumn("w", word)
    return rows.select(
        "id",
        F.when(short, F.when(is_secret, short_secret).otherwise(short_word)).when(is_secret, secret).otherwise(innocent).alias("candidate"),
        F.when(short, short_before).when(is_secret, secret_before).otherwise(innocent_before).alias("before"),
        F.when(is_secret & F.col("c").endswith('"'), F.lit('" and')).otherwise(F.lit(" and")).alias("after"),
        one("p", F.lit("src0"), F.lit("deploy/config.yaml"), F.lit("tests/fixtures/a.json"), F.lit("site.org"), F.lit("lib/main.py")).alias("path"),
        "label",
    )


def train(findings: DataFrame, trees: int = 15, depth: int = 4) -> list:
    """Fit the forest; returns its trees as nested tuples. At most as many findings as were given are read.

    Findings have the column ``covered`` of ``with_words``.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), F.col("covered"))
    rows = findings.select("label", *[c.cast("double").alias(k) for k, c in made.items()])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features").coalesce(2)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(rows)

    def walk(node):
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats)
        split = node.split()
        return split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return [walk(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees]


def probability(forest: list, columns: tuple[str, ...] = FEATURES) -> Column:
    """The mean of the trees' votes."""

    def case(node) -> str:
        if not isinstance(node, tuple):
            return repr(float(node)) + "D"
        k, cut, low, high = node
        return f"CASE WHEN `{columns[k]}` <= {float(cut)!r}D THEN {case(low)} ELSE {case(high)} END"

    return F.expr("(" + " + ".join(case(t) for t in forest) + f") / {len(forest)}D")


def candidates(df: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """Every candidate of every text with its place, in characters, and what stands beside it; ``row`` and ``no`` name it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), text.alias("text")).where(F.rlike("text", F.lit(MAYBE)))
    # Found tokens and the text between them alternate, so places are running sums of lengths.
    cut = rows.select("id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("between")).where(F.size("found") > 0)
    between = F.col("between")
    hits = F.transform("found", lambda x, i: F.struct(i.alias("no"), x.alias("candidate"), F.length(F.get(between, i)).alias("gap"), F.right(F.get(between, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(between, i + 1), F.lit(CONTEXT)).alias("after")))
    one = cut.select(F.monotonically_increasing_id().alias("row"), "id", "path", hits.alias("hits")).select("row", "id", "path", F.explode("hits").alias("hit")).select("row", "id", "path", "hit.*")
    end = F.sum(F.col("gap") + F.length("candidate")).over(Window.partitionBy("row").orderBy("no"))
    return one.select("row", "no", "id", "path", "candidate", (end - F.length("candidate")).cast("long").alias("start"), "before", "after")


def scan(df: DataFrame, forest: list, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", cut: float = CUT) -> DataFrame:
    """Id, place, digest of the candidate, probability and verdict of every candidate of every text.

    Null and empty texts have no candidates; a null path is one without kind; repeated rows give repeated findings; texts
    of any length are scanned whole, and runs of any length are candidates from 16 characters on, or after a cue,
    but for over 512 times one character. ``known`` is a dictionary, which may be empty.
    """
    found = with_words(common.Stash(df.sparkSession)(candidates(df, id_col, text_col, path_col)), known, "row", "no")
    made = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), F.col("covered"))
    scored = found.select("id", "start", "candidate", *[c.cast("double").alias(k) for k, c in made.items()]).withColumn("probability", F.round(probability(forest), 6))
    return scored.select(F.col("id").alias(id_col), "start", (F.col("start") + F.length("candidate")).alias("end"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", (F.col("probability") >= cut).alias("is_secret"))


def fitted(known: DataFrame) -> list:
    """A forest from findings made with the common words of a dictionary, of which at most COMMON_WORDS come to the driver."""
    words = tuple(r["word"] for r in known.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).collect())
    return train(with_words(labelled_findings(known.sparkSession, words=words), known, "id"))


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in ``documents``, judged by a forest trained from labelled findings."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    known = common.Stash(spark)(dictionary(docs))
    return scan(docs, fitted(known), known)
