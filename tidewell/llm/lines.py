"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Two lines are linked if one edit turns one into the other: of a character, where the shorter has ``PER_EDIT`` characters at
least, or of a whole word, where it has ``PER_WORD`` words. An edit in less is no near copy. Of two segments of a line, the edit leaves one untouched, so each line is indexed by the halves
of its own length, and probes with the halves that lines of its length, and of one character less, would have. Halves
that two different lines share give candidates. What is left of both beside the shared half is compared by a banded
bit-parallel automaton.

A key may be shared by many lines, such as a template with a number in it. Pairs are only formed for keys of up to
``PAIRED`` lines. In a larger one what is left beside the shared half is halved again, and so on. At the end one
character is left, or none of the shorter line; then all lines of the key are one edit apart. Lines of one length need
no pairs then: each has as many links as there are others, and a star joins them for the components. Shorter lines of
the other kind are one line, so its links are a star by themselves.

Both units go the same way, lines as texts or as arrays of words. Lines of ``PER_WORD`` words with as many words each that
are one character apart differ in one word, so these links are left to words and no link is found twice.

Lines are compared as ``quality.normalised`` gives them and named by 64-bit hashes. Classes are connected components. Of
each class, the first line in the order of documents and lines stays.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.components import components
from tidewell.llm.quality import normalised, worded

PER_EDIT = 8
PER_WORD = 8
PAIRED = 32


class Unit(NamedTuple):
    """What edits are of: the size of a text in it, a part by start and size, and an array of a part's units."""

    size: Callable[[Column | str], Column]
    part: Callable[[Column, Column, Column], Column]
    units: Callable[[Column], Column]


CHARS = Unit(F.length, F.substr, lambda part: F.split(part, ""))
WORDS = Unit(F.size, F.slice, lambda part: part)


def within(shorter: Column, longer: Column, k: int, unit: Unit = CHARS) -> Column:
    """Whether two texts, the longer by at most ``k`` units, are ``k`` edits apart or fewer.

    An automaton walks along the shorter. For each number of errors it has a bit for each of 2 k + 1 diagonals, set if what
    was read can be matched up to there; all bits are in one number, and a step is a few operations on it. It goes by
    stretches of about the root of the length: those that are equal as long as there is no error are skipped, and
    nothing is read once no bit is left.
    """
    width = 2 * k + 1
    full = (1 << width) - 1
    n = unit.size(shorter)
    stretch = F.greatest(F.lit(8), F.ceil(F.sqrt(n)).cast("int"))
    number = lambda rows: F.lit(sum(row << (e * width) for e, row in enumerate(rows))).cast("long")
    start = number([((1 << (e + 1)) - 1) << k for e in range(k + 1)])
    matched = number([((1 << (2 * e + 1)) - 1) << (k - e) for e in range(k + 1)])  # e errors reach e diagonals to both sides
    repeated = sum(1 << (e * width) for e in range(k + 1))

    def row(state: Column, e: int) -> Column:
        return F.shiftright(state, e * width).bitwiseAND(F.lit(full))

    def step(state: Column, same: Column) -> Column:
        kept = state.bitwiseAND(same * repeated)
        rows = [row(kept, 0)]
        for e in range(1, k + 1):
            below = row(state, e - 1)
            rows.append(row(kept, e).bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(rows[-1], 1).bitwiseAND(F.lit(full))))
        out = rows[0]
        for e in range(1, k + 1):
            out = out.bitwiseOR(F.shiftleft(rows[e], e * width))
        return F.when(state == 0, state).otherwise(out)

    def walk(state: Column, first: Column) -> Column:
        own = unit.part(shorter, first + 1, stretch)
        x = unit.units(own)
        y = unit.units(unit.part(longer, F.greatest(first - k, F.lit(0)) + 1, stretch + 2 * k))
        shift = F.when(first == 0, k).otherwise(0)

        def equal(j: Column) -> Column:
            bits = [F.when(F.get(y, j + d - shift) == F.get(x, j), F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long")) for d in range(width)]
            return sum(bits[1:], bits[0])

        read = F.aggregate(F.transform(F.sequence(F.lit(0), F.least(stretch, n - first) - 1), equal), state, step)
        clean = (row(state, 0) != 0) & (F.least(stretch, n - first) >= k) & (own == unit.part(longer, first + 1, F.least(stretch, n - first)))
        return F.when(state == 0, state).when(clean, matched).otherwise(read)

    end = F.aggregate(F.sequence(F.lit(0), n - 1, stretch), start, walk)
    # The bit of the last diagonal, found by its number.
    last = F.get(F.array(*[F.lit(1 << (k * width + k + d)).cast("long") for d in range(k + 1)]), unit.size(longer) - n)
    return F.when(n == 0, unit.size(longer) <= k).otherwise(end.bitwiseAND(last) != 0)


def halves(n: Column, same: bool, role: int) -> list[tuple[Column, Column]]:
    """For a text of ``n`` units, the lengths of the front and the end that it may share with others.

    With texts of its length, these two cover it. With those of one unit more or less they are as long as an
    insertion between leaves them, whatever its place: half of the shorter, rounded up.
    """
    half = F.floor(n / 2).cast("int")
    return (half, n - half) if same else ((n - half, n - half) if role == 0 else (half, half))


ROLES = ((True, 0), (False, 0), (False, 1))


def cuts(of: str, known: tuple[Column, ...], unit: Unit = CHARS) -> Column:
    """All ways to cut a text into a shared half and the rest: (same, role, key, rest), with what is known in the key."""
    text, n = F.col(of), unit.size(of)
    out = []
    for same, role in ROLES:
        front, end = halves(n, same, role)
        size = n - role
        for side, cut, rest in ((0, unit.part(text, F.lit(1), front), unit.part(text, front + 1, n)), (1, unit.part(text, n - end + 1, n), unit.part(text, F.lit(1), n - end))):
            out.append(F.struct(F.lit(same).alias("same"), F.lit(role).alias("role"), F.xxhash64(F.lit(same), F.lit(side), size, cut, *known).alias("key"), rest.alias("rest")))
    return F.array(*out)


def n_words() -> Column:
    """Words of a normalised line."""
    return F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1


def sharing(lines: DataFrame, per_edit: int, per_word: int | None) -> DataFrame:
    """``around`` and ``a``: a row for each half by which a line may be found, for its own size and those beside it."""

    def keys(n: Column, front: Callable[[Column], Column], end: Callable[[Column], Column], least: int) -> Column:
        half = F.floor(n / 2).cast("int")
        return F.when(n < least, F.array().cast("array<bigint>")).when(n % 2 == 0, F.array(front(half), end(half))).otherwise(F.array(front(half), front(n - half), end(half), end(n - half)))

    n = F.col("n")
    found = keys(n, lambda size: F.xxhash64(F.lit(0), F.substr("line", F.lit(1), size)), lambda size: F.xxhash64(F.lit(1), F.substr("line", n - size + 1)), per_edit)
    if per_word is not None:
        first = lambda size: F.call_function("substring_index", F.col("line"), F.lit(" "), size)
        found = F.concat(found, keys(F.col("w"), lambda size: F.xxhash64(F.lit(2), first(size)), lambda size: F.xxhash64(F.lit(3), first(-size)), per_word))
    return lines.select("a", "line", F.length("line").alias("n"), n_words().alias("w")).select("a", F.explode(found).alias("around"))


def shared_keys(members: DataFrame) -> DataFrame:
    """Keys that two different lines, one in each role, have and that may link them; with their number of rows."""
    least = F.min(F.when(F.col("role") == 0, F.struct("a", "words")))
    counts = members.groupBy("key").agg(
        F.count("*").alias("n"), F.min("a").alias("least"), F.max("a").alias("most"), F.min("role").alias("low"), F.max("role").alias("high"), F.max("same").alias("same"),
        F.min("words").alias("fewest"), F.max(F.struct("words", "a")).alias("wordy"), least.alias("center"),
    )
    counts = counts.where("least <> most and (same or low < high) and (fewest = 0 or fewest < wordy.words)")
    return counts.select("key", "n", "fewest", F.col("wordy.a").alias("wordy"), F.col("center.a").alias("center"), F.col("center.words").alias("center_words"))


def occurrences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line with a word: keys of the document, its id, the line's number, the line and its hash."""
    split = df.select(*common.row_key(id_col, text_col), F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("no", "raw"))
    # The filter reads the raw line, so that no line is normalised twice.
    lines = split.where(worded(F.col("raw"))).select("k1", "k2", "id", "no", normalised(F.col("raw")).alias("line"))
    return lines.withColumn("a", F.xxhash64("line"))


def links(lines: DataFrame, per_edit: int = PER_EDIT, *, per_word: int | None = PER_WORD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What joins the hashes of lines that are one edit apart, in three tables.

    Links as pairs ``u``, ``v``; stars ``u``, ``v`` of groups in which all are linked to all, which are in no pair; and for
    the lines ``node`` of these groups how many ``links`` each has there. A line has links to different lines only.
    Without ``per_word``, only edits of a character link.
    """
    stash = common.Stash(lines.sparkSession)
    first = sharing(lines, per_edit, per_word)
    shared = first.groupBy("around").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most").select("around")
    wanted = stash(first.join(common.sorted_side(shared), "around", "left_semi").select("a").distinct())
    known = stash(lines.select("a", "line").join(common.sorted_side(wanted), "a", "left_semi").dropDuplicates(["a"]))
    stash.drop(wanted)
    pairs, stars, degrees = [], [], []

    def join(known: DataFrame, unit: Unit, least: int) -> None:
        """Links of ``a`` with the text ``line``; those of two lines of equal ``words`` other than 0 are not looked for."""
        spots = known.select("a", "words", unit.size("line").alias("n"), F.explode(cuts("line", (), unit)).alias("spot")).select("a", "words", "n", "spot.*")
        members = spots.where(F.col("n") - F.col("role") >= least).drop("n")
        while True:
            full = stash(members.join(shared_keys(members), "key"))
            few, many = full.where(F.col("n") <= PAIRED), full.where(F.col("n") > PAIRED)
            left = few.where("role = 0").select("key", "same", "a", "words", "rest")
            right = few.where("same or role = 1").select("key", F.col("a").alias("b"), F.col("words").alias("words2"), F.col("rest").alias("rest2"))
            met = left.join(right, "key").where("((same and a < b) or (not same and a <> b)) and (words = 0 or words <> words2)")
            pairs.append(stash(met.where(within(F.col("rest"), F.col("rest2"), 1, unit)).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()))
            if many.isEmpty():
                break
            ended = unit.size("rest") == F.when(F.col("same"), 1).otherwise(F.col("role"))
            # Where lines of as many words are left out, those that have a space in the place of the character are one line.
            hub = F.when(F.col("same"), F.col("wordy")).otherwise(F.col("center"))
            spokes = many.where(ended & (F.col("a") != hub)).where("(same and fewest > 0) or (not same and (words = 0 or words <> center_words))")
            pairs.append(stash(spokes.select(F.least("a", hub).alias("u"), F.greatest("a", hub).alias("v")).distinct()))
            whole = many.where(ended).where("same and fewest = 0")
            stars.append(stash(whole.where("a <> center").select(F.col("center").alias("u"), F.col("a").alias("v"))))
            degrees.append(stash(whole.groupBy(F.col("a").alias("node")).agg(F.sum(F.col("n") - 1).alias("links"))))
            narrower = many.where(~ended).select("a", "words", "same", "role", F.explode(cuts("rest", (F.col("key"),), unit)).alias("spot"))
            members = narrower.where("spot.same = same and spot.role = role").select("a", "words", "spot.*")

    words = F.lit(0) if per_word is None else F.when(n_words() >= per_word, n_words()).otherwise(0)
    join(known.select("a", "line", words.alias("words")), CHARS, per_edit)
    if per_word is not None:
        join(known.where(n_words() >= per_word).select("a", F.split("line", " ").alias("line"), F.lit(0).alias("words")), WORDS, per_word)

    def united(parts: list[DataFrame], schema: str) -> DataFrame:
        out = parts[0] if parts else lines.sparkSession.createDataFrame([], schema)
        for more in parts[1:]:
            out = out.union(more)
        return out

    return united(pairs, "u long, v long").distinct(), united(stars, "u long, v long"), united(degrees, "node long, links long")


def marked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_edit: int = PER_EDIT, *, per_word: int | None = PER_WORD) -> DataFrame:
    """Every line with a word: keys of its document, number, class, links of the line, and whether it goes.

    Null and empty texts have no lines. Rows equal in id and text are one document. Documents with a null id come last.
    Lines of any length are compared whole. An empty table gives no rows.
    """
    stash = common.Stash(df.sparkSession)
    lines = stash(occurrences(df, id_col, text_col))  # texts are split and normalised once
    pairs, stars, degrees = links(lines, per_edit, per_word=per_word)
    pairs = stash(pairs)
    roots = components(pairs.union(stars))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    degree = ends.union(degrees).groupBy("node").agg(F.sum("links").alias("links"))
    linked = roots.join(degree, "node").withColumnRenamed("node", "a")
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("k1"), F.col("k2"), F.col("no"))
    # Each different line once, if it is there twice or linked; with the first place of its class.
    kinds = lines.groupBy("a").agg(F.min(place).alias("first"), F.count("*").alias("size"))
    kinds = stash(kinds.join(common.sorted_side(linked), "a", "left").where("root is not null or size > 1").select("a", F.coalesce("root", "a").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), "first"))
    firsts = kinds.groupBy("class").agg(F.min("first").alias("first"))
    kinds = kinds.drop("first").join(common.sorted_side(firsts), "class")
    first = F.col("first")
    goes = first.isNotNull() & ((first["no"] != F.col("no")) | (first["k1"] != F.col("k1")) | (first["k2"] != F.col("k2")))
    return lines.select("k1", "k2", "no", "a").join(common.sorted_side(kinds), "a", "left").select("k1", "k2", "no", F.coalesce("class", "a").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), goes.alias("goes"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, per_word: int | None = None) -> DataFrame:
    """The table without repeated lines, in its own columns; documents of which no line with a word is left go.

    Lines that an edit of a word links are repeated only where ``per_word`` is given.
    """
    k1, k2, gone, had = common.fresh(df, "k1", "k2", "gone", "had")
    marks = marked(df, id_col, text_col, per_word=per_word).groupBy("k1", "k2").agg(F.collect_set(F.struct("no", "goes")).alias(had)).where(F.exists(had, lambda x: x["goes"]))
    marks = marks.withColumn(gone, F.transform(F.filter(had, lambda x: x["goes"]), lambda x: x["no"])).withColumn(had, F.size(had))
    a, b = common.row_key(id_col, text_col)
    keyed = df.withColumns({k1: a, k2: b}).join(common.sorted_side(marks.withColumnsRenamed({"k1": k1, "k2": k2})), [k1, k2], "left")
    left = keyed.where(F.col(gone).isNull() | (F.size(gone) < F.col(had)))
    text = F.when(F.size(gone) > 0, F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")).otherwise(F.col(text_col))
    return left.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in df.columns])


def op9_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its lines, links, removed lines, and a digest of the classes of its lines in their order."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    by = marked(docs).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("no", "class", "links", "goes"))).alias("lines"))
    a, b = common.row_key("doc_id", "text")
    lines = F.coalesce("lines", F.array().cast("array<struct<no:int,class:bigint,links:bigint,goes:boolean>>"))
    return (
        docs.select("doc_id", a, b)
        .join(common.sorted_side(by), ["k1", "k2"], "left")
        .select(
            "doc_id",
            F.size(lines).cast("long").alias("n_lines"),
            F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + x["links"]).alias("n_links"),
            F.size(F.filter(lines, lambda x: x["goes"])).cast("long").alias("n_removed"),
            F.sha2(F.array_join(F.transform(F.filter(lines, lambda x: ~x["goes"]), lambda x: x["no"].cast("string")), ","), 256).alias("kept_sha256"),
            F.sha2(F.array_join(F.transform(lines, lambda x: x["class"].cast("string")), ","), 256).alias("classes_sha256"),
        )
    )
