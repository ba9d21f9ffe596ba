"""Lines, near-duplicates, repeated strings, and the pipeline: against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_ops import DOC, ODD
from tidewell.llm import bpe, common, lines, minhash, quality, suffix
from tidewell.llm.components import components


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, 8) for r in ODD], DOC + ", node int, K1 int").cache()


def groups(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)] + [(50, i) for i in range(51, 70)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == 30 and got[40] == 40 and got[69] == 50
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def edited(rng, x, letters="abcé日"):
    p, r, c = rng.randrange(len(x) + 1), rng.random(), rng.choice(letters)
    return x[:p] + c + x[p:] if r < 0.33 else x[:p] + x[p + 1 :] if r < 0.66 else x[:p] + c + x[p + 1 :]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_bit_parallel_distance_equals_levenshtein(spark, k):
    rng, rows = random.Random(k), []
    for _ in range(400):
        x = y = "".join(rng.choice("abé日") for _ in range(rng.randrange(12)))
        for _ in range(rng.randrange(k + 2)):
            y = edited(rng, y, "abé日")
        if abs(len(x) - len(y)) <= k:
            rows.append((*sorted([x, y], key=len), levenshtein(x, y)))
    long = "".join(rng.choice("abé日") for _ in range(400))
    for at in (0, 1, 19, 20, 21, 39, 40, 200, 398, 399):
        for edits in ([(at, "x")], [(at, "")], [(at, long[at] + "z")], [(at, "x"), (max(0, at - 5), "")], [(at, "x"), (300, "xy"), (20, "")]):
            y = long
            for p, new in edits:
                y = y[:p] + new + y[p + 1 :]
            if abs(len(y) - 400) <= k:
                rows.append((*sorted([long, y], key=len), levenshtein(long, y)))
    out = spark.createDataFrame(rows, "x string, y string, d int").select("d", lines.within(F.col("x"), F.col("y"), k).alias("near")).collect()
    assert len(out) > 200 and all(r.near == (r.d <= k) for r in out)


def brute_lines(rows, per_edit):
    """What ``op9`` gives for (id, text) rows, without repeated rows: lines, links, removed lines, kept numbers and classes."""
    at = [(i, no, " ".join(raw.split())) for i, text in rows for no, raw in enumerate((text or "").split("\n")) if raw.split()]
    own = sorted({x for _, _, x in at})
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if min(len(own[i]), len(own[j])) >= per_edit and one_edit(own[i], own[j])]
    label = dict(zip(own, groups(len(own), pairs), strict=True))
    degree = Counter(own[i] for pair in pairs for i in pair)
    seen, out = set(), {i: ([], 0, []) for i, _ in rows}
    for i, no, x in sorted(at):
        classes, n, kept = out[i]
        out[i] = ([*classes, label[x]], n + degree[x], kept if label[x] in seen else [*kept, no])
        seen.add(label[x])
    return out


@pytest.mark.parametrize(("paired", "per_edit"), [(32, 8), (2, 8), (2, 1), (1, 3)])
def test_line_query_equals_brute_force(spark, tmp_path, monkeypatch, paired, per_edit):
    monkeypatch.setattr(lines, "PAIRED", paired)
    monkeypatch.setattr(lines.marked, "__defaults__", ("doc_id", "text", per_edit))
    rng = random.Random(5)
    all_lines = []
    for _ in range(200):
        x = f"the quick brown fox jumps over {rng.randrange(6)}"
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            x = edited(rng, x)
        all_lines.append(x)
    all_lines += [f"template line number {i:03d} of the list" for i in range(80)] + ["short", "short", "shorts", "sorts", "  "]
    all_lines += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(40)] + [f"Seite {i} von 30" for i in range(8, 14)]
    rng.shuffle(all_lines)
    rows = [(i, "\n".join(all_lines[i::31])) for i in range(31)] + [(90, None), (91, ""), (92, " \n\t")]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "t/documents.parquet"))
    want = brute_lines(rows, per_edit)
    got = {r.doc_id: r for r in lines.op9_segment_join(spark, str(tmp_path / "t")).collect()}
    assert got.keys() == want.keys()
    marks = lines.marked(spark.createDataFrame(rows, "doc_id bigint, text string"))
    keys = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", *common.row_key("doc_id", "text"))
    ours = {(r.doc_id, r.no): r["class"] for r in marks.join(keys, ["k1", "k2"]).collect()}
    named: dict = {}
    for i, (classes, n, kept) in want.items():
        mine = [ours[i, no] for no in sorted(no for d, no in ours if d == i)]
        r = got[i]
        assert (r.n_lines, r.n_links, r.n_removed) == (len(classes), n, len(classes) - len(kept))
        assert r.kept_sha256 == hashlib.sha256(",".join(map(str, kept)).encode()).hexdigest()
        assert r.classes_sha256 == hashlib.sha256(",".join(map(str, mine)).encode()).hexdigest()
        for ours_is, theirs in zip(mine, classes, strict=True):
            assert named.setdefault(("ours", ours_is), theirs) == theirs and named.setdefault(("theirs", theirs), ours_is) == ours_is


@pytest.mark.parametrize("k", [1, 2, 3])
def test_bit_parallel_distance_of_words(spark, k):
    rng, rows = random.Random(k), []
    for _ in range(300):
        x = [rng.choice(["a", "bé", "日", "ab"]) for _ in range(rng.randrange(14))]
        y = list(x)
        for _ in range(rng.randrange(k + 2)):
            p = rng.randrange(len(y) + 1)
            y[p : p + rng.randrange(2)] = [rng.choice(["a", "bé"])] * rng.randrange(2)
        if abs(len(x) - len(y)) <= k:
            rows.append((*sorted([x, y], key=len), levenshtein(x, y)))
    near = lines.within(F.col("x"), F.col("y"), k, lines.WORDS)
    out = spark.createDataFrame(rows, "x array<string>, y array<string>, d int").select("d", near.alias("near")).collect()
    assert len(out) > 200 and all(r.near == (r.d <= k) for r in out)


def linked(x, y, per_edit, per_word):
    """Whether lines are one character or one word apart."""
    a, b = x.split(" "), y.split(" ")
    return (min(len(x), len(y)) >= per_edit and one_edit(x, y)) or (min(len(a), len(b)) >= per_word and one_edit(a, b))


@pytest.mark.parametrize(("paired", "per_edit", "per_word"), [(32, 8, 8), (2, 3, 4)])
def test_links_of_a_word_equal_brute_force(spark, tmp_path, monkeypatch, paired, per_edit, per_word):
    monkeypatch.setattr(lines, "PAIRED", paired)
    monkeypatch.setattr(lines.marked, "__defaults__", ("doc_id", "text", per_edit))
    monkeypatch.setattr(lines.marked, "__kwdefaults__", {"per_word": per_word})
    rng = random.Random(7)
    base = "one line of the list that all of them were made from at first".split(" ")
    own = [" ".join(base)]
    for _ in range(150):  # one to three words changed, put in or taken out
        x = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            p = rng.randrange(len(x))
            x[p : p + rng.randrange(2)] = [f"other{rng.randrange(40)}"] * rng.randrange(2)
        own.append(" ".join(x))
    own += [f"all lines of this large group differ in {i:02d} alone" for i in range(60)]  # a word, and often a character
    own += [f"here is one that may be cut{c}off or not at all" for c in "abcdefgh "] + [f"three words{c}here" for c in "abcdefgh "]
    own += [f"a line of few words{c}so that a space counts" for c in "abcdefghijklmnopqrstuvwxyz0123456789 "] + ["a line of few wordsso that a space counts"]
    own += [" ".join(rng.choice(["a", "b", "ab"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    own = sorted(set(own))
    rows = [(i, "\n".join(own[i::17] + own[i::40])) for i in range(17)]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "t/documents.parquet"))
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if linked(own[i], own[j], per_edit, per_word)]
    assert any(not one_edit(own[i], own[j]) for i, j in pairs)
    label, degree = dict(zip(own, groups(len(own), pairs), strict=True)), Counter(own[i] for pair in pairs for i in pair)
    seen: set = set()
    got = {r.doc_id: r for r in lines.op9_segment_join(spark, str(tmp_path / "t")).collect()}
    for i, text in rows:
        kept = []
        for no, x in enumerate(text.split("\n")):
            if label[x] not in seen:
                kept.append(no)
            seen.add(label[x])
        assert (got[i].n_lines, got[i].n_links) == (text.count("\n") + 1, sum(degree[x] for x in text.split("\n")))
        assert got[i].n_removed == got[i].n_lines - len(kept) and got[i].kept_sha256 == hashlib.sha256(",".join(map(str, kept)).encode()).hexdigest()


def test_lines_a_word_apart_go_on_request(spark):
    text = "of all these words in this line one is other"
    rows = [(1, text, "x"), (2, text.replace("other", "changed") + "\nand a line of its own", "y"), (3, "short other line", "z"), (4, "short changed line", "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, more string")
    got = {r.doc_id: (r.text, r.more) for r in lines.deduplicated(df, per_word=lines.PER_WORD).collect()}
    assert got == {1: rows[0][1:], 2: ("and a line of its own", "y"), 3: rows[2][1:], 4: rows[3][1:]}


def test_lines_of_odd_rows(odd):
    out = lines.deduplicated(odd)
    assert out.columns == odd.columns and lines.deduplicated(odd.limit(0)).count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 2), (False, 2), (False, 3), (False, 4), (True, 0)]


def near_copies(rng, n):
    texts = []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        texts.append(" ".join(base))
        for k in (1, 2, 40):
            copy = list(base)
            for p in rng.sample(range(120), k):
                copy[p] = f"z{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("paired", [12, 1])
def test_near_classes_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(minhash, "PAIRED", paired)
    texts = near_copies(random.Random(8), 25)
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, t) for i, t in enumerate(texts[:5])), (None, None), (7, texts[7])], "doc_id bigint, text string")
    weights = minhash.weigh(docs)
    sets = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        _, got, counts = minhash.shingles(raw, np.array([0, len(raw)]))
        sets.append(dict(zip(got.tolist(), weights(got, counts).tolist(), strict=True)))

    def similar(a, b):
        both = sum(min(w, b.get(k, 0)) for k, w in a.items())
        return both / (sum(a.values()) + sum(b.values()) - both) >= 0.8

    label = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])])
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect() if r.doc_id is not None and r.doc_id < 1000}
    first = {}
    for i, g in enumerate(label):
        first.setdefault(g, i)
    agree = sum(got[i] == first[g] for i, g in enumerate(label))
    assert len(set(label)) < 90 and agree >= 0.97 * len(texts)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == minhash.classes(docs).selectExpr("coalesce(class_id, -1) c").distinct().count()


def test_near_query_equals_brute_force_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    weights = minhash.weigh(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = sorted({r.text or "" for r in docs})
    label, n_links = near_labels(texts, weights)
    at, first, want = {t: i for i, t in enumerate(texts)}, {}, {}
    for r in docs:
        want[r.doc_id] = first.setdefault(label[at[r.text or ""]], r.doc_id)
    assert n_links >= 5 and {r.doc_id: r.class_id for r in minhash.op8_weighted_minhash(spark, sf).collect()} == want


def test_near_copies_within_a_template(spark, monkeypatch):
    shared = [f"s{i}" for i in range(170)]
    texts = []
    for i in range(250):
        own = [f"w{i}x{k}" for k in range(34)]
        texts.append(" ".join(shared + own))
        for p in (5, 13, 21, 28):
            own[p] = "changed"
        texts.append(" ".join(shared + own))
    # Equal weights, as where the template is a small part of a corpus: 0.69 to each other, 0.82 to the copy.
    weights = minhash.Weights(10**6, {})
    monkeypatch.setattr(minhash, "weigh", lambda docs, text_col="text": weights)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    rows, got, counts = minhash.shingles(raw, np.cumsum([0, *map(len, texts)]))
    drawn = minhash.samples(rows, got, weights(got, counts))
    same = (drawn[0::2] == drawn[1::2]).reshape(250, minhash.ROWS, minhash.BANDS).all(axis=1).any(axis=1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert same.sum() > 240 and [i for i in range(250) if same[i] and found[2 * i + 1] != 2 * i] == []
    assert all(found[2 * i] == 2 * i for i in range(250))


def test_common_shingles_weigh_less(spark):
    docs = spark.createDataFrame([(f"all of these say the same and then {i} differ",) for i in range(100)], "text string")
    weights = minhash.weigh(docs)
    assert len(weights.keys) == 4 and all(w < weights.most for w in weights.idf)


def test_near_dedup_of_odd_rows(odd):
    assert minhash.deduplicated(odd).columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in minhash.deduplicated(odd).collect()) == [(False, 1), (False, 2), (False, 3), (False, 4)]
    assert minhash.classes(odd.limit(0)).count() == 0 and minhash.deduplicated(odd.limit(0)).count() == 0


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 60))] + [0]
        assert suffix.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeats_in_a_shard():
    rng = random.Random(3)
    for _ in range(100):
        n, own = rng.randint(1, 6), list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 6))})
        count = Counter(x[i : i + n] for x in own for i in range(len(x) - n + 1))
        for x, flags in zip(own, suffix.repeated_in_shard(own, n), strict=True):
            assert flags.tolist() == [count[x[i : i + n]] > 1 for i in range(max(0, len(x) - n + 1))]


def brute_removed(rows, n):
    count = Counter(t[i : i + n] for t in rows for i in range(len(t) - n + 1))
    for t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        yield bytes(b for b, g in zip(t, gone, strict=True) if not g)


def spans_of(rows, n):
    """The removed runs of each text."""
    count = Counter(t[i : i + n] for t in rows for i in range(len(t) - n + 1))
    for t in rows:
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        yield sum(gone), sum(gone[i] and not gone[i + 1] for i in range(len(t)))


@pytest.mark.parametrize("many", [2048, 2])
def test_suffix_query_equals_brute_force(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(suffix, "MANY", many)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdé ") for _ in range(500))
    texts = ["".join(rng.choice("abcdefgé ") for _ in range(rng.randint(0, 400))) + passage[rng.randint(0, 200) : rng.randint(250, 500)] + "x" * rng.choice([0, 0, 230]) for _ in range(30)]
    texts += [texts[0], "du " * 200, None, "", "q" * 201, "r" * 200]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "t/documents.parquet"))
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in suffix.op6_suffix_array(spark, str(tmp_path / "t")).collect()}
    assert len(got) == len(texts)
    for i, (kept, (n, spans)) in enumerate(zip(brute_removed(raw, 200), spans_of(raw, 200), strict=True)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw[i]), n, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_suffix_of_odd_rows(odd):
    assert suffix.without_repeats(odd).count() == len(ODD) and suffix.without_repeats(odd.limit(0)).count() == 0


def near_labels(texts, weights):
    """A class for each text, by comparing all that share a shingle."""
    posted, total = {}, []
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        _, got, counts = minhash.shingles(raw, np.array([0, len(raw)]))
        own = weights(got, counts).tolist()
        total.append(sum(own))
        for k, w in zip(got.tolist(), own, strict=True):
            posted.setdefault(k, []).append((i, w))
    both = Counter()
    for own in posted.values():
        for x, (i, w) in enumerate(own):
            for j, v in own[:x]:
                both[j, i] += min(w, v)
    links = [(i, j) for (i, j), w in both.items() if w / (total[i] + total[j] - w) >= minhash.SIMILAR - 1e-9]
    return groups(len(texts), links), len(links)


def plain_pipeline(spark, docs, items):
    """The stages one after another in plain code, over {doc_id: (text, host)}."""
    low = lambda text: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    clean = lambda line: " ".join(x for x in re.split(r"[\x20\x09-\x0D]+", low(line)) if x)
    had: dict = {}
    for text, host in docs.values():
        for line in text.split("\n"):
            if clean(line):
                had.setdefault((host, clean(line)), set()).add(int(hashlib.md5(text.encode()).hexdigest()[:15], 16))
    over = {k: min(v) for k, v in had.items() if len(v) > quality.MAX_DOCS}
    kept = {}
    for i, (text, host) in docs.items():
        n, _, _, _, repeat = quality.base_counts(text)
        me = int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
        gone = {k for k, line in enumerate(text.split("\n")) if over.get((host, clean(line)), me) != me}
        left = n - sum(len(clean(line).split(" ")) for k, line in enumerate(text.split("\n")) if k in gone)
        if n >= 50 and 100 * repeat <= 50 * n and 5 * left >= n:
            kept[i] = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
    counts = [len(kept)]

    at = [(i, k, clean(line)) for i, text in sorted(kept.items()) for k, line in enumerate(text.split("\n")) if clean(line)]
    own = sorted({x for _, _, x in at}, key=len)
    size = [len(x) for x in own]
    pairs = []
    for i, x in enumerate(own):
        j = i - 1
        while j >= 0 and size[j] >= size[i] - 1:
            if size[j] >= lines.PER_EDIT and one_edit(own[j], x):
                pairs.append((i, j))
            j -= 1
    label = dict(zip(own, groups(len(own), pairs), strict=True))
    seen, gone, total = set(), {}, Counter()
    for i, k, x in at:
        total[i] += 1
        if label[x] in seen:
            gone.setdefault(i, set()).add(k)
        seen.add(label[x])
    kept = {i: "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone.get(i, ())) for i, text in kept.items() if len(gone.get(i, ())) < total[i]}
    counts.append(len(kept))

    texts = sorted(set(kept.values()))
    weights = minhash.weigh(spark.createDataFrame([(t,) for t in kept.values()], "text string"))
    label = dict(zip(texts, near_labels(texts, weights)[0], strict=True))
    first: dict = {}
    for i, text in sorted(kept.items()):
        first.setdefault(label[text], i)
    kept = {i: kept[i] for i in first.values()}
    counts.append(len(kept))

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {tuple(w[i : i + 13]) for w in map(words, items) for i in range(len(w) - 12)}
    assert all(len(words(t)) >= 13 for t in items)
    found = lambda w: any(tuple(w[i : i + 13]) in windows for i in range(len(w) - 12))
    kept = {i: text for i, text in kept.items() if not found(words(text))}
    return kept, [*counts, len(kept)]


def test_pipeline_equals_plain_code(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text or "", r.source or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept, counts = plain_pipeline(spark, docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    ranks, pattern = bpe.vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert len(docs) > counts[0] >= counts[1] >= counts[2] > counts[3] > 0.5 * len(docs) and got.keys() == kept.keys()
    for i, text in kept.items():
        ids = known.encode_ordinary(text)
        assert got[i].text == text and got[i].n_chars == len(text) and got[i].token_ids == ids
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        assert 0 < out.count() <= docs.count()
        if i < 4:
            assert out.columns == docs.columns and out.where("n_chars <> length(text)").isEmpty()
            docs = out
    for r in out.collect():
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r.n_tokens == len(r.token_ids)
    assert quality.rules(docs).where("base_failed and n_words >= 50").isEmpty()
