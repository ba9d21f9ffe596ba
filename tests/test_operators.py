from pyspark.sql import functions as F

from tidewell.functions import hashing
from tidewell.operators import counting, stateless, windows
from tidewell.plans.plan import QueryPlan, Strategy
from tidewell.session import Settings, ready, shared_folder


def jvm_hash(text: str) -> int:
    h = 0
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h * 31 + raw[i] * 256 + raw[i + 1]) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_string_hash(spark):
    texts = ["", "a", "en.wikipedia.org", "é日", "🎉x", "x" * 300, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.string_hash(F.col("t")).alias("h"))
    for r in df.collect():
        assert r.h == (None if r.t is None else jvm_hash(r.t))
    assert jvm_hash("en.wikipedia.org") == -512088920


def test_key_ranges_cover_all_hashes(spark):
    for n in (1, 3, 5, 8):
        bounds = hashing.ranges(n)
        assert bounds[0][0] == -(1 << 31) and bounds[-1][1] == (1 << 31) - 1
        edges = [x for b in bounds for x in b]
        df = spark.createDataFrame([(x,) for x in edges], "h int").select("h", hashing.key_range(F.col("h"), n).alias("p"))
        for r in df.collect():
            assert bounds[r.p][0] <= r.h <= bounds[r.p][1]


def test_ring_places(spark):
    texts = ["", "a", "node-00", "é日", "🎉x", "x" * 300, None]
    ring = hashing.Ring()
    ring.add("a")
    ring.add("b")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.ring_hash(F.col("t")).alias("h"), ring.owner_of(F.col("t")).alias("o")).collect()
    for r in rows:
        assert (r.h, r.o) == ((None, None) if r.t is None else (hashing.ring_place(r.t), ring.lookup(r.t)))
        assert r.t is None or -(1 << 31) <= r.h < 1 << 31


def test_ring_moves_only_what_changes():
    ring = hashing.Ring()
    ring.add("a")
    ring.add("b")
    keys = [f"k{i}" for i in range(500)]
    before = {k: ring.lookup(k) for k in keys}
    assert ring.add("c")
    assert all(ring.lookup(k) in (before[k], "c") for k in keys)
    assert ring.remove("c") and {k: ring.lookup(k) for k in keys} == before


def test_negative_and_null_ids(spark):
    df = spark.createDataFrame([(-4,), (-3,), (None,), (0,), (7,)], "id long")
    assert sorted(r.id for r in stateless.not_every_fourth(df).collect()) == [-3, 7]


def test_running_count_is_the_same_for_any_slices(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a") for i in range(60)], "i long, k string")
    for piece in (F.lit(0), F.floor(F.col("i") / 7), F.col("i")):
        got = {r.i: r.n for r in counting.running_count(df, ["k"], ["i"], piece).collect()}
        want, seen = {}, {}
        for i in range(60):
            key = None if i % 3 == 0 else "a"
            seen[key] = want[i] = seen.get(key, 0) + 1
        assert got == want


def test_sliding_sum_over_block_ends(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 4)
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(50)], "i long, k long, v double")
    got = {r.i: r.total for r in windows.sliding_sum(df, ["k"], "v", 3, ["i"], F.lit(0)).collect()}
    assert got == {i: float(sum(j for j in (i, i - 2, i - 4) if j >= 0)) for i in range(50)}


def test_flat_map_batches_and_busy(spark):
    df = spark.range(4)
    assert stateless.flat_map_batches(df, lambda b: b.loc[b.index.repeat(2)], "id long").count() == 8
    assert stateless.busy(df, 0.1).count() == 4


def test_plan(spark):
    plan = QueryPlan()
    plan.add_stage(0, lambda df: df, name="in")
    plan.add_stage(1, lambda df: df.where("id % 2 = 0"), lambda df: df.where("id % 2 = 1"), name="split")
    plan.add_stage(2, lambda df: df.groupBy().count(), name="all", strategy=Strategy.HASH, keys=("id",), parallelism=3)
    assert plan.build(spark.range(10))["all_1"].first()[0] == 10


def test_key_by_deals_rows_of_a_key_to_one_partition(spark):
    rows = stateless.key_by(spark.range(100).selectExpr("id", "id % 7 as k"), "k", parts=5).select("k", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(rows) == 7 and {r.k for r in rows} == set(range(7))


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"shuffle_partitions": 7, "unknown": 1, "watermark_policy": "max"}')
    settings = Settings.load(tmp_path / "c.json")
    assert settings.shuffle_partitions == 7
    assert ready(spark, settings).conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "max"
    assert ready(spark).conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "min"
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
