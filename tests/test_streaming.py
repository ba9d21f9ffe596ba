"""Streams: continuity over a restart, late rows, sinks, paced and event sources."""

import threading
import time
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidewell.functions import serde
from tidewell.operators import windows
from tidewell.session import Settings, ready
from tidewell.sources import lines
from tidewell.streaming import processors, sinks
from tidewell.streaming.state import inspect


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(df, folder, mode="append"):
    df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination()


def test_counts_go_on_after_a_restart(spark, tmp_path):
    schema, source = "k string, i long", str(tmp_path / "in")
    for part in ([("a", 1), ("b", 2)], [("a", 3), ("a", 4)]):
        write(spark, source, part, schema)
        run(processors.running_count(spark.readStream.schema(schema).parquet(source), ["k"], ["i"]), tmp_path)
    got = {(r.k, r.i, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1, 1), ("b", 2, 1), ("a", 3, 2), ("a", 4, 3)}
    assert inspect(spark, str(tmp_path / "ckpt"), "cnt").count() == 2


def late_counts(spark, tmp_path, grace):
    schema, source = "t timestamp, k string", str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    df = windows.time_windows(processors.with_grace(spark.readStream.schema(schema).parquet(source), "t", grace), "t", "10 seconds", None, ["k"], F.count("*").alias("n"))
    mode = "append" if grace else "complete"
    for rows in (["00:00:01", "00:01:00"], ["00:00:02"], ["00:02:00"], ["00:02:01"]):
        spark.createDataFrame([(t, "a") for t in rows], "s string, k string").select(F.expr("cast('2024-01-01 ' || s as timestamp)").alias("t"), "k").coalesce(1).write.mode("append").parquet(source)
        if mode == "append":
            run(df, tmp_path)
        else:
            df.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    return {r.window_start.strftime("%M:%S"): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_late_row_is_dropped_behind_the_watermark(spark, tmp_path):
    assert late_counts(spark, tmp_path, "2 seconds")["00:00"] == 1


def test_late_row_counts_without_watermark(spark, tmp_path):
    assert late_counts(spark, tmp_path, None)["00:00"] == 2


def test_triggered_window(spark, tmp_path):
    schema, source = "k string, t long", str(tmp_path / "in")
    write(spark, source, [("a", t) for t in (0, 5, 10, 15, 40)], schema)
    run(processors.triggered_window(spark.readStream.schema(schema).parquet(source), ["k"], ["t"], "t", 10, 5, lambda r: r.t % 2 == 1 or r.t == 40, lambda r, kept: len(kept)), tmp_path)
    assert {(r.t, r.emitted) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(5, 2.0), (15, 3.0), (40, 1.0)}


def test_data_and_latency_sinks(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [(1,), (2,)], "i long")
    source = spark.readStream.schema("i long").parquet(str(tmp_path / "in")).withColumn("ingest_ts", F.current_timestamp())
    sinks.to_files(source, str(tmp_path / "data"), str(tmp_path / "ckpt"), str(tmp_path / "latency")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "data")).select("i").count() == 2
    log = spark.read.parquet(str(tmp_path / "latency"))
    assert log.select("ts_ms", "latency_ms").dtypes == [("ts_ms", "bigint"), ("latency_ms", "double")] and log.where("latency_ms < 0").isEmpty()


def test_paced_lines(spark, tmp_path):
    lines.register(spark)
    (tmp_path / "f.txt").write_text("x\ny\nz\n")
    source = spark.readStream.format("paced_lines").option("path", str(tmp_path / "f.txt")).load()
    query = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").start()
    query.processAllAvailable()
    query.stop()
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out")).orderBy("line").collect()] == ["x", "y", "z"]


class Events(BaseHTTPRequestHandler):
    """Numbered events: those after the id asked for."""

    known: list[str] = []

    def do_GET(self):
        after = int(self.headers.get("Last-Event-ID") or 0)
        self.send_response(200)
        self.end_headers()
        for i, text in enumerate(self.known[after:], after + 1):
            data = "".join(f"data: {line}\n" for line in text.split("\n"))
            self.wfile.write(f": note\nevent: m\nid: {i}\n{data}\n".encode())

    def do_PUT(self):
        self.known.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
        self.send_response(200)
        self.end_headers()

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    handler = type("Own", (Events,), {"known": []})
    server = HTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", handler.known
    server.shutdown()


def test_server_sent_events(server):
    url, known = server
    known += ['{"a": 1}', "x\ny"]
    assert list(lines.sse_events(url, 5)) == [("1", '{"a": 1}'), ("2", "x\ny")]
    assert list(lines.sse_events(url, 5, "1")) == [("2", "x\ny")]


def test_server_sent_events_through_a_query_and_a_restart(spark, tmp_path, server):
    url, known = server
    lines.register(spark)
    for more in (["a", "b"], ["c\nd"]):
        known += more
        source = spark.readStream.format("server_sent_events").option("url", url).option("seconds", "2").option("log", f"{tmp_path}/log").load()
        query = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").start()
        query.processAllAvailable()
        query.stop()
    assert [(r.event, r.value) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("event").collect()] == [(0, "a"), (1, "b"), (2, "c\nd")]


def test_events_of_a_planned_batch_are_there_after_a_crash(tmp_path, server):
    url, known = server
    known += ["a", "b"]
    reader = lines._SseReader(url, 2, str(tmp_path / "log"))
    _, end = reader.read(reader.initialOffset())
    known.append("c")
    again = lines._SseReader(url, 2, str(tmp_path / "log"))
    assert list(again.readBetweenOffsets(reader.initialOffset(), end)) == [(0, "a"), (1, "b")]
    rows, last = again.read(end)
    assert list(rows) == [(2, "c")] and last == {"event": 3, "last": "3"} and again.read(last)[1] == last
    again.commit(end)
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["2-3.json"]


def test_lines_of_files_are_stamped_parsed_and_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"id": 5, "server_name": "a"}\n{bad\n')
    (tmp_path / "in" / "b.txt").write_text('{"id": 8, "server_name": "b"}\n')
    batch = lines.read_lines(spark, str(tmp_path / "in" / "a.txt"), str(tmp_path / "in" / "b.txt"))
    assert batch.count() == 3
    counted = lines.count_lines(batch.withColumn("id", F.get_json_object("value", "$.id")), "id")
    assert sorted((r.file[-5:], r.events, r.errors) for r in counted.collect()) == [("a.txt", 1, 1), ("b.txt", 1, 0)]
    stream = lines.stream_lines(spark, str(tmp_path / "in"), Settings(max_files_per_trigger=1, watermark_grace_seconds=5))
    query = sinks.to_files(stream, str(tmp_path / "data"), str(tmp_path / "ckpt"), name="lines")
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "data")).count() == 3 and spark.read.parquet(str(tmp_path / "data")).where("ingest_ts is null").isEmpty()
    assert len(query.recentProgress) >= 2 and not sinks.status(query)["active"]
    assert sinks.status(query)["watermark"] > "2020"


def test_the_hook_is_called_when_the_watermark_passes(spark, tmp_path):
    schema, source = "k string, t long, v double", str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(source)
    stream = processors.with_grace(spark.readStream.schema(schema).parquet(source).withColumn("at", F.timestamp_millis("t")), "at", "1 second")
    out = processors.at_watermark(stream, ["k"], "t", 10_000, lambda total, r: total + r.v, lambda key, end, total: 100 * total)
    for rows in ([("a", 1_000, 1.0), ("a", 9_999, 2.0), ("b", 3_000, 5.0), ("a", 10_000, 7.0)], [("a", 30_000, 1.0)], [("a", 2_000, 9.0), ("a", 60_000, 1.0)], [("b", 61_000, 1.0)]):
        write(spark, source, rows, schema)
        run(out, tmp_path)
    got = {(r.k, r.window_end_ms, r.emitted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 10_000, 300.0), ("b", 10_000, 500.0), ("a", 20_000, 700.0), ("a", 40_000, 100.0)}


@pytest.mark.parametrize(("policy", "late"), [("min", 2), ("max", 1)])
def test_watermark_of_two_inputs(spark, tmp_path, policy, late):
    schema, folders = "t timestamp, k string", [str(tmp_path / "x"), str(tmp_path / "y")]
    ready(spark, Settings(watermark_policy=policy))
    try:
        for f in folders:
            spark.createDataFrame([], schema).write.parquet(f)
        ends = [processors.with_grace(spark.readStream.schema(schema).parquet(f), "t", "1 second") for f in folders]
        out = windows.time_windows(ends[0].union(ends[1]), "t", "10 seconds", None, ["k"], F.count("*").alias("n"))
        at = lambda s: [(datetime(2024, 1, 1, 0, s // 60, s % 60), "a")]
        for x, y in ((60, 1), (None, 2), (300, 300), (301, 301)):
            for s, f in ((x, folders[0]), (y, folders[1])):
                if s is not None:
                    write(spark, f, at(s), schema)
            run(out, tmp_path)
        counts = {r.window_start.minute * 60 + r.window_start.second: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert counts[0] == late and counts[60] == 1
    finally:
        ready(spark)


def test_counts_go_on_with_other_resources(spark, tmp_path):
    schema, source = "k string, i long", str(tmp_path / "in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, part in (("2", [(f"k{i % 9}", i) for i in range(40)]), ("7", [(f"k{i % 9}", i) for i in range(40, 90)])):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            write(spark, source, part, schema)
            run(processors.running_count(spark.readStream.schema(schema).parquet(source), ["k"], ["i"]), tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r.i: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: i // 9 + 1 for i in range(90)}


def test_progress_is_pushed_to_the_gateway(spark, tmp_path, server):
    url, known = server
    assert sinks.watch(spark, Settings()) is None
    write(spark, str(tmp_path / "in"), [(1,), (2,)], "i long")
    listener = sinks.watch(spark, Settings(push_gateway=url))
    try:
        sinks.to_files(spark.readStream.schema("i long").parquet(str(tmp_path / "in")), str(tmp_path / "data"), str(tmp_path / "ckpt"), name="pushed").awaitTermination()
        for _ in range(100):
            if any("batch_rows" in x for x in known):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert any('batch_rows{query="pushed"} 2' in x and 'batch_duration_ms{query="pushed"}' in x for x in known)


def test_texts_on_the_console(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [("a", 1), ("b", 1), ("a", 2)], "k string, i long")
    counted = processors.running_count(spark.readStream.schema("k string, i long").parquet(str(tmp_path / "in")), ["k"], ["i"])
    told = []
    sinks.to_lines(counted.select(serde.count_text(F.col("k"), F.col("n")).alias("text")), told.append, checkpoint=str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(told) == ["Count for server-name: <a>: [1]", "Count for server-name: <a>: [2]", "Count for server-name: <b>: [1]"]


def test_a_query_with_a_trigger_goes_on_until_stopped(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [(1,)], "i long")
    query = sinks.to_files(spark.readStream.schema("i long").parquet(str(tmp_path / "in")), str(tmp_path / "data"), str(tmp_path / "ckpt"), once=False, settings=Settings(trigger_seconds=0.2))
    query.processAllAvailable()
    assert sinks.status(query)["active"]
    write(spark, str(tmp_path / "in"), [(2,)], "i long")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "data")).count() == 2


def test_json_modes(spark):
    df = spark.createDataFrame([('{"id": 5, "server_name": "a", "more": 1}',), ('{"server_name": "b"}',), ('{"id": null}',), ("{bad",), ("",)], "value string")
    assert [(r.id, r.server_name) for r in serde.wiki_info(df).collect()] == [(5, "a"), (0, "b"), (0, None)]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        serde.wiki_info(df, strict=True).collect()


def test_gauge_text():
    assert sinks.gauge("latency_ms", 1.5, op="sink") == '# TYPE latency_ms gauge\nlatency_ms{op="sink"} 1.5\n'


def test_rows_of_a_key_are_not_held_at_once(spark, tmp_path):
    import gc

    from pyspark.sql import Row

    n = 25_000
    spark.range(n).selectExpr("'a' as k", "(id * 7919) % 25000 as t").coalesce(1).write.parquet(str(tmp_path / "in"))
    alive = lambda row, kept: sum(isinstance(x, Row) for x in gc.get_objects())
    out = processors.triggered_window(spark.readStream.schema("k string, t long").parquet(str(tmp_path / "in")), ["k"], ["t"], "t", 10, 5, lambda r: r.t in (9, n - 1), alive)
    run(out, tmp_path)
    got = {r.t: r.emitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {9, n - 1} and max(got.values()) < n / 2


def frames(values, size=500):
    """What Spark hands to a processor: order, value, and whether each is null."""
    import pandas as pd

    rows = pd.DataFrame({"k0": "a", "c0": [i for i, _ in values], "n0": False, "c1": [0.0 if v is None else float(v) for _, v in values], "n1": [v is None for _, v in values]})
    return (rows.iloc[i : i + size] for i in range(0, len(rows), size))


@pytest.mark.parametrize("shape", ["mixed", "sorted", "reversed", "equal"])
def test_runs_on_disk_give_the_same_sums_and_counts(monkeypatch, shape):
    import random

    from pyspark.sql.types import DoubleType, LongType, StringType

    from tidewell.streaming import ordering
    from tidewell.streaming.state import LocalHandle

    for name, value in (("RUN_BYTES", 20_000), ("HEAD", 64), ("FAN", 3)):
        monkeypatch.setattr(ordering, name, value)
    n = 12_000
    values = [(i // 4 if shape == "equal" else i, None if i % 11 < 6 else i % 97) for i in range(n)]
    given = {"mixed": random.Random(5).sample(values, n), "sorted": values, "reversed": values[::-1], "equal": random.Random(6).sample(values, n)}[shape]
    columns = ordering.Columns(("k",), ("i", "v"), (LongType(), DoubleType()), (StringType(),), 1)
    counter, summer = processors.RunningCount(columns, 10), processors.SlidingSum(columns, "v", 5)
    for p in (counter, summer):
        p.init(LocalHandle())
    parts = [given] if shape != "sorted" else [given[:7001], given[7001:]]
    counted = [x for part in parts for f in counter.handleInputRows(("a",), frames(part), None) for x in zip(f.c0, f.n, strict=True)]
    assert [x for _, x in counted] == list(range(1, n + 1, 10)) and [i for i, _ in counted] == [values[k - 1][0] for _, k in counted]
    summed = [(i, None if t is None else float(t)) for part in parts for f in summer.handleInputRows(("a",), frames(part), None) for i, t in zip(f.c0, f.total.astype(object).where(f.total.notna(), None), strict=True)]
    assert [i for i, _ in summed] == [i for i, _ in values]
    if shape != "equal":
        last = [[v for _, v in values[max(0, i - 4) : i + 1] if v is not None] for i in range(n)]
        assert [t for _, t in summed] == [float(sum(x)) if x else None for x in last]


def test_memory_of_ordering_does_not_follow_the_rows(monkeypatch):
    import tracemalloc

    import numpy as np
    import pandas as pd

    from tidewell.streaming import ordering

    monkeypatch.setattr(ordering, "RUN_BYTES", 1 << 20)
    monkeypatch.setattr(ordering, "FAN", 4)

    def peak(n):
        made = (pd.DataFrame({"c0": np.arange(i, n * 10_000, n), "n0": False}) for i in range(n))
        tracemalloc.start()
        try:
            assert sum(len(f) for f in ordering.in_order(made, ["n0", "c0"])) == n * 10_000
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(400) < 1.5 * peak(100)


def test_types_and_nulls_of_keys_orders_and_values(spark, tmp_path):
    schema, source = "k long, t timestamp, d date, s string, i long, v double", str(tmp_path / "in")
    big = 2**60
    first = [(None, 1, 1), (None, 2, None), (7, 3, 2.5), (7, None, None), (None, 4, 3), (8, 1, None)]
    for part in (first, [(None, 5, 4), (8, 6, None), (7, 7, 1.0)]):
        rows = [(k, i and datetime(2024, 1, 1, 0, 0, i, i), None if i is None else datetime(9999, 12, 31).date(), i and f"x{i}", i and big + i, None if v is None else float(v)) for k, i, v in part]
        write(spark, source, rows[::-1], schema)
        run(processors.sliding_sum(spark.readStream.schema(schema).parquet(source), ["k"], "v", 2, ["t", "d", "s", "i"]), tmp_path)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [t for _, t in out.dtypes] == ["bigint", "timestamp", "date", "string", "bigint", "double"]
    assert {(r.k, r.i and r.i - big, r.total) for r in out.collect()} == {(None, 1, 1.0), (None, 2, 1.0), (None, 4, 3.0), (7, 3, 2.5), (7, None, 2.5), (8, 1, None), (None, 5, 7.0), (8, 6, None), (7, 7, 1.0)}
    assert {(r.t, r.d, r.s) for r in out.where("i is null").collect()} == {(None, None, None)}
    assert out.where("i is not null and (second(t) != substr(s, 2) or year(d) != 9999)").isEmpty()


def test_a_count_gives_frames_and_holds_few_rows(monkeypatch):
    import tracemalloc

    import numpy as np
    import pandas as pd
    from pyspark.sql.types import LongType, StringType

    from tidewell.streaming import ordering
    from tidewell.streaming.state import LocalHandle

    monkeypatch.setattr(ordering, "RUN_BYTES", 1 << 20)
    monkeypatch.setattr(ordering, "FAN", 4)

    def peak(n):
        counter = processors.RunningCount(ordering.Columns(("k",), ("i",), (LongType(),), (StringType(),), 1))
        counter.init(LocalHandle())
        made = (pd.DataFrame({"k0": "a", "c0": np.arange(i, n * 10_000, n), "n0": False}) for i in range(n))
        seen = 0
        tracemalloc.start()
        try:
            for frame in counter.handleInputRows(("a",), made, None):
                assert len(frame) <= ordering.HEAD and (frame.c0 + 1 == frame.n).all() and frame.n.iloc[0] == seen + 1
                seen += len(frame)
            assert seen == n * 10_000 == counter.count.value()
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(200) < 1.5 * peak(50)
