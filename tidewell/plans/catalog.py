"""Queries over the event tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import hashing, serde
from tidewell.operators import counting, stateless, windows
from tidewell.plans.plan import QueryPlan, Strategy
from tidewell.session import ready, shared_folder
from tidewell.sources import lines
from tidewell.streaming import processors, sinks

ORDER = ["ts", "event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def by_hour() -> Column:
    """Slices of the order of events."""
    return F.date_trunc("hour", F.col("ts"))


def kept_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateless.not_every_fourth(events(spark, sf_dir), "event_id")


def server_count_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, count by key and format: the whole pipeline, as a plan of stages."""
    plan = QueryPlan()
    plan.add_stage(0, lambda df: df.select("event_id", "ts", "event_type"), name="source")
    plan.add_stage(1, lambda df: stateless.not_every_fourth(df, "event_id"), name="filter")
    plan.add_stage(2, lambda df: counting.server_count(df, "event_type", ORDER, by_hour()), name="count")
    plan.add_stage(3, lambda df: df.select("event_id", "event_type", "n", "text"), name="sink")
    return plan.build(events(spark, sf_dir))["sink_1"]


def server_count_final(spark, sf_dir):
    return counting.final_count(kept_events(spark, sf_dir), "event_type")


def server_count_emit_every(spark, sf_dir):
    return counting.server_count(kept_events(spark, sf_dir), "event_type", ORDER, by_hour(), 10).select("event_id", "event_type", "n", "text")


def single_count(spark, sf_dir):
    return counting.single_count(events(spark, sf_dir), ORDER, by_hour()).select("event_id", "n", "text")


def single_count_keyed(spark, sf_dir):
    return counting.single_count(events(spark, sf_dir), ORDER, by_hour(), ["user_id"]).select("event_id", "user_id", "n", "text")


def frequency_count(spark, sf_dir):
    return counting.frequency(events(spark, sf_dir), "event_type", ORDER, by_hour()).select("event_id", "n", "text")


def edit_server_count(spark, sf_dir):
    return counting.final_count(stateless.filter_rows(events(spark, sf_dir), "event_type = 'purchase'"), "user_id")


def json_project(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.from_json("props", "k bigint").alias("p"))
    return rows.select("event_id", F.col("p.k").alias("k"))


def recent_change_project(spark, sf_dir):
    """Text records in, four text fields out: missing ones are empty, malformed lines are dropped."""
    made = F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_type").alias("type"), F.concat(F.lit("server-"), F.col("user_id").cast("string")).alias("server_name"))))
    return serde.recent_change(events(spark, sf_dir).select(made.alias("value")))


def map_project(spark, sf_dir):
    return stateless.map_rows(events(spark, sf_dir), event_id=F.col("event_id"), kind=F.upper("event_type"), cents=F.round(F.col("value") * 100).cast("long"))


def flat_map_tokens(spark, sf_dir):
    return stateless.flat_map(table(spark, sf_dir, "documents"), F.split("text", " "), "token", ("doc_id",))


def union_fan_in(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "event_type")
    return stateless.union(rows.where("event_type = 'click'"), rows.where("event_id % 2 = 0"))


def broadcast_fan_out(spark, sf_dir):
    return stateless.fan_out(events(spark, sf_dir).select("event_id"), 3)


def fan_out_plan(spark, sf_dir):
    """Two operators of one stage feed a third, which unites them."""
    plan = QueryPlan()
    plan.add_stage(0, lambda df: df.select("event_id", "user_id"), name="source")
    (clicks,) = plan.add_stage(1, lambda df: df.where("event_id % 3 = 0"), name="third")
    (rest,) = plan.add_stage(1, lambda df: df.where("event_id % 5 = 0"), name="fifth", strategy=Strategy.ROUND_ROBIN, parallelism=4)
    (count,) = plan.add_stage(2, lambda df: counting.final_count(df, "user_id"), name="count", strategy=Strategy.HASH, parallelism=8, keys=("user_id",))
    plan.add_downstream(clicks, count).add_downstream(rest, count)
    return plan.build(events(spark, sf_dir))[count]


def key_hash_range(spark, sf_dir):
    name = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    keyed = events(spark, sf_dir).select("event_id", hashing.string_hash(name).alias("hash"))
    return keyed.withColumn("part", hashing.key_range(F.col("hash"), 5))


def ring_owner(spark, sf_dir):
    """The node of a ring of four that each user belongs to."""
    ring = hashing.Ring()
    for n in range(4):
        ring.add(f"node-{n}")
    return events(spark, sf_dir).select("event_id", ring.owner_of(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("node"))


def legacy_channel(spark, sf_dir):
    keyed = events(spark, sf_dir).select("event_id", hashing.channel(hashing.string_hash(F.col("event_type")), 4).alias("channel"))
    return keyed


def weighted_sum(spark, sf_dir):
    return counting.summed(events(spark, sf_dir), "value", "event_type").withColumn("total", F.round("total", 2))


def reduce_extremes(spark, sf_dir):
    return counting.reduced(events(spark, sf_dir), F.max("value").alias("most"), "user_id")


def sliding_sum_5(spark, sf_dir):
    out = windows.sliding_sum(events(spark, sf_dir), ["event_type"], "value", 5, ORDER, by_hour())
    return out.select("event_id", F.round("total", 2).alias("total"))


def time_sliding(spark, sf_dir):
    return windows.time_windows(events(spark, sf_dir), "ts", "1 day", "6 hours", ["event_type"], F.count("*").alias("n"))


def time_tumbling(spark, sf_dir):
    return windows.time_windows(events(spark, sf_dir), "ts", "1 hour", None, ["event_type"], F.count("*").alias("n"))


def window_membership(spark, sf_dir):
    """Closed membership in a window of one day."""
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-02 00:00:00", "2024-01-03 00:00:00"))
    return events(spark, sf_dir).select("event_id", windows.in_window(F.col("ts"), start, end).alias("inside"))


def anchored_windows(spark, sf_dir):
    """The anchored window replayed by user."""
    rows = events(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return windows.anchored_windows(rows, ["user_id"], "us", 3_600_000_000 * 24, 3_600_000_000 * 6, ["us", "event_id"])


def generated_servers(spark, sf_dir):
    """Generated lines, parsed, filtered and counted."""
    work = serde.wiki_info(lines.generated_work(spark, 10_000))
    return counting.final_count(stateless.not_every_fourth(work), "server_name")


def latency_summary(spark, sf_dir):
    log = events(spark, sf_dir).select(F.col("event_type").alias("run"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("value").alias("latency_ms"))
    return sinks.summary(log)


def latency_timeline(spark, sf_dir):
    log = events(spark, sf_dir).select("event_id", F.col("event_type").alias("run"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("value").alias("latency_ms"))
    out = sinks.timeline(log, longest_ms=86_400_000 * 7, highest_ms=400.0, marks={"click": 1704240000000})
    return out.select("event_id", "elapsed_ms", "after_mark")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def streamed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Run a stream over the events to its end, into files, and read these."""
    ready(spark)
    out = build(lines.stream_parquet(spark, f"{sf_dir}/events.parquet"))
    folder = _folder(spark)
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/data").start()
        query.awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{folder}/data")
    query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/data")).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/data")


def stream_filter(spark, sf_dir):
    return streamed(spark, sf_dir, lambda df: stateless.not_every_fourth(df, "event_id").select("event_id", "event_type"))


def stream_server_count(spark, sf_dir):
    def build(df: DataFrame) -> DataFrame:
        kept = stateless.not_every_fourth(df, "event_id").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
        return processors.running_count(kept, ["event_type"], ORDER)

    return streamed(spark, sf_dir, build).select("event_id", "event_type", "n", serde.count_text(F.col("event_type"), F.col("n")).alias("text"))


def stream_server_count_final(spark, sf_dir):
    return streamed(spark, sf_dir, lambda df: counting.final_count(stateless.not_every_fourth(df, "event_id"), "event_type"), "complete")


def stream_sliding_sum_5(spark, sf_dir):
    def build(df: DataFrame) -> DataFrame:
        return processors.sliding_sum(df.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"), ["event_type"], "value", 5, ORDER)

    return streamed(spark, sf_dir, build).select("event_id", F.round("total", 2).alias("total"))


def stream_union(spark, sf_dir):
    def build(df: DataFrame) -> DataFrame:
        rows = df.select("event_id", "event_type")
        return stateless.union(rows.where("event_type = 'click'"), rows.where("event_id % 2 = 0"))

    return streamed(spark, sf_dir, build)


def stream_time_tumbling(spark, sf_dir):
    def build(df: DataFrame) -> DataFrame:
        return windows.time_windows(processors.with_grace(df, "ts", None), "ts", "1 hour", None, ["event_type"], F.count("*").alias("n"))

    out = streamed(spark, sf_dir, build, "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        server_count_changelog, server_count_final, server_count_emit_every, single_count, single_count_keyed, frequency_count, edit_server_count,
        json_project, recent_change_project, map_project, flat_map_tokens, union_fan_in, broadcast_fan_out, fan_out_plan, key_hash_range, ring_owner, legacy_channel,
        weighted_sum, reduce_extremes, sliding_sum_5, time_sliding, time_tumbling, window_membership, anchored_windows, generated_servers, latency_summary,
        latency_timeline, stream_filter, stream_server_count, stream_server_count_final, stream_sliding_sum_5, stream_union, stream_time_tumbling,
    )
}

_RUNNING = "count(*) OVER (PARTITION BY {key} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_CHANGELOG = f"SELECT event_id, event_type, n, format('Count for server-name: <{{}}>: [{{}}]', event_type, n) AS text FROM (SELECT *, {_RUNNING.format(key='event_type')} AS n FROM events WHERE event_id % 4 <> 0)"
_POSITIVE = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, u: (a * 31 + u) % 4294967296)"
_SIGNED = "(CASE WHEN {p} >= 2147483648 THEN {p} - 4294967296 ELSE {p} END)"
_WRAP = "(((({x}) % 4294967296) + 6442450944) % 4294967296 - 2147483648)"
_TUMBLING = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL"
_SLIDING_SUM = "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 4 PRECEDING), 2) AS total FROM events"
_UNION = "SELECT event_id, event_type FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 2 = 0"
_FINAL = "SELECT event_type, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY event_type"

ORACLES: dict[str, str] = {
    "server_count_changelog": _CHANGELOG,
    "server_count_final": _FINAL,
    "server_count_emit_every": f"SELECT * FROM ({_CHANGELOG}) WHERE n % 10 = 1",
    "single_count": "SELECT event_id, n, format('Count: {}', n) AS text FROM (SELECT event_id, count(*) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events)",
    "single_count_keyed": f"SELECT event_id, user_id, n, format('Count: {{}}', n) AS text FROM (SELECT event_id, user_id, {_RUNNING.format(key='user_id')} AS n FROM events)",
    "frequency_count": f"SELECT event_id, n, format('Element: {{}}, Frequency: {{}}', event_type, n) AS text FROM (SELECT event_id, event_type, {_RUNNING.format(key='event_type')} AS n FROM events)",
    "edit_server_count": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "json_project": "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events",
    "recent_change_project": "SELECT event_type AS type, '' AS timestamp, '' AS user, 'server-' || user_id AS server_name FROM events WHERE event_id % 50 <> 0",
    "map_project": "SELECT event_id, upper(event_type) AS kind, CAST(round(value * 100) AS BIGINT) AS cents FROM events",
    "flat_map_tokens": "SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents",
    "union_fan_in": _UNION,
    "broadcast_fan_out": "SELECT event_id, CAST(b AS INTEGER) AS branch FROM events, range(3) AS r(b)",
    "fan_out_plan": "SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id FROM events WHERE event_id % 5 = 0) GROUP BY user_id",
    "key_hash_range": f"SELECT event_id, CAST(h AS INTEGER) AS hash, CAST(least((h + 2147483648) // 858993459, 4) AS INTEGER) AS part FROM (SELECT event_id, {_SIGNED.format(p='p')} AS h FROM (SELECT event_id, {_POSITIVE.format(x=chr(39) + 'user-' + chr(39) + ' || user_id')} AS p FROM events))",
    "ring_owner": f"""WITH k AS (SELECT 'node-' || n || i AS t, 'node-' || n AS node FROM range(4) AS a(n), range(3) AS b(i) UNION ALL SELECT DISTINCT 'user-' || user_id, NULL FROM events),
h0 AS (SELECT t, node, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(t, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, u: xor(a, u) * 16777619 % 4294967296) AS h FROM k),
h1 AS (SELECT t, node, {_WRAP.format(x='h + h * 8192')} AS h FROM h0),
h2 AS (SELECT t, node, {_WRAP.format(x='s + s * 8')} AS h FROM (SELECT t, node, xor(h, CAST(floor(h / 128.0) AS BIGINT)) AS s FROM h1)),
h3 AS (SELECT t, node, {_WRAP.format(x='s + s * 32')} AS h FROM (SELECT t, node, xor(h, CAST(floor(h / 131072.0) AS BIGINT)) AS s FROM h2)),
p AS (SELECT h, node FROM h3 WHERE node IS NOT NULL),
o AS (SELECT u.t, coalesce((SELECT arg_min(node, p.h) FROM p WHERE p.h >= u.h), (SELECT arg_min(node, h) FROM p)) AS node FROM h3 AS u WHERE u.node IS NULL)
SELECT event_id, o.node FROM events JOIN o ON o.t = 'user-' || user_id""",
    "legacy_channel": f"SELECT event_id, CAST(abs(h % 4) AS INTEGER) AS channel FROM (SELECT event_id, {_SIGNED.format(p='p')} AS h FROM (SELECT event_id, {_POSITIVE.format(x='event_type')} AS p FROM events))",
    "weighted_sum": "SELECT event_type, round(sum(value), 2) AS total FROM events GROUP BY event_type",
    "reduce_extremes": "SELECT user_id, max(value) AS most FROM events GROUP BY user_id",
    "sliding_sum_5": _SLIDING_SUM,
    "time_sliding": "SELECT s AS window_start, s + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS * k FOR k IN range(4)]) AS s FROM events) GROUP BY ALL",
    "time_tumbling": _TUMBLING,
    "window_membership": "SELECT event_id, ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-03' AS inside FROM events",
    "anchored_windows": """WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_id, user_id, us, k, us AS window_start, true AS inside FROM r WHERE k = 1
UNION ALL SELECT r.event_id, r.user_id, r.us, r.k, w.window_start + CASE WHEN r.us BETWEEN w.window_start AND w.window_start + 86400000000 THEN 0 ELSE 21600000000 END,
  r.us BETWEEN w.window_start AND w.window_start + 86400000000 FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
SELECT event_id, user_id, us, window_start, window_start + 86400000000 AS window_end, inside FROM w""",
    "generated_servers": """SELECT server_name, count(*) AS n FROM (SELECT ('0x' || substr(md5(i || ':1:id'), 1, 15))::BIGINT % 100 + 1 AS id,
'server-' || (('0x' || substr(md5(i || ':1:server'), 1, 15))::BIGINT % 100000 + 1) AS server_name FROM range(10000) AS t(i)) WHERE id % 4 <> 0 GROUP BY server_name""",
    "latency_summary": "SELECT event_type AS run, count(*) AS n, round(avg(value), 4) AS mean_ms, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, quantile_disc(value, 0.99) AS p99_ms, min(value) AS min_ms, max(value) AS max_ms, round((count(*) - 1) / ((max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / 1000.0), 4) AS rows_per_s FROM events GROUP BY event_type",
    "latency_timeline": "SELECT event_id, t - f AS elapsed_ms, run = 'click' AND t >= 1704240000000 AS after_mark FROM (SELECT event_id, event_type AS run, value, (epoch_us(ts) // 1000) AS t, min((epoch_us(ts) // 1000)) OVER (PARTITION BY event_type) AS f FROM events) WHERE t - f < 604800000 AND value < 400",
    "stream_filter": "SELECT event_id, event_type FROM events WHERE event_id % 4 <> 0",
    "stream_server_count": _CHANGELOG,
    "stream_server_count_final": _FINAL,
    "stream_sliding_sum_5": _SLIDING_SUM,
    "stream_union": _UNION,
    "stream_time_tumbling": _TUMBLING,
}
