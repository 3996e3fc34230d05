"""Structured Streaming versions of the message path: windows, sessions, deduplication, limits, changes, context, outbox.

Each flow is a function from a streaming DataFrame of events to a streaming DataFrame, so any source fits; run() drains
what a file source has (availableNow) into Parquet, which is how the queries and tests compare them with batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..operators import ranges
from ..operators.ranges import messages_of
from ..session import scratch_path
from .outbox import committed, run_outbox
from .stateful import OPS, PURGE_FROM, changes, context_batches, limited, messages_now, operations

LATE = "2 days"


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", files_a_batch: int = 1) -> DataFrame:
    """New files of a table, as they come."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet").option("maxFilesPerTrigger", files_a_batch).parquet(sf_dir)


def windows(events: DataFrame, every: str = "300 seconds") -> DataFrame:
    """Counts per tumbling window; a window is final once the watermark passes it, later events are dropped."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", LATE)
    w = e.groupBy(F.window("t", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "first_id")


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", LATE)
    w = e.groupBy(F.session_window("t", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def once(events: DataFrame) -> DataFrame:
    """The first event of each idempotency key; state is kept only as long as a repeat may still come."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withColumn("key", F.concat_ws(":", F.lit("window"), "user_id", F.floor(F.unix_seconds("t") / 300)))
    return e.withWatermark("t", LATE).dropDuplicatesWithinWatermark(["key"]).select("key")


def drain(flow: DataFrame, out: str, mark: str, mode: str = "append") -> DataFrame:
    """Runs a flow over what its source has, on from its checkpoint, and returns all that it has written."""
    flow.writeStream.format("parquet").option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start(out).awaitTermination()
    return flow.sparkSession.read.schema(flow.schema).parquet(out)


def run(flow: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drains a flow from its beginning and returns what it wrote."""
    spark = flow.sparkSession
    return drain(flow, scratch_path(spark, label), scratch_path(spark, f"{label}-progress"), mode)


def run_batches(source: DataFrame, label: str, batch: Callable[[DataFrame], dict[str, DataFrame]], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """What the whole batches of a stream wrote, table by table (see outbox.py)."""
    spark = source.sparkSession
    out = scratch_path(spark, label)
    run_outbox(source, out, scratch_path(spark, f"{label}-progress"), batch)
    return {name: committed(spark, out, name, T.StructType.fromDDL(ddl)) for name, ddl in schemas.items()}


def _counted(batch: DataFrame) -> DataFrame:
    return batch.groupBy(F.window("ts", "300 seconds").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).select(F.col("w.start").alias("window_start"), "event_type", "n", "first_id")


WINDOW = "window_start timestamp_ntz, event_type string, n long, first_id long"


def stream_windows(spark, d):
    """All windows, those still open too: counts of whole batches, merged."""
    counted = run_batches(event_stream(spark, d), "windows", lambda b: {"windows": _counted(b)}, {"windows": WINDOW})["windows"]
    return counted.groupBy("window_start", "event_type").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


def stream_outbox(spark, d):
    """Windows with the jobs that were written beside them: one extraction a window and channel, by its idempotency key,
    in the first batch that saw the window."""

    def tables(b: DataFrame) -> dict[str, DataFrame]:
        counted = _counted(b)
        return {"windows": counted, "jobs": counted.select(F.concat_ws(":", F.lit("extract"), "event_type", F.date_format("window_start", "yyyyMMddHHmm")).alias("job_key"), "window_start", "event_type")}

    found = run_batches(event_stream(spark, d), "outbox", tables, {"windows": WINDOW, "jobs": "job_key string, window_start timestamp_ntz, event_type string"})
    windows = found["windows"].groupBy("window_start", "event_type").agg(F.sum("n").alias("n"))
    jobs = found["jobs"].groupBy("job_key", "window_start", "event_type").agg(F.min("batch").alias("batch"))
    return windows.join(jobs, ["window_start", "event_type"]).select("job_key", "window_start", "event_type", "n")


def stream_windows_closed(spark, d):
    """The windows that the watermark has passed, each written once, when it is final."""
    return run(windows(event_stream(spark, d)), "closed-windows")


def stream_sessions_closed(spark, d):
    """The sessions that the watermark has passed."""
    return run(sessions(event_stream(spark, d)), "closed-sessions")


def stream_changes(spark, d):
    """Each message's last state after a stream of creates, edits and deletes, from the retractions that it told."""
    told = run(changes(operations(event_stream(spark, d))), "changes")
    return messages_now(told).select("message_id", "status", "rev", "seq", F.md5("content").alias("content_md5"))


def stream_context(spark, d):
    """Each message's prior context from its channel's ring buffer."""
    found = context_batches(messages_of(event_stream(spark, d)), scratch_path(spark, "contexts"), scratch_path(spark, "contexts-progress"))
    return found.select("message_id", F.array_join(F.transform("context", lambda m: m.cast("string")), ",").alias("context"), "reply_found")


def stream_once(spark, d):
    return run(once(event_stream(spark, d)), "once")


def stream_limited(spark, d):
    return run(limited(event_stream(spark, d)), "limited")


def stream_latest(spark, d):
    """Latest-wins state over a change stream: each user's last event."""
    kind = "user_id long, r struct<ts timestamp_ntz, event_id long, event_type string, value double>"
    parts = run_batches(event_stream(spark, d), "latest", lambda b: {"latest": b.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("r"))}, {"latest": kind})["latest"]
    return parts.groupBy("user_id").agg(F.max("r").alias("r")).select("user_id", "r.event_type", "r.value")


QUERIES = {f.__name__: f for f in (stream_windows, stream_windows_closed, stream_sessions_closed, stream_outbox, stream_once, stream_limited, stream_latest, stream_changes, stream_context)}
ORACLES = {
    "stream_windows": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL",
    "stream_once": "SELECT DISTINCT concat_ws(':', 'window', user_id, CAST(floor(epoch(date_trunc('second', ts)) / 300) AS BIGINT)) AS key FROM events",
    "stream_latest": "SELECT user_id, r.event_type, r.value FROM (SELECT user_id, arg_max({'event_type': event_type, 'value': value}, row(ts, event_id)) AS r FROM events GROUP BY user_id)",
    "stream_limited": ranges.ORACLES["rate_limit_sliding_greedy"],
    "stream_context": ranges.ORACLES["message_context"],
    "stream_outbox": "SELECT concat_ws(':', 'extract', event_type, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y%m%d%H%M')) AS job_key, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_windows_closed": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 5 MINUTE, any_value(ts)) + INTERVAL 5 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY FROM events)",
    "stream_sessions_closed": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY FROM events)""",
    "stream_changes": f"""WITH o AS (SELECT concat_ws(':', user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 10) AS message_id, event_id AS seq, CASE {' '.join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in OPS.items())} WHEN event_type = 'error' THEN CASE WHEN value >= {PURGE_FROM} THEN 'purge' ELSE 'delete' END ELSE 'pin' END AS op,
  CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS content, row_number() OVER (PARTITION BY message_id ORDER BY ts, event_id) AS n FROM events),
made AS (SELECT message_id, min(n) AS made FROM o WHERE op = 'create' GROUP BY 1), gone AS (SELECT message_id, min(n) AS gone, bool_or(op = 'purge') AS purged FROM o JOIN made USING (message_id) WHERE n > made AND op IN ('delete', 'purge') GROUP BY 1),
c AS (SELECT *, content IS DISTINCT FROM lag(content) OVER (PARTITION BY message_id ORDER BY n) OR n = made AS changes FROM o JOIN made USING (message_id) LEFT JOIN gone USING (message_id) WHERE n >= made AND op IN ('create', 'edit') AND (gone IS NULL OR n < gone))
SELECT message_id, CASE WHEN bool_or(purged) THEN 'purged' WHEN any_value(gone) IS NOT NULL THEN 'deleted' ELSE 'active' END AS status, count(*) FILTER (changes) AS rev,
  CASE WHEN NOT coalesce(bool_or(purged), false) THEN max(seq) FILTER (changes AND n = m) END AS seq, CASE WHEN NOT coalesce(bool_or(purged), false) THEN md5(arg_max(content, n)) END AS content_md5
FROM (SELECT *, max(n) FILTER (changes) OVER (PARTITION BY message_id) AS m FROM c) GROUP BY message_id""",
}
