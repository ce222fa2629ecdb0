"""Streaming queries over the test tables: each drains a file stream, then reads what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.exprs import HOUR_NS, floor_to
from tidegauge.operators.aggregate import LIVE_KEY
from tidegauge.streaming import live

_KEYS = ["source", "category", "timeBin"]


def _stream(s, d):
    return live.event_stream(s, f"{d}/io_event.parquet", bytes_per_trigger=live.BATCH_BYTES).withColumn("fd", F.coalesce("fd", F.lit(0)))


def stream_tumbling(s, d):
    return live.running_counts(_stream(s, d).withColumn("time_bin", floor_to(F.col("start_ns"), HOUR_NS)), ["category", "time_bin"])


def stream_split_agg(s, d):
    return live.merged_partials(s, live.partial_rows(_stream(s, d), LIVE_KEY), LIVE_KEY)


def stream_late_partials(s, d):
    return live.merged_partials(s, live.partial_rows(_stream(s, d), _KEYS), _KEYS)


def stream_zip_refcount(s, d):
    e = live.event_stream(s, f"{d}/events.parquet")
    handles = e.select(F.col("user_id").alias("handle"), "event_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("delta"))
    return live.counted_opens_stream(handles)


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_split_agg, stream_late_partials, stream_zip_refcount)}

_SPLIT = """WITH p AS (SELECT *, row_number() OVER () AS rid FROM io_event),
t AS (SELECT rid, source, category, thread_id, coalesce(fd, 0) AS fd, start_ns, end_ns, coalesce(data, 0) AS data, coalesce(is_remote, false) AS rem,
  unnest(range(start_ns - start_ns % 3600000000000, end_ns - end_ns % 3600000000000 + 1, 3600000000000)) AS tb FROM p),
q AS (SELECT *, least(end_ns, tb + 3600000000000) - greatest(start_ns, tb) AS cpu, tb = start_ns - start_ns % 3600000000000 AS is_first,
  end_ns - end_ns % 3600000000000 = start_ns - start_ns % 3600000000000 AS one FROM t),
r AS (SELECT *, CASE WHEN is_first THEN 0 ELSE CAST(trunc(cpu::FLOAT / (end_ns - start_ns)::FLOAT * data::FLOAT) AS BIGINT) END AS later FROM q),
sp AS (SELECT *, CASE WHEN is_first THEN data - CAST(sum(later) OVER (PARTITION BY rid) AS BIGINT) ELSE later END AS part FROM r)
SELECT {keys}, CAST(count(*) FILTER (is_first) AS BIGINT) AS "count", CAST(sum(cpu) AS BIGINT) AS "cpuTime", CAST(sum(part) AS BIGINT) AS data,
  CAST(count(*) FILTER (rem AND one) AS BIGINT) AS "remoteCount", CAST(coalesce(sum(cpu) FILTER (rem), 0) AS BIGINT) AS "remoteCpuTime",
  CAST(coalesce(sum(part) FILTER (rem), 0) AS BIGINT) AS "remoteData" FROM sp GROUP BY ALL"""

ORACLE_SQL = {
    "stream_tumbling": "SELECT category, start_ns - start_ns % 3600000000000 AS time_bin, count(*) AS n FROM io_event GROUP BY ALL",
    "stream_split_agg": _SPLIT.format(keys='source, category, thread_id, tb AS "timeBin", fd'),
    "stream_late_partials": _SPLIT.format(keys='source, category, tb AS "timeBin"'),
    "stream_zip_refcount": """WITH h AS (SELECT user_id AS handle, event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS delta FROM events),
        z AS (SELECT *, sum(delta) OVER (PARTITION BY handle ORDER BY event_id) AS n FROM h) SELECT handle, event_id FROM z WHERE delta = 1 AND n = 1""",
}
