"""File-system counters, metric dumps and scheduler logs read as text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.skew import SALTS, salted_join


def counter_deltas(snapshots: DataFrame, host: str = "host") -> DataFrame:
    """Growth of ``rd`` and ``wr`` between the snapshots ``pre``, ``mid`` and ``post``, by mount and for all mounts.

    Phase 1 is mid - pre, phase 2 post - mid, summed over the hosts. ``mount`` is ``all`` in the totals of a file
    system.
    """
    sign1 = F.when(F.col("snapshot") == "mid", 1).when(F.col("snapshot") == "pre", -1).otherwise(0)
    sign2 = F.when(F.col("snapshot") == "post", 1).when(F.col("snapshot") == "mid", -1).otherwise(0)
    deltas = [F.sum(F.col(c) * s).alias(f"{c}_{p}") for c in ("rd", "wr") for p, s in ((1, sign1), (2, sign2))]
    sets = snapshots.groupingSets([["fs", "mount"], ["fs"]], "fs", "mount").agg(*deltas, F.grouping("mount").alias("__all"))
    return sets.withColumn("mount", F.when(F.col("__all") == 1, "all").otherwise(F.col("mount"))).drop("__all")


def last_value_totals(lines: DataFrame, keys: Sequence[str], order: str, value: str, total_by: Sequence[str]) -> DataFrame:
    """Sum over ``keys`` of each key's last value (by the order of its lines), per ``total_by``."""
    last = lines.groupBy(*total_by, *keys).agg(F.max_by(value, order).alias("__v"))
    return last.groupBy(*total_by).agg(F.sum("__v").alias("total"))


def first_occurrences(lines: DataFrame, key: str, order: str, value: str, salts: int = SALTS) -> DataFrame:
    """Per counter: its first and second value (the two phases), and its last (overwriting wins).

    The lowest orders are found by aggregation with map-side combine, the second one after a salted join, so no task
    sorts or holds all lines of a counter.
    """
    item = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    lows = lines.groupBy(key).agg(F.min(item).alias("lo1"), F.max_by(value, order).alias("last_value"))
    rest = salted_join(lines.select(key, order, value), lows.select(key, F.col("lo1.o").alias("__o")), [key], [order], salts)
    second = rest.filter(F.col(order) > F.col("__o")).groupBy(key).agg(F.min(item).alias("lo2"))
    return lows.join(second, key, "left").select(
        key, F.col("lo1.v").alias("phase_1"), F.col("lo2.v").alias("phase_2"), "last_value"
    )


def xfs_counters(lines: DataFrame) -> DataFrame:
    """``(file, name, value)`` of the byte and call counters in ``xpc`` and ``rw`` lines ``(file, line)``."""
    f = F.split(F.trim("line"), r"\s+")
    at = lambda i: F.get(f, F.lit(i)).try_cast("bigint")
    named = F.when(
        F.get(f, F.lit(0)) == "xpc",
        F.array(F.struct(F.lit("write_bytes").alias("name"), at(2).alias("value")), F.struct(F.lit("read_bytes").alias("name"), at(3).alias("value"))),
    ).when(
        F.get(f, F.lit(0)) == "rw",
        F.array(F.struct(F.lit("writes").alias("name"), at(1).alias("value")), F.struct(F.lit("reads").alias("name"), at(2).alias("value"))),
    )
    return lines.select("file", F.explode(named).alias("x")).select("file", "x.name", "x.value")


def ext4_counter(lines: DataFrame) -> DataFrame:
    """``(file, value)``: the KiB written in the first line of each file, in bytes; ``lines`` has ``file, line_no, line``."""
    return lines.filter(F.col("line_no") == 1).select("file", (F.trim("line").try_cast("bigint") * 1024).alias("value"))


def metric_values(lines: DataFrame) -> DataFrame:
    """``(file, line_no, record, port, name, value)`` of the network and data-node counters in metric dumps."""
    line = F.col("line")
    record = F.when(line.contains("rpc.rpc"), "rpc").when(line.contains("dfs.datanode"), "datanode")
    names = F.when(record == "rpc", F.array(F.lit("SentBytes"), F.lit("ReceivedBytes"))).otherwise(
        F.array(*[F.lit(x) for x in ("BytesWritten", "BytesRead", "RemoteBytesRead", "RemoteBytesWritten")])
    )
    rows = lines.withColumn("record", record).filter(F.col("record").isNotNull()).withColumn("name", F.explode(names))
    pairs = F.str_to_map(F.regexp_replace("line", r",\s*", " "), F.lit(" "), F.lit("="))
    value = F.try_element_at(pairs, F.col("name")).try_cast("bigint")
    return rows.select("file", "line_no", "record", F.try_element_at(pairs, F.lit("port")).alias("port"), "name", value.alias("value")).filter(
        F.col("value").isNotNull()
    )


#: What the lines of a scheduler log hold.
LOG_MARKS = {
    "engine": r"Using engine: (\w+)", "hdfs_read": r"HDFS: Number of bytes read=([0-9]+)", "hdfs_written": r"HDFS: Number of bytes written=([0-9]+)",
    "file_read": r"FILE: Number of bytes read=([0-9]+)", "file_written": r"FILE: Number of bytes written=([0-9]+)",
    "shuffle": r"Reduce shuffle bytes=([0-9]+)", "map_output": r"Map output materialized bytes=([0-9]+)", "spilled": r"Spilled Records=([0-9]+)",
}
#: The lines between which the phases run.
LOG_TIMES = {
    "phase_1_start": r"^(.*): Generating TeraSort data on HDFS$", "phase_1_end": r"^(.*): Generating TeraSort data on HDFS done",
    "phase_2_start": r"^(.*): Running TeraSort$", "phase_2_end": r"^(.*): Running TeraSort done: 0",
}


def log_values(lines: DataFrame) -> DataFrame:
    """``(file, line_no, name, text)`` of the marks and times in scheduler-log lines ``(file, line_no, line)``."""
    found = [
        F.struct(F.lit(n).alias("name"), F.regexp_extract(F.trim("line"), p, 1).alias("text")) for n, p in (LOG_MARKS | LOG_TIMES).items()
    ]
    return lines.select("file", "line_no", F.explode(F.array(*found)).alias("x")).select("file", "line_no", "x.*").filter("text <> ''")


def log_time(text: Column) -> Column:
    """Seconds since the epoch of a date like ``Mon Jan  1 10:00:00 UTC 2024``; null if it isn't one."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\w{3} ", ""), r"\s+", " ")
    return F.unix_timestamp(F.try_to_timestamp(plain, F.lit("MMM d HH:mm:ss z yyyy")))


def phase_border(times: DataFrame) -> DataFrame:
    """Border between the phases in ns, per file: the rounded middle of the pause between them.

    ``times`` has ``file, phase_1_end, phase_2_start`` in seconds.
    """
    middle = F.bround(F.col("phase_1_end") + (F.col("phase_2_start") - F.col("phase_1_end")) / 2.0)
    return times.select("file", (middle.cast("bigint") * 1_000_000_000).alias("border_ns"))


def log_times(lines: DataFrame) -> DataFrame:
    """``(file, phase_1_start, phase_1_end, phase_2_start, phase_2_end)`` in seconds, from log lines."""
    values = log_values(lines)
    return values.groupBy("file").agg(*[F.max(F.when(F.col("name") == n, log_time(F.col("text")))).alias(n) for n in LOG_TIMES])


def metric_component(file_name: Column) -> Column:
    """Component of ``<jobid>-<host>-<component>-metrics.out``, whatever dashes the host has."""
    return F.regexp_extract(file_name, r"^[0-9]+-.+-([^-]+)-metrics\.out\z", 1)


def running_rank(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Lines with the number ``nth`` of their occurrence within their counter (for logs of bounded length)."""
    return lines.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
