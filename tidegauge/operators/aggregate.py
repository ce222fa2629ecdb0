"""Aggregations of statistics rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schema import MEASURES

LIVE_KEY = ["source", "category", "thread_id", "timeBin", "fd"]
STATS_KEY = ["hostname", "pid", "key", "timeBin", "source", "category", "fileDescriptor", "threadId"]


def sum_by(rows: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Sums of the measures per key; map-side combined, so partial rows of a key may come in any number."""
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def partial_merge(rows: DataFrame, keys: Sequence[str], parts: int = 8) -> DataFrame:
    """The same sums in two explicit steps: per worker (a hash slice of the rows), then over the workers."""
    worker = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    return sum_by(sum_by(rows.withColumn("__worker", worker), [*keys, "__worker"]), keys)


def phase_totals(stats: DataFrame, border: int, keys: Sequence[str] = ("source", "category")) -> DataFrame:
    """Counts and bytes before and after ``border``; bins exactly at the border belong to neither phase."""
    before, after = F.col("timeBin") < border, F.col("timeBin") > border
    pick = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return stats.groupBy(*keys).agg(
        pick(before, "count").alias("count_1"), pick(before, "data").alias("data_1"), pick(after, "count").alias("count_2"),
        pick(after, "data").alias("data_2"),
    )


def rounded_ratio(a: Column, b: Column) -> Column:
    """``a / b`` rounded half to even as a whole number, 0 where ``b`` is 0."""
    return F.when(b != 0, F.bround(a.cast("double") / b).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def file_totals(stats: DataFrame, fd_map: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Bytes and calls per host and file of the traced reads and writes of the upper layer.

    Statistics are summed per descriptor before they meet the dictionary, so a hot descriptor is one row in the
    join. A descriptor registered again takes its latest path. Unknown files are left out, or named ``n/a``.
    """
    key = ["hostname", "pid", "key", "fileDescriptor"]
    per_fd = sum_by(stats.filter("source = 'jvm' and category <> 'other'"), key, ["count", "data"])
    latest = fd_map.groupBy(*key).agg(F.max_by("path", F.struct("first_seen_ns", "map_id")).alias("path"))
    joined = per_fd.join(latest, key, "left")
    named = joined.withColumn("path", F.coalesce("path", F.lit("n/a"))) if keep_unknown else joined.filter("path is not null")
    return sum_by(named, ["hostname", "path"], ["count", "data"])


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
