"""Splitting of events over fixed-width time bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.exprs import HOUR_NS, floor_to


def _single(c: Column) -> Column:
    """``c`` rounded to a 32-bit float; the factor keeps the optimizer from widening the cast away."""
    return c.cast("float") * F.lit(1).cast("float")


def split_over_bins(events: DataFrame, bin_ns: int = HOUR_NS) -> DataFrame:
    """One row per event and bin that it touches, with ``timeBin, count, cpuTime, data, remote*`` added.

    The call counts in its first bin. Time goes to the bins by overlap; an event that ends on a bin border has a
    row of no time there. Bytes go by overlap in 32-bit arithmetic, truncated, and the first bin takes the rest,
    so all totals are kept. Remote counts are 1 for remote events within one bin and 0 otherwise. Null bytes
    count as 0, a null flag as local; an event that ends before it starts or lacks a time has no row. Only
    per-row arrays are used, so the same plan runs on streams.
    """
    start, end = F.col("start_ns"), F.col("end_ns")
    timed = events.filter((start <= end) & F.col("end_ns").isNotNull())
    first = floor_to(start, bin_ns)
    size = F.coalesce(F.col("data"), F.lit(0)).cast("bigint")
    bins = F.sequence(first, floor_to(end, bin_ns), F.lit(bin_ns).cast("bigint"))
    overlap = lambda b: F.least(end, b + bin_ns) - F.greatest(start, b)
    share = lambda b: (
        F.when(b == first, F.lit(0).cast("bigint")).otherwise(
            ((_single(overlap(b)) / _single(end - start)).cast("float") * _single(size)).cast("bigint")
        )
    )
    parts = F.transform(bins, lambda b: F.struct(b.alias("timeBin"), overlap(b).alias("cpuTime"), share(b).alias("later")))
    later = F.aggregate("__parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p["later"])
    remote = F.coalesce(F.col("is_remote"), F.lit(False))
    one_bin = F.col("__n") == 1
    spread = (
        timed.withColumn("__parts", parts)
        .withColumns({"__later": later, "__n": F.size("__parts"), "__first": first})
        .withColumn("__p", F.explode("__parts"))
        .drop("__parts")
    )
    at_first = F.col("__p.timeBin") == F.col("__first")
    bytes_here = F.when(at_first, size - F.col("__later")).otherwise(F.col("__p.later"))
    zero = F.lit(0).cast("bigint")
    return (
        spread.withColumns(
            {
                "timeBin": F.col("__p.timeBin"),
                "count": at_first.cast("bigint"),
                "cpuTime": F.col("__p.cpuTime"),
                "__data": bytes_here,
                "remoteCount": F.when(remote & one_bin, F.lit(1).cast("bigint")).otherwise(zero),
                "remoteCpuTime": F.when(remote, F.col("__p.cpuTime")).otherwise(zero),
            }
        )
        .withColumn("remoteData", F.when(remote, F.col("__data")).otherwise(zero))
        .drop("data", "__p", "__later", "__n", "__first")
        .withColumnRenamed("__data", "data")
    )
