"""Series on a common time axis: alignment, cumulation, smoothing, stacking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.aggregate import sum_by

GIB = 1073741824.0
MIB = 1048576.0
MINUTE_NS = 6.0e10

#: The layers that are reported, from the bottom of the stack to the top.
LAYER_ORDER = [
    ("yarn", "jvm", "write", 0), ("yarn", "jvm", "read", 1), ("hdfs", "jvm", "write", 2), ("hdfs", "jvm", "read", 3), ("map", "jvm", "write", 4),
    ("map", "jvm", "read", 5), ("reduce", "jvm", "write", 6), ("reduce", "jvm", "read", 7), ("flink", "jvm", "write", 6), ("flink", "jvm", "read", 7),
    ("spark", "jvm", "write", 6), ("spark", "jvm", "read", 7), ("map", "sfs", "write", 4), ("map", "sfs", "read", 5), ("reduce", "sfs", "write", 6),
    ("reduce", "sfs", "read", 7), ("flink", "sfs", "write", 6), ("flink", "sfs", "read", 7), ("spark", "sfs", "write", 6), ("spark", "sfs", "read", 7),
]

GROUP = ["key", "source", "category"]


def with_layer_order(rows: DataFrame) -> DataFrame:
    """Rows of the reported layers with their place ``ord`` in the stack."""
    spark = rows.sparkSession
    order = spark.createDataFrame(LAYER_ORDER, "key string, source string, category string, ord int")
    return rows.join(F.broadcast(order), GROUP, "inner")  # a literal table of 20 rows


def minutes_axis(rows: DataFrame) -> DataFrame:
    """Distinct bins with the minutes since the first one."""
    first = rows.agg(F.min("timeBin").alias("t")).scalar()
    return rows.select("timeBin").distinct().withColumn("minutes", (F.col("timeBin") - first) / MINUTE_NS)


def cumulative(stats: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Bytes per key and bin and their running total, in bytes and GiB. Sums per bin come first, so the windows are
    as long as there are bins."""
    along = Window.partitionBy(*keys).orderBy("timeBin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_bin = sum_by(stats, [*keys, "timeBin"], ["data"])
    return per_bin.withColumn("total", F.sum("data").over(along)).withColumn("gib", F.col("total") / GIB)


def aligned(series: DataFrame, value: str, keys: Sequence[str] = GROUP) -> DataFrame:
    """The series on the union of all bins: gaps take the last value before, or 0.

    The bins (as many as the time span has) are exploded from one array per group.
    """
    bins = series.agg(F.sort_array(F.collect_set("timeBin")).alias("b")).scalar()
    axis = series.select(*keys).distinct().withColumn("timeBin", F.explode(bins))
    along = Window.partitionBy(*keys).orderBy("timeBin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(along), F.lit(0))
    return axis.join(series.select(*keys, "timeBin", value), [*keys, "timeBin"], "left").withColumn(value, filled)


def rolling_rate(per_bin: DataFrame, key: str, rows: int = 120) -> DataFrame:
    """Mean bytes over the last ``rows`` bins in MiB; null until there are as many."""
    along = Window.partitionBy(key).orderBy("timeBin").rowsBetween(-(rows - 1), 0)
    full = F.count(F.lit(1)).over(along) >= rows
    return per_bin.withColumn("mib_per_bin", F.when(full, F.sum("data").over(along) / F.lit(rows * MIB)))


def value_at(series: DataFrame, value: str, position: int, keys: Sequence[str] = GROUP) -> DataFrame:
    """Value at a row position (from 0) of each aligned series, and at its end."""
    along = Window.partitionBy(*keys).orderBy("timeBin")
    numbered = series.withColumn("__i", F.row_number().over(along) - 1)
    return numbered.groupBy(*keys).agg(
        F.max(F.when(F.col("__i") == position, F.col(value))).alias("at_border"), F.max_by(value, "timeBin").alias("at_end")
    )


def stacked(series: DataFrame, value: str, source: str) -> DataFrame:
    """Lower and upper bound of each layer of a source in the stack, per bin."""
    layers = with_layer_order(series.filter(F.col("source") == source))
    along = Window.partitionBy("timeBin").orderBy("ord", "key")
    upper = F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return layers.withColumn("upper_bound", upper).withColumn("lower_bound", F.col("upper_bound") - F.col(value))
