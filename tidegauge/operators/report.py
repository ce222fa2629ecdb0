"""Report rows: labels, rounding, table rows and long-format phase reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.aggregate import phase_totals, rounded_ratio
from tidegauge.operators.timeline import GIB


def label(key: Column) -> Column:
    """Display name of a role: YARN and HDFS in capitals, others capitalised."""
    return F.when(key == "yarn", "YARN").when(key == "hdfs", "HDFS").otherwise(F.initcap(key))


def gib(size: Column) -> Column:
    """Bytes in whole GiB, rounded half to even."""
    return F.bround(size.cast("double") / GIB).cast("bigint")


def scaled(size: Column, unit: float) -> Column:
    """Bytes in whole ``unit`` s, rounded half to even."""
    return F.bround(size.cast("double") / unit).cast("bigint")


def table_rows(totals: DataFrame, name: Column, values: list[str]) -> DataFrame:
    """``(name, line)``: a LaTeX table row per row, numbers with thousands separators."""
    cells = [F.format_number(F.col(v), 0) for v in values]
    return totals.select(name.alias("name"), F.concat_ws(" & ", name, *cells).alias("line"))


def phase_report(stats: DataFrame, border: int, count_other: bool = False) -> DataFrame:
    """Long-format report ``(phase, source, metric, value)``: calls, bytes and mean bytes per call and category.

    ``other`` calls are left out unless ``count_other``.
    """
    wanted = stats if count_other else stats.filter(F.col("category").isin("read", "write"))
    totals = phase_totals(wanted, border)
    rows = F.array(
        *[
            F.struct(F.lit(f"phase_{p}").alias("phase"), F.concat("category", F.lit(f"_{m}")).alias("metric"), v.alias("value"))
            for p in (1, 2)
            for m, v in (
                ("calls", F.col(f"count_{p}")), ("bytes", F.col(f"data_{p}")),
                ("bytes_per_call", rounded_ratio(F.col(f"data_{p}"), F.col(f"count_{p}"))),
            )
        ]
    )
    return totals.select("source", F.explode(rows).alias("x")).select("x.phase", "source", "x.metric", "x.value")


def write_rows(rows: DataFrame, path: str) -> None:
    """Write the lines of ``table_rows`` as text, one directory per name."""
    rows.select("name", F.col("line").alias("value")).write.mode("overwrite").partitionBy("name").text(path)
