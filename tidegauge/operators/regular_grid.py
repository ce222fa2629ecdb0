"""Irregular readings onto a regular grid: one entry per source and period.

Short gaps are filled by shape-preserving monotone cubic interpolation (Fritsch-Carlson slopes) through the readings at
their own times; long gaps stay marked and end a segment. The series are cut into time shards. Shards exchange their
outermost readings only: one slim row per shard, from which each gets its halo. A long series is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.exprs import epoch_ns, floor_to, wall_micros
from tidegauge.operators.skew import SALTS, salted_join

#: Missing periods that are still filled; longer gaps are only marked.
MAX_FILL = 12
#: Periods in a time shard.
SHARD_PERIODS = 2048
_CHUNK = 10_000


def usable_readings(readings: DataFrame, end_of_file: int = -1) -> DataFrame:
    """``(series_id, reading_id, t, v)`` of the usable readings, ``t`` in ns.

    A reading is usable if its time and length are known, the time is above 0 and, in ns, not later than its
    receipt (an unknown receipt makes it unusable). The length ``end_of_file`` counts as 0.
    """
    t = epoch_ns(F.col("startTime"))
    return readings.filter(F.col("series_id").isNotNull() & (F.col("startTime") > 0) & F.col("length").isNotNull()).select(
        "series_id", "reading_id", t.alias("t"), wall_micros(F.col("received_ts")).alias("us"),
        F.when(F.col("length") == end_of_file, F.lit(0)).otherwise(F.col("length")).cast("double").alias("v"),
    ).filter(F.col("t") <= F.col("us") * 1000).drop("us")


def knots(readings: DataFrame, series: DataFrame, salts: int = SALTS) -> DataFrame:
    """``(series_id, period_ns, period_start, t, v)``: the last usable reading of each period that has one, with its time.

    Repeated readings don't change it. Series without a positive period, and readings of unknown series,
    have no grid. Readings are combined before the shuffle, so a period of very many readings does no harm.
    """
    periods = series.filter(F.col("series_id").isNotNull() & (F.col("period_ns") > 0)).groupBy("series_id").agg(
        F.min("period_ns").alias("period_ns")
    )
    joined = salted_join(usable_readings(readings), periods, ["series_id"], ["reading_id", "t"], salts)
    last = joined.groupBy("series_id", "period_ns", floor_to(F.col("t"), F.col("period_ns")).alias("period_start")).agg(
        F.max(F.struct("t", "reading_id", "v")).alias("k")
    )
    return last.select("series_id", "period_ns", "period_start", "k.t", "k.v")


def with_neighbours(k: DataFrame, shard_periods: int = SHARD_PERIODS) -> DataFrame:
    """``(series_id, period_ns, k0, k1, k2, k3)`` per row of ``knots``: the knot ``k1``, the one before and the two after it as ``(x, t, y)``.

    Neighbours are found within time shards of at most ``shard_periods`` knots. Shards exchange their outermost knots only: one
    slim row of three knots each, from which a shard's first and last knots get their neighbours (null where the series ends).
    """
    shard = F.coalesce(F.floor(F.col("period_start") / F.col("period_ns") / shard_periods), F.lit(0)).alias("shard")
    cut = k.select("series_id", "period_ns", shard, "period_start", F.struct(F.col("period_start").alias("x"), "t", F.col("v").alias("y")).alias("k1"))
    inside = Window.partitionBy("series_id", "shard").orderBy("period_start")
    own = cut.select(
        "series_id", "shard", "period_ns", "k1", F.lag("k1").over(inside).alias("b"), F.lead("k1").over(inside).alias("c1"), F.lead("k1", 2).over(inside).alias("c2")
    )
    is_first, is_last = F.col("b").isNull(), F.col("c1").isNull()
    edges = own.filter(is_first | is_last).groupBy("series_id", "shard").agg(
        F.max(F.when(is_first, F.col("k1"))).alias("first"), F.max(F.when(is_first, F.col("c1"))).alias("second"), F.max(F.when(is_last, F.col("k1"))).alias("last")
    )
    along = Window.partitionBy("series_id").orderBy("shard")
    halo = edges.select(
        "series_id", "shard", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after1"),
        F.coalesce(F.lead("second").over(along), F.lead("first", 2).over(along)).alias("after2"),
    )
    return own.join(halo, ["series_id", "shard"]).select(
        "series_id", "period_ns", F.coalesce("b", "before").alias("k0"), "k1", F.coalesce("c1", "after1").alias("k2"),
        F.coalesce("c2", F.when(is_last, F.col("after2")).otherwise(F.col("after1"))).alias("k3"),
    )


def _end_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """Three-point slope at the end of a segment, kept within the shape of its first interval."""
    d = ((h0 * 2 + h1) * m0 - h0 * m1) / (h0 + h1)
    return F.when(F.signum(d) != F.signum(m0), 0.0).when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > F.abs(m0) * 3), m0 * 3).otherwise(d)


def _inner_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """Weighted harmonic mean of the neighbouring secants, 0 at a local extremum."""
    w0, w1 = h1 * 2 + h0, h1 + h0 * 2
    safe0, safe1 = F.when(m0 != 0, m0).otherwise(1.0), F.when(m1 != 0, m1).otherwise(1.0)
    return F.when(m0 * m1 <= 0, 0.0).otherwise((w0 + w1) / (w0 / safe0 + w1 / safe1))


def regular_grid(
    readings: DataFrame, series: DataFrame, max_fill: int = MAX_FILL, shard_periods: int = SHARD_PERIODS, salts: int = SALTS
) -> DataFrame:
    """The regular series: ``(series_id, period_start, status, value)``.

    Every period between the first and the last with a usable reading has one row: ``observed`` with the
    period's last reading, ``interpolated`` in gaps of at most ``max_fill`` periods, with the value that the curve through the
    readings, each at its own time, has at the period's start, ``gap`` (value null) in longer ones. Slopes never look across
    a long gap. Empty tables give no rows; a series with one usable period gives that period.
    """
    pts = with_neighbours(knots(readings, series, salts), shard_periods).select(
        "series_id", F.col("period_ns").alias("p"), *[F.col(f"k{i}.{c}").alias(f"{c}{i}") for i in range(4) for c in "xty"]
    ).withColumn("missing", F.coalesce(F.try_divide(F.col("x2") - F.col("x1"), F.col("p")).cast("bigint") - 1, F.lit(0)))
    observed = pts.select("series_id", F.col("x1").alias("period_start"), F.lit("observed").alias("status"), F.col("y1").alias("value"))

    reach = (F.lit(max_fill) + 1) * F.col("p")
    unit = lambda c: c.cast("double") / F.col("p")  # noqa: E731  in periods, so that no power of ns overflows
    h0, h1, h2 = unit(F.col("t1") - F.col("t0")), unit(F.col("t2") - F.col("t1")), unit(F.col("t3") - F.col("t2"))
    has0 = F.coalesce(F.col("x1") - F.col("x0") <= reach, F.lit(False))
    has3 = F.coalesce(F.col("x3") - F.col("x2") <= reach, F.lit(False))
    m0, m1, m2 = (F.col("y1") - F.col("y0")) / h0, (F.col("y2") - F.col("y1")) / h1, (F.col("y3") - F.col("y2")) / h2
    d1 = F.when(F.col("has0"), _inner_slope(F.col("h0"), F.col("h1"), F.col("m0"), F.col("m1"))).when(
        F.col("has3"), _end_slope(F.col("h1"), F.col("h2"), F.col("m1"), F.col("m2"))
    ).otherwise(F.col("m1"))
    d2 = F.when(F.col("has3"), _inner_slope(F.col("h1"), F.col("h2"), F.col("m1"), F.col("m2"))).when(
        F.col("has0"), _end_slope(F.col("h1"), F.col("h0"), F.col("m1"), F.col("m0"))
    ).otherwise(F.col("m1"))
    gaps = pts.filter(F.col("missing") > 0)
    curves = (
        gaps.select("*", h0.alias("h0"), h1.alias("h1"), h2.alias("h2"), has0.alias("has0"), has3.alias("has3"), m0.alias("m0"),
                    m1.alias("m1"), m2.alias("m2"))
        .select("series_id", "p", "x1", "t1", "y1", "y2", "missing", "h1", d1.alias("d1"), d2.alias("d2"))
    )
    # a gap of any length is unrolled in chunks, so that no array grows with it
    chunked = curves.withColumn("c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("missing"), F.lit(_CHUNK).cast("bigint"))))
    steps = chunked.withColumn("j", F.explode(F.sequence(F.col("c"), F.least(F.col("missing"), F.col("c") + (_CHUNK - 1)))))
    s = unit(F.col("x1") + F.col("j") * F.col("p") - F.col("t1")) / F.col("h1")
    value = (
        (2 * s * s * s - 3 * s * s + 1) * F.col("y1")
        + (s * s * s - 2 * s * s + s) * F.col("h1") * F.col("d1")
        + (3 * s * s - 2 * s * s * s) * F.col("y2")
        + (s * s * s - s * s) * F.col("h1") * F.col("d2")
    )
    short = F.col("missing") <= max_fill
    filled = steps.select(
        "series_id", (F.col("x1") + F.col("j") * F.col("p")).alias("period_start"),
        F.when(short, "interpolated").otherwise("gap").alias("status"), F.when(short, value).alias("value"),
    )
    return observed.unionByName(filled)


def missing_periods(grid: DataFrame) -> DataFrame:
    """``(series_id, period_start)`` of the periods without a usable reading of their own."""
    return grid.filter(F.col("status") != "observed").select("series_id", "period_start")


def coverage(grid: DataFrame) -> DataFrame:
    """Periods per series and status: ``(series_id, n_observed, n_filled, n_marked)``."""
    n = lambda s: F.count_if(F.col("status") == s)
    return grid.groupBy("series_id").agg(
        n("observed").alias("n_observed"), n("interpolated").alias("n_filled"), n("gap").alias("n_marked")
    )
