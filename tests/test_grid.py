"""Regular grids against an independent monotone cubic interpolation."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import regular_grid as G

BASE = 1_741_000_000_000_000_000
READINGS = "reading_id bigint, series_id bigint, startTime bigint, length bigint, received_ts timestamp_ntz"


def when(ns):
    return datetime(1970, 1, 1) + timedelta(microseconds=ns // 1000 + 1)


def slopes(x, y):
    h, m = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.array([m[0], m[0]])
    d = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if m[i - 1] * m[i] > 0:
            w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            d[i] = (w0 + w1) / (w0 / m[i - 1] + w1 / m[i])

    def end(h0, h1, m0, m1):
        v = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        if np.sign(v) != np.sign(m0):
            return 0.0
        return 3 * m0 if np.sign(m0) != np.sign(m1) and abs(v) > 3 * abs(m0) else v

    d[0], d[-1] = end(h[0], h[1], m[0], m[1]), end(h[-1], h[-2], m[-1], m[-2])
    return d


def expected(knots, max_fill):
    """{period: (status, value)} from {period: (time in periods, value)}."""
    ps = sorted(knots)
    out = {p: ("observed", knots[p][1]) for p in ps}
    segments, cur = [], [ps[0]]
    for a, b in zip(ps, ps[1:]):
        if b - a - 1 > max_fill:
            out |= {p: ("gap", None) for p in range(a + 1, b)}
            segments.append(cur)
            cur = [b]
        else:
            cur.append(b)
    for seg in [*segments, cur]:
        if len(seg) < 2:
            continue
        x, y = np.array([knots[p][0] for p in seg]), np.array([knots[p][1] for p in seg], float)
        d = slopes(x, y)
        for i in range(len(seg) - 1):
            h = x[i + 1] - x[i]
            for p in range(seg[i] + 1, seg[i + 1]):
                s = (p - x[i]) / h
                v = (2 * s**3 - 3 * s**2 + 1) * y[i] + (s**3 - 2 * s**2 + s) * h * d[i] + (3 * s**2 - 2 * s**3) * y[i + 1] + (s**3 - s**2) * h * d[i + 1]
                out[p] = ("interpolated", v)
    return out


@pytest.mark.parametrize("shard", [2, 7, 1000])
def test_against_plain_interpolation(spark, shard):
    rng = random.Random(shard)
    rows, knots = [], {}
    for series, period in ((1, 1_000_000_000), (2, 5_000_000_000), (3, 60_000_000_000)):
        p, start = 0, BASE - BASE % period
        knots[series] = {}
        for _ in range(60):
            p += rng.choice((1, 1, 1, 2, 3, 4, 6, 20))
            v = rng.choice((0, 5, 5, 100, rng.randrange(1000), -1))
            unit = rng.choice((1, 1000, 1_000_000))
            t = (start + p * period + rng.randrange(period)) // unit * unit
            knots[series][p] = (start, period, ((t - start) / period, max(v, 0)))
            row = (len(rows), series, t // unit, v, when(t + 10**9))
            rows += [row] * rng.choice((1, 1, 2))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, READINGS).withColumn("period_ns", F.lit("clash"))
    series = spark.createDataFrame([(1, 1_000_000_000), (2, 5_000_000_000), (3, 60_000_000_000), (4, 0), (5, None), (None, 7), (6, 1000)], "series_id bigint, period_ns bigint")
    got = {(r["series_id"], r["period_start"]): (r["status"], r["value"]) for r in G.regular_grid(df, series, max_fill=5, shard_periods=shard).collect()}
    want = {}
    for s, ks in knots.items():
        start, period, _ = next(iter(ks.values()))
        for p, x in expected({p: k[2] for p, k in ks.items()}, 5).items():
            want[s, start + p * period] = x
    assert got.keys() == want.keys()
    for k, (status, value) in want.items():
        assert got[k][0] == status
        assert (got[k][1] is None) if value is None else abs(got[k][1] - value) < 1e-6 * max(1, abs(value)), k


def test_unusable_readings(spark):
    t = BASE
    rows = [
        (1, 1, t, 7, when(t)), (2, 1, None, 7, when(t)), (3, 1, t + 3 * 10**9, None, when(t + 10**12)), (4, 1, 0, 7, when(t)), (5, 1, -5, 7, when(t)),
        (6, 1, t + 10**12, 7, when(t)), (7, 1, (t + 5 * 10**9) // 1000, -1, when(t + 6 * 10**9)), (8, 9, t, 7, when(t)), (9, None, t, 7, when(t)), (10, 1, t, 7, None),
        (11, 1, 99_999_999_999_999, 7, when(t)),
    ]
    df = spark.createDataFrame(rows, READINGS)
    series = spark.createDataFrame([(1, 10**9), (1, 10**9), (2, 10**9)], "series_id bigint, period_ns bigint")
    grid = G.regular_grid(df, series)
    got = sorted((r["period_start"] - t, r["status"], r["value"]) for r in grid.collect())
    assert got[0] == (0, "observed", 7.0) and got[-1] == (5 * 10**9, "observed", 0.0)
    assert [g[1] for g in got[1:-1]] == ["interpolated"] * 4
    assert G.missing_periods(grid).count() == 4
    assert G.regular_grid(df.limit(0), series).count() == 0
    assert G.regular_grid(df, series.limit(0)).count() == 0


def test_a_long_gap_is_marked_whole(spark):
    t = BASE - BASE % 10**9
    rows = [(1, 1, t, 7, when(t)), (2, 1, t + 25_001 * 10**9, 8, when(t + 25_002 * 10**9))]
    grid = G.regular_grid(spark.createDataFrame(rows, READINGS), spark.createDataFrame([(1, 10**9)], "series_id bigint, period_ns bigint"))
    assert tuple(G.coverage(grid).first()) == (1, 2, 0, 25_000)


def test_readings_count_at_their_own_times(spark):
    """A straight line read at any time within its periods stays that line."""
    t = BASE - BASE % 10**9
    times = [int(x * 10**9) for x in (0.9, 3.1, 4.95, 8.0, 11.5)]
    rows = [(i, 1, t + x, x // 10**6, when(t + x)) for i, x in enumerate(times)]
    grid = G.regular_grid(spark.createDataFrame(rows, READINGS), spark.createDataFrame([(1, 10**9)], "series_id bigint, period_ns bigint"), shard_periods=3)
    got = {(r["period_start"] - t) // 10**9: r["value"] for r in grid.filter("status = 'interpolated'").collect()}
    assert sorted(got) == [1, 2, 5, 6, 7, 9, 10] and all(abs(v - 1000 * p) < 1e-6 for p, v in got.items())


def test_a_long_series_spreads_over_tasks(spark):
    df = spark.range(40_000).select(
        F.col("id").alias("reading_id"), F.lit(1).cast("bigint").alias("series_id"), (F.col("id") * 10**9 + BASE).alias("startTime"), F.lit(5).cast("bigint").alias("length"),
        F.lit(when(2 * BASE)).cast("timestamp_ntz").alias("received_ts"),
    )
    grid = G.regular_grid(df.filter("reading_id % 7 > 0 or reading_id = 0"), spark.createDataFrame([(1, 10**9)], "series_id bigint, period_ns bigint"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = grid.groupBy(F.spark_partition_id().alias("task")).count().collect()
        text = grid._sc._jvm.PythonSQLUtils.explainString(grid._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in tasks) == 40_000 and len(tasks) >= 4 and max(r["count"] for r in tasks) < 30_000
    by_series = re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\(series_id#\d+L?, \d+\)", text)
    assert by_series and all(columns.count("first") == 1 and columns.count("last") == 1 for columns in by_series)  # a row per shard, not per reading
    assert "ReusedExchange" in text and "collect_list" not in text
