"""Splitting over bins: conservation, borders, 32-bit shares."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.binning import split_over_bins
from tidegauge.functions.exprs import floor_to

EVENT = "event_id bigint, start_ns bigint, end_ns bigint, data bigint, is_remote boolean"


def split(spark, rows, d=1000):
    return split_over_bins(spark.createDataFrame(rows, EVENT), d).orderBy("event_id", "timeBin").collect()


def test_tumbling_keeps_the_sign(spark):
    df = spark.createDataFrame([(-7,), (7,), (0,), (-2000,)], "t bigint")
    assert [r[0] for r in df.select(floor_to(F.col("t"), 1000)).collect()] == [0, 0, 0, -2000]


def test_single_and_border(spark):
    rows = [(1, 100, 900, 10, True), (2, 100, 1000, 10, True), (3, 5, 5, None, None), (4, 9, 8, 1, False), (5, None, 8, 1, False), (6, 1, None, 1, False)]
    got = [tuple(r[c] for c in ("event_id", "timeBin", "count", "cpuTime", "data", "remoteCount", "remoteCpuTime", "remoteData")) for r in split(spark, rows)]
    assert got == [
        (1, 0, 1, 800, 10, 1, 800, 10), (2, 0, 1, 900, 10, 0, 900, 10), (2, 1000, 0, 0, 0, 0, 0, 0), (3, 0, 1, 0, 0, 0, 0, 0),
    ]


def test_totals_are_kept_and_shares_are_single_precision(spark):
    rng = random.Random(0)
    rows = []
    for i in range(300):
        s = rng.randrange(10**12, 2 * 10**12)
        rows.append((i, s, s + rng.randrange(0, 20_000), rng.randrange(0, 10**10), rng.random() < 0.5))
    got = split(spark, rows)
    for i, s, e, data, remote in rows:
        own = [r for r in got if r["event_id"] == i]
        assert sum(r["count"] for r in own) == 1 and own[0]["count"] == 1
        assert sum(r["cpuTime"] for r in own) == e - s
        assert sum(r["data"] for r in own) == data
        assert sum(r["remoteData"] for r in own) == (data if remote else 0)
        for r in own[1:]:
            part = min(e, r["timeBin"] + 1000) - r["timeBin"]
            assert r["data"] == int(np.float32(part) / np.float32(e - s) * np.float32(data))


@pytest.mark.parametrize("d", [1, 7, 1000])
def test_bins_are_consecutive(spark, d):
    got = [r["timeBin"] for r in split(spark, [(1, 3, 20, 5, False)], d)]
    assert got == list(range(3 - 3 % d, 21 - 20 % d if d > 1 else 21, d)) or got == [b for b in range(3 - 3 % d, 20 - 20 % d + 1, d)]
