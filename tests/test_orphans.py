"""Orphan references against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import orphans as O

REFS = "ref_table string, ref_id bigint, k string, n int, at bigint, until bigint"
PARENTS = "k string, n int, valid_from bigint, valid_to bigint"


def brute(refs, parents):
    out = []
    for table, i, k, n, at, until in refs:
        own = [(s, e) for pk, pn, s, e in parents if k is not None and n is not None and (pk, pn) == (k, n)]
        if at is not None and until is not None and any(s <= until and e > at for s, e in own):
            continue
        begun = at is not None and until is not None and any(s <= until for s, _ in own)
        out.append((table, i, at, "absent" if not own else "removed" if begun else "later"))
    return sorted(out, key=str)


def found(spark, refs, parents, **kw):
    r = spark.createDataFrame(refs, REFS)
    p = spark.createDataFrame(parents, PARENTS)
    keyed = O.parents(p, {"k": F.col("k"), "n": F.col("n")}, F.col("valid_from"), F.col("valid_to"))
    return sorted(map(tuple, O.orphans(r, keyed, ["k", "n"], **kw).collect()), key=str)


@pytest.mark.parametrize(("task_rows", "buckets"), [(10**6, 1 << 20), (120, 1 << 20), (20, 1 << 20), (2, 1 << 20), (5, 2)])
def test_against_brute_force(spark, task_rows, buckets):
    rng = random.Random(3)
    keys = [("a", 1)] * 5 + [("a", 2), ("b", 1), ("c", 3), (None, 1), ("d", None)]
    parents, refs = [], []
    for _ in range(60):
        k, n = rng.choice(keys)
        s = rng.randrange(-50, 200)
        parents.append((k, n, s, None if rng.random() < 0.1 else s + rng.randrange(-2, 30)))
    parents += parents[:10]
    for i in range(400):
        k, n = rng.choice(keys + [("e", 9)])
        at = None if rng.random() < 0.05 else rng.randrange(-60, 230)
        refs.append((rng.choice("xy"), i, k, n, at, None if at is None else at + rng.choice((0, 0, 9))))
    refs += refs[:20]
    ends = [(k, n, s, 2**63 - 1 if e is None else e) for k, n, s, e in parents if e is None or s < e]
    assert found(spark, refs, parents, shard_ns=20, task_rows=task_rows, buckets=buckets) == brute(refs, ends)


def test_empty_sides(spark):
    refs = [("x", 1, "a", 1, 5, 5), ("x", 1, "a", 1, 5, 5), ("x", 2, None, None, None, None)]
    assert found(spark, refs, []) == [("x", 1, 5, "absent"), ("x", 1, 5, "absent"), ("x", 2, None, "absent")]
    assert found(spark, [], [("a", 1, 0, 9)]) == []


def test_bounds_are_half_open(spark):
    refs = [("x", 1, "a", 1, 10, 10), ("x", 2, "a", 1, 19, 19), ("x", 3, "a", 1, 20, 20), ("x", 4, "a", 1, 9, 9), ("x", 5, "a", 1, 0, 10)]
    assert [r[1] for r in found(spark, refs, [("a", 1, 10, 20)])] == [3, 4]


def test_descriptors(spark):
    io = spark.createDataFrame(
        [(1, " Host-A.rack:80 ", 7, "map", 5, 100), (2, "host-a", 7, "map", 0, 100), (3, "host-a", 7, "map", None, 100), (4, "host-a", -7, "map", 5, 100)],
        "event_id bigint, hostname string, pid int, key string, fd int, start_ns bigint",
    ).withColumn("ref_id", F.lit("clash"))
    stats = spark.createDataFrame(
        [(9, "HOST-A", 7, "map", 5, -3600), (8, "host-a", 7, "map", 5, 120)], "stat_id bigint, hostname string, pid int, key string, fileDescriptor int, timeBin bigint"
    ).withColumn("at", F.lit("clash"))
    fd = spark.createDataFrame(
        [("host-a", 7, "map", 5, 90, 110), ("host-a", 7, "map", 5, 90, 110)],
        "hostname string, pid int, key string, fileDescriptor int, first_seen_ns bigint, removed_ns bigint",
    )
    got = O.descriptor_orphans(io, stats, fd, bin_ns=3600)
    assert sorted(map(tuple, O.distinct_orphans(got).collect())) == [("io_event", 4), ("op_stats", 8), ("op_stats", 9)]
    counts = {(r["ref_table"], r["period"], r["reason"]): r["n_orphans"] for r in O.orphan_counts(got, 3600).collect()}
    assert counts == {("io_event", 0, "absent"): 1, ("op_stats", -3600, "later"): 1, ("op_stats", 0, "removed"): 1}


def test_a_hot_hour_of_one_key_is_spread(spark):
    """Half of all references have one key, one hour and even one time; a key of 0.4 % is swept by one task."""
    rows = spark.range(20_000).select(
        F.lit("x").alias("ref_table"), F.col("id").alias("ref_id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 250 == 1, "warm").otherwise(F.col("id").cast("string")).alias("k"),
        F.lit(100).cast("bigint").alias("at"), F.lit(130).cast("bigint").alias("until"),
    )
    known = spark.createDataFrame([("hot", 0, 50), ("hot", 110, 120), ("warm", 131, 200), ("hot", 125, 126)], "k string, valid_from bigint, valid_to bigint")
    found = O.orphans(rows, known, ["k"], shard_ns=60, task_rows=500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        tasks = [r["count"] for r in O.orphans(rows, known.limit(0), ["k"], shard_ns=60, task_rows=500).groupBy(F.spark_partition_id()).count().collect()]
        reasons = {r["reason"]: r["count"] for r in found.groupBy("reason").count().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert reasons == {"absent": 9920, "later": 80}
    assert sum(tasks) == 20_000
    known = spark.createDataFrame([("hot", 0, 50), ("hot", 30, 121), ("hot", 131, 400)], "k string, valid_from bigint, valid_to bigint")
    assert {r["reason"]: r["count"] for r in O.orphans(rows.filter("k = 'hot'"), known, ["k"], shard_ns=60, task_rows=500).groupBy("reason").count().collect()} == {}


def test_inputs_are_read_twice(spark, sf_dir):
    """Without hot keys: once to count, once for the sweep."""
    io, stats, fd = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("io_event", "op_stats", "fd_map"))
    text = O.descriptor_orphans(io, stats, fd)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 3 and text.count("Exchange hashpartitioning") == 1


def test_cuts_of_a_hot_hour_do_not_see_its_later_parents(spark):
    """A reference before the only parent of its hour is an orphan in every cut of that hour."""
    refs = [("x", i, "a", 1, 10, 10) for i in range(40)]
    assert found(spark, refs, [("a", 1, 30, 50)], shard_ns=60, task_rows=8) == brute(refs, [("a", 1, 30, 50)])
