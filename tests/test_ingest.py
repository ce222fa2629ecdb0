"""Ingestion rules."""

from pyspark.sql import functions as F

from tidegauge.operators import ingest as I


def test_calls(spark):
    rows = [
        (1, "stream", "open", None, None, 3, None), (2, "stream", "read", -1, None, 3, None), (3, "stream", "read", 65, None, 3, None),
        (4, "stream", "readBytes", -1, 100, 3, None), (5, "stream", "readBytes", 60, 100, 3, None), (6, "stream", "write", None, None, 3, None),
        (7, "stream", "writeBytes", None, 9, 3, None), (8, "random", "readFully", None, 12, 3, None), (9, "random", "writeChars", None, 5, 3, None),
        (10, "channel", "readBytes", 20, None, 3, 4), (11, "channel", "transferFrom", 30, None, 3, 4), (12, "buffer", "get:long", None, 2, 3, None),
        (13, "buffer", "put:char", None, None, 3, None), (14, "fs", "mkdirs", None, None, 0, None), (15, "fs", "exists", None, None, 0, None),
        (16, "fs", "seek", None, None, 5, None), (17, "stream", None, 5, 5, 5, None), (18, "random", "readLine", 11, None, 3, None),
        (19, "buffer", "get:int", None, None, 0, None),
    ]
    df = spark.createDataFrame(rows, "call_id int, kind string, method string, result bigint, size bigint, fd int, other_fd int")
    got = [(r["call_id"], r["fd"], r["category"], r["data"]) for r in I.call_rows(df).orderBy("call_id", "fd").collect()]
    assert got == [
        (1, 3, "other", 0), (2, 3, "read", 0), (3, 3, "read", 1), (4, 3, "read", 0), (5, 3, "read", 60), (6, 3, "write", 1), (7, 3, "write", 9),
        (8, 3, "read", 12), (9, 3, "write", 10), (10, 3, "read", 20), (10, 4, "write", 20), (11, 3, "write", 30), (11, 4, "read", 30),
        (12, 3, "read", 16), (13, 3, "write", 2), (14, 0, "other", 0), (16, 5, "other", 0), (18, 3, "read", 11),
    ]
    assert {r["call_id"] for r in I.call_rows(df, trace_mapped=False).collect()} == {g[0] for g in got} - {12, 13}


def test_small_rules(spark):
    df = spark.createDataFrame([(" A.b:1", "a", "sfs://h:1/p#f"), ("a", "localhost:9", "x"), ("a", None, None)], "h string, d string, u string")
    got = df.select(I.is_local(F.col("h"), F.col("d")).alias("l"), I.rewrite_scheme(F.col("u"), "sfs", "hdfs").alias("u")).collect()
    assert [tuple(r) for r in got] == [(True, "hdfs://h:1/p#f"), (True, "x"), (None, None)]
    ev = spark.createDataFrame([(1, "jvm", "zip", 5, "out/x"), (2, "jvm", "read", 9, "stdin"), (3, "sfs", "zip", 12, "/d"), (4, "jvm", None, 12, None)],
                               "event_id int, source string, category string, start_ns bigint, path string")
    assert [r[0] for r in I.skip_categories(ev, {"jvm": "rz"}).collect()] == [3, 4]
    assert [r[0] for r in I.discard_own_files(ev, "path", "out/").collect()] == [3, 4]
    assert [r[0] for r in I.while_running(ev, 6, 11).collect()] == [2]
    assert spark.range(1).select(I.to_epoch(F.lit(500), F.lit(7), F.lit(100)).alias("t")).first()[0] == 7_000_400


def test_once_and_dictionary(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, None), (None, "z", 1)], "id int, v string, o int")
    assert sorted(map(tuple, I.once(df, "id", ["o", "v"]).collect())) == [(1, "a", 1), (2, None, None)]
    seen = spark.createDataFrame([("p", "/b", 5), ("p", "/a", 5), ("p", "/b", 1), ("q", "/z", 9), ("q", None, 1)], "proc string, path string, at bigint")
    got = sorted((r["proc"], r["path"], r["descriptor"]) for r in I.descriptor_ids(seen, ["proc"], "path", "at").collect())
    assert got == [("p", "/a", 2), ("p", "/b", 1), ("q", "/z", 1)]


def test_running_sum_across_shards(spark):
    rows = [("a" if i % 3 else "b", i, 1 if i % 2 else -1) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, v int").repartition(7)
    got = {(r["k"], r["i"]): r["s"] for r in I.running_sum(df, ["k"], "i", "v", "s", shard=16).collect()}
    total = {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + v
        assert got[k, i] == total[k]
