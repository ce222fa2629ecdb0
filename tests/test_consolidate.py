"""Consolidation of small files."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import consolidate as C

HEAD = "hostname,pid,key,count,timeBin,cpuTime,source,category,fileDescriptor,threadId"


def tables(spark, files):
    """``files``: (file_id, name, size, lines)."""
    listing = [(i, n, s, len(ls)) for i, n, s, ls in files]
    lines = [(i, k + 1, x) for i, _, _, ls in files for k, x in enumerate(ls)]
    random.Random(5).shuffle(lines)
    return (
        spark.createDataFrame(listing + listing[:1], "file_id bigint, file_name string, size_bytes bigint, n_lines int").withColumn("target", F.lit("clash")),
        spark.createDataFrame(lines, "file_id bigint, line_no int, line string").withColumn("sort_key", F.lit("clash")),
    )


def row(t, x=""):
    return f"h{x},1,map,1,{t},1,jvm,other,1,1"


FILES = [
    (1, "a.b-c.map.12.100.jvm.other.csv", 200, [HEAD, row(5), row(9), row(9), "", HEAD, row(2)]),
    (2, "77-a.b-c.map.12.100.jvm.other.csv", 100, [HEAD, row(5)]),
    (3, "z.map.-3.100.jvm.other.csv", 200, [HEAD, row(7), "broken"]),
    (4, "z.map.-3.200.jvm.other.csv", 20_000, [HEAD, row(7)]),
    (5, "z.map.-3.300.jvm.other.csv", 20, [HEAD, HEAD, "  "]),
    (6, "run3-jvm-other-final.csv", 20, [HEAD, row(1)]),
    (7, "z.map.1.5.filedescriptormappings.csv", 20, ["hostname,pid,key,fileDescriptor,filename", "z,1,map,8,/x", "z,1,map,3,/y"]),
    (9, "q.map.1.5.sfs.zip.csv", 20, [HEAD, row(1)]),
    (8, "4-q.map.1.5.sfs.zip.csv", 20, [HEAD, row(1)]),
    (10, "q.map.1.6.sfs.zip.csv.tmp", 20, [HEAD, row(1)]),
    (11, "q.map.1.7.sfs.zip.csv", 20, []),
]


@pytest.mark.parametrize("roll", [30, 70, 10**6])
def test_merge(spark, roll):
    merged = C.consolidate(*tables(spark, FILES), roll_bytes=roll, range_bytes=10**6)
    assert sorted(map(tuple, C.taken_in(merged).collect())) == [("filedescriptormappings", 7), ("jvm-other", 1), ("jvm-other", 3), ("sfs-zip", 8)]
    rows = merged.orderBy("target", "out_file", "seq").collect()
    other = [(r["sort_key"], r["file_id"], r["line_no"]) for r in rows if r["target"] == "jvm-other"]
    assert sorted(other) == other == [(0, 3, 3), (2, 1, 7), (5, 1, 2), (7, 3, 2), (9, 1, 3), (9, 1, 4)]
    assert [r["record"] for r in rows if r["target"] == "filedescriptormappings"] == ["z,1,map,3,/y", "z,1,map,8,/x"]
    for m in C.manifest(merged).collect():
        own = [r for r in rows if r["out_file"] == m["out_file"]]
        assert (m["n_records"], m["n_bytes"]) == (len(own), sum(r["n_bytes"] for r in own))
        assert (m["first_key"], m["last_key"]) == (own[0]["sort_key"], own[-1]["sort_key"])
        assert m["n_bytes"] <= roll or m["n_records"] == 1


def test_many_ranges_keep_every_record_once(spark):
    rng = random.Random(9)
    files = [
        (i, f"h{i}.map.1.{i}.jvm.other.csv", 500, [HEAD, *sorted((row(rng.randrange(100, 130), i) for _ in range(20)))]) for i in range(40)
    ]
    listing, lines = tables(spark, files)
    merged = C.consolidate(listing, lines, range_bytes=2000, roll_bytes=1500)
    got = [(r["file_id"], r["line_no"], r["record"]) for r in merged.collect()]
    assert sorted(got) == sorted((i, k + 2, x) for i, _, _, ls in files for k, x in enumerate(ls[1:]))
    ends = sorted((m["first_key"], m["last_key"]) for m in C.manifest(merged).collect())
    assert len(ends) > 5 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_written_files(spark, tmp_path):
    merged = C.consolidate(*tables(spark, FILES), roll_bytes=70)
    listed = C.write_consolidated(merged, str(tmp_path / "out")).collect()
    rows = merged.orderBy("out_file", "seq").collect()
    assert {m["out_file"] for m in listed} == {r["out_file"] for r in rows} and len(listed) > 4
    for m in listed:
        own = [r["record"] for r in rows if r["out_file"] == m["out_file"]]
        with open(m["path"].removeprefix("file:")) as f:
            text = f.read()
        assert text.splitlines() == [m["header"], *own]
        assert m["file_bytes"] == len(text) == m["n_bytes"] + len(m["header"]) + 1
    assert spark.read.text(str(tmp_path / "out")).count() == len(rows) + len(listed)
    assert C.write_consolidated(merged.limit(0), str(tmp_path / "none")).count() == 0


def test_outputs_have_one_header(spark):
    other = HEAD + ",data"
    files = [(i, f"h{i}.map.1.{i}.jvm.other.csv", 500, [HEAD if i % 2 else other, row(i) + ("" if i % 2 else ",1")]) for i in range(20)]
    merged = C.consolidate(*tables(spark, files))
    got = {(m["header"], m["n_records"]) for m in C.manifest(merged).collect()}
    assert got == {(HEAD, 10), (other, 10)}


def test_rolling_over_batches(spark):
    """Many batches of Arrow rows: an output goes on from batch to batch and is as full as it may be."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        files = [(i, f"h{i}.map.1.{i}.jvm.other.csv", 500, [HEAD, *[row(100 + k, i) for k in range(9)]]) for i in range(30)]
        merged = C.consolidate(*tables(spark, files), roll_bytes=1000).orderBy("out_file", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    outputs = {}
    for r in merged:
        outputs.setdefault(r["out_file"], []).append(r)
    assert len(merged) == 270 and [r["seq"] for o in outputs.values() for r in o] == [i for o in outputs.values() for i in range(len(o))]
    sizes = [sum(r["n_bytes"] for r in o) for o in outputs.values()]
    assert all(950 < x <= 1000 for x in sizes[:-1])
    keys = [(r["sort_key"], r["file_id"], r["line_no"]) for r in merged]
    assert keys == sorted(keys)


def test_lines_stored_twice(spark):
    listing, lines = tables(spark, FILES)
    twice = lines.unionByName(lines)
    want = sorted(map(str, C.consolidate(listing, lines).select("file_id", "line_no", "record").collect()))
    assert sorted(map(str, C.consolidate(listing, twice).select("file_id", "line_no", "record").collect())) == want


def test_empty(spark):
    listing, lines = tables(spark, FILES)
    assert C.consolidate(listing.limit(0), lines).count() == 0
    assert C.consolidate(listing, lines.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", ["2", "50"])
def test_few_outputs_with_default_parameters(spark, partitions):
    """6 MB of files in two targets: an output each, whatever the cluster's shuffle partitions."""
    files = [(i, f"h{i}.map.1.{i}.jvm.{'read' if i % 2 else 'other'}.csv", 16_000, [HEAD, row(i), row(i + 5)]) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        outputs = C.manifest(C.consolidate(*tables(spark, files))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((m["target"], m["n_records"], m["n_inputs"]) for m in outputs) == [("jvm-other", 400, 200), ("jvm-read", 400, 200)]
