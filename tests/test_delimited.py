"""Parsing rules against a reference parser."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.operators import delimited as D

STATS = "hostname,pid,key,count,timeBin,cpuTime,source,category,fileDescriptor,threadId,data"


def parse(line):
    """Cells, or None for broken quoting: a plain character-by-character reading."""
    cells, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            cell, i = line[i:j], j
            if '"' in cell:
                return None
        cells.append(cell)
        if i >= len(line):
            return cells
        i += 1


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet='ab",\r \ue000\uf8ff', max_size=9), min_size=40, max_size=40))
def test_quoting_and_cells(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = df.select("i", D.quoting_ok(F.col("line")).alias("ok"), D.cells_of(F.col("line")).alias("cells")).collect()
    for r in got:
        want = parse(lines[r["i"]])
        assert r["ok"] == (want is not None), repr(lines[r["i"]])
        if want is not None:
            assert r["cells"] == want, repr(lines[r["i"]])


@pytest.fixture(scope="module")
def lines(spark):
    good = "h,1,map,2,3600,5,jvm,write,7,8,9"
    rows = [
        (1, 1, STATS), (1, 2, good), (1, 3, ""), (1, 4, "  \t"), (1, 5, STATS + "\r"), (1, 6, good + "\r"), (1, 7, None),
        (1, 8, '"h, x",-1,"ma""p",+2,3600,5,JVM,Write,0,-8,009'), (1, 9, "h,1,map"), (1, 10, 'h"x,1,map,2,3600,5,jvm,write,7,8,9'),
        (1, 11, ",x,,-2,9223372036854775808,5,disk,copy,2147483648,1.5,"), (1, 12, "h,1,map,2,3600,5,jvm,write,7,8,٣"),
        (1, 13, "h," + "1" * 100_000 + ",map,2,3600,5,jvm,write,7,8,9"), (1, 14, "h, 1,map,2,3600,5,jvm,write,7,8,9"),
        (2, 1, "hostname,pid,key,fileDescriptor,filename"), (2, 3, "h,1,map,4,/a"), (2, 2, "h,1,map,4,"), (2, 4, "h,1,map,4,\"/a, b\""),
        (3, 2, good), (4, 1, STATS), (None, 2, good), (5, 1, "name,n"), (5, 2, "a,b"), (5, 3, "a"),
    ]
    return spark.createDataFrame(rows, "file_id bigint, line_no int, line string").withColumn("header", F.lit("clash"))


def test_rejected(spark, lines):
    got = {(r["file_id"], r["line_no"]): r["reasons"] for r in D.rejected_rows(D.records(lines), D.agent_rules(lines)).collect()}
    assert got == {
        (1, 9): "wrong column count", (1, 10): "broken quoting",
        (1, 11): "category: unknown value; count: negative value; data: not a whole number; fileDescriptor: out of range; hostname: empty value; "
        "key: empty value; pid: not a whole number; source: unknown value; threadId: not a whole number; timeBin: out of range",
        (1, 12): "data: not a whole number", (1, 13): "pid: out of range", (1, 14): "pid: not a whole number", (2, 2): "filename: empty value",
        (5, 3): "wrong column count",
    }


def test_accepted(spark, lines):
    types = [("hostname", "string"), ("key", "string"), ("count", "bigint"), ("data", "bigint"), ("filename", "string")]
    got = {(r["file_id"], r["line_no"]): tuple(r)[2:] for r in D.accepted_rows(D.records(lines), D.agent_rules(lines), types).collect()}
    assert got == {
        (1, 2): ("h", "map", 2, 9, None), (1, 6): ("h", "map", 2, 9, None), (1, 8): ("h, x", 'ma"p', 2, 9, None), (2, 3): ("h", "map", None, None, "/a"),
        (2, 4): ("h", "map", None, None, "/a, b"), (5, 2): (None, None, None, None, None),
    }


def test_empty(spark, lines):
    none = lines.limit(0)
    assert D.rejected_rows(D.records(none), D.agent_rules(none)).count() == 0
    assert D.accepted_rows(D.records(none), D.agent_rules(none), [("pid", "int")]).count() == 0


def test_private_use_characters_and_long_quoted_values_stay(spark):
    x, long = "\ue000\U000f0000", '""' * 200_000
    rows = [(1, 1, "hostname,pid,key,filename"), (1, 2, f'"a{x}b",1,k{x}z,"/x,{x}y"'), (1, 3, f'h,1,k,"{long},"'), (1, 4, f'h,1,k,"{long}')]
    df = spark.createDataFrame(rows, "file_id bigint, line_no int, line string")
    types = [("hostname", "string"), ("key", "string"), ("filename", "string")]
    got = {r["line_no"]: tuple(r)[2:] for r in D.accepted_rows(D.records(df), D.agent_rules(df), types).collect()}
    assert got == {2: (f"a{x}b", f"k{x}z", f"/x,{x}y"), 3: ("h", "k", '"' * 200_000 + ",")}
    assert [r["reasons"] for r in D.rejected_rows(D.records(df), D.agent_rules(df)).collect()] == ["broken quoting"]


def test_lines_stored_twice_count_once(spark, lines):
    twice = lines.unionByName(lines)
    want = sorted(map(tuple, D.rejected_rows(D.records(lines), D.agent_rules(lines)).collect()))
    assert sorted(map(tuple, D.rejected_rows(D.records(twice), D.agent_rules(lines)).collect())) == want
    accepted = lambda df: sorted(map(str, D.accepted_rows(D.records(df), D.agent_rules(df), [("pid", "int")]).collect()))
    assert accepted(twice) == accepted(lines)


def test_a_long_file_is_cut_into_chunks(spark):
    rows = [(1, 1, "hostname,pid"), *((1, i, f"h,{i if i % 9 else 'x'}") for i in range(2, 200)), (2, 1, "hostname"), (2, 70_000, "")]
    df = spark.createDataFrame(rows, "file_id bigint, line_no int, line string")
    got = D.rejected_rows(D.records(df, chunk_lines=7), D.agent_rules(df)).collect()
    assert sorted(r["line_no"] for r in got if r["file_id"] == 1) == [i for i in range(2, 200) if i % 9 == 0]
    assert D.records(df, chunk_lines=7).count() == 198
