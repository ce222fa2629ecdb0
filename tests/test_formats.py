"""Binary codecs, the packed source, CSV files and the Parquet cache."""

import io
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.schema import FD_MAP, OP_STATS
from tidegauge.sources import csvfiles as K
from tidegauge.sources import packed as P

ASCII = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126), min_size=1, max_size=254)
I32, I64, U63 = st.integers(-(2**31), 2**31 - 1), st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**63 - 1)


@st.composite
def stats_rows(draw):
    category = draw(st.sampled_from(["read", "write", "other", "zip"]))
    row = {"hostname": draw(ASCII), "pid": draw(I32), "key": draw(ASCII), "count": draw(I64), "timeBin": draw(I64), "cpuTime": draw(I64),
           "source": draw(st.sampled_from(["jvm", "sfs"])), "category": category, "fileDescriptor": draw(I32), "threadId": draw(I64)}
    for name in ("data", "remoteCount", "remoteCpuTime", "remoteData"):
        kept = category in ("read", "zip") or (category == "write" and name == "data")
        row[name] = draw(I64) if kept else 0
    return row


MAPPING = st.fixed_dictionaries({"hostname": ASCII, "pid": I32, "key": ASCII, "fileDescriptor": I32, "path": st.text(alphabet="ab/, \"'", max_size=300)})


@pytest.mark.parametrize("fmt", ["bb", "fb"])
@settings(max_examples=60, deadline=None)
@given(rows=st.lists(stats_rows(), max_size=6), cut=st.integers(1, 40))
def test_stats_round_trip_and_cut_tail(fmt, rows, cut):
    want = [tuple(r[n] for n in OP_STATS.fieldNames()) for r in rows]
    raw = P.ENCODERS[fmt, "stats"](rows)
    assert list(P.DECODERS[fmt, "stats"](raw)) == want
    got = list(P.DECODERS[fmt, "stats"](raw[: max(0, len(raw) - cut)]))
    assert got == want[: len(got)]
    assert not rows or len(got) < len(rows) or fmt == "fb"


@pytest.mark.parametrize("fmt", ["bb", "fb"])
@settings(max_examples=60, deadline=None)
@given(rows=st.lists(MAPPING, max_size=6), cut=st.integers(1, 40))
def test_mappings_round_trip_and_cut_tail(fmt, rows, cut):
    want = [tuple(r[n] for n in FD_MAP.fieldNames()) for r in rows]
    raw = P.ENCODERS[fmt, "fdmap"](rows)
    assert list(P.DECODERS[fmt, "fdmap"](raw)) == want
    got = list(P.DECODERS[fmt, "fdmap"](raw[: max(0, len(raw) - cut)]))
    assert got == want[: len(got)]


@pytest.mark.parametrize("length", [1, 127, 128, 254])
def test_long_names(length):
    row = {"hostname": "h" * length, "pid": -1, "key": "k", "count": 1, "timeBin": 0, "cpuTime": 0, "source": "jvm", "category": "other", "fileDescriptor": 0, "threadId": 128}
    assert next(P.decode_bb_stats(P.encode_bb_stats([row])))[0] == "h" * length
    with pytest.raises(ValueError):
        P.encode_bb_stats([row | {"hostname": "h" * 255}])


def test_bb_bytes():
    """Fixed bytes of one record, worked out by hand from the format."""
    row = {"hostname": "ab", "pid": 1, "key": "c", "count": 300, "timeBin": 5, "cpuTime": 0, "source": "sfs", "category": "write", "fileDescriptor": -1, "threadId": 0, "data": 70000}
    header = 1 << 28 | 4 << 25 | 5 << 22 | 4 << 16
    want = (
        (1).to_bytes(8, "little") + header.to_bytes(4, "little") + bytes([6 << 4]) + bytes([(2 - 127) & 255]) + b"ab" + b"\x01" + bytes([(1 - 127) & 255]) + b"c"
        + (5).to_bytes(8, "little") + (300).to_bytes(2, "little") + b"\x01\x01" + b"\xff" + (70000).to_bytes(4, "little")
    )
    assert P.encode_bb_stats([row]) == want


@pytest.mark.parametrize("fmt", ["bb", "fb"])
def test_source_and_binary_scan(spark, sf_dir, tmp_path, fmt):
    P.register(spark)
    stats = spark.read.parquet(f"{sf_dir}/op_stats.parquet").na.drop(subset=["fileDescriptor"]).na.fill(0).select(*OP_STATS.fieldNames())
    maps = spark.read.parquet(f"{sf_dir}/fd_map.parquet").filter("path is not null").select(*FD_MAP.fieldNames())
    for record, df in (("stats", stats), ("fdmap", maps)):
        for _ in range(2):  # the second write replaces the first
            df.repartition(3).write.format("packed").mode("overwrite").option("path", str(tmp_path)).option("format", fmt).option("record", record).save()
        want = sorted(map(str, df.collect()))
        back = spark.read.format("packed").option("path", str(tmp_path)).option("format", fmt).option("record", record).load()
        assert sorted(map(str, back.collect())) == want
        assert sorted(map(str, P.read_packed(spark, str(tmp_path), record, fmt).collect())) == want
    some = spark.read.format("packed").option("path", str(tmp_path)).option("format", fmt).load().filter("source = 'sfs' and category = 'zip'")
    assert some.count() == stats.filter("source = 'sfs' and category = 'zip'").count()


def test_tar(spark, tmp_path):
    row = {"hostname": "h", "pid": 1, "key": "k", "count": 1, "timeBin": 0, "cpuTime": 0, "source": "jvm", "category": "other", "fileDescriptor": 0, "threadId": 1}
    with tarfile.open(tmp_path / "all.tar", "w") as tar:
        for name, raw in (("a.k.1.5.jvm.other.bb", P.encode_bb_stats([row, row])), ("a.k.1.5.filedescriptormappings.bb", P.encode_bb_mappings([])), ("notes.txt", b"x"), ("b.jvm.other.bb", b"\x05")):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    (tmp_path / "cut.tar").write_bytes((tmp_path / "all.tar").read_bytes()[:700])
    assert P.read_packed(spark, str(tmp_path)).count() == 4  # the cut archive still has its first file
    assert P.read_packed(spark, str(tmp_path), "fdmap").count() == 0


def test_csv(spark, tmp_path):
    maps = spark.createDataFrame([("h", -1, "map", 5, '/a, "b"'), ("h", 2, "map", 6, "/c")], FD_MAP)
    K.write_mappings(maps, str(tmp_path / "m"))
    assert sorted(map(tuple, K.read_mappings(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, maps.collect()))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.csv").write_text("hostname,pid,key,count,timeBin,cpuTime,source,category,fileDescriptor,threadId,data\nh,1,map,1,2,3,jvm,write,4,5,6\nh,1,map\nh,x,map,1,2,3,jvm,write,4,5,6\nh,1,map,1,2,3,jvm,write,4,5,\n")
    from pyspark.sql import types as T

    got = K.read_permissive(spark, str(tmp_path / "s"), T.StructType(OP_STATS.fields[:11])).collect()
    assert sorted(r["data"] for r in got) == [0, 6]


def test_cache(spark, tmp_path):
    assert K.cached_table(spark, str(tmp_path / "none"), FD_MAP).count() == 0
    maps = spark.createDataFrame([("h", 1, "map", 5, "/a"), ("i", 2, "map", 6, "/c")], FD_MAP)
    K.write_cache(maps, str(tmp_path / "c"))
    cached = K.cached_table(spark, str(tmp_path / "c"), FD_MAP)
    assert cached.filter("hostname = 'h'").select("path").first()[0] == "/a"
