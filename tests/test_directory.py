"""A folder of collected files, from packed statistics to table rows; concatenation of CSV files."""

import io
import tarfile

from test_counters import LOG
from tidegauge.__main__ import main
from tidegauge.plans.directory import analyse
from tidegauge.sources import packed as P
from tidegauge.sources.csvfiles import concatenate

GIB = 2**30
#: 2024-01-01 10:00:00 UTC
T0 = 1_704_103_200


def stats(t, data, key="map", category="write", source="jvm", host="n1", fd=3):
    return {"hostname": host, "pid": 1, "key": key, "count": 1, "timeBin": (T0 + t) * 10**9, "cpuTime": 5, "source": source, "category": category,
            "fileDescriptor": fd, "threadId": 1, "data": data, "remoteCount": 0, "remoteCpuTime": 0, "remoteData": 0}


def collected(folder):
    folder.mkdir()
    (folder / "slurm-7.out").write_text(LOG.replace("written=500", f"written={3 * GIB}"))
    for snapshot, n in (("pre", 1), ("mid", 3), ("post", 9)):
        for host in ("n-1", "n-2"):
            (folder / f"7-{host}.xfs.local.{snapshot}").write_text(f"extent_alloc 1\nxpc 0 {n * GIB} {2 * n * GIB}\nrw {n} {10 * n}\n")
            (folder / f"7-{host}.ext4.data.{snapshot}").write_text(f"{n * 2**20}\n")
    (folder / "7-n-1-datanode-metrics.out").write_text("x dfs.datanode: BytesWritten=1, BytesRead=2\ny dfs.datanode: BytesWritten=5, BytesRead=6\nz rpc.rpc: port=1, SentBytes=7, ReceivedBytes=8\n")
    rows = [stats(0, 2 * GIB), stats(5, 4 * GIB, category="read"), stats(30, 6 * GIB), stats(30, GIB, "hdfs", "read", fd=4), stats(31, GIB, "map", "read", "sfs"), stats(31, 0, "map", "other")]
    maps = [{"hostname": "n1", "pid": 1, "key": "map", "fileDescriptor": 3, "path": "/data/a"}]
    with tarfile.open(folder / "7-stats.tar", "w") as tar:
        for name, raw in (("n1.map.1.5.jvm.write.bb", P.encode_bb_stats(rows)), ("n1.map.1.5.filedescriptormappings.bb", P.encode_bb_mappings(maps))):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))


def test_analyse(spark, tmp_path):
    collected(tmp_path / "in")
    for _ in range(2):  # the second run reads the cache
        out = analyse(spark, str(tmp_path / "in"), str(tmp_path / "out"), rolling=1)
    read = lambda name: spark.read.parquet(out[name])
    counters = {(r["phase"], r["metric"]): (r["value"], r["gib"]) for r in read("counters").collect()}
    assert counters["phase_1", "hdfs_written"] == (3 * GIB, 3) and counters["phase_2", "hdfs_written"] == (700, 0)
    assert counters["phase_1", "seconds"] == (10, None) and counters["total", "seconds"][0] == 49
    assert counters["phase_1", "xfs.local.write_bytes"] == (4 * GIB, 4) and counters["phase_2", "xfs.all.read_bytes"] == (24 * GIB, 24)
    assert counters["total", "xfs.all.reads"] == (160, None) and counters["phase_2", "ext4.all.write_bytes"] == (12 * GIB, 12)
    assert counters["phase_2", "shuffle_read"][0] == 12
    rows = {r["name"]: r["line"] for r in read("counter_rows").collect()}
    assert rows["xfs"] == "XFS & 8 & 4 & 24 & 12 & 32 & 16" and rows["ext4"] == "ext4 & -- & 4 & -- & 12 & -- & 16"
    assert rows["hdfs"] == r"\texttt{hdfs://} & -- & 3 & -- & 0 & -- & 3" and rows["file"].count("--") == 6
    assert {tuple(r) for r in read("metrics").collect()} == {
        ("datanode", "BytesWritten", 5), ("datanode", "BytesRead", 6), ("datanode", "SentBytes", 7), ("datanode", "ReceivedBytes", 8),
    }
    layers = {r["name"]: r["line"] for r in read("layer_rows").collect()}
    assert layers["map-jvm"] == "Map & 4 & 2 & 0 & 6 & 4 & 8" and layers["hdfs-jvm"] == "HDFS & 0 & 0 & 1 & 0 & 1 & 0"
    assert layers["total-jvm"] == "Total & 4 & 2 & 1 & 6 & 5 & 8" and layers["total-sfs"] == "Total & 0 & 0 & 1 & 0 & 1 & 0"
    phases = {(r["phase"], r["source"], r["metric"]): r["value"] for r in read("phases").collect()}
    assert phases["phase_1", "jvm", "write_calls"] == 1 and phases["phase_2", "jvm", "read_bytes"] == GIB
    assert [tuple(r) for r in read("files").collect()] == [("n1", "/data/a", 3, 12 * GIB)]
    assert sorted(r["mib_per_bin"] for r in read("write_bandwidth").collect()) == [2048.0, 6144.0]
    assert spark.read.text(str(tmp_path / "out" / "tex_counter_rows" / "name=xfs")).first()[0] == rows["xfs"]


def test_analyse_without_side_inputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n1.map.1.5.jvm.write.bb").write_bytes(P.encode_bb_stats([stats(0, 5)]))
    out = analyse(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert "phases" not in out and spark.read.parquet(out["all_nodes"]).count() == 1
    assert spark.read.parquet(out["metrics"]).count() == 0


def test_concatenate(spark, tmp_path, capsys):
    head = "hostname,pid,key,count,timeBin,cpuTime,source,category,fileDescriptor,threadId"
    for name, text in {
        "a.map.1.5.jvm.other.csv": f"{head}\na,1\na,2", "9-b.map.1.5.jvm.other.csv": f"{head}\nb,1\n", "c.map.1.5.jvm.other.csv": "", "d.map.1.5.sfs.zip.csv": f"{head}\n",
        "a.map.1.5.filedescriptormappings.csv": "hostname,pid,key,fileDescriptor,filename\na,1,map,1,/x\n", "run1-jvm-other-final.csv": f"{head}\nold\n",
    }.items():
        (tmp_path / name).write_text(text)
    main(["concat", "--path", str(tmp_path), "--prefix", "run2-", "--suffix=-final", "--delete"])
    assert len(capsys.readouterr().out.split()) == 3
    read = lambda name: [r[0] for r in spark.read.text(str(tmp_path / name)).collect()]
    assert read("run2-jvm-other-final.csv") == [head, "b,1", "a,1", "a,2"]
    assert read("run2-sfs-zip-final.csv") == [head]
    assert read("run2-filedescriptormappings-final.csv")[1:] == ["a,1,map,1,/x"]
    left = sorted(p.name for p in tmp_path.iterdir() if p.is_file())
    assert left == ["run1-jvm-other-final.csv"]
    assert concatenate(spark, str(tmp_path)) == []
