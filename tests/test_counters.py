"""Text side inputs."""

from pyspark.sql import functions as F

from tidegauge.operators import counters as C
from tidegauge.operators import report as R
from tidegauge.operators import timeline as L
from tidegauge.sources.csvfiles import text_lines

LOG = """Using engine: flink
Mon Jan  1 10:00:00 UTC 2024: Generating TeraSort data on HDFS
\t\tHDFS: Number of bytes written=500
Mon Jan  1 10:00:10 UTC 2024: Generating TeraSort data on HDFS done
Mon Jan  1 10:00:21 UTC 2024: Running TeraSort
HDFS: Number of bytes written=700
Reduce shuffle bytes=11
Reduce shuffle bytes=12
Mon Jan  1 10:01:00 UTC 2024: Running TeraSort done: 0
"""


def test_log(spark, tmp_path):
    (tmp_path / "slurm1.out").write_text(LOG)
    lines = text_lines(spark, str(tmp_path))
    values = C.log_values(lines)
    got = {(r["name"], r["line_no"]): r["text"] for r in values.collect()}
    assert got["engine", 1] == "flink" and got["hdfs_written", 3] == "500" and got["hdfs_written", 6] == "700"
    times = C.log_times(lines)
    t = times.first()
    assert (t["phase_1_end"] - t["phase_1_start"], t["phase_2_start"] - t["phase_1_end"], t["phase_2_end"] - t["phase_2_start"]) == (10, 11, 39)
    assert C.phase_border(times).first()["border_ns"] == (t["phase_1_end"] + 6) * 10**9  # 5.5 rounds to the even second
    numbers = values.filter("name in ('hdfs_written', 'shuffle')").select("name", "line_no", F.col("text").cast("bigint").alias("v"))
    got = {r["name"]: tuple(r)[1:] for r in C.first_occurrences(numbers, "name", "line_no", "v").collect()}
    assert got == {"hdfs_written": (500, 700, 700), "shuffle": (11, 12, 12)}
    assert sorted(r["nth"] for r in C.running_rank(numbers, "name", "line_no").collect()) == [1, 1, 2, 2]


def test_counters(spark):
    lines = spark.createDataFrame([("f", 1, "xpc 1 20 30"), ("f", 2, "rw 4 5"), ("f", 3, "abt 1 2"), ("f", 4, "xpc x"), ("f", 5, None)], "file string, line_no int, line string")
    got = sorted((r["name"], r["value"]) for r in C.xfs_counters(lines).filter("value is not null").collect())
    assert got == [("read_bytes", 30), ("reads", 5), ("write_bytes", 20), ("writes", 4)]
    ext = spark.createDataFrame([("e", 1, " 12 "), ("e", 2, "99"), ("g", 1, "x")], "file string, line_no int, line string")
    assert sorted(map(tuple, C.ext4_counter(ext).collect()), key=str) == [("e", 12288), ("g", None)]


def test_metrics(spark):
    text = "1 rpc.rpc: port=8020, Context=rpc, ReceivedBytes=10, SentBytes=20"
    lines = spark.createDataFrame(
        [("f", 1, text), ("f", 2, text.replace("10", "15")), ("f", 3, "2 dfs.datanode: Context=dfs, BytesWritten=7, BytesRead=8, RemoteBytesRead=1"), ("f", 4, "jvm x=1")],
        "file string, line_no int, line string",
    )
    v = C.metric_values(lines)
    got = {(r["record"], r["name"], r["line_no"]): r["value"] for r in v.collect()}
    assert got["rpc", "ReceivedBytes", 2] == 15 and got["datanode", "BytesRead", 3] == 8 and len(got) == 7
    last = C.last_value_totals(v.fillna("", ["port"]), ["file", "port"], "line_no", "value", ["record", "name"])
    assert {tuple(r) for r in last.collect()} >= {("rpc", "ReceivedBytes", 15), ("datanode", "BytesWritten", 7)}
    names = spark.createDataFrame([("12-node-3-yarn-metrics.out",), ("x",)], "n string")
    assert [r[0] for r in names.select(C.metric_component(F.col("n"))).collect()] == ["yarn", ""]


def test_series(spark):
    df = spark.createDataFrame([("a", "jvm", "read", 10, 1), ("a", "jvm", "read", 30, 2), ("b", "jvm", "read", 20, 5)], "key string, source string, category string, timeBin bigint, data bigint")
    al = L.aligned(L.cumulative(df), "total")
    got = sorted((r["key"], r["timeBin"], r["total"]) for r in al.collect())
    assert got == [("a", 10, 1), ("a", 20, 1), ("a", 30, 3), ("b", 10, 0), ("b", 20, 5), ("b", 30, 5)]
    at = {r["key"]: (r["at_border"], r["at_end"]) for r in L.value_at(al, "total", 1).collect()}
    assert at == {"a": (1, 3), "b": (5, 5)}
    rate = L.rolling_rate(df.groupBy("key", "timeBin").agg(F.sum("data").alias("data")), "key", 2)
    assert sorted(((r["key"], r["timeBin"], r["mib_per_bin"]) for r in rate.collect())) == [("a", 10, None), ("a", 30, 3 / (2 * 1048576.0)), ("b", 20, None)]


def test_labels_and_rounding(spark):
    df = spark.createDataFrame([("yarn", 3 * 2**29), ("hdfs", 2**29), ("map", 0)], "k string, v bigint")
    got = [tuple(r) for r in df.select(R.label(F.col("k")), R.gib(F.col("v"))).collect()]
    assert got == [("YARN", 2), ("HDFS", 0), ("Map", 0)]
