"""Analysis of a folder of collected files: statistics, descriptor mappings, a scheduler log, counters and metric dumps.

``analyse`` writes every result as a Parquet table and the table rows as text. The side inputs are small files read
whole; the statistics may be of any size and are cached once, partitioned by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import aggregate as A
from tidegauge.operators import counters as C
from tidegauge.operators import report as R
from tidegauge.operators import timeline as L
from tidegauge.schema import FD_MAP, OP_STATS
from tidegauge.sources import csvfiles, packed

#: Counters that occur once per phase, and those of the second phase only, of which the last line counts.
PHASE_COUNTERS = ["hdfs_read", "hdfs_written", "file_read", "file_written", "spilled"]
LAST_COUNTERS = {"shuffle": "shuffle_read", "map_output": "shuffle_written"}
#: Fixed value: bytes of a spilled record.
RECORD_BYTES = 100
#: Fixed value: parts of ``<jobid>-<host>.<fs>.<mount>.<snapshot>``.
COUNTER_NAME = r"^[0-9]+-(.+)\.(xfs|ext4)\.([^.]+)\.(pre|mid|post)\z"


def load_stats(spark: SparkSession, folder: str, fmt: str = "bb", cache: str | None = None) -> DataFrame:
    """Statistics of all ``fmt`` files in the folder, also within tar archives; kept in and read from ``cache`` if given."""
    if cache:
        known = csvfiles.cached_table(spark, cache, OP_STATS)
        if not known.isEmpty():
            return known
    rows = packed.read_packed(spark, folder, "stats", fmt)
    if not cache:
        return rows
    csvfiles.write_cache(rows, cache)
    return csvfiles.cached_table(spark, cache, OP_STATS)


def log_counters(lines: DataFrame) -> DataFrame:
    """``(phase, metric, value)`` in bytes and seconds, of a scheduler log ``(file, line_no, line)``."""
    values = C.log_values(lines)
    numbers = values.select("name", "line_no", F.col("text").try_cast("bigint").alias("v")).filter("v is not null")
    first = C.first_occurrences(numbers, "name", "line_no", "v")
    unit = F.when(F.col("name") == "spilled", RECORD_BYTES).otherwise(1)
    both = F.array(
        F.struct(F.lit("phase_1").alias("phase"), F.col("phase_1").alias("v")), F.struct(F.lit("phase_2").alias("phase"), F.col("phase_2").alias("v"))
    )
    per_phase = first.filter(F.col("name").isin(PHASE_COUNTERS)).select("name", F.explode(both).alias("x")).select(
        "x.phase", F.col("name").alias("metric"), (F.col("x.v") * unit).alias("value")
    )
    renamed = F.create_map(*[x for k, v in LAST_COUNTERS.items() for x in (F.lit(k), F.lit(v))])
    last = first.filter(F.col("name").isin(list(LAST_COUNTERS))).select(
        F.lit("phase_2").alias("phase"), F.element_at(renamed, F.col("name")).alias("metric"), F.col("last_value").alias("value")
    )
    times = C.log_times(lines)
    spans = times.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(p).alias("phase"), (F.col(f"{p}_end") - F.col(f"{p}_start")).alias("value")) for p in ("phase_1", "phase_2")]
            )
        ).alias("x")
    ).select("x.phase", F.lit("seconds").alias("metric"), "x.value")
    return per_phase.unionByName(last).unionByName(spans).filter("value is not null")


def file_system_counters(lines: DataFrame) -> DataFrame:
    """``(phase, metric, value)`` of the growth of the file systems' counters, per mount and for ``all`` mounts."""
    part = lambda i: F.regexp_extract("file", COUNTER_NAME, i)
    own = lines.filter(F.col("file").rlike(COUNTER_NAME))
    xfs = C.xfs_counters(own.filter(part(2) == "xfs"))
    ext4 = C.ext4_counter(own.filter(part(2) == "ext4")).select("file", F.lit("write_bytes").alias("name"), "value")
    named = xfs.unionByName(ext4).select(
        part(1).alias("host"), F.concat_ws(".", part(2), "name").alias("fs"), part(3).alias("mount"), part(4).alias("snapshot"),
        F.col("value").alias("rd"), F.lit(0).cast("bigint").alias("wr"),
    )
    deltas = C.counter_deltas(named)
    both = F.array(*[F.struct(F.lit(f"phase_{p}").alias("phase"), F.col(f"rd_{p}").alias("v")) for p in (1, 2)])
    return deltas.select("fs", "mount", F.explode(both).alias("x")).select(
        "x.phase", F.concat_ws(".", F.element_at(F.split("fs", r"\."), 1), "mount", F.element_at(F.split("fs", r"\."), 2)).alias("metric"),
        F.col("x.v").alias("value"),
    )


def component_metrics(lines: DataFrame) -> DataFrame:
    """``(component, metric, value)``: each file's and port's last value, summed per component."""
    dumps = lines.withColumn("component", C.metric_component(F.col("file"))).filter("component <> ''")
    values = C.metric_values(dumps).withColumn("component", C.metric_component(F.col("file"))).na.fill("", ["port"])
    port = F.when(F.col("record") == "rpc", F.col("port")).otherwise("")
    totals = C.last_value_totals(values.withColumn("port", port), ["file", "port"], "line_no", "value", ["component", "name"])
    return totals.select("component", F.col("name").alias("metric"), F.col("total").alias("value"))


def with_totals(counters: DataFrame) -> DataFrame:
    """The phases' rows and their sums as phase ``total``; ``gib`` holds byte values in whole GiB."""
    total = counters.groupBy("metric").agg(F.sum("value").alias("value")).select(F.lit("total").alias("phase"), "metric", "value")
    is_bytes = ~F.col("metric").isin("seconds") & ~F.col("metric").rlike(r"\.(reads|writes)\z")
    return counters.unionByName(total).withColumn("gib", F.when(is_bytes, R.gib(F.col("value"))))


def _cell(metric: str, phase: str) -> Column:
    value = F.max(F.when((F.col("metric") == metric) & (F.col("phase") == phase), F.col("gib")))
    return F.coalesce(F.format_number(value, 0), F.lit("--"))


def counter_rows(report: DataFrame) -> DataFrame:
    """``(name, line)``: a table row per kind of counter: read and written in phase 1, phase 2 and in total; what is unknown is ``--``."""
    kinds = {
        "hdfs": (r"\texttt{hdfs://}", "hdfs_read", "hdfs_written"), "file": (r"\texttt{file://}", "file_read", "file_written"),
        "shuffle": ("Shuffle", "shuffle_read", "shuffle_written"), "spill": ("Spill", "spilled", "spilled"),
        "xfs": ("XFS", "xfs.all.read_bytes", "xfs.all.write_bytes"), "ext4": ("ext4", "n/a", "ext4.all.write_bytes"),
    }
    cells = {
        name: F.concat_ws(" & ", F.lit(title), *[_cell(m, p) for p in ("phase_1", "phase_2", "total") for m in (rd, wr)])
        for name, (title, rd, wr) in kinds.items()
    }
    row = report.agg(*[c.alias(n) for n, c in cells.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("line")) for n in cells])).alias("x")).select("x.*")


def layer_rows(series: DataFrame, border: int) -> DataFrame:
    """``(name, line)`` per role and layer: GiB read and written up to the border, after it and in total, and the totals of a layer.

    ``series`` is the aligned running total in bytes; its value at the border is that of the last bin up to it.
    """
    at = lambda c: F.max(F.when((F.col("category") == c) & (F.col("timeBin") <= border), F.col("total")))
    end = lambda c: F.max(F.when(F.col("category") == c, F.col("total")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = L.with_layer_order(series)
    per_role = known.groupBy("key", "source").agg(
        *[zero(f(c)).alias(n) for n, f, c in (("r1", at, "read"), ("w1", at, "write"), ("r", end, "read"), ("w", end, "write"))]
    )
    total = per_role.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("r1", "w1", "r", "w")]).select(F.lit("total").alias("key"), "source", "r1", "w1", "r", "w")
    rows = per_role.unionByName(total).select(
        "key", "source", *[R.gib(c).alias(n) for n, c in (("a", F.col("r1")), ("b", F.col("w1")), ("c", F.col("r") - F.col("r1")), ("d", F.col("w") - F.col("w1")), ("e", F.col("r")), ("f", F.col("w")))]
    )
    cells = [F.format_number(F.col(c), 0) for c in "abcdef"]
    return rows.select(F.concat_ws("-", "key", "source").alias("name"), F.concat_ws(" & ", R.label(F.col("key")), *cells).alias("line"))


def analyse(spark: SparkSession, folder: str, out: str, fmt: str = "bb", hosts: list[str] | None = None, rolling: int = 120) -> dict[str, str]:
    """Analyse the collected files in ``folder``; tables go to ``out/<name>``. Returns their paths by name.

    Missing side inputs give empty tables; without a log there are no phases. ``hosts`` restricts the series to
    these hosts.
    """
    lines = csvfiles.text_lines(spark, f"{folder}/*").cache() if _has_text(spark, folder) else spark.createDataFrame([], "file string, line_no int, line string")
    log = lines.filter(F.col("file").rlike(r"^slurm.*out\z"))
    report = with_totals(log_counters(log).unionByName(file_system_counters(lines)))
    stats = load_stats(spark, folder, fmt, f"{out}/stats_cache")
    if hosts:
        stats = stats.filter(F.col("hostname").isin(hosts))
    maps = packed.read_packed(spark, folder, "fdmap", fmt).select(*FD_MAP.fieldNames())
    numbered = maps.withColumns({"first_seen_ns": F.lit(0), "map_id": F.lit(0)})
    series = L.aligned(L.cumulative(stats), "total")
    writes = A.sum_by(stats.filter("category = 'write' and source = 'jvm'"), ["hostname", "timeBin"], ["data"])
    results = {
        "counters": report, "counter_rows": counter_rows(report), "metrics": component_metrics(lines), "series": L.with_layer_order(series),
        "minutes": L.minutes_axis(stats), "per_node": A.sum_by(stats.filter("category in ('read', 'write')"), ["timeBin", "hostname", "source", "category"]),
        "all_nodes": A.sum_by(stats.filter("category in ('read', 'write')"), ["timeBin", "source", "category"]),
        "write_bandwidth": L.rolling_rate(writes, "hostname", rolling), "files": A.file_totals(stats, numbered),
        "duplicate_descriptors": A.duplicate_keys(maps, FD_MAP.fieldNames()[:4]),
    }
    border = C.phase_border(C.log_times(log)).first()
    if border and border["border_ns"] is not None:
        results["phases"] = R.phase_report(stats, border["border_ns"])
        results["layer_rows"] = layer_rows(series, border["border_ns"])
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    for name in ("counter_rows", "layer_rows"):
        if name in results:
            R.write_rows(spark.read.parquet(f"{out}/{name}"), f"{out}/tex_{name}")
    return {name: f"{out}/{name}" for name in results}


def _has_text(spark: SparkSession, folder: str) -> bool:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return not listed.limit(1).isEmpty()
