"""Queries of the telemetry operators over the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.exprs import HOUR_NS, canonical_host, floor_to
from tidegauge.functions.shared import shared_path
from tidegauge.operators import aggregate as A
from tidegauge.operators import binning as B
from tidegauge.operators import counters as C
from tidegauge.operators import ingest as I
from tidegauge.operators import report as R
from tidegauge.operators import timeline as L
from tidegauge.schema import MEASURES, OP_STATS
from tidegauge.sources import csvfiles
from tidegauge.sources.tables import table

#: A bin start within the test data, so that the strict comparison on both sides matters.
BORDER = 1_741_392_000_000_000_000
#: Row position of the border in the aligned series, and bins of the rolling mean.
BORDER_ROW, ROLLING = 100, 120
#: Hosts of the allow-list.
HOSTS = ["nd-k11", "nd-k67", "qv-m54", "cx-r76", "sfsgw-t64", "spread-k85", "jvmbox-m88", "lumen-k77", "brother-t23", "rewrite-t12", "zipgate-k89"]


def _events(s: SparkSession, d: str) -> DataFrame:
    return I.clean_events(table(s, d, "io_event"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    return I.clean_stats(table(s, d, "op_stats"))


def _split(s: SparkSession, d: str) -> DataFrame:
    return B.split_over_bins(_events(s, d))


def _fd_map(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fd_map").withColumn("hostname", canonical_host(F.col("hostname")))


def bin_tumbling(s, d):
    t = _events(s, d)
    return t.groupBy("category", floor_to(F.col("start_ns"), HOUR_NS).alias("time_bin")).agg(F.count(F.lit(1)).alias("n"))


def split_count(s, d):
    return A.sum_by(_split(s, d), ["category", "timeBin"], ["count"])


def split_duration(s, d):
    return A.sum_by(_split(s, d), ["category", "timeBin"], ["cpuTime"])


def split_data(s, d):
    return A.sum_by(_split(s, d), ["category", "timeBin"], ["data"])


def split_remote(s, d):
    return A.sum_by(_split(s, d), ["category", "timeBin"], ["remoteCount", "remoteCpuTime", "remoteData"])


def skip_categories(s, d):
    kept = I.skip_categories(_events(s, d), {"sfs": "o", "jvm": "oz"})
    return kept.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("data", F.lit(0))).alias("data"))


def locality_flag(s, d):
    local = I.is_local(F.col("hostname"), F.col("datanode_hostname"))
    return _events(s, d).groupBy("source", local.alias("is_local")).agg(F.count(F.lit(1)).alias("n"))


def scheme_rewrite(s, d):
    paths = table(s, d, "fd_map").filter("path is not null").select("path").distinct()
    outer = F.concat(F.lit("sfs://nn1:8020"), "path")
    inner = I.rewrite_scheme(outer, "sfs", "hdfs")
    return paths.select("path", inner.alias("inner_uri"), I.rewrite_scheme(inner, "hdfs", "sfs").alias("outer_uri"))


def fd_dictionary(s, d):
    ids = I.descriptor_ids(_fd_map(s, d), ["hostname", "pid", "key"], "path", "first_seen_ns")
    return ids.select("hostname", "pid", "key", "path", "descriptor")


def _handles(s, d):
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("handle"), "event_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("delta"))


def zip_refcount(s, d):
    return I.counted_opens(_handles(s, d))


def _layers(stats):
    return A.sum_by(stats, ["timeBin", "key", "source", "category"])


def filter_hosts(s, d):
    return _layers(_stats(s, d).filter(F.col("hostname").isin(HOSTS)))


def filter_hosts_semi(s, d):
    allowed = s.createDataFrame([(h,) for h in HOSTS], "hostname string")
    return _layers(_stats(s, d).join(F.broadcast(allowed), "hostname", "left_semi"))


def layer_order(s, d):
    rows = L.with_layer_order(_stats(s, d))
    return A.sum_by(rows, ["ord", "key", "source", "category"], ["count", "data"]).orderBy("ord", "key", "source")


def minutes_axis(s, d):
    return L.minutes_axis(table(s, d, "op_stats"))


def gib_rounding(s, d):
    t = A.sum_by(_stats(s, d), ["key"], ["data"])
    return t.select("key", R.gib(F.col("data")).alias("gib"), R.scaled(F.col("data"), L.MIB).alias("mib"))


def pretty_labels(s, d):
    return table(s, d, "op_stats").select("key", R.label(F.col("key")).alias("label")).distinct()


def agg_live(s, d):
    return A.sum_by(_split(s, d), A.LIVE_KEY)


def agg_partial_merge(s, d):
    return A.partial_merge(_split(s, d), A.LIVE_KEY)


def agg_reaggregate(s, d):
    return A.sum_by(_stats(s, d), A.STATS_KEY)


def agg_key_layer(s, d):
    return _layers(_stats(s, d))


def per_node_rw(s, d):
    rows = _stats(s, d).filter(F.col("category").isin("read", "write"))
    return A.sum_by(rows, ["timeBin", "hostname", "source", "category"])


def all_nodes_rw(s, d):
    return A.sum_by(_stats(s, d).filter(F.col("category").isin("read", "write")), ["timeBin", "source", "category"])


def phase_split(s, d):
    return A.phase_totals(_stats(s, d), BORDER)


def avg_bytes_per_op(s, d):
    t = A.sum_by(_stats(s, d), ["source", "category"], ["count", "data"])
    return t.select("source", "category", A.rounded_ratio(F.col("data"), F.col("count")).alias("bytes_per_op"))


def _snapshots(s, d):
    o = table(s, d, "orders")
    return o.select(
        F.when(F.col("o_orderkey") % 5 == 0, "ext4").otherwise("xfs").alias("fs"), F.col("o_orderpriority").alias("mount"),
        F.element_at(F.array(F.lit("pre"), F.lit("mid"), F.lit("post")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("snapshot"),
        (F.col("o_custkey") % 8).alias("host"), F.floor("o_totalprice").alias("rd"), F.floor(F.col("o_totalprice") / 2.0).alias("wr"),
    )


def fs_counter_delta(s, d):
    return C.counter_deltas(_snapshots(s, d))


def metrics_last_value(s, d):
    o = table(s, d, "orders")
    lines = o.select(
        (F.col("o_custkey") % 50).alias("file"), (F.col("o_custkey") % 50 % 3).alias("component"), (F.col("o_orderkey") % 4).alias("port"),
        F.col("o_orderkey").alias("line_no"), F.floor("o_totalprice").alias("v"),
    )
    return C.last_value_totals(lines, ["file", "port"], "line_no", "v", ["component"])


def nth_occurrence(s, d):
    lines = table(s, d, "events").select(F.col("event_type").alias("counter"), F.col("event_id").alias("line_no"), F.floor("value").alias("v"))
    return C.first_occurrences(lines, "counter", "line_no", "v")


def bytes_per_fd(s, d):
    return A.sum_by(_stats(s, d), ["hostname", "pid", "key", "fileDescriptor"], ["count", "data"])


def file_report(s, d):
    return A.file_totals(_stats(s, d), _fd_map(s, d)).orderBy("hostname", F.desc("data"))


def file_report_na(s, d):
    return A.file_totals(_stats(s, d), _fd_map(s, d), keep_unknown=True)


def cumulative_io(s, d):
    return L.cumulative(_stats(s, d))


def _aligned(s, d):
    return L.aligned(L.cumulative(_stats(s, d)), "total")


def align_timeline(s, d):
    return _aligned(s, d)


def host_write_bw(s, d):
    rows = _stats(s, d).filter("category = 'write' and source = 'jvm'")
    return L.rolling_rate(A.sum_by(rows, ["hostname", "timeBin"], ["data"]), "hostname", ROLLING)


def phase_cumulative_at(s, d):
    return L.value_at(_aligned(s, d), "total", BORDER_ROW)


def stacked_bounds(s, d):
    return L.stacked(_aligned(s, d), "total", "jvm").select("timeBin", "key", "category", "ord", "lower_bound", "upper_bound")


def bandwidth_ratio(s, d):
    t = A.sum_by(_stats(s, d), ["timeBin", "hostname", "category"], ["cpuTime", "data"])
    ratio = F.when(F.col("cpuTime") != 0, F.col("data") / (F.col("cpuTime") * 1048.576))
    return t.select("timeBin", "hostname", "category", ratio.alias("bandwidth"))


def fdmap_duplicates(s, d):
    return A.duplicate_keys(_fd_map(s, d), ["hostname", "pid", "key", "fileDescriptor"])


def union_parts(s, d):
    t = table(s, d, "op_stats")
    parts = None
    for source in ("jvm", "sfs"):
        for category in ("read", "write", "other", "zip"):
            part = t.filter((F.col("source") == source) & (F.col("category") == category))
            parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("count").alias("count"))


def scan_csv_roundtrip(s, d):
    path = f"{shared_path(s)}/csv-{uuid.uuid4().hex}"
    csvfiles.write_stats(_stats(s, d).select(*OP_STATS.fieldNames()), path)
    return A.sum_by(csvfiles.read_stats(s, path), ["hostname", "source", "category"])


def scan_dropna_fillna(s, d):
    return csvfiles.complete_rows(table(s, d, "op_stats").drop("stat_id", "written_ts"))


def filename_parse(s, d):
    names = table(s, d, "stat_file").select("file_name").distinct()
    return csvfiles.parsed_names(names)


def latex_rows(s, d):
    t = A.phase_totals(_stats(s, d).filter("category in ('read', 'write')"), BORDER, ["key", "source"])
    name = F.concat_ws("-", R.label(F.col("key")), "source")
    return R.table_rows(t, name, ["count_1", "data_1", "count_2", "data_2"])


def report_phase(s, d):
    return R.phase_report(_stats(s, d), BORDER)


QUERIES = {
    f.__name__: f
    for f in (
        bin_tumbling, split_count, split_duration, split_data, split_remote, skip_categories, locality_flag, scheme_rewrite, fd_dictionary,
        zip_refcount, filter_hosts, filter_hosts_semi, layer_order, minutes_axis, gib_rounding, pretty_labels, agg_live, agg_partial_merge,
        agg_reaggregate, agg_key_layer, per_node_rw, all_nodes_rw, phase_split, avg_bytes_per_op, fs_counter_delta, metrics_last_value,
        nth_occurrence, bytes_per_fd, file_report, file_report_na, align_timeline, cumulative_io, host_write_bw, phase_cumulative_at,
        stacked_bounds, bandwidth_ratio, fdmap_duplicates, union_parts, scan_csv_roundtrip, scan_dropna_fillna, filename_parse, latex_rows,
        report_phase,
    )
}


def _host(c: str) -> str:
    return f"split_part(split_part(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13))), ':', 1), '.', 1)"


_EV = f"""ev AS (SELECT event_id, {_host('hostname')} AS hostname, pid, key, source, category, coalesce(fd, 0) AS fd, thread_id, start_ns, end_ns,
  coalesce(data, 0) AS data, coalesce(is_remote, false) AS rem, datanode_hostname FROM io_event
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrived_ts, hostname) = 1)"""
_SPLIT = (
    f"WITH {_EV}, "
    + """p AS (SELECT *, unnest(range(start_ns - start_ns % 3600000000000, end_ns - end_ns % 3600000000000 + 1, 3600000000000)) AS tb FROM ev),
q AS (SELECT *, least(end_ns, tb + 3600000000000) - greatest(start_ns, tb) AS cpu, tb = start_ns - start_ns % 3600000000000 AS is_first,
  end_ns - end_ns % 3600000000000 = start_ns - start_ns % 3600000000000 AS one FROM p),
r AS (SELECT *, CASE WHEN is_first THEN 0 ELSE CAST(trunc(cpu::FLOAT / (end_ns - start_ns)::FLOAT * data::FLOAT) AS BIGINT) END AS later FROM q),
sp AS (SELECT event_id, source, category, thread_id, fd, tb AS "timeBin", CAST(is_first AS BIGINT) AS "count", cpu AS "cpuTime",
  CASE WHEN is_first THEN data - CAST(sum(later) OVER (PARTITION BY event_id) AS BIGINT) ELSE later END AS data, rem, one FROM r)
"""
)
_ST = f"""st AS (SELECT stat_id, {_host('hostname')} AS hostname, pid, key, coalesce(count, 0) AS "count", "timeBin", coalesce("cpuTime", 0) AS "cpuTime",
  source, category, coalesce("fileDescriptor", 0) AS "fileDescriptor", "threadId", coalesce(data, 0) AS data, coalesce("remoteCount", 0) AS "remoteCount",
  coalesce("remoteCpuTime", 0) AS "remoteCpuTime", coalesce("remoteData", 0) AS "remoteData" FROM op_stats
  QUALIFY row_number() OVER (PARTITION BY stat_id ORDER BY written_ts, hostname) = 1)"""
_FM = f"fm AS (SELECT * REPLACE ({_host('hostname')} AS hostname) FROM fd_map)"


def _sum(*names: str) -> str:
    return ", ".join(f'CAST(sum("{n}") AS BIGINT) AS "{n}"' for n in names)


_ALL = _sum(*MEASURES)
_W = f"WITH {_ST} "
_HOSTS = ", ".join(f"'{h}'" for h in HOSTS)
_BY_LAYER = f'SELECT "timeBin", key, source, category, {_ALL} FROM st WHERE hostname IN ({_HOSTS}) GROUP BY ALL'
_LABEL = "CASE key WHEN 'yarn' THEN 'YARN' WHEN 'hdfs' THEN 'HDFS' ELSE upper(key[1]) || key[2:] END"
_ORD = ", ".join(f"('{k}', '{s}', '{c}', {o})" for k, s, c, o in L.LAYER_ORDER)
_LIVE = _SPLIT + f""", m AS (SELECT *, CASE WHEN rem AND one THEN 1 ELSE 0 END AS "remoteCount", CASE WHEN rem THEN "cpuTime" ELSE 0 END AS "remoteCpuTime",
  CASE WHEN rem THEN data ELSE 0 END AS "remoteData" FROM sp)
SELECT source, category, thread_id, "timeBin", fd, {_ALL} FROM m GROUP BY ALL"""
_PHASES = f"""CAST(coalesce(sum("count") FILTER ("timeBin" < {BORDER}), 0) AS BIGINT) AS count_1, CAST(coalesce(sum(data) FILTER ("timeBin" < {BORDER}), 0) AS BIGINT) AS data_1,
  CAST(coalesce(sum("count") FILTER ("timeBin" > {BORDER}), 0) AS BIGINT) AS count_2, CAST(coalesce(sum(data) FILTER ("timeBin" > {BORDER}), 0) AS BIGINT) AS data_2"""
_RATIO = lambda a, b: f"CASE WHEN {b} <> 0 THEN CAST(round_even(CAST({a} AS DOUBLE) / {b}, 0) AS BIGINT) ELSE 0 END"
_CUM = f"""{_W}, pb AS (SELECT key, source, category, "timeBin", CAST(sum(data) AS BIGINT) AS data FROM st GROUP BY ALL),
cu AS (SELECT *, CAST(sum(data) OVER (PARTITION BY key, source, category ORDER BY "timeBin") AS BIGINT) AS total FROM pb)"""
_ALIGN = _CUM + """, ax AS (SELECT * FROM (SELECT DISTINCT key, source, category FROM cu) g, (SELECT DISTINCT "timeBin" FROM cu) b),
al AS (SELECT ax.key, ax.source, ax.category, ax."timeBin", coalesce(last_value(cu.total IGNORE NULLS) OVER
  (PARTITION BY ax.key, ax.source, ax.category ORDER BY ax."timeBin" ROWS UNBOUNDED PRECEDING), 0) AS total
  FROM ax LEFT JOIN cu ON cu.key = ax.key AND cu.source = ax.source AND cu.category = ax.category AND cu."timeBin" = ax."timeBin")"""
_FILES = f"""WITH {_ST}, {_FM}, la AS (SELECT hostname, pid, key, "fileDescriptor", path FROM fm
  QUALIFY row_number() OVER (PARTITION BY hostname, pid, key, "fileDescriptor" ORDER BY first_seen_ns DESC, map_id DESC) = 1),
j AS (SELECT st.hostname, st."count", st.data, la.path FROM st LEFT JOIN la ON la.hostname = st.hostname AND la.pid = st.pid AND la.key = st.key
  AND la."fileDescriptor" = st."fileDescriptor" WHERE st.source = 'jvm' AND st.category <> 'other')"""
_NAME = csvfiles.NAME.replace(r"\z", "$")
_HANDLES = """WITH h AS (SELECT user_id AS handle, event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS delta FROM events),
z AS (SELECT *, sum(delta) OVER (PARTITION BY handle ORDER BY event_id) AS n FROM h) SELECT handle, event_id FROM z WHERE delta = 1 AND n = 1"""

ORACLE_SQL = {
    "bin_tumbling": f"WITH {_EV} SELECT category, start_ns - start_ns % 3600000000000 AS time_bin, count(*) AS n FROM ev GROUP BY ALL",
    "split_count": _SPLIT + f'SELECT category, "timeBin", {_sum("count")} FROM sp GROUP BY ALL',
    "split_duration": _SPLIT + f'SELECT category, "timeBin", {_sum("cpuTime")} FROM sp GROUP BY ALL',
    "split_data": _SPLIT + f'SELECT category, "timeBin", {_sum("data")} FROM sp GROUP BY ALL',
    "split_remote": _SPLIT
    + """SELECT category, "timeBin", CAST(sum(CASE WHEN rem AND one THEN 1 ELSE 0 END) AS BIGINT) AS "remoteCount",
         CAST(sum(CASE WHEN rem THEN "cpuTime" ELSE 0 END) AS BIGINT) AS "remoteCpuTime", CAST(sum(CASE WHEN rem THEN data ELSE 0 END) AS BIGINT) AS "remoteData"
         FROM sp GROUP BY ALL""",
    "skip_categories": f"""WITH {_EV} SELECT source, category, count(*) AS n, CAST(sum(data) AS BIGINT) AS data FROM ev
        WHERE NOT ((source = 'sfs' AND category = 'other') OR (source = 'jvm' AND category IN ('other', 'zip'))) GROUP BY ALL""",
    "locality_flag": f"""WITH {_EV} SELECT source, {_host('datanode_hostname')} = hostname OR {_host('datanode_hostname')} = 'localhost' AS is_local,
        count(*) AS n FROM ev GROUP BY ALL""",
    "scheme_rewrite": "SELECT DISTINCT path, 'hdfs://nn1:8020' || path AS inner_uri, 'sfs://nn1:8020' || path AS outer_uri FROM fd_map WHERE path IS NOT NULL",
    "fd_dictionary": f"""WITH {_FM}, f AS (SELECT hostname, pid, key, path, min(first_seen_ns) AS t FROM fm WHERE path IS NOT NULL GROUP BY ALL)
        SELECT hostname, pid, key, path, CAST(dense_rank() OVER (PARTITION BY hostname, pid, key ORDER BY t, path) AS INTEGER) AS descriptor FROM f""",
    "zip_refcount": _HANDLES,
    "filter_hosts": _W + _BY_LAYER,
    "filter_hosts_semi": _W + _BY_LAYER,
    "layer_order": _W + f"""SELECT ord, key, source, category, {_sum("count", "data")} FROM st JOIN (VALUES {_ORD}) o(key, source, category, ord)
        USING (key, source, category) GROUP BY ALL""",
    "minutes_axis": 'SELECT DISTINCT "timeBin", ("timeBin" - (SELECT min("timeBin") FROM op_stats)) / 6.0e10::DOUBLE AS minutes FROM op_stats',
    "gib_rounding": _W + """SELECT key, CAST(round_even(CAST(sum(data) AS DOUBLE) / 1073741824.0::DOUBLE, 0) AS BIGINT) AS gib,
        CAST(round_even(CAST(sum(data) AS DOUBLE) / 1048576.0::DOUBLE, 0) AS BIGINT) AS mib FROM st GROUP BY key""",
    "pretty_labels": f"SELECT DISTINCT key, {_LABEL} AS label FROM op_stats",
    "agg_live": _LIVE,
    "agg_partial_merge": _LIVE,
    "agg_reaggregate": _W + f'SELECT hostname, pid, key, "timeBin", source, category, "fileDescriptor", "threadId", {_ALL} FROM st GROUP BY ALL',
    "agg_key_layer": _W + f'SELECT "timeBin", key, source, category, {_ALL} FROM st GROUP BY ALL',
    "per_node_rw": _W + f"""SELECT "timeBin", hostname, source, category, {_ALL} FROM st WHERE category IN ('read', 'write') GROUP BY ALL""",
    "all_nodes_rw": _W + f"""SELECT "timeBin", source, category, {_ALL} FROM st WHERE category IN ('read', 'write') GROUP BY ALL""",
    "phase_split": _W + f"SELECT source, category, {_PHASES} FROM st GROUP BY source, category",
    "avg_bytes_per_op": _W + f"""SELECT source, category, {_RATIO('sum(data)', 'sum("count")')} AS bytes_per_op FROM st GROUP BY source, category""",
    "fs_counter_delta": """WITH o AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'ext4' ELSE 'xfs' END AS fs, o_orderpriority AS mount, o_orderkey % 3 AS n,
        CAST(floor(o_totalprice) AS BIGINT) AS rd, CAST(floor(o_totalprice / 2.0) AS BIGINT) AS wr FROM orders)
        SELECT fs, CASE WHEN grouping(mount) = 1 THEN 'all' ELSE mount END AS mount,
        CAST(sum(CASE n WHEN 1 THEN rd WHEN 0 THEN -rd ELSE 0 END) AS BIGINT) AS rd_1, CAST(sum(CASE n WHEN 2 THEN rd WHEN 1 THEN -rd ELSE 0 END) AS BIGINT) AS rd_2,
        CAST(sum(CASE n WHEN 1 THEN wr WHEN 0 THEN -wr ELSE 0 END) AS BIGINT) AS wr_1, CAST(sum(CASE n WHEN 2 THEN wr WHEN 1 THEN -wr ELSE 0 END) AS BIGINT) AS wr_2
        FROM o GROUP BY GROUPING SETS ((fs, mount), (fs))""",
    "metrics_last_value": """WITH o AS (SELECT o_custkey % 50 AS file, o_custkey % 50 % 3 AS component, o_orderkey % 4 AS port, o_orderkey AS line_no,
        CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders), l AS (SELECT component, file, port, arg_max(v, line_no) AS v FROM o GROUP BY ALL)
        SELECT component, CAST(sum(v) AS BIGINT) AS total FROM l GROUP BY component""",
    "nth_occurrence": """WITH e AS (SELECT event_type AS counter, event_id AS line_no, CAST(floor(value) AS BIGINT) AS v,
        row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events)
        SELECT counter, max(v) FILTER (nth = 1) AS phase_1, max(v) FILTER (nth = 2) AS phase_2, arg_max(v, line_no) AS last_value FROM e GROUP BY counter""",
    "bytes_per_fd": _W + f'SELECT hostname, pid, key, "fileDescriptor", {_sum("count", "data")} FROM st GROUP BY ALL',
    "file_report": _FILES + f"SELECT hostname, path, {_sum('count', 'data')} FROM j WHERE path IS NOT NULL GROUP BY ALL",
    "file_report_na": _FILES + f"SELECT hostname, coalesce(path, 'n/a') AS path, {_sum('count', 'data')} FROM j GROUP BY ALL",
    "align_timeline": _ALIGN + ' SELECT key, source, category, "timeBin", total FROM al',
    "cumulative_io": _CUM + ' SELECT key, source, category, "timeBin", data, total, total / 1073741824.0::DOUBLE AS gib FROM cu',
    "host_write_bw": _W + f""", pb AS (SELECT hostname, "timeBin", CAST(sum(data) AS BIGINT) AS data FROM st WHERE category = 'write' AND source = 'jvm' GROUP BY ALL)
        SELECT *, CASE WHEN count(*) OVER w >= {ROLLING} THEN CAST(sum(data) OVER w AS BIGINT) / ({ROLLING} * 1048576.0::DOUBLE) END AS mib_per_bin FROM pb
        WINDOW w AS (PARTITION BY hostname ORDER BY "timeBin" ROWS {ROLLING - 1} PRECEDING)""",
    "phase_cumulative_at": _ALIGN + f""", nu AS (SELECT *, row_number() OVER (PARTITION BY key, source, category ORDER BY "timeBin") - 1 AS i FROM al)
        SELECT key, source, category, max(total) FILTER (i = {BORDER_ROW}) AS at_border, arg_max(total, "timeBin") AS at_end FROM nu GROUP BY ALL""",
    "stacked_bounds": _ALIGN + f""", lo AS (SELECT al.*, o.ord FROM al JOIN (VALUES {_ORD}) o(key, source, category, ord) USING (key, source, category)
        WHERE al.source = 'jvm'), b AS (SELECT *, CAST(sum(total) OVER (PARTITION BY "timeBin" ORDER BY ord, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upper_bound FROM lo)
        SELECT "timeBin", key, category, ord, upper_bound - total AS lower_bound, upper_bound FROM b""",
    "bandwidth_ratio": _W + """SELECT "timeBin", hostname, category, CASE WHEN sum("cpuTime") <> 0 THEN CAST(sum(data) AS DOUBLE) / (CAST(sum("cpuTime") AS DOUBLE) * 1048.576::DOUBLE) END
        AS bandwidth FROM st GROUP BY ALL""",
    "fdmap_duplicates": f'WITH {_FM} SELECT hostname, pid, key, "fileDescriptor", count(*) AS n_rows FROM fm GROUP BY ALL HAVING count(*) > 1',
    "union_parts": 'SELECT source, category, count(*) AS n_rows, CAST(sum("count") AS BIGINT) AS "count" FROM op_stats GROUP BY source, category',
    "scan_csv_roundtrip": _W + f"SELECT hostname, source, category, {_ALL} FROM st GROUP BY ALL",
    "scan_dropna_fillna": """SELECT hostname, pid, key, "count", "timeBin", "cpuTime", source, category, "fileDescriptor", "threadId", coalesce(data, 0) AS data,
        coalesce("remoteCount", 0) AS "remoteCount", coalesce("remoteCpuTime", 0) AS "remoteCpuTime", coalesce("remoteData", 0) AS "remoteData" FROM op_stats
        WHERE hostname IS NOT NULL AND pid IS NOT NULL AND key IS NOT NULL AND "count" IS NOT NULL AND "timeBin" IS NOT NULL AND "cpuTime" IS NOT NULL
        AND source IS NOT NULL AND category IS NOT NULL AND "fileDescriptor" IS NOT NULL AND "threadId" IS NOT NULL""",
    "filename_parse": f"""WITH n AS (SELECT DISTINCT file_name FROM stat_file WHERE regexp_matches(file_name, '{_NAME}')),
        p AS (SELECT file_name, regexp_extract(file_name, '{_NAME}', ['j', 'h', 'k', 'p', 's', 'o', 'c', 'f']) AS m FROM n)
        SELECT file_name, CAST(nullif(m.j, '') AS BIGINT) AS job_id, m.h AS hostname, m.k AS key, CAST(m.p AS INTEGER) AS pid, CAST(m.s AS BIGINT) AS start_ms,
        nullif(m.o, '') AS source, nullif(m.c, '') AS category, m.f AS format FROM p""",
    "latex_rows": _W + f""", t AS (SELECT {_LABEL} || '-' || source AS name, {_PHASES} FROM st WHERE category IN ('read', 'write') GROUP BY key, source)
        SELECT name, name || format(' & {{:,}} & {{:,}} & {{:,}} & {{:,}}', count_1, data_1, count_2, data_2) AS line FROM t""",
    "report_phase": _W + f""", t AS (SELECT source, category, {_PHASES} FROM st WHERE category IN ('read', 'write') GROUP BY source, category)
        SELECT 'phase_1' AS phase, source, category || '_calls' AS metric, count_1 AS value FROM t UNION ALL SELECT 'phase_2', source, category || '_calls', count_2 FROM t
        UNION ALL SELECT 'phase_1', source, category || '_bytes', data_1 FROM t UNION ALL SELECT 'phase_2', source, category || '_bytes', data_2 FROM t
        UNION ALL SELECT 'phase_1', source, category || '_bytes_per_call', {_RATIO('data_1', 'count_1')} FROM t
        UNION ALL SELECT 'phase_2', source, category || '_bytes_per_call', {_RATIO('data_2', 'count_2')} FROM t""",
}
