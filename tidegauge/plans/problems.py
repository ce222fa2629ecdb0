"""Queries of the general data problems 1 to 5, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.exprs import canonical_host
from tidegauge.operators import consolidate as C
from tidegauge.operators import delimited as D
from tidegauge.operators import orphans as O
from tidegauge.operators import regular_grid as G
from tidegauge.operators import skew as S
from tidegauge.sources.tables import table

#: Shares of all rows from which a key counts as heavy.
HEAVY_FD, HEAVY_HOST = 0.02, 0.03

#: Columns of the loaded statistics rows and mappings.
STAT_TYPES = [
    ("hostname", "string"), ("pid", "int"), ("key", "string"), ("count", "bigint"), ("timeBin", "bigint"), ("cpuTime", "bigint"),
    ("source", "string"), ("category", "string"), ("fileDescriptor", "int"), ("threadId", "bigint"), ("data", "bigint"),
    ("remoteCount", "bigint"), ("remoteCpuTime", "bigint"), ("remoteData", "bigint"), ("filename", "string"),
]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.descriptor_orphans(table(spark, d, "io_event"), table(spark, d, "op_stats"), table(spark, d, "fd_map"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return O.distinct_orphans(_orphans(spark, d))


def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_counts(_orphans(spark, d))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return C.consolidate(table(spark, d, "stat_file"), table(spark, d, "raw_line"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return C.taken_in(_merged(spark, d))


def p2_target_totals(spark: SparkSession, d: str) -> DataFrame:
    return C.manifest(_merged(spark, d)).groupBy("target").agg(
        F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), F.min("first_key").alias("first_key"),
        F.max("last_key").alias("last_key"),
    )


def p2_manifest(spark: SparkSession, d: str) -> DataFrame:
    return C.manifest(_merged(spark, d))


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "raw_line")
    return D.records(lines), D.agent_rules(lines)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return D.rejected_rows(*_records(spark, d)).select("file_id", "line_no")


def p3_rejected(spark: SparkSession, d: str) -> DataFrame:
    return D.rejected_rows(*_records(spark, d))


def p3_accepted(spark: SparkSession, d: str) -> DataFrame:
    return D.accepted_rows(*_records(spark, d), STAT_TYPES)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return G.regular_grid(table(spark, d, "op_reading"), table(spark, d, "op_series"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return G.missing_periods(_grid(spark, d))


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    rounded = F.round("value", 3)
    return _grid(spark, d).withColumn("value", F.when(rounded == 0, 0.0).otherwise(rounded))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    return G.coverage(_grid(spark, d))


def _key_totals(spark: SparkSession, d: str) -> DataFrame:
    io = table(spark, d, "io_event")
    return S.key_totals(
        io,
        {"fd": F.col("fd"), "hostname": canonical_host(F.col("hostname"))},
        {"n_bytes": F.coalesce("data", F.lit(0)), "busy_ns": F.col("end_ns") - F.col("start_ns")},
        {"n_events": "event_id"},
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    least = F.when(F.col("field") == "fd", HEAVY_FD).otherwise(HEAVY_HOST)
    return _key_totals(spark, d).filter(F.col("share") >= least).select("field", "val")


def p5_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return _key_totals(spark, d).select("field", "val", "n_rows", "n_events", "n_bytes", "busy_ns")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_orphan_counts, p2_found, p2_target_totals, p2_manifest, p3_found, p3_rejected, p3_accepted, p4_found, p4_grid,
        p4_coverage, p5_found, p5_key_totals,
    )
}


def _host(c: str) -> str:
    return f"split_part(split_part(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13))), ':', 1), '.', 1)"


_P1 = f"""
WITH fm AS (SELECT DISTINCT {_host('hostname')} AS h, pid AS p, key AS k, fileDescriptor AS f, first_seen_ns AS s,
                   coalesce(removed_ns, 9223372036854775807) AS e FROM fd_map),
r AS (SELECT 'io_event' AS ref_table, event_id AS ref_id, {_host('hostname')} AS h, pid AS p, key AS k, fd AS f, start_ns AS a,
             start_ns AS b FROM io_event WHERE fd IS NOT NULL AND fd <> 0
      UNION ALL
      SELECT 'op_stats', stat_id, {_host('hostname')}, pid, key, fileDescriptor, timeBin, timeBin + 3599999999999
      FROM op_stats WHERE fileDescriptor IS NOT NULL AND fileDescriptor <> 0),
o AS (SELECT r.ref_table, r.ref_id, r.a, bool_or(fm.s IS NOT NULL) AS known, bool_or(fm.s <= r.b) AS begun,
             bool_or(fm.s < fm.e AND fm.s <= r.b AND fm.e > r.a) AS in_use
      FROM r LEFT JOIN fm ON fm.h = r.h AND fm.p = r.p AND fm.k = r.k AND fm.f = r.f GROUP BY ALL)
"""

_P2 = r"""
WITH s AS (SELECT DISTINCT file_id, file_name, size_bytes, n_lines,
    regexp_extract(file_name, '^(?:[0-9]+-)?(.+\.[^.]+\.-?[0-9]+\.[0-9]+\.(jvm|sfs)\.(read|write|other|zip)\.csv)$', ['b', 's', 'c']) AS m,
    regexp_extract(file_name, '^(?:[0-9]+-)?(.+\.[^.]+\.-?[0-9]+\.[0-9]+\.filedescriptormappings\.csv)$', 1) AS fm FROM stat_file),
n AS (SELECT file_id, size_bytes, n_lines, CASE WHEN m.b <> '' THEN m.b ELSE fm END AS base,
    CASE WHEN m.b <> '' THEN m.s || '-' || m.c ELSE 'filedescriptormappings' END AS target FROM s WHERE m.b <> '' OR fm <> ''),
best AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY n_lines DESC, file_id) AS rn FROM n),
l AS (SELECT DISTINCT file_id, line_no, regexp_replace(line, '\r$', '') AS line FROM raw_line),
hd AS (SELECT file_id, line AS header FROM l WHERE line_no = 1),
rec AS (SELECT b.target, l.file_id, l.line_no, l.line, hd.header FROM l JOIN hd USING (file_id) JOIN best b USING (file_id)
    WHERE b.rn = 1 AND b.size_bytes < 16384 AND l.line_no > 1 AND trim(l.line, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND l.line <> hd.header)
"""

_P2_KEYS = r""", cells AS (SELECT target, header, file_id, strlen(line) + 1 AS n, coalesce(TRY_CAST(trim(list_extract(
    regexp_extract_all(',' || CASE WHEN regexp_full_match(line, '(?s:("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*)') THEN line ELSE '' END,
    '(?s:,("(?:[^"]|"")*"|[^",]*))', 1),
    list_position(string_split(header, ','), CASE WHEN target = 'filedescriptormappings' THEN 'fileDescriptor' ELSE 'timeBin' END)), '"') AS BIGINT), 0) AS k FROM rec)
"""

_P3 = r"""
WITH l AS (SELECT DISTINCT file_id, line_no, regexp_replace(line, '\r$', '') AS line FROM raw_line),
hd AS (SELECT file_id, string_split(line, ',') AS names, line AS header FROM l WHERE line_no = 1),
rec AS (SELECT l.file_id, l.line_no, l.line, hd.names FROM l JOIN hd USING (file_id)
    WHERE l.line_no > 1 AND trim(l.line, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND l.line <> hd.header),
q AS (SELECT *, regexp_full_match(line, '(?s:("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*)') AS sound FROM rec),
c AS (SELECT *, CASE WHEN sound THEN regexp_extract_all(',' || line, '(?s:,("(?:[^"]|"")*"|[^",]*))', 1) ELSE NULL END AS cells FROM q),
x AS (SELECT file_id, line_no, unnest(names) AS name, unnest(cells) AS raw FROM c WHERE sound AND len(cells) = len(names)),
v AS (SELECT file_id, line_no, name,
    CASE WHEN raw LIKE '"%' THEN replace(substr(raw, 2, length(raw) - 2), '""', '"') ELSE raw END AS val FROM x),
e AS (SELECT file_id, line_no, name,
    CASE WHEN name IN ('hostname', 'key', 'filename') THEN CASE WHEN val = '' THEN 'empty value' END
         WHEN name = 'source' THEN CASE WHEN lower(val) NOT IN ('jvm', 'sfs') THEN 'unknown value' END
         WHEN name = 'category' THEN CASE WHEN lower(val) NOT IN ('read', 'write', 'other', 'zip') THEN 'unknown value' END
         WHEN name IN ('pid', 'count', 'timeBin', 'cpuTime', 'fileDescriptor', 'threadId', 'data', 'remoteCount', 'remoteCpuTime', 'remoteData') THEN
           CASE WHEN NOT regexp_full_match(val, '[+-]?[0-9]+') THEN 'not a whole number'
                WHEN name IN ('pid', 'fileDescriptor') AND TRY_CAST(val AS INTEGER) IS NULL THEN 'out of range'
                WHEN TRY_CAST(val AS BIGINT) IS NULL THEN 'out of range'
                WHEN name IN ('count', 'cpuTime', 'data', 'remoteCount', 'remoteCpuTime', 'remoteData') AND TRY_CAST(val AS BIGINT) < 0 THEN 'negative value' END
    END AS reason FROM v),
bad AS (SELECT file_id, line_no, name || ': ' || reason AS why FROM e WHERE reason IS NOT NULL
    UNION ALL SELECT file_id, line_no, CASE WHEN NOT sound THEN 'broken quoting' ELSE 'wrong column count' END
    FROM c WHERE NOT sound OR len(cells) <> len(names))
"""



def _typed(name: str, kind: str) -> str:
    raw = f"list_extract(cells, list_position(names, '{name}'))"
    bare = f"CASE WHEN {raw} LIKE '\"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END"
    return bare if kind == "string" else f"TRY_CAST({bare} AS {kind.upper()})"


_P4 = """
WITH r AS (SELECT series_id, reading_id, CASE WHEN length = -1 THEN 0 ELSE length END AS v, epoch_us(received_ts) * 1000 AS rx,
    CASE WHEN startTime < 100000000000000 THEN TRY(CAST(startTime AS HUGEINT) * 1000000)
         WHEN startTime < 100000000000000000 THEN CAST(startTime AS HUGEINT) * 1000 ELSE startTime END AS t
    FROM op_reading WHERE startTime > 0 AND length IS NOT NULL),
u AS (SELECT DISTINCT r.series_id, s.period_ns AS p, CAST(t - t % s.period_ns AS BIGINT) AS period_start
    FROM r JOIN op_series s USING (series_id) WHERE t <= rx),
b AS (SELECT series_id, p, min(period_start) AS lo, max(period_start) AS hi FROM u GROUP BY ALL),
g AS (SELECT series_id, p, unnest(range(lo, hi + p, p)) AS period_start FROM b),
m AS (SELECT g.series_id, g.period_start FROM g ANTI JOIN u ON u.series_id = g.series_id AND u.period_start = g.period_start)
"""

_H0, _H1, _H2 = (f"(CAST(t{i + 1} - t{i} AS DOUBLE) / p)" for i in range(3))
_END = lambda h0, h1, m0, m1: (  # noqa: E731  slope at the end of a segment
    f"(SELECT CASE WHEN sign(d) <> sign({m0}) THEN 0.0 WHEN sign({m0}) <> sign({m1}) AND abs(d) > abs({m0}) * 3 THEN {m0} * 3 ELSE d END "
    f"FROM (SELECT (({h0} * 2 + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1}) AS d))"
)
_MID = lambda h0, h1, m0, m1: (
    f"CASE WHEN {m0} * {m1} <= 0 THEN 0.0 ELSE ({h1} * 2 + {h0} + ({h1} + {h0} * 2)) / (({h1} * 2 + {h0}) / {m0} + ({h1} + {h0} * 2) / {m1}) END"
)
_P4_GRID = (
    _P4
    + f""", k AS (SELECT r.series_id, s.period_ns AS p, CAST(t - t % s.period_ns AS BIGINT) AS x, CAST(t AS BIGINT) AS t, CAST(v AS DOUBLE) AS y FROM r
      JOIN op_series s USING (series_id) WHERE t <= rx QUALIFY row_number() OVER (PARTITION BY series_id, x ORDER BY t DESC, reading_id DESC, v DESC) = 1),
    n AS (SELECT series_id, p, x AS x1, t AS t1, y AS y1, lag(x) OVER w AS x0, lag(t) OVER w AS t0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(t) OVER w AS t2,
      lead(y) OVER w AS y2, lead(x, 2) OVER w AS x3, lead(t, 2) OVER w AS t3, lead(y, 2) OVER w AS y3 FROM k WINDOW w AS (PARTITION BY series_id ORDER BY x)),
    g2 AS (SELECT *, (x2 - x1) // p - 1 AS missing, coalesce(x1 - x0 <= 13 * p, false) AS has0, coalesce(x3 - x2 <= 13 * p, false) AS has3, {_H0} AS h0, {_H1} AS h1, {_H2} AS h2
      FROM n WHERE x2 - x1 > p),
    sl AS (SELECT *, (y1 - y0) / h0 AS m0, (y2 - y1) / h1 AS m1, (y3 - y2) / h2 AS m2 FROM g2),
    dd AS (SELECT *, CASE WHEN has0 THEN {_MID('h0', 'h1', 'm0', 'm1')} WHEN has3 THEN {_END('h1', 'h2', 'm1', 'm2')} ELSE m1 END AS d1,
      CASE WHEN has3 THEN {_MID('h1', 'h2', 'm1', 'm2')} WHEN has0 THEN {_END('h1', 'h0', 'm1', 'm0')} ELSE m1 END AS d2 FROM sl),
    st AS (SELECT *, unnest(range(x1 + p, x2, p)) AS period_start FROM dd),
    ev AS (SELECT *, CAST(period_start - t1 AS DOUBLE) / p / h1 AS s FROM st),
    f AS (SELECT series_id, period_start, missing <= 12 AS short, round((2 * s * s * s - 3 * s * s + 1) * y1 + (s * s * s - 2 * s * s + s) * h1 * d1
      + (3 * s * s - 2 * s * s * s) * y2 + (s * s * s - s * s) * h1 * d2, 3) AS v FROM ev)
    SELECT series_id, x AS period_start, 'observed' AS status, y AS value FROM k
    UNION ALL SELECT series_id, period_start, CASE WHEN short THEN 'interpolated' ELSE 'gap' END, CASE WHEN short THEN CASE WHEN v = 0 THEN 0.0 ELSE v END END FROM f"""
)

_HOST = _host("hostname")

ORACLE_SQL = {
    "p1_found": _P1 + "SELECT DISTINCT ref_table, ref_id FROM o WHERE NOT coalesce(in_use, false)",
    "p1_orphan_counts": _P1
    + """SELECT ref_table, a - a % 3600000000000 AS period,
         CASE WHEN NOT known THEN 'absent' WHEN NOT coalesce(begun, false) THEN 'later' ELSE 'removed' END AS reason,
         count(DISTINCT ref_id) AS n_orphans FROM o WHERE NOT coalesce(in_use, false) GROUP BY ALL""",
    "p2_found": _P2 + "SELECT DISTINCT target, file_id FROM rec",
    "p2_target_totals": _P2
    + _P2_KEYS
    + """SELECT target, CAST(count(*) AS BIGINT) AS n_records, CAST(sum(n) AS BIGINT) AS n_bytes, min(k) AS first_key, max(k) AS last_key
       FROM cells GROUP BY target""",
    # below 128 MiB a target and 512 MiB in all there is one range and one output per target (whose files have one header)
    "p2_manifest": _P2
    + _P2_KEYS
    + """SELECT target, target || '-00000-000' AS out_file, header, min(k) AS first_key, max(k) AS last_key, CAST(count(*) AS BIGINT) AS n_records,
       CAST(sum(n) AS BIGINT) AS n_bytes, count(DISTINCT file_id) AS n_inputs FROM cells GROUP BY target, header""",
    "p3_found": _P3 + "SELECT DISTINCT file_id, line_no FROM bad",
    "p3_rejected": _P3
    + "SELECT file_id, line_no, count(*) AS n_errors, string_agg(DISTINCT why, '; ' ORDER BY why) AS reasons FROM bad GROUP BY ALL",
    "p3_accepted": _P3
    + "SELECT file_id, line_no, " + ", ".join(f'{_typed(n, t)} AS "{n}"' for n, t in STAT_TYPES)
    + " FROM c WHERE sound AND len(cells) = len(names) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.file_id = c.file_id AND bad.line_no = c.line_no)",
    "p4_found": _P4 + "SELECT series_id, period_start FROM m",
    "p4_coverage": _P4
    + """, gaps AS (SELECT series_id, p, (lead(period_start) OVER (PARTITION BY series_id ORDER BY period_start) - period_start) // p - 1 AS n FROM u)
       SELECT series_id, count(*) AS n_observed, CAST(coalesce(sum(n) FILTER (n <= 12), 0) AS BIGINT) AS n_filled,
              CAST(coalesce(sum(n) FILTER (n > 12), 0) AS BIGINT) AS n_marked FROM gaps GROUP BY ALL""",
    "p4_grid": _P4_GRID,
    "p5_found": f"""WITH n AS (SELECT count(*) AS n FROM io_event)
       SELECT 'fd' AS field, CAST(fd AS VARCHAR) AS val FROM io_event WHERE fd IS NOT NULL GROUP BY fd
       HAVING count(*) >= 0.02 * (SELECT n FROM n)
       UNION ALL SELECT 'hostname', {_HOST} FROM io_event WHERE hostname IS NOT NULL GROUP BY {_HOST}
       HAVING count(*) >= 0.03 * (SELECT n FROM n)""",
    "p5_key_totals": f"""WITH x AS (SELECT 'fd' AS field, CAST(fd AS VARCHAR) AS val, event_id, data, end_ns - start_ns AS busy FROM io_event
       UNION ALL SELECT 'hostname', {_HOST}, event_id, data, end_ns - start_ns FROM io_event)
       SELECT field, val, count(*) AS n_rows, count(DISTINCT event_id) AS n_events, CAST(sum(coalesce(data, 0)) AS BIGINT) AS n_bytes,
       CAST(sum(busy) AS BIGINT) AS busy_ns FROM x WHERE val IS NOT NULL GROUP BY ALL""",
}
