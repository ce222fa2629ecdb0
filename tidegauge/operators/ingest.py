"""Rules that turn raw calls and deliveries into event rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.exprs import HOUR_NS, canonical_host

#: Letters of the skip flags and the categories they stand for.
SKIP_LETTERS = {"r": "read", "w": "write", "o": "other", "z": "zip"}

#: Bytes moved by a single get or put of a mapped buffer.
BUFFER_WIDTHS = {"byte": 1, "char": 2, "short": 2, "int": 4, "float": 4, "long": 8, "double": 8}

#: File system operations that count as ``other``.
COUNTED_FS_CALLS = [
    "append", "create", "createNonRecursive", "delete", "getFileBlockLocations", "getFileStatus", "listStatus", "mkdirs", "open", "rename", "seek",
]


def once(df: DataFrame, row_id: str, order: Sequence[str]) -> DataFrame:
    """One row per ``row_id`` (the first by ``order``): redelivered rows count once. Null ids are left out.

    Ids hardly repeat, so combining before the shuffle would only sort once more: the rows are shuffled by id first.
    """
    columns = df.columns
    rest = [c for c in columns if c != row_id]
    picked = df.filter(F.col(row_id).isNotNull()).repartition(row_id).groupBy(row_id).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return picked.select(row_id, "__r.*").select(*columns)


def clean_events(io_event: DataFrame) -> DataFrame:
    """Events once each, hosts canonical, unknown descriptors 0."""
    return once(io_event, "event_id", ["arrived_ts", "hostname"]).withColumns(
        {"hostname": canonical_host(F.col("hostname")), "fd": F.coalesce("fd", F.lit(0))}
    )


def clean_stats(op_stats: DataFrame) -> DataFrame:
    """Statistics records once each, hosts canonical, missing measures and descriptors 0."""
    kept = once(op_stats, "stat_id", ["written_ts", "hostname"])
    return kept.withColumn("hostname", canonical_host(F.col("hostname"))).na.fill(
        0, ["count", "cpuTime", "data", "remoteCount", "remoteCpuTime", "remoteData", "fileDescriptor"]
    )


def skip_categories(events: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Events without the categories that the flags of their source (letters r, w, o, z) skip."""
    dropped = F.lit(False)
    for source, letters in flags.items():
        dropped = dropped | ((F.col("source") == source) & F.col("category").isin([SKIP_LETTERS[x] for x in letters]))
    return events.filter(~F.coalesce(dropped, F.lit(False)))


def is_local(hostname: Column, datanode: Column) -> Column:
    """Whether the data node is the host itself; null if the data node is unknown."""
    return (canonical_host(hostname) == canonical_host(datanode)) | (canonical_host(datanode) == "localhost")


def rewrite_scheme(uri: Column, old: str, new: str) -> Column:
    """The URI with scheme ``old`` replaced by ``new``; authority, path and fragment stay, other schemes too."""
    return F.regexp_replace(uri, f"^{old}:", f"{new}:")


def call_rows(calls: DataFrame, trace_mapped: bool = True) -> DataFrame:
    """Event rows ``(call_id, fd, category, data)`` of raw calls ``(call_id, kind, method, result, size, fd, other_fd)``.

    ``kind`` is the instrumented interface (``stream``, ``random``, ``channel``, ``buffer``, ``fs``). Opening and
    metadata calls are ``other``; reads count the bytes returned (nothing at the end of a file), single reads
    and writes one byte, ``readFully`` and array writes their size, UTF-16 writes two bytes a character, buffer
    accesses the width of their type times ``size``. A transfer to or from a second traced descriptor adds a row of
    the opposite direction for it. Mapped buffers count only if ``trace_mapped`` and if they come from a traced
    descriptor. Calls of other methods give no row.
    """
    m, res, size = F.col("method"), F.coalesce("result", F.lit(0)), F.coalesce("size", F.lit(1))
    width = F.element_at(F.create_map(*[x for k, v in BUFFER_WIDTHS.items() for x in (F.lit(k), F.lit(v))]), F.substring_index(m, ":", -1))
    reads = m.isin("read", "readBytes", "readFully", "readLine", "readUTF", "transferTo") | m.startswith("get:")
    writes = m.isin("write", "writeBytes", "writeChars", "writeUTF", "transferFrom") | m.startswith("put:")
    category = (
        F.when(m.isin(COUNTED_FS_CALLS) | (m == "open"), "other").when(reads, "read").when(writes, "write")
    )
    data = (
        F.when(m == "read", F.when(res == -1, 0).otherwise(1))
        .when(m.isin("readBytes", "readLine", "readUTF", "transferTo", "transferFrom"), F.greatest(res, F.lit(0)))
        .when(m.startswith("get:") | m.startswith("put:"), width * size)
        .when(m == "writeChars", size * 2)
        .when(m.isin("readFully", "writeBytes", "writeUTF"), size)
        .when(m == "write", F.lit(1))
        .otherwise(0)
    ).cast("bigint")
    opposite = F.when(category == "read", "write").when(category == "write", "read")
    counted = (F.col("kind") != "buffer") | (F.lit(trace_mapped) & (F.coalesce("fd", F.lit(0)) != 0))
    rows = calls.withColumns({"category": category, "data": data}).filter(F.col("category").isNotNull() & counted)
    both = F.when(
        F.col("other_fd").isNotNull() & (F.col("kind") == "channel"),
        F.array(
            F.struct(F.col("fd").alias("fd"), F.col("category").alias("category")),
            F.struct(F.col("other_fd").alias("fd"), opposite.alias("category")),
        ),
    ).otherwise(F.array(F.struct(F.col("fd").alias("fd"), F.col("category").alias("category"))))
    return rows.select("call_id", "data", F.explode(both).alias("x")).select("call_id", "x.fd", "x.category", "data")


def discard_own_files(events: DataFrame, path: str, own_prefix: str) -> DataFrame:
    """Events that are neither on the standard streams nor on the collector's own output files."""
    p = F.col(path)
    return events.filter(p.isNull() | ~(p.isin("stdin", "stdout", "stderr") | p.startswith(own_prefix)))


def to_epoch(nano: Column, init_millis: Column, nano_at_init: Column) -> Column:
    """Epoch nanoseconds of a monotonic clock reading, by the process's offset."""
    return nano + (init_millis * 1_000_000 - nano_at_init)


def while_running(events: DataFrame, started: int, stopped: int) -> DataFrame:
    """Events that start while the collector runs."""
    return events.filter(F.col("start_ns").between(started, stopped))


def descriptor_ids(seen: DataFrame, process: Sequence[str], path: str, at: str, shard_ns: int = HOUR_NS) -> DataFrame:
    """Dense ids from 1 per process, in the order in which paths were first seen; a path seen again keeps its id.

    Paths first seen at the same time are numbered by name. Null paths get no id, unknown times come first. First
    sightings are pre-aggregated, and numbered per time shard on top of the number of ids given before, so a process
    with very many files is no single task's work.
    """
    first = seen.filter(F.col(path).isNotNull()).groupBy(*process, path).agg(F.min(at).alias("first_seen"))
    cut = first.withColumn("__shard", F.coalesce(F.floor(F.col("first_seen") / F.lit(shard_ns)), F.lit(-(2**62))))
    before = Window.partitionBy(*process).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    given = (
        cut.groupBy(*process, "__shard").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__given", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    )
    order = Window.partitionBy(*process, "__shard").orderBy("first_seen", path)
    same = [cut[c].eqNullSafe(given[c]) for c in (*process, "__shard")]
    numbered = cut.join(given, reduce(and_, same)).select(cut["*"], "__given")
    return numbered.withColumn("descriptor", (F.col("__given") + F.row_number().over(order)).cast("int")).drop("__shard", "__given")


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, shard: int = 1 << 20) -> DataFrame:
    """Running sum of ``value`` per key in the order of the unique integer ``order``.

    Keys are cut into shards of the order; sums per shard are carried on, so a hot key is no single task's work.
    """
    cut = df.withColumn("__shard", F.floor(F.col(order) / F.lit(shard)))
    sums = cut.groupBy(*keys, "__shard").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "__shard", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carried"))
    within = Window.partitionBy(*keys, "__shard").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.join(carried, [*keys, "__shard"])
        .withColumn(out, F.col("__carried") + F.sum(value).over(within))
        .drop("__shard", "__carried")
    )


def counted_opens(handles: DataFrame) -> DataFrame:
    """Of reference-counted opens (+1) and closes (-1), ``(handle, event_id)`` of the opens that raise the count to 1."""
    return running_sum(handles, ["handle"], "event_id", "delta", "open_count").filter("delta = 1 and open_count = 1").select(
        "handle", "event_id"
    )
