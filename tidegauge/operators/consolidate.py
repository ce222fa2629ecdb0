"""Consolidation of many tiny sorted files into few well-sized ones.

The records of a target are range-partitioned by key. Per range Spark's external sorter takes them as they come from the
files, spills sorted runs and merges these k ways, so a task holds no range in memory; outputs are rolled by bytes while
the merged stream passes, and a manifest keeps the key range of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.shared import checkpointed
from tidegauge.operators.delimited import CHUNK_LINES, cells_of, quoting_ok, records

#: The file-name forms of the agents.
_HEAD = r"^(?:[0-9]+-)?(.+\.[^.]+\.-?[0-9]+\.[0-9]+"
STATS_NAME = _HEAD + r"\.(jvm|sfs)\.(read|write|other|zip)\.csv)\z"
MAPPING_NAME = _HEAD + r"\.filedescriptormappings\.csv)\z"

MERGED = (
    "target string, out_file string, seq bigint, file_id bigint, line_no int, sort_key bigint, record string, n_bytes bigint, header string"
)
#: Bytes of an output, and of the key range that a task merges.
ROLL_BYTES, RANGE_BYTES = 128 << 20, 512 << 20


def input_files(files: DataFrame, small_bytes: int) -> DataFrame:
    """Files to be taken in: ``(file_id, target, key_column)``.

    ``files`` has ``file_id, file_name, size_bytes, n_lines``; repeated listing rows count once. The name must
    have one of the two agent forms. Of the files that share a name without job id the one with most
    lines counts, on a tie the lowest id (null counts as fewest), and only if it is smaller than
    ``small_bytes``. The choice is an aggregation with map-side combine, so many copies of one name do no harm.
    """
    name = F.col("file_name")
    stats = F.regexp_extract(name, STATS_NAME, 1)
    mapping = F.regexp_extract(name, MAPPING_NAME, 1)
    target = F.when(
        stats != "", F.concat_ws("-", F.regexp_extract(name, STATS_NAME, 2), F.regexp_extract(name, STATS_NAME, 3))
    ).when(mapping != "", "filedescriptormappings")
    named = files.select(
        "file_id", "size_bytes", F.coalesce("n_lines", F.lit(-1)).alias("n_lines"), target.alias("target"),
        F.when(stats != "", stats).otherwise(mapping).alias("base"),
    ).filter(F.col("target").isNotNull() & F.col("file_id").isNotNull())
    best = named.groupBy("base").agg(
        F.max_by(F.struct("file_id", "target", "size_bytes"), F.struct(F.col("n_lines"), -F.col("file_id"))).alias("f")
    )
    return best.select("f.*").filter(F.col("size_bytes") < small_bytes).select(
        "file_id", "target", "size_bytes",
        F.when(F.col("target") == "filedescriptormappings", "fileDescriptor").otherwise("timeBin").alias("key_column"),
    )


def keyed_records(files: DataFrame, lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Records of the chosen files with their sort key: ``(target, header, layout, sort_key, file_id, line_no, record)``.

    The key is the file's key column as a number, 0 where a broken record has none there. ``layout`` is the hash of target
    and header: records meet only records of the same columns.
    """
    wanted = records(lines, files.select("file_id", "target", "key_column"), chunk_lines)
    cells = F.when(quoting_ok(F.col("record")), cells_of(F.col("record")))
    key = F.get(cells, F.array_position("names", F.col("key_column")).cast("int") - 1)
    return wanted.select(
        "target", "header", F.xxhash64("target", "header").alias("layout"), F.coalesce(key.try_cast("bigint"), F.lit(0)).alias("sort_key"),
        "file_id", "line_no", "record",
    )


def _rolled(roll_bytes: int):
    """Cut the merged stream of a range into outputs; what is kept between batches is the last line and a few counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        numbers: dict[str, int] = {}
        last: tuple | None = None  # (file, line, record): a line stored twice follows itself
        group: tuple[str, str] | None = None
        name, held, seq = "", 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            file, line = (b.column(c).to_numpy(zero_copy_only=False) for c in ("file_id", "line_no"))
            record = b.column("record")
            same = np.zeros(len(file), bool)
            same[1:] = (file[1:] == file[:-1]) & (line[1:] == line[:-1])
            for i in np.flatnonzero(same):
                same[i] = record[i].equals(record[i - 1])
            same[0] = last == (file[0], line[0], record[0].as_py())
            last = (file[-1], line[-1], record[-1].as_py())
            if same.any():
                b = b.filter(pa.array(~same))
                if not b.num_rows:
                    continue
            n = b.num_rows
            sizes = pc.add(pc.binary_length(b.column("record")).cast(pa.int64()), 1).to_numpy(zero_copy_only=False)
            grown = np.concatenate([[0], np.cumsum(sizes)])
            layout = b.column("layout").to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(layout[1:] != layout[:-1]) + 1).tolist(), n]
            names, runs, seqs = [], [], []
            for i, j in zip(borders, borders[1:]):
                own = (b.column("target")[i].as_py(), b.column("header")[i].as_py())
                if own != group:
                    group, name = own, ""
                while i < j:
                    k = int(np.searchsorted(grown, grown[i] + roll_bytes - held, "right")) - 1 if name else i
                    if k <= i:  # the next record would exceed the output, or there is none yet
                        numbers[own[0]] = number = numbers.get(own[0], -1) + 1
                        name, held, seq = f"{own[0]}-{part:05d}-{number:03d}", 0, 0
                        k = max(i + 1, int(np.searchsorted(grown, grown[i] + roll_bytes, "right")) - 1)
                    k = min(k, j)
                    names.append(name)
                    runs.append(k - i)
                    seqs.append(np.arange(seq, seq + k - i))
                    held, seq, i = held + int(grown[k] - grown[i]), seq + k - i, k
            out = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(names), dtype=np.int32), runs), pa.array(names, pa.string())).dictionary_decode()
            yield pa.RecordBatch.from_arrays(
                [b.column("target"), out, pa.array(np.concatenate(seqs)), b.column("file_id"), b.column("line_no"), b.column("sort_key"), b.column("record"),
                 pa.array(sizes), b.column("header")],
                names=["target", "out_file", "seq", "file_id", "line_no", "sort_key", "record", "n_bytes", "header"],
            )

    return run


def consolidate(
    files: DataFrame, lines: DataFrame, small_bytes: int = 16384, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES,
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """All records of the small files, merged: ``(target, out_file, seq, file_id, line_no, sort_key, record, n_bytes, header)``.

    Key ranges of about ``range_bytes`` are cut over (target and header, key, file, line), so even one key that holds a third of
    the records is split. The range's records are sorted externally and streamed; an output is closed before it would exceed
    ``roll_bytes`` (a longer record has one of its own) and where the header changes, so each output has one header.
    The number of ranges follows from the bytes alone, not from the cluster's settings: one output per target if all are small.
    Equal records stay as often as they are stored under different (file, line); a line stored twice counts
    once. No files, or files without records, give an empty result.
    """
    chosen = input_files(files, small_bytes)
    total = chosen.agg(F.sum("size_bytes")).first()[0] or 0
    n_ranges = 1 + total // range_bytes
    order = ["layout", "sort_key", "file_id", "line_no", "record"]
    ranged = keyed_records(chosen, lines, chunk_lines).repartitionByRange(n_ranges, *order[:-1]).sortWithinPartitions(*order)
    return ranged.mapInArrow(_rolled(roll_bytes), MERGED)


def manifest(merged: DataFrame) -> DataFrame:
    """Range metadata per output: ``(target, out_file, header, first_key, last_key, n_records, n_bytes, n_inputs)``."""
    per_input = merged.groupBy("target", "out_file", "header", "file_id").agg(
        F.min("sort_key").alias("lo"), F.max("sort_key").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b")
    )
    return per_input.groupBy("target", "out_file", "header").agg(
        F.min("lo").alias("first_key"), F.max("hi").alias("last_key"), F.sum("n").alias("n_records"), F.sum("b").alias("n_bytes"),
        F.count(F.lit(1)).alias("n_inputs"),
    )


def taken_in(merged: DataFrame) -> DataFrame:
    """``(target, file_id)`` of the files whose records are in the outputs."""
    return merged.select("target", "file_id").distinct()


def _with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(target, out_file, seq, value)``: the header before the first record of each output."""
    names = ["target", "out_file", "seq", "value"]
    for b in batches:
        first = b.filter(pc.equal(b.column("seq"), 0))
        if first.num_rows:
            before = pa.array(np.full(first.num_rows, -1, np.int64))
            yield pa.RecordBatch.from_arrays([first.column("target"), first.column("out_file"), before, first.column("header")], names=names)
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("target", "out_file", "seq", "record")], names=names)


def write_consolidated(merged: DataFrame, path: str) -> DataFrame:
    """Write one text file per output below ``path/target=.../out_file=...`` and the manifest to ``path/_manifest``, which is returned.

    An output is its header and its records in merged order. The merged rows are kept in the shared folder once, so that outputs
    and manifest describe the same ranges; an output is written by the task that merged it. The manifest has the path and
    length of the written file besides the range metadata.
    """
    kept = checkpointed(merged)
    spark = kept.sparkSession
    (
        kept.mapInArrow(_with_header, "target string, out_file string, seq bigint, value string")
        .sortWithinPartitions("target", "out_file", "seq")
        .select("target", "out_file", "value")
        .write.mode("overwrite").partitionBy("target", "out_file").text(path)
    )
    if not kept.isEmpty():
        written = spark.read.format("binaryFile").option("basePath", path).option("recursiveFileLookup", True).load(path).select(
            F.regexp_extract("path", r"/out_file=([^/]+)/", 1).alias("out_file"), "path", F.col("length").alias("file_bytes")
        )
        manifest(kept).join(written, "out_file").write.mode("overwrite").parquet(f"{path}/_manifest")
    else:
        manifest(kept).withColumns({"path": F.lit(""), "file_bytes": F.lit(0).cast("bigint")}).write.mode("overwrite").parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")
