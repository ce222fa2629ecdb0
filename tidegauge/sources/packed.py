"""Packed binary files of statistics and descriptor mappings: codecs, distributed reading, a data source.

Two formats: ``bb`` (presence bits and minimal-width integers) and ``fb`` (size-prefixed FlatBuffers tables, read and
written without a generated class). Files are decoded record by record; a truncated or invalid record ends
its file, what came before is kept.
"""

from __future__ import annotations

import glob
import io
import os
import struct
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegauge.schema import CATEGORIES, FD_MAP, OP_STATS, SOURCES

# --- Fixed values of the bb format -----------------------------------------------------------------------------
#: Bit offsets of the presence-and-width groups in the 4-byte header, in the order in which the values follow.
BB_HEADER_BITS = {"pid": 25, "count": 22, "cpuTime": 19, "fileDescriptor": 16, "threadId": 13}
#: Variant in bits 28-29 of the header; each variant adds one header byte.
BB_VARIANT_BIT = 28
#: (header byte, bit offset) of the groups in the additional bytes.
BB_EXTRA_BITS = {"data": (0, 4), "remoteCount": (0, 1), "remoteCpuTime": (1, 4), "remoteData": (1, 1)}
#: Variants: number of additional header bytes per category.
BB_VARIANTS = {"other": 0, "write": 1, "read": 2, "zip": 2}
#: Bytes of the width codes; strings are a signed length byte (length - 127) and their bytes (UTF-8, so plain ASCII stays as it is).
BB_WIDTHS = (1, 2, 4, 8)
BB_STRING_BIAS, BB_STRING_MAX = 127, 254
# --- Fixed values of the fb format: field numbers --------------------------------------------------------------
FB_STATS = ["hostname", "pid", "key", "timeBin", "count", "cpuTime", "source", "category", "fileDescriptor", "threadId", "data",
            "remoteCount", "remoteCpuTime", "remoteData"]
FB_MAPPING = ["hostname", "pid", "key", "fileDescriptor", "path"]
FB_KINDS = {"hostname": "s", "key": "s", "path": "s", "pid": "i", "fileDescriptor": "i", "source": "b", "category": "b"}
# ---------------------------------------------------------------------------------------------------------------

_NAMES = OP_STATS.fieldNames()
_MAP_NAMES = FD_MAP.fieldNames()


class Truncated(ValueError):
    """The bytes end within a record, or hold what no record can."""


def _width_code(v: int) -> int:
    """Code of the smallest signed width that holds ``v``."""
    return next(i for i, w in enumerate(BB_WIDTHS) if -(1 << (8 * w - 1)) <= v < 1 << (8 * w - 1))


def _int(v: int, code: int) -> bytes:
    return v.to_bytes(BB_WIDTHS[code], "little", signed=True)


def _string(s: str) -> bytes:
    raw = s.encode("utf-8")
    if len(raw) > BB_STRING_MAX:
        raise ValueError(f"longer than {BB_STRING_MAX} bytes: {s[:40]}...")
    return struct.pack("<b", len(raw) - BB_STRING_BIAS) + raw


class _Bytes:
    """Reading position in a buffer."""

    def __init__(self, buf: bytes, at: int = 0) -> None:
        self.buf, self.at = buf, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.buf):
            raise Truncated(f"{n} bytes wanted at {self.at} of {len(self.buf)}")
        self.at += n
        return self.buf[self.at - n : self.at]

    def int(self, size: int, signed: bool = True) -> int:
        return int.from_bytes(self.take(size), "little", signed=signed)

    def string(self) -> str:
        try:
            return self.take(self.int(1) + BB_STRING_BIAS).decode("utf-8")
        except UnicodeDecodeError as e:
            raise Truncated(str(e)) from e


def encode_bb_stats(rows: Iterable[dict]) -> bytes:
    """A bb file of statistics rows (dicts by column; missing measures are 0)."""
    out, n = io.BytesIO(), 0
    out.write(bytes(8))
    for row in rows:
        variant = BB_VARIANTS[row["category"]]
        header, extra, body = variant << BB_VARIANT_BIT, bytearray(variant), {}
        for name, bit in BB_HEADER_BITS.items():
            v = row[name] or 0
            if v:
                code = _width_code(v)
                header |= (4 | code) << bit
                body[name] = _int(v, code)
        for name, (byte, bit) in BB_EXTRA_BITS.items():
            v = row.get(name) or 0
            if v and byte < variant and (name == "data" or variant == 2):
                code = _width_code(v)
                extra[byte] |= (4 | code) << bit
                body[name] = _int(v, code)
        put = lambda name: body.get(name, b"")  # noqa: E731, B023
        out.write(header.to_bytes(4, "little") + bytes(extra) + _string(row["hostname"]) + put("pid") + _string(row["key"]))
        out.write(struct.pack("<q", row["timeBin"]) + put("count") + put("cpuTime"))
        out.write(bytes((SOURCES.index(row["source"]), CATEGORIES.index(row["category"]))) + put("fileDescriptor") + put("threadId"))
        out.write(b"".join(put(name) for name in BB_EXTRA_BITS))
        n += 1
    whole = bytearray(out.getvalue())
    whole[:8] = n.to_bytes(8, "little")
    return bytes(whole)


def decode_bb_stats(buf: bytes) -> Iterator[tuple]:
    """Rows of a bb file, in the order of the schema; ends at the first record that is truncated or invalid."""
    b = _Bytes(buf)
    try:
        for _ in range(b.int(8, signed=False)):
            header = b.int(4, signed=False)
            variant = header >> BB_VARIANT_BIT & 3
            if variant == 3:
                raise Truncated("no such variant")
            extra = b.take(variant)
            group = lambda name: header >> BB_HEADER_BITS[name] & 7  # noqa: E731, B023
            value = lambda g: b.int(BB_WIDTHS[g & 3]) if g & 4 else 0
            host, pid, key = b.string(), value(group("pid")), b.string()
            time_bin, count, cpu = b.int(8), value(group("count")), value(group("cpuTime"))
            source, category = b.int(1), b.int(1)
            if not (0 <= source < len(SOURCES) and 0 <= category < len(CATEGORIES)):
                raise Truncated("no such source or category")
            fd, thread = value(group("fileDescriptor")), value(group("threadId"))
            rest = [value(extra[byte] >> bit & 7) if byte < variant else 0 for byte, bit in BB_EXTRA_BITS.values()]
            yield (host, pid, key, count, time_bin, cpu, SOURCES[source], CATEGORIES[category], fd, thread, *rest)
    except Truncated:
        return


def encode_bb_mappings(rows: Iterable[dict]) -> bytes:
    """A bb file of descriptor mappings. The format has no code for 0, so 0 takes one byte."""
    out, n = [], 0
    for row in rows:
        path = row["path"].encode("utf-8")
        codes = [_width_code(row["pid"]), _width_code(row["fileDescriptor"]), _width_code(len(path))]
        out.append(bytes((codes[0] << 4 | codes[1] << 2 | codes[2],)) + _string(row["hostname"]) + _int(row["pid"], codes[0]))
        out.append(_string(row["key"]) + _int(row["fileDescriptor"], codes[1]) + _int(len(path), codes[2]) + path)
        n += 1
    return n.to_bytes(4, "little") + b"".join(out)


def decode_bb_mappings(buf: bytes) -> Iterator[tuple]:
    """Rows of a bb mapping file; ends at the first record that is truncated or invalid."""
    b = _Bytes(buf)
    try:
        for _ in range(b.int(4, signed=False)):
            header = b.int(1, signed=False)
            pid_w, fd_w, len_w = (BB_WIDTHS[header >> s & 3] for s in (4, 2, 0))
            host, pid, key, fd = b.string(), b.int(pid_w), b.string(), b.int(fd_w)
            path = b.take(b.int(len_w))
            yield host, pid, key, fd, path.decode("utf-8")
    except (Truncated, UnicodeDecodeError):
        return


_FB_SIZES = {"s": 4, "i": 4, "b": 1, "l": 8}


def _fb_table(values: dict[str, object], fields: list[str]) -> bytes:
    """One size-prefixed table; zero and missing values are left out."""
    kept = [(i, f, FB_KINDS.get(f, "l"), values[f]) for i, f in enumerate(fields) if values.get(f)]
    slots, at = {}, 4
    for i, _, kind, _ in sorted(kept, key=lambda x: -_FB_SIZES[x[2]]):
        size = _FB_SIZES[kind]
        at += -(at + 4) % size  # the table begins at an odd multiple of 4
        slots[i] = at
        at += size
    table_size = at
    vtable = struct.pack("<HH", 4 + 2 * len(fields), table_size) + b"".join(struct.pack("<H", slots.get(i, 0)) for i in range(len(fields)))
    start = 4 + len(vtable)
    pad = -(start + 4) % 8
    table_at = start + pad
    table, tail = bytearray(table_size), bytearray()
    struct.pack_into("<i", table, 0, table_at - 4)
    for i, _, kind, v in kept:
        if kind == "s":
            tail += bytes(-len(tail) % 4)
            text = str(v).encode("utf-8")
            struct.pack_into("<I", table, slots[i], table_size + (-table_size % 4) + len(tail) - slots[i])
            tail += struct.pack("<I", len(text)) + text + b"\0"
        else:
            struct.pack_into({"i": "<i", "b": "<b", "l": "<q"}[kind], table, slots[i], v)
    body = struct.pack("<I", table_at) + vtable + bytes(pad) + bytes(table) + bytes(-table_size % 4) + bytes(tail)
    return struct.pack("<I", len(body)) + body


def _fb_values(body: bytes, fields: list[str]) -> dict[str, object]:
    try:
        (table,) = struct.unpack_from("<I", body, 0)
        (back,) = struct.unpack_from("<i", body, table)
        vtable = table - back
        (vsize,) = struct.unpack_from("<H", body, vtable)
        out: dict[str, object] = {}
        for i, f in enumerate(fields):
            kind = FB_KINDS.get(f, "l")
            slot = struct.unpack_from("<H", body, vtable + 4 + 2 * i)[0] if 4 + 2 * i < vsize else 0
            if not slot:
                out[f] = "" if kind == "s" else 0
            elif kind == "s":
                at = table + slot + struct.unpack_from("<I", body, table + slot)[0]
                (n,) = struct.unpack_from("<I", body, at)
                if at + 4 + n > len(body):
                    raise Truncated("string beyond its record")
                out[f] = body[at + 4 : at + 4 + n].decode("utf-8")
            else:
                (out[f],) = struct.unpack_from({"i": "<i", "b": "<b", "l": "<q"}[kind], body, table + slot)
        return out
    except (struct.error, UnicodeDecodeError) as e:
        raise Truncated(str(e)) from e


def encode_fb_stats(rows: Iterable[dict]) -> bytes:
    """An fb file of statistics rows: the count and one table per row."""
    tables = [
        _fb_table({**r, "source": SOURCES.index(r["source"]), "category": CATEGORIES.index(r["category"])}, FB_STATS) for r in rows
    ]
    return len(tables).to_bytes(8, "little") + b"".join(tables)


def _fb_records(b: _Bytes, most: int | None) -> Iterator[bytes]:
    n = 0
    while b.at < len(b.buf) and (most is None or n < most):
        yield b.take(b.int(4, signed=False))
        n += 1


def decode_fb_stats(buf: bytes) -> Iterator[tuple]:
    """Rows of an fb file, in the order of the schema; ends at the first record that is truncated or invalid."""
    b = _Bytes(buf)
    try:
        for body in _fb_records(b, b.int(8, signed=False)):
            v = _fb_values(body, FB_STATS)
            v["source"], v["category"] = SOURCES[v["source"]], CATEGORIES[v["category"]]
            yield tuple(v[n] for n in _NAMES)
    except (Truncated, IndexError):
        return


def encode_fb_mappings(rows: Iterable[dict]) -> bytes:
    """An fb file of mappings: one table per row, no count."""
    return b"".join(_fb_table(dict(r), FB_MAPPING) for r in rows)


def decode_fb_mappings(buf: bytes) -> Iterator[tuple]:
    """Rows of an fb mapping file; ends at the first record that is truncated or invalid."""
    try:
        for body in _fb_records(_Bytes(buf), None):
            v = _fb_values(body, FB_MAPPING)
            yield tuple(v[n] for n in _MAP_NAMES)
    except Truncated:
        return


DECODERS = {("bb", "stats"): decode_bb_stats, ("bb", "fdmap"): decode_bb_mappings, ("fb", "stats"): decode_fb_stats, ("fb", "fdmap"): decode_fb_mappings}
ENCODERS = {("bb", "stats"): encode_bb_stats, ("bb", "fdmap"): encode_bb_mappings, ("fb", "stats"): encode_fb_stats, ("fb", "fdmap"): encode_fb_mappings}
SCHEMAS = {"stats": OP_STATS, "fdmap": FD_MAP}
_BATCH_ROWS = 16384


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == _BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def record_of(name: str) -> str:
    """What a file holds, by its name: descriptor mappings or statistics."""
    return "fdmap" if "filedescriptormappings" in name else "stats"


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """The file itself, or the files in it if it is a tar archive (a cut archive gives its whole members)."""
    if not name.endswith((".tar", ".tar.gz", ".tgz")):
        yield name, content
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            for m in tar:
                if m.isfile() and (f := tar.extractfile(m)):
                    yield os.path.basename(m.name), f.read()
    except (tarfile.TarError, EOFError):
        return


def read_packed(spark: SparkSession, path: str, record: str = "stats", fmt: str = "bb") -> DataFrame:
    """Rows of all ``fmt`` files below ``path`` that hold ``record``, also within tar archives there.

    Works on any file system that Spark reads; each file is one row of a binary scan and decoded where it is read.
    """
    schema = to_arrow_schema(SCHEMAS[record])
    decode = DECODERS[fmt, record]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                for inner, data in members(name, content):
                    if inner.endswith("." + fmt) and record_of(inner) == record:
                        yield from _batches(decode(data), schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, SCHEMAS[record])


@dataclass
class _FilePart(InputPartition):
    path: str


class _Reader(DataSourceReader):
    """One partition per file; filters on source and category skip files by name."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.path, self.fmt, self.record = options["path"], options.get("format", "bb"), options.get("record", "stats")
        self.wanted: dict[str, str] = {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if type(f).__name__ == "EqualTo" and f.attribute in (("source",), ("category",)):
                self.wanted[f.attribute[0]] = f.value
            yield f  # names only rule files out: the rows are still tested

    def partitions(self):
        found = []
        for p in sorted(glob.glob(os.path.join(self.path, "**", f"*.{self.fmt}"), recursive=True)):
            parts = os.path.basename(p).split(".")
            named = {"source": parts[-3], "category": parts[-2]} if len(parts) >= 3 and parts[-3] in SOURCES else {}
            if record_of(p) == self.record and all(named.get(k, v) == v for k, v in self.wanted.items()):
                found.append(_FilePart(p))
        return found or [_FilePart("")]

    def read(self, partition):
        if partition.path:
            with open(partition.path, "rb") as f:
                content = f.read()
            yield from _batches(DECODERS[self.fmt, self.record](content), to_arrow_schema(SCHEMAS[self.record]))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Per task one file per source and category, renamed into place on commit."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.fmt, self.record = options["path"], options.get("format", "bb"), options.get("record", "stats")
        self.overwrite = overwrite

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        groups: dict[str, list[dict]] = {}
        for row in iterator:
            r = row.asDict()
            name = f"{r['source']}.{r['category']}" if self.record == "stats" else "filedescriptormappings"
            groups.setdefault(name, []).append(r)
        done = []
        for name, rows in groups.items():
            final = os.path.join(self.path, f"part-{uuid.uuid4().hex}.{name}.{self.fmt}")
            with open(final + ".tmp", "wb") as f:
                f.write(ENCODERS[self.fmt, self.record](rows))
            done.append((final + ".tmp", final))
        return _Written(done)

    def commit(self, messages):
        old = glob.glob(os.path.join(self.path, f"*.{self.fmt}")) if self.overwrite else []
        for m in messages:
            for tmp, final in m.files if m else []:
                os.replace(tmp, final)
        for p in old:
            if record_of(p) == self.record:
                os.remove(p)

    def abort(self, messages):
        for m in messages:
            for tmp, _ in m.files if m else []:
                if os.path.exists(tmp):
                    os.remove(tmp)


class PackedSource(DataSource):
    """``spark.read.format("packed").option("path", ...).option("format", "bb" | "fb").option("record", "stats" | "fdmap")``.

    ``path`` is a folder on a file system that all executors mount. Register with ``register(spark)``.
    """

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> StructType:
        return SCHEMAS[self.options.get("record", "stats")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the ``packed`` format known to the session, with filters passed on to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackedSource)
