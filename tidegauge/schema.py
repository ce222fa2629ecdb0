"""Row types of the telemetry tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


#: One row per I/O call, the input of the aggregation.
IO_EVENT = _struct(
    event_id=_L, hostname=_S, pid=_I, key=_S, source=_S, category=_S, fd=_I, thread_id=_L, start_ns=_L, end_ns=_L, data=_L, is_remote=_B,
    datanode_hostname=_S,
)
#: Aggregated statistics per process, layer, thread, bin and descriptor; what a category lacks is 0.
OP_STATS = _struct(
    hostname=_S, pid=_I, key=_S, count=_L, timeBin=_L, cpuTime=_L, source=_S, category=_S, fileDescriptor=_I, threadId=_L, data=_L,
    remoteCount=_L, remoteCpuTime=_L, remoteData=_L,
)
#: Dictionary of descriptors.
FD_MAP = _struct(hostname=_S, pid=_I, key=_S, fileDescriptor=_I, path=_S)

MEASURES = ["count", "cpuTime", "data", "remoteCount", "remoteCpuTime", "remoteData"]
CATEGORIES = ["read", "write", "other", "zip"]
SOURCES = ["jvm", "sfs"]


def columns_of(category: str) -> list[str]:
    """Columns that are written for a category, in file order."""
    base = OP_STATS.fieldNames()[:10]
    return base + {"other": [], "write": ["data"]}.get(category, ["data", "remoteCount", "remoteCpuTime", "remoteData"])
