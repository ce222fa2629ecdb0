"""Column expressions that several operators share.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bin width of the stored statistics records, in nanoseconds (one hour).
HOUR_NS = 3_600_000_000_000

_BLANKS = " \t\r\n"


def canonical_host(host: Column) -> Column:
    """Host without surrounding blanks, lower case, cut at the first ``:`` and the first ``.``; null stays null."""
    name = F.lower(F.btrim(host, F.lit(_BLANKS)))
    return F.substring_index(F.substring_index(name, ":", 1), ".", 1)


def wall_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session's time zone is."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def floor_to(value: Column, width: int | Column) -> Column:
    """Start of the tumbling bin: ``v - v % width`` with the remainder's sign following ``v``."""
    return value - value % (F.lit(width) if isinstance(width, int) else width)


def epoch_ns(raw: Column) -> Column:
    """Nanoseconds since the epoch of a value written in ns, us or ms; its magnitude tells the unit.

    Values below 1e14 are milliseconds (until the year 5138), below 1e17 microseconds. A product
    outside int64 gives null.
    """
    return (
        F.when(raw < F.lit(10**14), F.try_multiply(raw, F.lit(1_000_000)))
        .when(raw < F.lit(10**17), F.try_multiply(raw, F.lit(1_000)))
        .otherwise(raw)
    )
