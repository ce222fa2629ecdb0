"""References to records that do not exist (at the time they are referred to).

Parents are valid during ``[valid_from, valid_to)``; a reference needs a parent of the same key that is
valid at some time in ``[at, until]``. Parent and child keys are united in tagged long form and grouped by
key; the references that lack a parent flag are kept and counted by period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.exprs import HOUR_NS, canonical_host

_OPEN = 2**63 - 1
#: Rows of a key that one task sweeps at most; buckets of keys whose rows are counted; tasks for references without a key.
TASK_ROWS, BUCKETS, NO_KEY_TASKS = 1 << 21, 1 << 20, 1024


def references(
    df: DataFrame, table: str, ref_id: Column, keys: dict[str, Column], at: Column, until: Column | None = None
) -> DataFrame:
    """Child rows ``(ref_table, ref_id, *keys, at, until)`` in the long form; ``until`` is inclusive."""
    return df.select(
        F.lit(table).alias("ref_table"),
        ref_id.cast("bigint").alias("ref_id"),
        *[c.alias(n) for n, c in keys.items()],
        at.cast("bigint").alias("at"),
        (at if until is None else until).cast("bigint").alias("until"),
    )


def parents(df: DataFrame, keys: dict[str, Column], valid_from: Column, valid_to: Column) -> DataFrame:
    """Parent rows ``(*keys, valid_from, valid_to)``; a null end is open, empty intervals are left out."""
    return df.select(
        *[c.alias(n) for n, c in keys.items()],
        valid_from.cast("bigint").alias("valid_from"),
        F.coalesce(valid_to.cast("bigint"), F.lit(_OPEN)).alias("valid_to"),
    ).filter(F.col("valid_from") < F.col("valid_to"))


def orphans(
    refs: DataFrame, known: DataFrame, keys: Sequence[str], shard_ns: int = HOUR_NS, task_rows: int = TASK_ROWS, buckets: int = BUCKETS
) -> DataFrame:
    """References without a valid parent: ``(ref_table, ref_id, at, reason)``, one row per row of ``refs``.

    A reference is covered if the largest end among the parents that started by ``until`` lies beyond
    ``at``: the tagged union is grouped by key, and in time order a running maximum of the parents' ends flags
    the references that have a parent. Keys are counted in hash buckets first; those of buckets above ``task_rows`` rows are
    cut along time as well, and a time shard with more references than that by their ids, see ``_hot_groups``. So
    no task sweeps much more than ``task_rows`` rows, whatever the size of the tables. One shuffle of all rows.

    ``reason`` is ``absent`` (the key has no parent at all), ``later`` (all of its parents start later, or the
    reference has no time) or ``removed``. A null in a key matches no parent (``absent``). Repeated
    references give repeated rows; an empty ``known`` makes every reference an orphan.
    """
    keys = list(keys)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    timed = F.col("at").isNotNull() & F.col("until").isNotNull()
    live = refs.select("ref_table", "ref_id", "at", *keys, F.when(timed, F.col("until")).alias("t"), F.when(~no_key, bucket).alias("bucket"))
    valid = known.filter(~no_key).select(*keys, F.col("valid_from").alias("t"), F.col("valid_to").alias("p_end"), bucket)
    counted = live.select("bucket").unionByName(valid.select("bucket")).filter("bucket is not null").groupBy("bucket").count()
    # at most one bucket per task_rows rows, and no more than there are buckets
    hot = [(r["bucket"],) for r in counted.filter(F.col("count") > task_rows).collect()]
    salt = F.when(F.col("bucket").isNull(), F.pmod(F.xxhash64("ref_id"), F.lit(NO_KEY_TASKS))).otherwise(0).cast("int")
    live, valid = live.withColumns({"shard": F.lit(None).cast("bigint"), "salt": salt}), valid.withColumns({"shard": F.lit(None).cast("bigint"), "salt": F.lit(0)})
    carried = None
    if hot:
        live, valid, carried = _hot_groups(live, valid, keys, refs.sparkSession.createDataFrame(hot, "bucket int"), shard_ns, task_rows)
    columns = [*keys, "shard", "salt", "t"]
    both = live.select(*columns, F.lit(1).alias("tag"), "ref_table", "ref_id", "at").unionByName(
        valid.select(*columns, F.lit(0).alias("tag"), "p_end"), allowMissingColumns=True
    )
    if carried is not None:
        both = both.unionByName(carried, allowMissingColumns=True)
    group = Window.partitionBy(*keys, "shard", "salt")
    so_far = group.orderBy("t", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # parents come before the references of their time
    swept = both.withColumn("end", F.max("p_end").over(so_far)).withColumn("has_parent", F.max(F.col("tag") == 0).over(group)).filter("tag = 1")
    found = swept.filter(F.col("end").isNull() | F.col("t").isNull() | (F.col("end") <= F.col("at")))
    reason = F.when(~F.col("has_parent"), "absent").when(F.col("end").isNull() | F.col("t").isNull(), "later").otherwise("removed")
    return found.select("ref_table", "ref_id", "at", reason.alias("reason"))


def _hot_groups(
    live: DataFrame, valid: DataFrame, keys: Sequence[str], hot: DataFrame, shard_ns: int, task_rows: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides with ``shard`` and ``salt`` set for the hot buckets, and rows that carry the ends of parents into each group.

    A hot bucket is cut into time shards (references without a time are one). A shard with more than ``task_rows`` references is cut
    by the hash of their ids too, and the parents that start in it go to each of its cuts. Into every group of a key with
    parents goes one row with the largest end of those that started in earlier shards: parents are pre-aggregated per (key,
    shard), and a running maximum runs over the shards of a key.
    """
    shard = F.coalesce(F.col("t") - F.pmod(F.col("t"), F.lit(shard_ns)), F.lit(-_OPEN))
    flagged = hot.withColumn("hot", F.lit(True))

    def cut(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(flagged), "bucket", "left").withColumn("shard", F.when(F.col("hot"), shard)).drop("hot")

    live, valid = cut(live), cut(valid)
    both = live.select("bucket", "shard", F.lit(1).alias("n")).unionByName(valid.select("bucket", "shard", F.lit(0).alias("n")))
    shards = both.filter("shard is not null").groupBy("bucket", "shard").agg(F.ceil((F.sum("n") + 1) / F.lit(task_rows)).cast("int").alias("salts"))
    many = F.broadcast(shards.filter("salts > 1"))  # at most one per task_rows references
    salts = F.coalesce("salts", F.lit(1))
    live = live.join(many, ["bucket", "shard"], "left").withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("ref_id"), F.col("salts")).cast("int")).otherwise(F.col("salt")))
    valid = valid.join(many, ["bucket", "shard"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    ends = valid.filter("shard is not null and salt = 0").groupBy(*keys, "bucket", "shard").agg(F.max("p_end").alias("p_end"))
    before = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    groups = ends.select(*keys, "bucket").distinct().join(shards, "bucket").join(ends.drop("bucket"), [*keys, "shard"], "left")
    earlier = groups.withColumn("p_end", F.max("p_end").over(before))  # before the cuts: within one select they would come first and see each other's ends
    carried = earlier.select(
        *keys, "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-_OPEN - 1).alias("t"), F.lit(0).alias("tag"), "p_end"
    )
    return live, valid, carried


def descriptor_orphans(io_event: DataFrame, op_stats: DataFrame, fd_map: DataFrame, bin_ns: int = HOUR_NS) -> DataFrame:
    """Orphans among the descriptors of ``io_event`` (at ``start_ns``) and ``op_stats`` (within their bin).

    Host names are compared in canonical form; a null or 0 descriptor refers to nothing. Columns as in
    ``orphans``.
    """

    def keys(fd: str) -> dict[str, Column]:
        return {"host": canonical_host(F.col("hostname")), "pid": F.col("pid"), "role": F.col("key"), "fd": F.col(fd)}

    def traced(df: DataFrame, fd: str) -> DataFrame:
        return df.filter(F.col(fd).isNotNull() & (F.col(fd) != 0))

    refs = references(
        traced(io_event, "fd"), "io_event", F.col("event_id"), keys("fd"), F.col("start_ns")
    ).unionByName(
        references(
            traced(op_stats, "fileDescriptor"), "op_stats", F.col("stat_id"), keys("fileDescriptor"), F.col("timeBin"),
            F.try_add(F.col("timeBin"), F.lit(bin_ns - 1)),
        )
    )
    known = parents(fd_map, keys("fileDescriptor"), F.col("first_seen_ns"), F.col("removed_ns"))
    return orphans(refs, known, ["host", "pid", "role", "fd"])


def distinct_orphans(found: DataFrame) -> DataFrame:
    """``(ref_table, ref_id)`` of the orphans, redelivered rows once."""
    return found.select("ref_table", "ref_id").distinct()


def orphan_counts(found: DataFrame, period_ns: int = HOUR_NS) -> DataFrame:
    """Distinct orphan ids per table, period of their time and reason: ``(ref_table, period, reason, n_orphans)``."""
    return (
        found.select("ref_table", "ref_id", (F.col("at") - F.pmod(F.col("at"), F.lit(period_ns))).alias("period"), "reason")
        .distinct()
        .groupBy("ref_table", "period", "reason")
        .agg(F.count(F.lit(1)).alias("n_orphans"))
    )
