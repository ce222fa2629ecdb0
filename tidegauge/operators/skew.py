"""Per-key results when a few keys hold most of the records.

``heavy_keys`` finds every key above a share with a mergeable frequent-items sketch,
``skew_totals`` aggregates the heavy keys apart from the others, and ``salted_join`` /
``skew_join`` join without sending a hot key to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slices that a hot key is cut into.
SALTS = 16


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], salts: int = SALTS, how: str = "inner"
) -> DataFrame:
    """Join ``big`` to ``small`` on ``keys``; every key of ``big`` is spread over ``salts`` tasks.

    ``small`` (about one row a key) is repeated once per salt and ``big`` takes its salt from the hash
    of the ``spread`` columns, so no key needs one task for all of its rows, however the keys are
    distributed. Null keys match nothing, as in any equi-join. ``how`` is ``inner`` or ``left``.
    """
    salt = "__salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, salt], how).drop(salt)


def long_keys(df: DataFrame, fields: dict[str, Column], carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per record and field: ``(field, val, *carry)``. Null values give no row."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), expr.cast("string").alias("val")) for name, expr in fields.items()])
    out = df.select(F.explode(pairs).alias("__p"), *[c.alias(n) for n, c in (carry or {}).items()])
    return out.select("__p.field", "__p.val", *(carry or {})).filter(F.col("val").isNotNull())


def heavy_keys(df: DataFrame, fields: dict[str, Column], support: float) -> DataFrame:
    """``(field, val)`` of every value whose share of the rows exceeds ``support``.

    A Misra-Gries sketch of ``1 / support`` counters per field is built per partition and merged. It
    never misses a value above ``support`` and returns at most ``1 / support`` values per field, some of
    which may be lighter; that bound makes the result safe to broadcast at any size of the input.
    Nulls are no values. An empty input gives no rows.
    """
    columns = df.select(*[expr.cast("string").alias(name) for name, expr in fields.items()])
    sketch = columns.stat.freqItems(list(fields), support)
    per_field = F.array(
        *[F.struct(F.lit(name).alias("field"), F.col(f"`{name}_freqItems`").alias("vals")) for name in fields]
    )
    return (
        sketch.select(F.explode(per_field).alias("__f"))
        .select("__f.field", F.explode("__f.vals").alias("val"))
        .filter(F.col("val").isNotNull())
    )


def listed(heavy: DataFrame) -> DataFrame:
    """The bounded result of ``heavy_keys`` as a local table: the sketch is made once, however often the list is used,
    and plans lose the branch for heavy keys where there are none."""
    return heavy.sparkSession.createDataFrame(heavy.collect(), heavy.schema)


def skew_totals(
    rows: DataFrame, heavy: DataFrame, sums: dict[str, Column], distinct: dict[str, str] | None = None, salts: int = SALTS
) -> DataFrame:
    """Totals per ``(field, val)`` of ``rows`` without a task that holds all rows of a heavy key.

    Heavy keys are picked by a broadcast join with the bounded ``heavy`` list and aggregated in two
    steps, first per salt; the other keys are what the broadcast anti-join leaves and take one ordinary
    shuffle. Both parts are united. ``distinct`` maps an output to an id column to be counted
    distinctly; the salt is a function of the id, so the counts of the salts add up exactly.
    """
    distinct = distinct or {}
    keys = ["field", "val"]
    spread = list(distinct.values())[:1]
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)) if spread else F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    aggs = [F.sum(c).alias(n) for n, c in sums.items()]
    dist = [F.countDistinct(c).alias(n) for n, c in distinct.items()]
    names = [*sums, *distinct]
    hot = (
        rows.join(F.broadcast(heavy), keys, "inner")
        .withColumn("__salt", salt)
        .groupBy(*keys, "__salt")
        .agg(*aggs, *dist)
        .groupBy(*keys)
        .agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("is_heavy", F.lit(True))
    )
    cold = (
        rows.join(F.broadcast(heavy), keys, "left_anti").groupBy(*keys).agg(*aggs, *dist).withColumn("is_heavy", F.lit(False))
    )
    return hot.unionByName(cold)


def skew_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` where ``heavy`` (a bounded list with column ``key``) names the hot keys.

    The rows of ``right`` with heavy keys are broadcast to the left rows with these keys; all other rows
    meet in an ordinary shuffle join. ``right`` must hold at most a few rows a key (a dimension).
    """
    hot = F.broadcast(heavy.select(key).distinct())
    right_hot = right.join(hot, key, "left_semi")
    return (
        left.join(hot, key, "left_semi")
        .join(F.broadcast(right_hot), key, how)
        .unionByName(left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key, how))
    )


def key_totals(
    events: DataFrame, fields: dict[str, Column], sums: dict[str, Column], distinct: dict[str, str] | None = None,
    support: float = 0.005,
) -> DataFrame:
    """Totals and row share per field and value of ``events``: sketch, heavy part, light part, union.

    Columns ``field, val, n_rows, *sums, *distinct, is_heavy, share``; ``share`` is of all stored rows,
    rows with a null value included. Null values form no key; an empty table gives no rows; repeated rows
    count as often as they are stored (``distinct`` counts ids once).
    """
    distinct = distinct or {}
    heavy = listed(heavy_keys(events, fields, support))
    carry = {f"__s_{n}": c for n, c in sums.items()} | {f"__d_{n}": F.col(c) for n, c in distinct.items()}
    rows = long_keys(events, fields, carry)
    totals = skew_totals(
        rows,
        heavy,
        {"n_rows": F.lit(1).cast("bigint")} | {n: F.col(f"__s_{n}") for n in sums},
        {n: f"__d_{n}" for n in distinct},
    )
    n_all = events.agg(F.count(F.lit(1)).alias("n")).scalar()
    return totals.withColumn("share", F.col("n_rows") / n_all)
