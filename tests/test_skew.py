"""Heavy keys, totals and joins on skewed keys."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidegauge.operators import skew as S


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i bigint, v string").repartition(5)


def test_heavy_keys_miss_nothing(spark):
    rng = random.Random(1)
    values = ["a"] * 400 + ["b"] * 150 + [str(rng.randrange(3000)) for _ in range(1450)] + [None] * 100
    rng.shuffle(values)
    got = {r["val"] for r in S.heavy_keys(rows(spark, values), {"v": F.col("v")}, 0.05).collect()}
    assert {"a", "b"} <= got
    assert len(got) <= 20 and None not in got


def test_totals_match_a_plain_aggregation(spark):
    rng = random.Random(2)
    values = ["a"] * 300 + [rng.choice("bcdefgh") for _ in range(200)] + [None] * 50
    df = rows(spark, values).withColumn("field", F.lit("clash")).withColumn("id", F.col("i") % 90)
    got = S.key_totals(df, {"v": F.col("v")}, {"total": F.col("i")}, {"n_ids": "id"}, support=0.2).collect()
    want = Counter(v for v in values if v is not None)
    assert {r["val"]: r["n_rows"] for r in got} == dict(want)
    assert {r["val"]: r["n_ids"] for r in got} == {v: len({i % 90 for i, x in enumerate(values) if x == v}) for v in want}
    assert {r["val"]: r["total"] for r in got} == {v: sum(i for i, x in enumerate(values) if x == v) for v in want}
    a = next(r for r in got if r["val"] == "a")
    assert a["is_heavy"] and abs(a["share"] - 300 / 550) < 1e-9


def test_empty(spark):
    assert S.key_totals(rows(spark, []), {"v": F.col("v")}, {}).count() == 0


def test_joins(spark):
    big = rows(spark, ["a"] * 50 + ["b", "c", None])
    small = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "v string, w int")
    plain = sorted(map(tuple, big.join(small, "v").collect()))
    assert sorted(map(tuple, S.salted_join(big, small, ["v"], ["i"]).collect())) == plain
    left = S.salted_join(big, small, ["v"], ["i"], how="left")
    assert left.count() == 53 and left.filter("w is null").count() == 2
    heavy = spark.createDataFrame([("a",), ("a",)], "v string")
    assert sorted(map(tuple, S.skew_join(big, small, "v", heavy).collect())) == plain
