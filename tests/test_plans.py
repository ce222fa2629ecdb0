"""Physical plans: no cross joins, pruned columns, filters that reach the scan."""

import re

import pytest

from tidegauge.plans import problems, telemetry

QUERIES = {n: f for m in (problems, telemetry) for n, f in m.QUERIES.items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_udf(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/op_stats.parquet")
    from tidegauge.operators.aggregate import sum_by

    text = plan(sum_by(rows, ["source", "timeBin"], ["data"]).filter("source = 'jvm'"))
    assert "EqualTo(source,jvm)" in text
    assert re.search(r"ReadSchema: struct<timeBin:bigint,source:string,data:bigint>", text)


def test_python_only_in_the_merge(spark, sf_dir):
    for name in ("p1_found", "p3_found", "p3_accepted", "p4_grid", "p5_found", "agg_live", "align_timeline", "zip_refcount"):
        assert "InArrow" not in plan(QUERIES[name](spark, sf_dir)) and "InPandas" not in plan(QUERIES[name](spark, sf_dir))
