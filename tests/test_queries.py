"""Every query of the core against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import both, connect
from tidegauge.plans import problems, streams, telemetry

QUERIES = {n: f for m in (problems, telemetry, streams) for n, f in m.QUERIES.items()}
SQL = {n: q for m in (problems, telemetry, streams) for n, q in m.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name not in SQL:
        assert QUERIES[name](spark, sf_dir).count() > 0
        return
    mine_cols, sql_cols, mine, sql = both(spark, con, QUERIES[name], SQL[name], sf_dir)
    assert mine_cols == sql_cols
    assert mine == sql


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
