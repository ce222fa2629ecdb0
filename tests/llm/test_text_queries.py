"""Text queries on the smallest tables, against SQL where SQL can say them."""

import pytest

from compare import both, connect
from tidegauge.llm import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, sf_dir, name):
    if name not in plans.ORACLE_SQL:
        assert plans.QUERIES[name](spark, sf_dir).columns
        plans.QUERIES[name](spark, sf_dir).count()
        return
    mine_cols, sql_cols, mine, sql = both(spark, con, plans.QUERIES[name], plans.ORACLE_SQL[name], sf_dir)
    assert mine_cols == sql_cols
    assert mine == sql
