"""Every catalogue query against its oracle."""

import pytest

import __spark_entry__ as entry_point
from compare import differences, oracle

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), oracle(ORACLES[name], SF)) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
