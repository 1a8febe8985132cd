"""Every registered query against its SQL in DuckDB, row for row."""

import pytest

from compare import compare, duck
from prodseries.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, registry.QUERIES[name], registry.ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 678
    assert set(e.oracle_sql()) <= set(e.queries())
