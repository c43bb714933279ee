"""Every query of the library against DuckDB on the smallest tables; those without SQL must give rows."""

import pytest
from compare import both, connection

from loomstone.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        ours, theirs = both(df, con, catalog.ORACLES[name])
        assert ours == theirs
    else:
        assert df.columns and df.count() > 0  # what it holds is tested in test_unexpressible.py
