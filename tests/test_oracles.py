"""Every analytics query against its SQL twin, over the smallest tables."""

import pytest
from oracle import connect, difference

from skerry import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLES:
        assert difference(df, con, catalog.ORACLES[name]) is None
    else:
        assert df.count() > 0
