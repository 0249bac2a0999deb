"""Every registered query against DuckDB over the smallest tables."""

import pytest

from quill.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert oracle.compare(df, con, registry.ORACLES[name]) is None
    else:
        assert df.count() >= 0
