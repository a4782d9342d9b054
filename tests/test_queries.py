"""Every registered query of the library runs; those with a SQL counterpart give its rows."""

import oracle
import pytest

from coterie.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    query = registry.QUERIES[name]
    if name in registry.ORACLES:
        assert oracle.compare(spark, con, query, registry.ORACLES[name], SF) is None
    else:
        assert query(spark, SF).count() > 0
