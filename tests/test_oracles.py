"""Every registered query of the annotation engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare

from isoloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


def test_all_queries_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
