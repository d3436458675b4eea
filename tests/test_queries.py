"""Every query of the engine against its DuckDB oracle, on the smallest tables."""

import os

import pytest

from motionweave.plans import registry
from tests.oracle import duck, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_oracle(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck(registry.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
