"""Every query of the core against its twin in DuckDB, on the smallest tables."""

import pytest

from parity import compare, connect
from tallyweave.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_twin(spark, con, name):
    assert compare(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE[name])[1] == ""


def test_without_a_twin():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"w8_shared_key_components"}
