"""Every registered query gives the rows of its SQL on the smallest tables."""

import pytest

from pairforge import bindings
from tests import oracle

SF = "/root/testdata/sf0.001"
bindings.load_all()


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_same_rows_as_sql(spark, db, name):
    assert oracle.difference(bindings.QUERIES[name](spark, SF), db, bindings.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(bindings.QUERIES) - set(bindings.ORACLES)))
def test_runs_without_sql(spark, name):
    assert bindings.QUERIES[name](spark, SF).count() > 0
