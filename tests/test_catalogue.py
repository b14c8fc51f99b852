import pytest
from helpers import compare

from quirefold.plans import decks, encoders, inspections, jobs, lookups  # noqa: F401 (they register their queries)
from quirefold.plans.catalogue import ORACLES, QUERIES

# Large enough that no query's answer is empty.
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name], ORACLES[name], spark, SF) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
