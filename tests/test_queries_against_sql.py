"""Every core query with SQL gives the same rows as that SQL."""

import pytest

from tests.conftest import normal
from weftgraph.queries import core_queries, core_sql

NAMES = sorted(core_sql())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, testdata, oracle, name):
    got = core_queries()[name](spark, testdata)
    want = oracle(testdata, core_sql()[name])
    assert not want or sorted(got.columns) == sorted(want[0])
    assert normal(got.collect()) == normal(want)


def test_every_sql_has_a_query():
    assert set(core_sql()) <= set(core_queries())


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_empty_tables(spark, empty_store, name):
    assert len(core_queries()[name](spark, empty_store).collect()) <= 1
