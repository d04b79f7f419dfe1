"""Every core query with SQL gives the SQL's rows; every other one runs."""

import pytest

from strandline.plans import core_queries, core_sql
from tests.oracle import compare, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, con, name):
    said, _ = compare(spark, con, name, core_queries()[name], core_sql().get(name), SF)
    assert said.startswith(("ok", "rows")), said


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
