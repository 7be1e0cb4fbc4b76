"""Every registered query over the planar-geometry tables against its SQL twin."""

import oracle
import pytest
from conftest import SMALL

from facetframe.plans import pass_queries, registry

#: Their operators are held against plain versions in test_extraction.py; each takes half a minute and more.
LONG = {name for name, (_, sql) in pass_queries.QUERIES.items() if sql is None} - {"g07_label_pass", "g13_guarded_leftovers"}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, duck, name):
    assert oracle.differences(registry.QUERIES[name](spark, SMALL), duck, registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - LONG))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
