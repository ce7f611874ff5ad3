import os

import pytest

import __spark_entry__ as E
from pinloom.plans import catalog

TINY = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.QUERIES) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no test data here")
def test_core_queries_run(spark):
    assert E.entry(spark).columns
    for name in ("p2_found", "p6_found", "streaming_search", "ranked_matches", "reachable"):
        assert E.queries()[name](spark, TINY).columns
    assert E.queries()["streaming_search"](spark, TINY).count() == E.queries()["scoped_exact_text"](spark, TINY).count()
