"""Training-data queries that SQL can express, over whole tables, and their registration."""

import pytest

import __spark_entry__ as E
from crashlens import catalog
from crashlens.llm import catalog as llm
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, want = llm.queries()[name](spark, SF).toPandas(), duck(SF).execute(llm.oracle_sql()[name]).df()
    assert compare(got, want)["exact"]


def test_the_entry_adds_these_queries_to_the_analytics():
    more = set(E.queries()) - set(catalog.queries())
    assert more == {*llm.queries(), "pipeline"} and len(more) == 14
    assert set(E.oracle_sql()) - set(catalog.oracle_sql()) == set(llm.oracle_sql())
