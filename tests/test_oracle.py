"""All registered queries on the smallest tables against their DuckDB texts.

Two that boost hundreds of trees for a minute each only run with PROCSPARK_ALL_QUERIES=1; ``python -m tests.check`` runs
queries on the larger tables.
"""

import os

import pytest

import __spark_entry__ as entry_point
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SLOW = {"evaluation_run", "second_stage_classifier"}
NAMES = sorted(n for n in entry_point.queries() if n not in SLOW or os.environ.get("PROCSPARK_ALL_QUERIES"))


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry_point.queries()[name](spark, SF).toPandas()
    text = entry_point.oracle_sql().get(name)
    if text is not None:
        assert compare(got, duck.execute(text).df()) == "ok"


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_text_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
