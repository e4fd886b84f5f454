"""Every registered query against its SQL on the smallest driver tables."""

import pytest

from plumbline.queries import ORACLES, QUERIES
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
CHECKED = sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    # a filter may leave nothing on the smallest tables; equality is what counts here
    problems = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert [p for p in problems if "oracle has no rows" not in p] == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
