"""Every query against its SQL twin on the smallest tables.

The queries run a few at a time, as most of their time here is planning.
"""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from plenum.catalog import ORACLES, QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
AT_ONCE = 4


@pytest.fixture(scope="module")
def problems(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    twin, runs = connect(SF), entry.queries()

    def check(name):
        try:
            return compare(spark, twin.cursor(), SF, runs[name], ORACLES[name])
        except Exception as failed:  # noqa: BLE001 - told by the test of this query
            return f"{type(failed).__name__}: {failed}"[:2000]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(QUERIES, pool.map(check, QUERIES)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_twin(problems, name):
    assert problems[name] is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
