"""Registered queries against their SQL."""

import os

import pytest
from check import compare, connect

from bazaarlens.plans import ORACLES, QUERIES

FOLDER = os.environ.get("BAZAARLENS_SF", "/root/testdata/sf0.001")
NAMES = list(ORACLES)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, name, FOLDER, con)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
