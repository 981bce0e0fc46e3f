"""Registered queries equal their SQL at the smallest scale; tables that several of them read are stored once."""

import pytest
from compare import compare, database

from shopledger.checks import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
    assert not any(name.startswith("op") and name[2:3].isdigit() for name in QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = database(SMALL)
    ok, message, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SMALL)
    assert ok, message
