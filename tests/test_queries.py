"""Every registered query against its SQL, or, without SQL, that it runs."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from compare import connect, differences

from lodestone.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        assert differences(df, con, ORACLE_SQL[name]) == []
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
