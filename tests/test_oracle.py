"""Every registered query of the person library against its oracle on the smallest driver data."""
import os

import pytest

import __spark_entry__ as entry
from checks.compare import check

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: q for part in entry.CORE for name, q in part.QUERIES.items()}
ORACLES = {name: sql for part in entry.CORE for name, sql in part.ORACLES.items()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver data not present")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, name):
    ok, message = check(spark, FOLDER, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
