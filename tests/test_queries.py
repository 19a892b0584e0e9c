import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import DATA, assert_same

from talentweave.plans.queries import QUERIES, SQL


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])
