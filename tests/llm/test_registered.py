import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import DATA, assert_same

from talentweave.llm import queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_gives_a_row_for_each_row(spark, name):
    table = {"op3_nearest": "embeddings"}.get(name, "documents")
    rows, got = spark.read.parquet(f"{DATA}/{table}.parquet").count(), queries.queries()[name](spark, DATA).count()
    assert got == (rows if name != "op3_nearest" else 20 * spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 20 = 0").count())
