"""The corpus queries that SQL can express against their SQL."""

import os

import pytest

from quillfold.llm import queries
from tests.test_queries import SF, duck, rows  # noqa: F401 - duck is a fixture

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, name):  # noqa: F811
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())
