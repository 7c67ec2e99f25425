import pytest

import lattica.plans.extra  # noqa: F401
import lattica.plans.more  # noqa: F401
from lattica.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name]) is None
