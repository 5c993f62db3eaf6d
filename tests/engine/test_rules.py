"""Rules on literal rows against rows derived by hand."""

import duckdb
import pytest

from tests.engine.duck import same
from tests.engine.rule_cases import CASES


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    f, sql = CASES[name]
    df = f(spark, "")
    if sql is None:
        assert not df.isEmpty()
        return
    same(df, duckdb.sql(sql))
