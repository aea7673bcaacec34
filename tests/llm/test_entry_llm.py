"""Every query of the subpackage runs on the smallest data and agrees with its SQL."""

from __future__ import annotations

import os

import pytest

from paperloom.llm.queries import REGISTRY, llm_sql
from tests.oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, name):
    df = REGISTRY[name](spark, SF)
    sql = llm_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert compare(df, connect(SF), sql) == ""
