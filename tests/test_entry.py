"""Every registered query of the core runs on the smallest data and agrees with its SQL."""

from __future__ import annotations

import os

import pytest

from paperloom.plans.oracle import core_sql
from paperloom.plans.queries import REGISTRY
from tests.oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    df = REGISTRY[name](spark, SF)
    sql = core_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) == ""


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "rank"


def test_pagerank_sums_to_one(spark):
    from pyspark.sql import functions as F

    total = REGISTRY["pagerank"](spark, SF).agg(F.sum("score")).first()[0]
    assert abs(total - 1) < 1e-6


def test_stream_equals_batch(spark):
    keep = ["original_id", "title", "authors", "category", "date", "dl"]
    stream, batch = (sorted(map(str, REGISTRY[q](spark, SF).select(*keep).collect())) for q in ("stream_ingest", "ingest_append"))
    assert stream == batch
