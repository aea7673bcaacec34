from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession


def make_session(cores: int | None = None) -> SparkSession:
    """A local session; on a cluster the settings come from the submitter."""
    spark = (
        SparkSession.builder.master(f"local[{cores or os.environ.get('TEST_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return make_session()
