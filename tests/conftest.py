import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("statweave-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(monkeypatch):
    """Thresholds so small that little tables take the paths meant for huge ones."""
    from statweave.operators import cleaning, correlation, resampling, timeseries
    from statweave.plans import gram, positions, quantiles, ranks, tables

    for module, name, value in [
        (ranks, "ROWS_PER_RANGE", 7),
        (quantiles, "DISTINCT_LIMIT", 3),
        (quantiles, "SKETCH_ACCURACY", 100),
        (positions, "ROWS_PER_CHUNK", 5),
        (tables, "BROADCAST_ROWS", 1),
        (gram, "WIDE", 1),
        (correlation, "WIDE", 1),
        (correlation, "HOT_SHARE", 5),
        (resampling, "VALUES_PER_TASK", 4),
        (cleaning, "KNN_QUERIES", 2),
        (cleaning, "KNN_DONORS", 5),
        (timeseries, "SMOOTHING_ROWS", 6),
        (timeseries, "FAN_IN", 2),
    ]:
        monkeypatch.setattr(module, name, value)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
