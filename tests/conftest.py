from __future__ import annotations

import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from helpers import GOLDEN  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("docweave-tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents from ``(doc, map)`` or ``(w, doc, map)`` tuples."""

    def make(rows, doc_type="long"):
        rows = [(0, *r) if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(rows, f"w long, doc {doc_type}, m map<string,string>")

    return make


@pytest.fixture(scope="session")
def golden(make_documents):
    return make_documents(GOLDEN)
