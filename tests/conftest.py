from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from towerlens import session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    built = (
        SparkSession.builder.master("local[4]").appName("towerlens-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    return session.prepare(built)


@pytest.fixture()
def rows(spark):
    """Build a DataFrame whose ``event_time`` text column is a timestamp."""
    from pyspark.sql import functions as F

    def build(data, schema):
        df = spark.createDataFrame(data, schema)
        return df.withColumn("event_time", F.col("event_time").cast("timestamp")) if "event_time" in df.columns else df
    return build
