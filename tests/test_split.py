"""Tuning samples of tables too large to build here, by their expression."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from towerlens.operators import split


@pytest.mark.parametrize("rows", [600_000_000, 900_000_000, 10_000_000_000])
def test_share_of_large_tables_is_kept(spark, rows):
    seen = 4_000_000
    kept = spark.range(seen).where(split.in_sample(F.col("id"), rows, 100_000)).count()
    want = seen * 100_000 / rows
    assert abs(kept - want) < 4 * want**0.5 and kept > 0


def test_sample_reaches_its_size(spark):
    kept = split.tuning_sample(spark.range(50_000).withColumn("g", F.col("id")), "g", max_rows=7).count()
    assert 0 < kept < 25
