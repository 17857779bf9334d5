"""Equal training rows are gathered, and every one of them counts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from towerlens.operators import training


def table(spark, rows=3_000):
    rng = np.random.default_rng(5)
    data = [(i, float(rng.integers(0, 4) if i % 3 else 0), float(rng.integers(0, 3) if i % 3 else 0), int(rng.random() < 0.3)) for i in range(rows)]
    frame = spark.createDataFrame(data, "id long, a double, b double, y int").repartition(3)
    return training.with_weights(training.assemble(frame, ["a", "b"], "y", ("id",)))


def counts(df, n):
    keys = [vector_to_array("features").cast("string").alias("x"), "label"]
    return {(r.x, r.label): (r.n, round(r.w, 6)) for r in df.groupBy(*keys).agg(n.cast("long").alias("n"), F.sum("weight").alias("w")).collect()}


def test_every_row_counts(spark, monkeypatch):
    rows = table(spark)
    monkeypatch.setattr(training, "GATHER_ROWS", 100)
    found = training.gathered(rows).cache()
    assert counts(found, F.sum(training.COUNT)) == counts(rows, F.count(F.lit(1)))
    # no row stands for more than its share, so bags stay as fine as those of 100 rows
    assert found.agg(F.max(training.COUNT)).first()[0] <= 30
    assert 100 <= found.count() <= 100 + len(counts(rows, F.count(F.lit(1))))
    order = [r.stands_for for r in found.collect()]
    assert order == [r.stands_for for r in training.gathered(rows.repartition(5)).collect()]


def test_trees_and_sigmoids_read_gathered_rows(spark, monkeypatch):
    rows = table(spark)
    plain = training.fit(training.linear(), rows)
    steps = training.calibrate(rows.drop("weight"), ["a", "b"], training.linear(), F.col("id"))
    monkeypatch.setattr(training, "GATHER_ROWS", 100)
    seen = []
    fitted = type(training.linear()).fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, *a: seen.append(df.count()) or fitted(self, df, *a))
    again = training.fit(training.linear(), rows)
    assert max(seen) < 150
    assert again.coefficients.toArray() == pytest.approx(plain.coefficients.toArray(), abs=1e-4)
    after = training.calibrate(rows.drop("weight"), ["a", "b"], training.linear(), F.col("id"))
    assert max(seen) < 250
    for (_, slope, offset), (_, slope2, offset2) in zip(steps.members, after.members):
        assert (slope2, offset2) == pytest.approx((slope, offset), abs=1e-3)
    # an estimator that does not weigh rows sees them one by one
    seen.clear()
    training.fit(LogisticRegression(), rows)
    assert seen == [3_000]
