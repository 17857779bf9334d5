"""Permutation importance against one pass per permutation over plain rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from towerlens.operators import training


def average_precision(scores, labels):
    """Step-wise, equal scores at one point."""
    area, hit, seen = 0.0, 0, 0
    for s in sorted(set(scores), reverse=True):
        here = [y for x, y in zip(scores, labels) if x == s]
        hit, seen = hit + sum(here), seen + len(here)
        area += sum(here) / sum(labels) * hit / seen
    return area


@pytest.mark.parametrize("rows", [97, training.FACTORS[0] % 1_000 + 300])
def test_matches_one_pass_per_permutation(spark, monkeypatch, rows):
    monkeypatch.setattr(training, "BLOCK", 64)
    rng = np.random.default_rng(rows)
    data = [(i, int(rng.integers(0, 9)), None if i % 11 == 0 else float(rng.integers(0, 5)), int(rng.integers(0, 3) == 0)) for i in range(rows)]
    frame = spark.createDataFrame(data, "id long, a int, b double, y int")

    def score(df):
        return df.withColumn("outage_probability", (F.col("a") + 3 * F.coalesce("b", F.lit(0.5))) / 100)

    got = {r.feature: r.importance for r in training.permutation_importance(frame, ["a", "b"], score, "y", ["id"], 3).collect()}
    data.sort(key=lambda r: (hashlib.md5(f"{r[0]}|42".encode()).hexdigest(), r[0]))
    rate = lambda a, b: (a + 3 * (0.5 if b is None else b)) / 100
    labels = [r[3] for r in data]
    base = average_precision([rate(r[1], r[2]) for r in data], labels)
    for i, name in enumerate(("a", "b")):
        drops = []
        for k in range(3 * i, 3 * i + 3):
            factor = next(f for f in training.FACTORS[k % 10:] + training.FACTORS if np.gcd(f, rows) == 1)
            values = {(at * factor + (k + 1) * training.STEP) % rows: r[i + 1] for at, r in enumerate(data)}
            scores = [rate(values[t], r[2]) if i == 0 else rate(r[1], values[t]) for t, r in enumerate(data)]
            drops.append(base - average_precision(scores, labels))
        assert got[name] == pytest.approx(np.mean(drops), abs=1e-12)


def test_rows_given_their_own_value_are_scored_once(spark):
    """What is scored are the rows as they are and those that a permutation changes."""
    frame = spark.createDataFrame([(i, None if i % 50 == 0 else int(i % 10 == 0), i % 7, int(i % 3 == 0)) for i in range(500)], "id long, a int, b int, y int")
    seen = []

    def score(df):
        seen.append(df.select("a", "b").collect())
        return df.withColumn("outage_probability", (2 * F.coalesce("a", F.lit(3)) + F.col("b")) / 100)

    got = {r.feature: r.importance for r in training.permutation_importance(frame, ["a", "b"], score, "y", ["id"], 2).collect()}
    assert set(got) == {"a", "b"} and len(seen[0]) == 500
    assert 0 < len(seen[1]) < 2 * 500 * 0.4 and 2 * 500 * 0.7 < len(seen[2]) < 2 * 500


def test_positions_beyond_32_bits():
    rows, at = 3_000_000_007, np.array([0, 1, 2_999_999_999, 3_000_000_006])
    for k in (0, 129):
        want = [(int(a) * training.FACTORS[k % 10] + (k + 1) * training.STEP) % rows for a in at]
        assert training._moved_to(at, k, rows).tolist() == want


def test_values_travel_in_packed_blocks(spark):
    """Rows shuffled are messages per block, not one row per value and permutation."""
    frame = spark.range(20_000).select(F.col("id").alias("_at"), (F.col("id") % 7).alias("a"))
    plan = training._permuted_values(frame, ["a"], 10, 20_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "decimal" not in plan and "MapInArrow" in plan
