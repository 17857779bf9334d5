from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import hard_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, row string, vec string, leaf int"


def brute(rows):
    """The definition, by Python integers over all pairs; ties between equal ids by any order."""
    fit = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        fit.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    last = lambda i: math.inf if i is None else i
    found = []
    for k, (i, v, label) in enumerate(fit):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for n, (j, w, other) in enumerate(fit) if n != k]
        mine = sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], last(s[1])))[:5]
        for score, positive, _ in mine:
            fits = sorted((s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=lambda s: (-s[0], last(s[1])))
            found += [(i, positive, r, j, score, s) for r, (s, j, _) in enumerate(fits[:10], 1)]
    return sorted(found, key=str)


def run(spark, tmp_path, rows):
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*r, "r", "v", 9) for r in rows], SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    return sorted([tuple(r) for r in op.query(spark, path).collect()], key=str)


def vectors(n, width, seed, clusters=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.12, (clusters, width))
    label = rng.integers(0, clusters, n)
    return (middle[label] + rng.normal(0, 0.06, (n, width))).astype(np.float32), label


def test_clusters_against_brute_force(spark, tmp_path):
    x, label = vectors(900, 12, 5)
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(900)]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows) and len(got) > 200


def test_nulls_ties_repeats_and_odd_vectors(spark, tmp_path):
    x, label = vectors(120, 4, 2, 3)
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(120)]
    rows += [(300, None, 1), (301, [0.1, None, 0.2, 0.3], 1), (302, [0.1, float("nan"), 0.2, 0.3], 1), (303, [float("inf")] * 4, 2), (304, [0.1] * 4, None)]
    rows += [(400 + i, [0.2, 0.2, 0.1, 0.0], i % 2) for i in range(40)]  # one common vector
    rows += [(None, [0.3, 0.2, 0.1, 0.1], 1), (500, [0.4], 1), (600, [], 2), (601, [], 1), (700, [0.0] * 4, 0), (800, [-0.3] * 4, 0)]
    rows += [(901, [0.25, 0.2, 0.1, 0.0], 1), (901, [0.25, 0.2, 0.1, 0.0], 1), (1000, [0.25, 0.2, 0.1, 0.0], 2), (1000, [0.25, 0.2, 0.1, 0.0], 2)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_and_alone(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    assert run(spark, tmp_path / "b", [(100, [0.5, 0.5], 1)]) == []
    assert run(spark, tmp_path / "c", [(100, None, 1), (200, [0.1], None)]) == []


def test_split_points_prune_and_never_lose(spark):
    """Bounds hold for every row of every leaf, and keep well separated leaves out."""
    session.ship_package(spark)
    x, label = vectors(4_000, 6, 1, 6)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i])) for i in range(4_000)], "vec_id long, embedding array<float>, label int")
    index = op.build(op.points(rows), sample_rows=600)
    assert len(index.tree.way) > 10 and max(index.blocks.values()) >= 1
    leaves, stored = defaultdict(list), index.rows.select("vec", "leaf").collect()
    for r in stored:
        leaves[r.leaf].append(r.vec)
    anchors = np.array([r.vec for r in stored[:50]], np.float64)
    least, most = index.bounds(anchors)
    kept = 0
    for leaf, members in leaves.items():
        scores = anchors @ np.array(members, np.float64).T
        assert (scores >= least[:, leaf][:, None]).all() and (scores <= most[:, leaf][:, None]).all()
        kept += (most[:, leaf] >= 0.9 * (anchors * anchors).sum(1)).sum()
    assert kept < 0.6 * len(leaves) * len(anchors)


def test_large_numbers_and_wide_blocks():
    a = np.array([[2**40, 3], [1, -2]])
    assert op.products(a, a).tolist() == [[op.MOST, 2**40 - 6], [2**40 - 6, 5]]
    lists = pa.array([[1, 2], [], [5]], pa.list_(pa.int64()))
    assert op.matrix(lists, 3).tolist() == [[1, 2, 0], [0, 0, 0], [5, 0, 0]]
    assert op.matrix(lists[1:], 2).tolist() == [[0, 0], [5, 0]]


def test_many_blocks_of_one_leaf(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 16)
    monkeypatch.setattr(op, "CHUNK_ANCHORS", 2)
    x, label = vectors(300, 3, 9, 2)
    data = [(i, [float(v) for v in x[i % 30]], int(label[i])) for i in range(300)]
    rows = op.points(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
    got = op.mine(rows, F.col("vec_id") % 100 == 0).collect()
    relabelled = [(i, v, (y - 1) % 10 if i % 7 == 0 else y) for i, v, y in data]  # brute() turns them back
    assert sorted([tuple(r) for r in got], key=str) == brute(relabelled)


def test_sample_is_gathered_from_few_rows(spark, monkeypatch):
    """the driver gets the sample once, not once from every task."""
    rows = spark.range(40_000, numPartitions=16).select(F.col("id").alias("row"), F.array(F.col("id")).alias("vec"))
    first = [r[0] for r in rows.select("vec").orderBy(F.xxhash64("row"), "row").limit(400).collect()]
    passed = []

    def counted(rows, wanted, count, below=op._below):
        found = below(rows, wanted, count)
        passed.append(found.count())
        return found

    monkeypatch.setattr(op, "_below", counted)
    assert op._sample(rows, 400, 40_000) == first
    assert len(passed) == 1 and 400 <= passed[0] < 1_000
    monkeypatch.setattr(op, "_below", lambda rows, wanted, count: counted(rows, wanted // 8, count))  # a bound too low
    assert op._sample(rows, 400, 40_000) == first
    assert op._sample(rows.limit(0), 400, 0) == []
    assert len(op._sample(rows.filter("row < 7"), 400, 7)) == 7


def test_no_table_of_vectors_is_broadcast(spark, monkeypatch):
    """packed files look small to the planner; the driver would hold what they unfold to."""
    x, label = vectors(600, 8, 4)
    data = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(600)]
    rows = op.points(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
    plans, stage = [], op.common.stage

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label)

    monkeypatch.setattr(op.common, "stage", seen)
    found = op.mine(rows, F.col("vec_id") % 100 == 0)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("BroadcastExchange" in p for p in plans)
