"""Split groups must give what plain windows give, whatever the limit."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from towerlens.operators import curves, quantiles, sequence, slices
from towerlens.operators.slices import Order


def skewed(spark, rows=900, seed=1):
    """One key holds most rows and many share a timestamp."""
    r = random.Random(seed)
    data = [
        ("hot" if r.random() < 0.6 else r.choice("abcde"), r.choice([5, r.randrange(400)]), i, r.choice("xyz"), int(r.random() < 0.1))
        for i in range(rows)
    ]
    return spark.createDataFrame(data, "k string, t long, id long, name string, flag int").repartition(3)


def same(left, right):
    a, b = sorted(map(tuple, left.collect())), sorted(map(tuple, right.collect()))
    assert a == b


@pytest.mark.parametrize("limit", [40, 200, None])
def test_running_totals(spark, limit):
    df = skewed(spark)
    sliced = slices.slice_groups(df, ("k",), ("t", "id"), limit)
    assert sliced.split == (limit is not None)
    got = slices.running(sliced, {"s": F.col("flag"), "n": F.lit(1)})
    got = slices.running(got, {"per_name": F.lit(1)}, extra=["name"])
    got = slices.running(got, {"top": F.col("t")}, how="max", inclusive=False)
    got = slices.running(got, {"later": F.when(F.col("flag") == 1, F.col("t"))}, how="min", inclusive=False, backwards=True)
    got = slices.with_group_total(got, {"all": F.col("flag")})
    w = Window.partitionBy("k").orderBy("t", "id")
    wn = Window.partitionBy("k", "name").orderBy("t", "id")
    expected = df.withColumns({
        "s": F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.row_number().over(w), "per_name": F.row_number().over(wn),
        "top": F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "later": F.min(F.when(F.col("flag") == 1, F.col("t"))).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "all": F.sum("flag").over(Window.partitionBy("k")),
    })
    names = ["k", "id", "s", "n", "per_name", F.coalesce("top", F.lit(-1)), F.coalesce("later", F.lit(-1)), "all"]
    same(got.rows().select(*names), expected.select(*names))


@pytest.mark.parametrize("limit", [3, 40, None])
def test_lags_cross_slice_borders(spark, limit):
    df = skewed(spark, 300, seed=2)
    haloed = slices.with_previous_rows(slices.slice_groups(df, ("k",), ("t", "id"), limit), 5)
    lags = {f"l{i}": F.coalesce(F.lag("id", i).over(haloed.window()), F.lit(-1)) for i in range(1, 6)}
    got = slices.without_ghosts(haloed.on(haloed.df.withColumns(lags))).rows()
    w = Window.partitionBy("k").orderBy("t", "id")
    expected = df.withColumns({f"l{i}": F.coalesce(F.lag("id", i).over(w), F.lit(-1)) for i in range(1, 6)})
    same(got.select("id", "l1", "l2", "l3", "l4", "l5"), expected.select("id", "l1", "l2", "l3", "l4", "l5"))


@pytest.mark.parametrize("mode", ["documented", "literal"])
@pytest.mark.parametrize("limit", [25, None])
def test_sequence_features_with_a_hot_tower(spark, limit, mode):
    df = skewed(spark, 400, seed=3).withColumns({
        "event_time": F.timestamp_seconds("t"), "is_cell_unavailable": F.col("flag"),
        "alarm_name": F.col("name"), "alarm_name_encoded": F.ascii("name")})
    sliced = slices.slice_groups(df, ("k",), ("event_time", "id"), limit)
    got = sequence.future_outage(sequence.outages_before(sequence.gap_minutes(sequence.lag_features(sliced))), mode=mode).rows()
    towers: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["k"], r["t"], r["id"])):
        towers.setdefault(r["k"], []).append(r)
    expected = []
    for series in towers.values():
        flags = [r["flag"] for r in series]
        for i, r in enumerate(series):
            gap = (r["t"] - series[i - 1]["t"]) / 60 if i else 0.0
            previous = ord(series[i - 5]["name"]) if i >= 5 else -1
            if mode == "documented":
                target = int(any(flags[i + 1:]))
            else:
                target = int(i > 0 and any(flags[i - 1:]))
            expected.append((r["id"], previous, round(gap, 6), sum(flags[:i]), target))
    rows = [(r["id"], r["previous_alarm_5"], round(r["time_gap_previous_alarm"], 6),
             r["previous_cell_unavailable_count"], r["target"]) for r in got.collect()]
    assert sorted(rows) == sorted(expected)


def test_towers_do_not_leak_into_each_other(spark):
    data = [("a", i, f) for i, f in enumerate([1, 0, 0])] + [("b", i, f) for i, f in enumerate([0, 1, 0])]
    df = spark.createDataFrame(data, "k string, t long, is_cell_unavailable int")
    sliced = slices.slice_groups(df, ("k",), ("t",))
    got = sequence.future_outage(sequence.outages_before(sliced)).rows().orderBy("k", "t").collect()
    assert [r["previous_cell_unavailable_count"] for r in got] == [0, 1, 1, 0, 0, 1]
    assert [r["target"] for r in got] == [0, 0, 0, 1, 0, 0]


@pytest.mark.parametrize("limit", [10, None])
def test_global_index(spark, limit):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("v"))
    got = slices.global_index(df, ("v",), "at", limit).collect()
    assert [r["at"] for r in sorted(got, key=lambda r: r["v"])] == list(range(100))


@pytest.mark.parametrize("limit", [20, None])
def test_quantiles(spark, limit):
    np = pytest.importorskip("numpy")
    r = random.Random(5)
    data = [(r.choice("ab"), round(r.gauss(0, 5), 1)) for _ in range(401)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {x["g"]: x for x in quantiles.quantiles(df, "v", (0.25, 0.5, 0.9), ("g",), limit=limit).collect()}
    for g in "ab":
        values = [v for k, v in data if k == g]
        for p, name in ((25, "p25"), (50, "p50"), (90, "p90")):
            assert got[g][name] == pytest.approx(np.percentile(values, p), abs=1e-9)


@pytest.mark.parametrize("limit", [5, None])
@pytest.mark.parametrize("data", [
    [(0.9, 1), (0.9, 0), (0.5, 1), (0.5, 1), (0.1, 0), (0.2, 0), (0.3, 1), (0.35, 0)],
    [(0.4, 1), (0.6, 1)], [(0.4, 0), (0.6, 0)], [(0.5, 1)],
])
def test_areas_against_the_definition(spark, data, limit):
    df = spark.createDataFrame(data, "s double, y int")
    points = curves.curve_points(df, "s", "y", limit=limit)
    row = curves.areas(points).first()
    positives, negatives = sum(y for _, y in data), sum(1 - y for _, y in data)
    before, pr, ap, roc = (0.0, 1.0, 0.0), 0.0, 0.0, 0.0
    best = (-1.0, 0.0)
    for edge in sorted({s for s, _ in data}, reverse=True):
        tp = sum(y for s, y in data if s >= edge)
        fp = sum(1 - y for s, y in data if s >= edge)
        recall = tp / positives if positives else 0.0
        precision, fpr = tp / (tp + fp), fp / negatives if negatives else 0.0
        pr += (recall - before[0]) * (precision + before[1]) / 2
        ap += (recall - before[0]) * precision
        roc += (fpr - before[2]) * (recall + before[0]) / 2
        before = (recall, precision, fpr)
        best = max(best, (2 * precision * recall / (precision + recall + 1e-10), -edge))
    assert (row["pr_auc"], row["average_precision"], row["roc_auc"]) == pytest.approx((pr, ap, roc))
    chosen = curves.best_threshold(points).first()
    assert (chosen["f1"], chosen["threshold"]) == pytest.approx((best[0], -best[1]))


def test_descending_order(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "s double")
    sliced = slices.slice_groups(df, (), (Order("s", descending=True),))
    got = {r["s"]: r["n"] for r in slices.running(sliced, {"n": F.lit(1)}).rows().collect()}
    assert got == {3.0: 1, 2.0: 2, 1.0: 3}


def test_null_keys_do_not_depend_on_the_limit(spark):
    rows = [(None if i % 2 else "a", None if i % 3 else "x", i) for i in range(24)]
    df = spark.createDataFrame(rows, "k string, name string, t int")
    found = []
    for limit in (1_000, 3):
        sliced = slices.slice_groups(df, ("k",), ("t",), limit)
        counted = slices.running(sliced, {"n": F.lit(1)}, extra=["name"])
        total = slices.with_group_total(counted, {"all": F.lit(1)})
        found.append(sorted(tuple(r) for r in total.rows().select("t", "n", "all").collect()))
    want = [(t, sum(r[:2] == rows[t][:2] for r in rows[:t + 1]), 12) for t in range(24)]
    assert found == [want, want]
