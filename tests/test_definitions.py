"""Grid features and interval analyses against brute force on small data."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from towerlens.operators import intervals, sliding
from towerlens.settings import Settings

START = datetime(2024, 1, 1, 3, 20)
NAMES = ["Cell Unavailable", "RF Unit Fault", "BBU Board Fault", "Mains Input Failure", "S1 Interface Fault", "Cell Outage"]


def sample(seed: int, count: int = 160):
    """Events with repeated times, some exactly on grid points, one tower very busy."""
    r = random.Random(seed)
    rows = []
    for i in range(count):
        t = START + timedelta(minutes=r.randrange(60 * 40))
        if r.random() < 0.2:
            t = t.replace(minute=0, hour=t.hour - t.hour % 2)
        if r.random() < 0.2 and rows:
            t = r.choice(rows)[1]
        tower = "hot" if r.random() < 0.5 else r.choice("abc")
        rows.append((tower, t, i, r.choice(NAMES), r.choice(["Critical", "Critical", "Major", "Minor"])))
    rows.append(("solo", START + timedelta(hours=5), count, NAMES[0], "Critical"))
    return rows


def frame(spark, rows):
    data = [(k, t.strftime("%Y-%m-%d %H:%M:%S"), i, n, s) for k, t, i, n, s in rows]
    df = spark.createDataFrame(data, "entity string, event_time string, log_serial_number long, alarm_name string, severity string")
    return df.withColumns({
        "event_time": F.col("event_time").cast("timestamp"), "site_id": F.col("entity"),
        "node_identifier": F.concat("entity", F.lit("-"), "log_serial_number"),
        "enodeb_id": F.col("entity"), "gnodeb_id": F.lit("-")})


def floor2(t):
    return t.replace(hour=t.hour - t.hour % 2, minute=0, second=0)


def grid(rows):
    low, high = floor2(min(r[1] for r in rows)), max(r[1] for r in rows)
    points, t = [], low
    while t < high:
        points.append(t)
        t += timedelta(hours=2)
    return [*points, t]


def brute(rows, hours, streak_hours):
    out = {}
    for tower in {r[0] for r in rows}:
        events = sorted((r for r in rows if r[0] == tower), key=lambda r: (r[1], r[2]))
        for t in grid(rows):
            seen = [e for e in events if t - timedelta(hours=hours) <= e[1] < t]
            crit = [e[4] == "Critical" for e in events if t - timedelta(hours=streak_hours) <= e[1] < t]
            ahead = [e for e in events if t <= e[1] < t + timedelta(hours=2)]
            out[tower, t] = (
                len(seen), sum(e[4] == "Critical" for e in seen), sum("rf" in e[3].lower() for e in seen),
                int(any(a and b for a, b in zip(crit, crit[1:]))),
                int(any(e[3] == "Cell Unavailable" for e in ahead)), int(any(e[3] == "Cell Outage" for e in ahead)),
            )
    return out


@pytest.mark.parametrize("hours, seed, limit", [(6, 1, None), (24, 2, 20), (5, 3, None), (3, 4, 15), (2, 5, None)])
def test_lookbacks_streak_and_targets(spark, hours, seed, limit):
    rows = sample(seed)
    got = sliding.lookback_features(frame(spark, rows), Settings(lookback_hours=(hours,)), limit=limit).collect()
    found = {
        (r["entity"], r["window_timestamp"]): (
            r[f"total_alarms_{hours}h"], r[f"critical_alarms_{hours}h"], r[f"rru_alarms_{hours}h"],
            r[f"consecutive_critical_streak_{hours}h"], r["target_cell_unavailable_2h"], r["target_cell_outage_2h"])
        for r in got
    }
    assert len(found) == len(got)
    assert found == brute(rows, hours, hours)
    firsts = {}
    for k, _, i, _, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        firsts.setdefault(k, f"{k}-{i}")
    assert {r["entity"]: r["node_identifier"] for r in got} == firsts


@pytest.mark.parametrize("seed", [6, 7])
def test_sparse_points_agree_with_dense_ones(spark, seed):
    df = frame(spark, sample(seed, 40))
    settings = Settings(lookback_hours=(4, 6))
    dense = {(r["entity"], r["window_timestamp"]): r for r in sliding.lookback_features(df, settings).collect()}
    sparse = sliding.lookback_features(df, settings, dense=False).collect()
    kept = {(r["entity"], r["window_timestamp"]) for r in sparse}
    for r in sparse:
        assert r == dense[r["entity"], r["window_timestamp"]]
    for key, r in dense.items():
        if r["total_alarms_6h"] > 0 or r["target_outage_next_2h"] == 1:
            assert key in kept


def test_no_active_target_means_no_outage(spark):
    df = frame(spark, sample(8, 30))
    got = sliding.lookback_features(df, Settings(active_targets=(), active_features=(), lookback_hours=(6,)))
    assert "bbu_alarms_6h" not in got.columns
    assert {r[0] for r in got.select("target_outage_next_2h").distinct().collect()} == {0}


@pytest.mark.parametrize("limit", [None, 20])
def test_precursors(spark, limit):
    rows = sample(9)
    expected, by_name = {}, {}
    for k, t, _, n, _ in rows:
        if n != "Cell Unavailable":
            continue
        for k2, t2, _, n2, _ in rows:
            if k2 == k and n2 != "Cell Unavailable" and t - timedelta(hours=1) <= t2 < t:
                key = (k, n2, t, t2)
                expected[key] = expected.get(key, 0) + 1
                by_name[n2] = by_name.get(n2, 0) + 1
    df = frame(spark, rows)
    got = {
        (r["enodeb_id"], r["precursor_alarm_name"], r["unavailable_time"], r["precursor_time"]): r["pairs"]
        for r in intervals.precursor_pairs(df).collect()
    }
    assert got == expected
    counts = intervals.precursor_counts(df, limit=limit).collect()
    assert {r["precursor_alarm_name"]: r["pairs"] for r in counts} == by_name


@pytest.mark.parametrize("limit", [None, 20])
def test_cooccurrence(spark, limit):
    rows = sample(10)
    edge = START + timedelta(days=3)
    rows += [("e", edge, 900, NAMES[1], "Minor"), ("e", edge + timedelta(minutes=30), 901, NAMES[2], "Minor"),
             ("e", edge + timedelta(minutes=60, seconds=1), 902, NAMES[3], "Minor"), ("e", edge, 903, NAMES[4], "Minor")]
    expected: dict = {}
    names = [n for n in NAMES if n != "Cell Unavailable"]
    for k, t, _, n, _ in rows:
        if n not in names:
            continue
        following = {n2 for k2, t2, _, n2, _ in rows if k2 == k and n2 in names and t < t2 <= t + timedelta(minutes=30)}
        for other in following:
            expected[n, other] = expected.get((n, other), 0) + 1
    got = intervals.cooccurrence(frame(spark, rows), limit=limit).collect()
    assert {(r[0], r[1]): r[2] for r in got if r[2]} == expected
    assert len(got) == len(names) ** 2


@pytest.mark.parametrize("limit", [None, 20])
def test_lead_time_prevalence(spark, limit):
    rows = sample(11)
    outages = [r for r in rows if r[3] == "Cell Unavailable"]

    def preceded(word):
        return sum(any(
            k2 == k and word in n2.lower() and t - timedelta(hours=6) <= t2 <= t - timedelta(hours=1)
            for k2, t2, _, n2, _ in rows) for k, t, _, _, _ in outages)

    got = {r["category"]: (r["preceded"], r["outages"]) for r in intervals.lead_time_prevalence(frame(spark, rows), limit=limit).collect()}
    assert got["RF"] == (preceded("rf"), len(outages))
    assert got["BOARD"] == (preceded("board"), len(outages))
    assert got["SCTP"] == (0, len(outages))


def test_minute_volume(spark):
    rows = sample(12)
    volume = intervals.minute_volume(frame(spark, rows)).collect()
    for r in volume:
        t = r["minute"]
        mine = [x for x in rows if x[0] == r["enodeb_id"]]
        floor = [x[1].replace(second=0) for x in mine]
        assert r["alarm_count"] == floor.count(t)
        assert r["rolling_alarm_count"] == sum(t - timedelta(minutes=60) < m <= t for m in floor)
    dense = intervals.minute_volume(frame(spark, rows), dense=True).groupBy("enodeb_id").agg(F.sum("alarm_count").alias("n"))
    assert sum(r["n"] for r in dense.collect()) == len(rows)


def test_latest_point_windows_are_closed(spark):
    last = datetime(2024, 1, 2, 12)
    rows = [("a", last, 1, NAMES[1], "Critical"), ("a", last - timedelta(hours=6), 2, NAMES[2], "Major"),
            ("a", last - timedelta(hours=6, seconds=1), 3, NAMES[3], "Major"), ("b", last - timedelta(hours=24), 4, NAMES[3], "Minor")]
    got = {r["entity"]: r for r in sliding.latest_point_features(frame(spark, rows)).collect()}
    assert (got["a"]["total_alarms_6h"], got["a"]["critical_alarms_6h"], got["a"]["total_alarms_24h"]) == (2, 1, 3)
    assert (got["b"]["total_alarms_6h"], got["b"]["total_alarms_24h"]) == (0, 1)
    assert got["a"]["window_timestamp"].replace(tzinfo=timezone.utc).hour == 12
