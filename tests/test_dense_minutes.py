"""Alarm volume of every minute against a plain count; only changes are ordered."""

from __future__ import annotations

import random

from towerlens.operators import intervals


def test_silent_minutes_are_written_out_last(spark, rows):
    rng = random.Random(2)
    minutes = [(rng.choice("ab"), rng.choice([0, 1, 2, 5, 59, 60, 61, 130, 131, 300])) for _ in range(40)] + [("c", 7)]
    frame = rows([(t, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:{i % 60:02d}") for i, (t, m) in enumerate(minutes)], "tower string, event_time string")
    found = intervals.minute_volume(frame, ("tower",), dense=True)
    got = {(r.tower, r.minute.hour * 60 + r.minute.minute): (r.alarm_count, r.rolling_alarm_count) for r in found.collect()}
    want = {}
    for tower in "abc":
        own = [m for t, m in minutes if t == tower]
        for m in range(min(own), max(own) + 1):
            want[tower, m] = (own.count(m), sum(m - 60 < x <= m for x in own))
    assert got == want and found.count() == len(want)
    text = found._jdf.queryExecution().executedPlan().toString()
    # the last generator writes the minutes out, nothing is sorted or shuffled after it
    assert "Sort" not in text[:text.index("Generate")] and "Exchange" not in text[:text.index("Generate")].replace("AdaptiveSparkPlan", "")
