"""Sequence queries give a row to every alarm, those of users without an eNodeB in the model included."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from check import compare

QUERIES, SQL = contract.queries(), contract.oracle_sql()
WHOLE = [
    "g1_lag_features",
    "g2_gap_minutes",
    "g3_position",
    "g4_repeat_count",
    "g5_outages_before",
    "g6_future_outage",
    "g6_future_outage_literal",
    "sequence_features",
    "g11_outage_spacing",
    "g14_streaks",
    "g15_distinct_sources",
    "g16_repeat_ratio",
    "g17_weighted_repeats",
    "g17_last_repeat",
]
#: One row for all alarms.
FOLDED = ("g11_outage_spacing",)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    kinds = ("error", "click", "view", "purchase", "login")
    rows = [(i, f"2024-01-{1 + i // 60:02d} {i // 3 % 24:02d}:{i % 60:02d}:{i % 50:02d}.5", i * i % 31, kinds[i % 5 if i % 2 else 0], float(i * 7 % 130), None) for i in range(900)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    frame.withColumn("ts", frame.ts.cast("timestamp_ntz")).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", WHOLE)
def test_every_alarm_is_there(spark, events, name):
    got = QUERIES[name](spark, events).toPandas()
    base = duckdb.connect()
    base.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}/events.parquet/*.parquet')")
    assert compare(got, base.sql(SQL[name]).df()) == "ok"
    if name not in FOLDED:
        assert len(got) == base.sql("SELECT count(*) FROM events").fetchall()[0][0]  # no two in one minute
    else:
        assert got["outage_rows"][0] == base.sql("SELECT count(*) FROM events WHERE event_type = 'error' AND event_id % 4 > 1").fetchall()[0][0]
