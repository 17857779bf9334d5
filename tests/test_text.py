from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from towerlens.functions import keywords, risk, text, timeparts
from towerlens.operators import clean


def one(spark, schema, value, expression):
    return spark.createDataFrame([(value,)], schema).select(expression.alias("r")).first()[0]


@pytest.mark.parametrize("source, site, node", [
    ("ZBIY43_x", "ZBIY43", "ZBIY43_x"),
    ("glind1", "GLIND1", "glind1"),
    ("NE Name=ZKSB03_GUL00", "ZKSB03", "ZKSB03_GUL00"),
    ("a=b= ZKSB03 _GUL00 ", "ZKSB03", "ZKSB03 _GUL00"),
    ("ABCDE_1", "-", "ABCDE_1"),
    ("ABCDEF7_1", "-", "ABCDEF7_1"),
    ("1BIY43", "-", "1BIY43"),
    ("ZBIY4X", "-", "ZBIY4X"),
    ("UGW_1", "-", "80001"),
    ("UGWAB1", "-", "80001"),
    ("OSS", "-", "80001"),
    ("  -  ", "-", "80001"),
    (None, "-", "80001"),
])
def test_identity(spark, source, site, node):
    df = spark.createDataFrame([(source, "80001", "-")], "alarm_source string, enodeb_id string, gnodeb_id string")
    found = clean.with_identity(df).first()
    assert (found["site_id"], found["node_identifier"]) == (site, node)


def test_identity_takes_the_first_candidate_that_matches(spark):
    df = spark.createDataFrame([("bad one", "ZBIY43_y", "AAAAA1")], "alarm_source string, mo_name string, bbu_name string")
    found = clean.with_identity(df).first()
    assert (found["site_id"], found["node_identifier"]) == ("ZBIY43", "ZBIY43_y")


def test_node_falls_back_to_numbers(spark):
    df = spark.createDataFrame([("-", "nan", "90001")], "alarm_source string, enodeb_id string, gnodeb_id string")
    found = clean.with_identity(df).first()
    assert (found["site_id"], found["enodeb_id"], found["node_identifier"]) == ("-", "-", "90001")


@pytest.mark.parametrize("name, cleaning, matrix, upload", [
    ("LTE Cell Unavailable", {"is_cell_unavailable"}, {"is_cell_unavailable"}, set()),
    ("Cell Service Outage", {"is_cell_outage"}, set(), set()),
    ("S1 Interface Fault", {"is_rru"}, {"is_rru"}, {"is_rru"}),
    ("Feeder Line Outage", {"is_rru"}, {"is_rru"}, set()),
    ("Generator Failure", {"is_power"}, set(), set()),
    ("AC Fail", {"is_power"}, {"is_power"}, set()),
    (None, set(), set(), set()),
])
def test_flags(spark, name, cleaning, matrix, upload):
    df = spark.createDataFrame([(name,)], "n string")
    for profile, expected in (("cleaning", cleaning), ("matrix", matrix), ("upload", upload)):
        row = df.select(*[c.alias(k) for k, c in keywords.flags(F.col("n"), profile).items()]).first().asDict()
        assert {k for k, v in row.items() if v} == expected, profile


@pytest.mark.parametrize("value, first, by_token", [
    ("2 hours 5 minutes 30 seconds", 125.5, 125.5),
    ("45 min", 45.0, 0.0),
    ("-", 0.0, 0.0),
    ("Unknown", 0.0, None),
    (None, 0.0, None),
    ("1 hour 1 hour", 60.0, 120.0),
    ("5 3 hours", 180.0, 0.0),
    ("3  5 hours", 300.0, 300.0),
    ("2hours", 120.0, 0.0),
])
def test_durations(spark, value, first, by_token):
    assert one(spark, "c string", value, text.duration_minutes(F.col("c"))) == first
    assert one(spark, "c string", value, text.duration_minutes_by_token(F.col("c"))) == by_token


@pytest.mark.parametrize("location, additional, expected", [
    ("Cell ID=7", None, "7"), ("x, Local Cell ID=12", None, "12"), ("none", "Cell ID=3", "3"),
    (None, None, "Tower-Level"), ("Cell ID=007", None, "7"),
])
def test_cell_id(spark, location, additional, expected):
    df = spark.createDataFrame([(location, additional)], "a string, b string")
    assert df.select(text.cell_id(F.col("a"), F.col("b"))).first()[0] == expected


@pytest.mark.parametrize("name, expected", [
    ("X_lte_1", "lte"), ("A_NR_B", "NR"), ("A_5G_b", "5G"), ("plain", "UNKNOWN"), (None, "UNKNOWN"),
])
def test_technology(spark, name, expected):
    assert one(spark, "c string", name, text.technology(F.col("c"))) == expected


def test_severity_and_rank(spark):
    df = spark.createDataFrame([("CRITICAL",), ("major",), (None,)], "s string")
    named = [r[0] for r in df.select(text.capitalised(F.col("s"))).collect()]
    assert named == ["Critical", "Major", "Nan"]
    ranks = [r[0] for r in df.select(text.severity_rank(text.capitalised(F.col("s")))).collect()]
    assert ranks == [4, 3, 0]


def test_header_names_are_normalised_and_unique():
    assert text.header_names(["Occurred On (NT)", " eNodeB ID", "Name", "name"]) == [
        "occurred_on_nt", "enodeb_id", "name", "name_1"]


@pytest.mark.parametrize("p, operations, batch", [
    (0.65, "CRITICAL", "WARNING"), (0.7, "CRITICAL", "CRITICAL"), (0.35, "WARNING", "NORMAL"), (0.1, "NOMINAL", "NORMAL"),
])
def test_tiers(spark, p, operations, batch):
    assert one(spark, "p double", p, risk.tier(F.col("p"), "operations")) == operations
    assert one(spark, "p double", p, risk.tier(F.col("p"), "batch")) == batch


def test_floor_index_of_times_before_1970(spark):
    df = spark.createDataFrame([("1969-12-31 23:00:00",), ("1970-01-01 02:00:00",)], "t string")
    us = timeparts.micros(F.col("t").cast("timestamp"))
    assert [r[0] for r in df.select(timeparts.floor_index(us, timeparts.STEP)).collect()] == [-1, 1]


def test_minute_dedupe_keeps_the_first_and_respects_minute_edges(rows):
    df = rows([
        ("2024-01-01 00:00:10", 2, "A"), ("2024-01-01 00:00:20", 1, "A"),
        ("2024-01-01 00:00:55", 3, "B"), ("2024-01-01 00:01:05", 4, "B"),
    ], "event_time string, log_serial_number long, alarm_name string")
    from pyspark.sql import functions as F
    full = df.withColumns({"site_id": F.lit("S"), "node_identifier": F.lit("N"), "severity": F.lit("Major")})
    kept = sorted(r["log_serial_number"] for r in clean.first_per_minute(full).collect())
    assert kept == [2, 3, 4]


def test_missing_time_column_is_an_error(spark):
    with pytest.raises(KeyError):
        clean.clean_alarms(spark.createDataFrame([("x",)], "Name string"))
