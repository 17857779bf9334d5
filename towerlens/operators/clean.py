"""Raw export rows to cleaned alarms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from towerlens.functions import keywords, text, timeparts
from towerlens.operators import columns
from towerlens.schema import NAME_CANDIDATES, SITE_CANDIDATES, TIME_CANDIDATES

DEDUPE_KEY = ("site_id", "node_identifier", "event_minute", "alarm_name", "severity")
#: Columns that decide which of several copies is first, as far as a table has them.
ARRIVAL_ORDER = ("source_file", "source_row", "log_serial_number")


def with_event_time(df: DataFrame) -> DataFrame:
    """``event_time`` from the first time column present; rows without a time are dropped."""
    source = columns.first_present(df, TIME_CANDIDATES, required=True)
    parsed = timeparts.parse_time(F.col(source), dict(df.dtypes)[source])
    return df.withColumn("event_time", parsed).where(F.col("event_time").isNotNull())


def with_identity(df: DataFrame) -> DataFrame:
    """Site from the first candidate that names one; node from it, else the first usable value."""
    present = [F.col(c) for c in SITE_CANDIDATES if c in df.columns]
    nothing = F.lit(None).cast("string")
    out = df.withColumns({
        "_site_text": text.site_text(present) if present else nothing,
        "_fallback": text.first_usable(present) if present else F.lit("-"),
        "enodeb_id": text.node_id(columns.column_or(df, "enodeb_id", "-")),
        "gnodeb_id": text.node_id(columns.column_or(df, "gnodeb_id", "-")),
    })
    by_number = F.when(F.col("enodeb_id") != "-", F.col("enodeb_id")).otherwise(F.col("gnodeb_id"))
    node = F.coalesce("_site_text", "_fallback")
    return out.withColumns({
        "site_id": F.coalesce(F.upper(F.left("_site_text", F.lit(6))), F.lit("-")),
        "node_identifier": F.when(node == "-", by_number).otherwise(node),
    }).drop("_site_text", "_fallback")


def with_attributes(df: DataFrame, profile: str = "cleaning") -> DataFrame:
    """Alarm name, severity, duration and category flags in one projection."""
    name_column = columns.first_present(df, NAME_CANDIDATES)
    name = text.text_or_nan(F.col(name_column)) if name_column else F.lit("Unknown Alarm")
    severity = text.capitalised(F.col("severity")) if "severity" in df.columns else F.lit("Major")
    duration = text.duration_minutes(F.col("alarm_duration")) if "alarm_duration" in df.columns else F.lit(0.0)
    flagged = df.withColumns({"alarm_name": name, "severity": severity, "duration_minutes": duration})
    flagged = keywords.with_flags(flagged, profile)
    return flagged.withColumn("is_outage", F.col("is_cell_unavailable"))


def first_per_minute(df: DataFrame, key: Sequence[str] = DEDUPE_KEY) -> DataFrame:
    """Keep the first alarm of each key and minute.

    ``row_number() = 1`` is pruned on the map side, so copies never travel.
    """
    arrival = [c for c in ARRIVAL_ORDER if c in df.columns]
    keyed = df.withColumn("event_minute", F.date_trunc("minute", "event_time"))
    window = Window.partitionBy(*key).orderBy("event_time", *arrival)
    return (
        keyed.withColumn("_copy", F.row_number().over(window))
        .where(F.col("_copy") == 1)
        .drop("_copy", "event_minute")
    )


def clean_alarms(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    """Full cleaning: headers, time, identity, attributes, minute dedupe."""
    named = columns.normalise_headers(raw)
    cleaned = with_attributes(with_identity(with_event_time(named)))
    return first_per_minute(cleaned) if dedupe else cleaned


def with_entity(df: DataFrame) -> DataFrame:
    return df.withColumn("entity", text.entity_key(F.col("site_id"), F.col("node_identifier")))


def has_enodeb(df: DataFrame) -> DataFrame:
    """4G rows: the eNodeB id is present."""
    value = text.strip(F.col("enodeb_id").cast("string"))
    return df.where(F.col("enodeb_id").isNotNull() & ~value.isin("nan", "", "-"))


def towers(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that belong to a tower: where the key is the eNodeB, those that have one.

    Rows without an eNodeB are no tower of their own; they neither precede nor follow.
    """
    return has_enodeb(df) if "enodeb_id" in keys else df


def outage_condition() -> Column:
    return F.col("is_cell_unavailable") == 1
