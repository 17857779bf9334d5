"""Risk tiers and outage labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from towerlens.functions.text import contains_ignoring_case

# Fixed values: (critical from, warning from, lowest tier) per named profile.
TIERS = {
    "operations": (0.65, 0.35, "NOMINAL"),
    "batch": (0.70, 0.40, "NORMAL"),
}


def tier(probability: Column, profile: str) -> Column:
    critical, warning, lowest = TIERS[profile]
    return (
        F.when(probability >= critical, F.lit("CRITICAL"))
        .when(probability >= warning, F.lit("WARNING"))
        .otherwise(F.lit(lowest))
    )


def is_outage(alarm_name: Column) -> Column:
    return contains_ignoring_case(alarm_name, "cell unavailable")


def outage_label(alarm_name: Column) -> Column:
    return F.when(is_outage(alarm_name), F.lit("Cell Unavailable")).otherwise(F.lit("Other Alarm"))
