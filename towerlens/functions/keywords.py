"""Alarm categories: a name belongs to a category when it contains any of its keywords."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# Keyword lists of the cleaning profile.
CLEANING = {
    "is_cell_unavailable": ["cell unavailable", "lte cell unavailable", "nr cell unavailable"],
    "is_cell_outage": ["cell outage", "cell service outage", "cell down"],
    "is_cell_fault": ["cell fault", "cell hardware fault"],
    "is_service_unavailable": ["service unavailable", "rf service unavailable", "service degradation"],
    "is_bbu": [
        "bbu board fault", "bbu cpri interface error", "bbu optical module fault",
        "bbu maintenance subrack fault", "bbu slot abnormal", "main control board offline",
        "bbu clock subsystem unsynchronized", "bbu power board fault",
        "bbu", "board", "subrack", "transmission", "baseband",
    ],
    "is_rru": [
        "rru rf unit maintenance fault", "rf unit vswr threshold exceeded", "rru transmit power abnormal",
        "antenna line device fault", "rru cpri interface error", "rf unit gain imbalance",
        "feeder line outage", "rru high temperature",
        "rf", "rru", "vswr", "feeder", "antenna",
    ],
    "is_power": [
        "mains input failure", "rectifier module failure", "battery voltage low",
        "ac power off", "dc high/low voltage", "generator failure",
        "power subsystem temperature high", "mains supply abnormal",
        "power", "mains", "rectifier", "battery", "ac fail", "dc fail",
    ],
}

# Keyword lists of the feature-matrix profile.
MATRIX = {
    "is_cell_unavailable": ["cell unavailable"],
    "is_cell_outage": ["cell outage", "cell down"],
    "is_cell_fault": ["cell fault"],
    "is_service_unavailable": ["service unavailable", "service degradation"],
    "is_bbu": ["bbu", "board", "subrack", "transmission", "baseband"],
    "is_rru": ["rf", "rru", "vswr", "feeder", "antenna"],
    "is_power": ["power", "mains", "rectifier", "battery", "ac fail", "dc fail"],
}

# Keyword lists of the upload profile.
UPLOAD = {
    "is_bbu": ["bbu", "board", "subrack", "transmission"],
    "is_rru": ["rf", "rru", "vswr"],
    "is_power": ["power", "mains", "rectifier", "battery"],
}

# Keywords of the lead-time report, each its own category.
LEAD_TIME = {
    "RF": "rf", "SCTP": "sctp", "MAINS": "mains", "TRANSMISSION": "transmission",
    "S1": "s1", "BOARD": "board", "VSWR": "vswr", "OPTICAL": "optical module",
}

PROFILES = {"cleaning": CLEANING, "matrix": MATRIX, "upload": UPLOAD}


def needed(keywords: Iterable[str]) -> list[str]:
    """Keywords that are not implied by a shorter one of the same list."""
    words = list(dict.fromkeys(keywords))
    return [w for w in words if not any(o != w and o in w for o in words)]


def has_any(name: Column, keywords: Iterable[str]) -> Column:
    return reduce(or_, [name.contains(word) for word in needed(keywords)])


def lowered(alarm_name: Column) -> Column:
    return F.lower(F.coalesce(alarm_name.cast("string"), F.lit("nan")))


def flags_of_lowered(name: Column, profile: str = "cleaning") -> dict[str, Column]:
    """0/1 column per category of the profile, for a name already in lower case."""
    return {
        category: has_any(name, words).cast("int")
        for category, words in PROFILES[profile].items()
    }


def flags(alarm_name: Column, profile: str = "cleaning") -> dict[str, Column]:
    """0/1 column per category of the profile."""
    return flags_of_lowered(lowered(alarm_name), profile)


def with_flags(df: DataFrame, profile: str = "cleaning", name: str = "alarm_name") -> DataFrame:
    """Add the flags; the name is put in lower case once per row."""
    staged = df.withColumn("_lowered", lowered(F.col(name)))
    return staged.withColumns(flags_of_lowered(F.col("_lowered"), profile)).drop("_lowered")
