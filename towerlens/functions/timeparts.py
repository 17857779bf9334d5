"""Time expressions on integer microseconds and date parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1_000_000
MINUTE = 60 * MICROS
HOUR = 3600 * MICROS
STEP_HOURS = 2
STEP = STEP_HOURS * HOUR


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c)


def floor_index(us: Column, width: int) -> Column:
    """Number of the interval of ``width`` microseconds that holds ``us``."""
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))


def parse_time(c: Column, dtype: str) -> Column:
    """Timestamp of a column; text that is no time becomes null."""
    if dtype.startswith("timestamp"):
        return c.cast("timestamp")
    return F.try_to_timestamp(c.cast("string"))


def date_parts(c: Column, prefix: str) -> dict[str, Column]:
    """Hour, day of month, weekday with Monday = 0, and month."""
    return {
        f"{prefix}_hour": F.hour(c),
        f"{prefix}_day": F.dayofmonth(c),
        f"{prefix}_weekday": F.weekday(c),
        f"{prefix}_month": F.month(c),
    }


def delay_seconds(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS))


def text_seconds(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
