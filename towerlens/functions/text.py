"""Text expressions: identity, durations, severity, cell and technology codes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

# Fixed values
SITE_PATTERN = "^[A-Za-z][A-Za-z0-9]{4}[0-9]$"
MISSING_NODE_IDS = ("-", "nan", "none", "")
TECHNOLOGY_PATTERN = "(?i)_(LTE|NR|GSM|UMTS|4G|5G|EUCELLSECTEQ|UCELLSECTEQ|_G|_L|_U)_"
CELL_ID_PATTERN = r"Cell ID=(\d+)"
SEVERITY_RANKS = {"Critical": 4, "Major": 3, "Minor": 2, "Warning": 1, "Unknown": 0}

SITE_TEXT_PATTERN = (
    r"(?s)^\s*+(?!UGW)(?:.*=)?\s*([A-Za-z][A-Za-z0-9]{4}[0-9](?:\s*_[^=]*?)?)\s*$"
)
USABLE_PATTERN = r"(?s)^\s*+(?!(?:-|nan|none|UNKNOWN|OSS)?\s*$|UGW)(.*?)\s*$"

_BLANKS = " \t\n\r\x0b\x0c"


def header_name(text: str) -> str:
    """Column name in lower snake case, everything but ``[a-z0-9_]`` dropped."""
    return re.sub("[^a-z0-9_]", "", str(text).strip().lower().replace(" ", "_"))


def header_names(names: Sequence[str]) -> list[str]:
    """Normalised names; a repeated name gets a numeric suffix."""
    seen: dict[str, int] = {}
    out = []
    for name in map(header_name, names):
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(name if count == 0 else f"{name}_{count}")
    return out


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def node_id(c: Column) -> Column:
    """eNodeB/gNodeB id: trimmed, every spelling of "missing" becomes ``-``."""
    value = strip(c.cast("string"))
    return F.when(value.isNull() | value.isin(*MISSING_NODE_IDS), F.lit("-")).otherwise(value)


def capitalised(c: Column) -> Column:
    """First letter upper, the rest lower; a missing value reads ``Nan``."""
    text = F.coalesce(c.cast("string"), F.lit("nan"))
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def text_or_nan(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("nan"))


def _found(c: Column, pattern: str) -> Column:
    """First capture of the pattern, null without a match; the text is evaluated once."""
    return F.try_element_at(F.regexp_extract_all(c.cast("string"), F.lit(pattern), F.lit(1)), F.lit(1))


def usable_identifier(c: Column) -> Column:
    """The stripped value, or null when it names no tower."""
    return _found(c, USABLE_PATTERN)


def site_text(candidates: Sequence[Column]) -> Column:
    """Text after the last ``=`` of the first candidate whose part before ``_`` is a site id."""
    return F.coalesce(*[_found(c, SITE_TEXT_PATTERN) for c in candidates])


def first_usable(candidates: Sequence[Column]) -> Column:
    return F.coalesce(*[usable_identifier(c) for c in candidates], F.lit("-"))


def entity_key(site: Column, node: Column) -> Column:
    """Aggregation entity: the site when known, the node otherwise."""
    return F.coalesce(F.when(~site.isin("-", "UNKNOWN"), site), node)


def _amount(text: Column, unit: str) -> Column:
    found = F.regexp_extract(text, rf"(\d+)\s*{unit}", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def duration_minutes(c: Column) -> Column:
    """Minutes of a text such as ``2 hours 5 minutes 30 seconds``; missing gives 0."""
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return _amount(text, "hour") * 60 + _amount(text, "min") + _amount(text, "sec") / 60


def duration_minutes_by_token(c: Column) -> Column:
    """Minutes by value/unit tokens: repeated units add up; missing or ``Unknown`` is null."""
    text = F.lower(c.cast("string"))
    pair = r"(?:^| )([+-]?\d+) ([^ ]*)"
    values = F.regexp_extract_all(text, F.lit(pair), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(pair), F.lit(2))

    def minutes(value: Column, unit: Column) -> Column:
        number = value.cast("double")
        return (
            F.when(unit.contains("hour"), number * 60)
            .when(unit.contains("minute"), number)
            .when(unit.contains("second"), number / 60)
            .otherwise(F.lit(0.0))
        )

    total = F.aggregate(F.zip_with(values, units, minutes), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(c.isNull() | (c == "Unknown"), F.lit(None)).otherwise(total)


def severity_rank(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SEVERITY_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(0))


def cell_id(*texts: Column) -> Column:
    """Number after ``Cell ID=`` in the first text that has one, else ``Tower-Level``."""
    found = [
        F.regexp_extract(t.cast("string"), CELL_ID_PATTERN, 1).try_cast("decimal(38,0)").cast("string")
        for t in texts
    ]
    return F.coalesce(*found, F.lit("Tower-Level"))


def technology(mo_name: Column) -> Column:
    found = F.regexp_extract(mo_name, TECHNOLOGY_PATTERN, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("UNKNOWN"))


def site_prefix(mo_name: Column) -> Column:
    return F.coalesce(F.substring_index(mo_name, "_", 1), F.lit("UNKNOWN"))


def contains_ignoring_case(c: Column, part: str) -> Column:
    """Substring test; a missing text does not match."""
    return F.coalesce(F.lower(c.cast("string")).contains(part.lower()), F.lit(False))


def placeholder_to_null(c: Column) -> Column:
    return F.when(c != "-", c)


def percent_text(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def joined(columns: Sequence[Column], separator: str) -> Column:
    parts = [c.cast("string") for c in columns]
    return F.concat_ws(separator, *parts)


def total(columns: Sequence[Column]) -> Column:
    return reduce(add, columns)
