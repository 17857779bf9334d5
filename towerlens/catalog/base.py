"""The given tables bound to the alarm model, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from towerlens import session
from towerlens.functions import keywords, text
from towerlens.operators import clean

# Raw alarm rows from `events`; the expressions run unchanged in Spark and DuckDB.
RAW = {
    "log_serial_number": "event_id",
    "event_time": "ts",
    "received_on": "ts + (event_id % 90) * INTERVAL '1' SECOND",
    "alarm_source": (
        "CASE WHEN user_id % 10 = 0 THEN 'OSS' "
        "WHEN user_id % 10 = 1 THEN 'NE Name=S' || lpad(CAST(user_id % 10000 AS STRING), 4, '0') || '1_GUL00_X' "
        "ELSE 'S' || lpad(CAST(user_id % 10000 AS STRING), 4, '0') || CAST(user_id % 10 AS STRING) || '_LTE_A' END"
    ),
    "mo_name": "CASE WHEN user_id % 20 = 0 THEN '-' ELSE 'NODE-' || CAST(user_id AS STRING) || '_NR_B' END",
    "enodeb_id": "CASE WHEN user_id % 5 = 2 THEN '-' ELSE CAST(80000 + user_id AS STRING) END",
    "gnodeb_id": "CASE WHEN user_id % 4 = 0 THEN CAST(90000 + user_id AS STRING) ELSE '-' END",
    "name": (
        "CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'Cell Outage' "
        "WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'Service Unavailable' "
        "WHEN event_type = 'error' THEN 'Cell Unavailable' "
        "WHEN event_type = 'click' THEN 'RF Unit VSWR Threshold Exceeded' "
        "WHEN event_type = 'view' THEN 'BBU Board Fault' "
        "WHEN event_type = 'purchase' THEN 'Mains Input Failure' "
        "ELSE 'S1 Interface Fault' END"
    ),
    "severity": (
        "CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 50 THEN 'major' "
        "WHEN value >= 20 THEN 'Minor' ELSE 'Warning' END"
    ),
    "alarm_duration": (
        "CASE WHEN event_id % 7 = 0 THEN '-' ELSE CAST(event_id % 5 AS STRING) || ' hours ' || "
        "CAST(event_id % 60 AS STRING) || ' minutes ' || CAST(event_id % 47 AS STRING) || ' seconds' END"
    ),
    "location_information": (
        "CASE WHEN event_id % 5 = 0 THEN 'ME ID=' || CAST(user_id AS STRING) "
        "ELSE 'ME ID=' || CAST(user_id AS STRING) || ', Local Cell ID=' || CAST(event_id % 6 AS STRING) END"
    ),
}

#: The same rows with the eNodeB of every user.
EVERY = RAW | {"enodeb_id": "CAST(80000 + user_id AS STRING)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str, model: dict[str, str] = RAW) -> DataFrame:
    """Raw alarm rows, times as plain TIMESTAMP."""
    rows = table(spark, sf_dir, "events").selectExpr(*[f"{sql} AS {name}" for name, sql in model.items()])
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in ("event_time", "received_on")})


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, deduplicated alarms with their entity."""
    return clean.with_entity(clean.clean_alarms(raw(spark, sf_dir)))


def every_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned alarms where every event has an eNodeB, so that none is left out."""
    return clean.with_entity(clean.clean_alarms(raw(spark, sf_dir, EVERY)))


def naive(name: str) -> Column:
    """Timestamp without zone, as DuckDB returns it."""
    return F.col(name).cast("timestamp_ntz").alias(name)


def integers(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def rounded(*names: str, places: int = 6) -> list[Column]:
    return [F.round(F.col(n).cast("double"), places).alias(n) for n in names]


def site_key() -> Column:
    return text.entity_key(F.col("site_id"), F.col("node_identifier"))


# ---- SQL side -------------------------------------------------------------------

def _raw_sql(model: dict[str, str]) -> str:
    return "raw AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in model.items()) + " FROM events)"


RAW_SQL = _raw_sql(RAW)

_USABLE = (
    "CASE WHEN trim({c}) IN ('', '-', 'nan', 'none', 'UNKNOWN', 'OSS') OR trim({c}) LIKE 'UGW%' "
    "THEN NULL ELSE trim({c}) END"
)
_CANDIDATES = ("alarm_source", "mo_name", "location_information", "enodeb_id", "gnodeb_id")
_TAIL = "trim(list_last(string_split({u}, '=')))"
_PREFIX = "trim(string_split({t}, '_')[1])"
_IS_SITE = "regexp_matches({p}, '^[A-Za-z][A-Za-z0-9]{{4}}[0-9]$')"


def _identity_sql() -> str:
    site, node, first = [], [], []
    for c in _CANDIDATES:
        usable = "(" + _USABLE.format(c=c) + ")"
        tail = _TAIL.format(u=usable)
        prefix = _PREFIX.format(t=tail)
        match = _IS_SITE.format(p=prefix)
        site.append(f"CASE WHEN {match} THEN upper({prefix}) END")
        node.append(f"CASE WHEN {match} THEN {tail} END")
        first.append(usable)
    return (
        f"coalesce({', '.join(site)}, '-') AS site_id, "
        f"coalesce({', '.join(node)}, {', '.join(first)}, '-') AS node0"
    )


def sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_MINUTES = (
    "coalesce(TRY_CAST(regexp_extract(lower({c}), '([0-9]+)\\s*hour', 1) AS DOUBLE), 0) * 60 + "
    "coalesce(TRY_CAST(regexp_extract(lower({c}), '([0-9]+)\\s*min', 1) AS DOUBLE), 0) + "
    "coalesce(TRY_CAST(regexp_extract(lower({c}), '([0-9]+)\\s*sec', 1) AS DOUBLE), 0) / 60"
)

CLEAN_SQL = (
    RAW_SQL
    + ", ident AS (SELECT *, " + _identity_sql() + " FROM raw)"
    + ", flagged AS (SELECT * REPLACE (upper(left(severity, 1)) || lower(substr(severity, 2)) AS severity), "
    + "CASE WHEN node0 = '-' THEN CASE WHEN enodeb_id <> '-' THEN enodeb_id ELSE gnodeb_id END ELSE node0 END AS node_identifier, "
    + "name AS alarm_name, " + _MINUTES.format(c="alarm_duration") + " AS duration_minutes, "
    + ", ".join(f"CAST({sql_any('lower(name)', w)} AS INT) AS {f}" for f, w in keywords.CLEANING.items())
    + " FROM ident)"
    + ", alarms AS (SELECT *, is_cell_unavailable AS is_outage, "
    + "CASE WHEN site_id <> '-' AND site_id <> 'UNKNOWN' THEN site_id ELSE node_identifier END AS entity, "
    + "epoch_us(event_time) AS us "
    + "FROM flagged QUALIFY row_number() OVER (PARTITION BY site_id, node_identifier, date_trunc('minute', event_time), "
    + "alarm_name, severity ORDER BY event_time, log_serial_number) = 1)"
)


def with_raw(sql: str) -> str:
    return f"WITH {RAW_SQL} {sql}"


def with_alarms(sql: str, *more: str) -> str:
    return "WITH " + ", ".join([CLEAN_SQL, *more]) + " " + sql


def with_every_alarm(sql: str, *more: str) -> str:
    return with_alarms(sql, *more).replace(RAW_SQL, _raw_sql(EVERY))


#: Only alarms of towers that have an eNodeB, under the name the analyses read.
_TOWERS = ", alarms AS (SELECT * FROM all_alarms WHERE enodeb_id <> '-')"


def with_towers(sql: str, *more: str) -> str:
    return "WITH " + ", ".join([CLEAN_SQL.replace(", alarms AS (", ", all_alarms AS (") + _TOWERS, *more]) + " " + sql
