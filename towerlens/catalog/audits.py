"""Correlation, information, uniqueness and the leakage audits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from towerlens.catalog import sequences
from towerlens.catalog.base import alarms, integers, raw, rounded, table, with_alarms, with_raw, with_towers
from towerlens.catalog.grids import _matrix_sql, matrix
from towerlens.catalog.registry import Area
from towerlens.operators import quality
from towerlens.settings import Settings

register = Area()
QUERIES, SQL = register.queries, register.sql

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
_ALL_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _pair_sql(a: str, b: str) -> str:
    return f"SELECT '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 6) AS correlation FROM lineitem"


@register("f20_correlation_matrix", " UNION ALL ".join(_pair_sql(a, b) for a, b in combinations(_ALL_NUMBERS, 2)))
def f20(spark, sf_dir):
    rows = quality.correlation_matrix(table(spark, sf_dir, "lineitem"))
    return rows.select("first", "second", *rounded("correlation"))


@register("f21_target_correlation", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(corr({c}, (l_returnflag = 'R')::INT), 6) AS correlation FROM lineitem" for c in _NUMBERS)
    + " UNION ALL SELECT 'constant', NULL")
def f21(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        *_NUMBERS, F.lit(3).alias("constant"), (F.col("l_returnflag") == "R").cast("int").alias("target"))
    return quality.target_correlations(rows, "target").select("column", *rounded("correlation"))


@register("f22_correlated_pairs",
          "SELECT * FROM (" + " UNION ALL ".join(
              f"SELECT '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 6) AS correlation FROM (SELECT *, l_quantity * 3 + l_tax AS l_charge FROM lineitem)"
              for a, b in combinations((*_ALL_NUMBERS, "l_charge"), 2)) + ") WHERE abs(correlation) > 0.7")
def f22(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_charge", F.col("l_quantity") * 3 + F.col("l_tax"))
    return quality.correlated_pairs(rows, 0.7).select("first", "second", *rounded("correlation"))


_INFORMATION = (
    "SELECT '{c}' AS \"column\", round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mutual_information FROM (SELECT x, y, n::DOUBLE AS n, "
    "sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny, sum(n) OVER ()::DOUBLE AS t FROM "
    "(SELECT {c} AS x, is_cell_unavailable AS y, count(*) AS n FROM alarms GROUP BY ALL))"
)


@register("f23_mutual_information", with_alarms(_INFORMATION.format(c="alarm_name") + " UNION ALL " + _INFORMATION.format(c="severity")))
def f23(spark, sf_dir):
    rows = quality.mutual_information(alarms(spark, sf_dir), ("alarm_name", "severity"), "is_cell_unavailable")
    return rows.select("column", *rounded("mutual_information"))


_UNIQUE = (*_ALL_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate")


@register("f24_unique_ratio", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS uniques, round(count(DISTINCT {c}) / count(*)::DOUBLE, 6) AS unique_ratio FROM lineitem" for c in _UNIQUE))
def f24(spark, sf_dir):
    rows = quality.unique_ratios(table(spark, sf_dir, "lineitem"))
    return rows.select("column", *integers("uniques"), *rounded("unique_ratio"))


_AUDITED = ("total_alarms_6h", "critical_alarms_6h", "major_alarms_6h", "bbu_alarms_6h", "rru_alarms_6h", "power_alarms_6h",
            "consecutive_critical_streak_6h")
_TWINS = ("target_cell_unavailable_2h", "target_cell_outage_2h", "target_cell_fault_2h", "target_service_unavailable_2h")


def _audit_sql() -> str:
    body = _matrix_sql((6,))
    strength = "abs(CASE WHEN stddev_pop({c}) > 0 AND stddev_pop(target_outage_next_2h) > 0 THEN corr({c}, target_outage_next_2h) END)"
    rows = [
        f"SELECT 'target_correlation' AS \"check\", '{c}' AS \"column\", 'abs_correlation' AS metric, round({strength.format(c=c)}, 6) AS value, "
        f"coalesce({strength.format(c=c)} > 0.85, false) AND {'false' if c in _TWINS else 'true'} AS flagged FROM m" for c in (*_AUDITED, *_TWINS)]
    words = ("id", "name", "code", "serial", "timestamp")
    for c in (*_AUDITED, *_TWINS):
        hit = any(w in c for w in words)
        rows.append(f"SELECT 'identifier_name', '{c}', 'name_match', {1.0 if hit else 0.0}::DOUBLE, {str(hit and c not in _TWINS).lower()} ")
    return f"WITH m AS ({body}) " + " UNION ALL ".join(rows)


@register("k16_matrix_audit", _audit_sql())
def k16(spark, sf_dir):
    rows = matrix(spark, sf_dir, Settings(lookback_hours=(6,))).drop("entity")
    return quality.audit_matrix(rows).select("check", "column", "metric", *rounded("value"), "flagged")


def _row_audit(spark, sf_dir):
    return alarms(spark, sf_dir).select(
        "log_serial_number", "event_time", "enodeb_id", "alarm_name", "severity", "duration_minutes",
        F.col("is_cell_unavailable").alias("target"))


_RATIO = "count(DISTINCT {c}) / count(*)::DOUBLE"


def _row_audit_sql(extended: bool) -> str:
    numeric = ("log_serial_number", "duration_minutes")
    textual = ("enodeb_id", "alarm_name", "severity")
    rows = [
        f"SELECT 'target_signal' AS \"check\", '{c}' AS \"column\", 'abs_correlation' AS metric, round(abs(corr({c}, is_cell_unavailable)), 6) AS value, "
        f"abs(corr({c}, is_cell_unavailable)) > 0.85 AS flagged FROM alarms" for c in numeric]
    rows += [
        f"SELECT 'target_signal', \"column\", 'mutual_information', mutual_information, mutual_information > 0.5 FROM ({_INFORMATION.format(c=c)})" for c in textual]
    for c in (*numeric, *textual):
        if extended:
            named = any(w in c for w in ("id", "name", "code", "serial", "index", "key", "address", "ip"))
            rule = "true" if named else f"{_RATIO.format(c=c)} > 0.5"
        else:
            named = any(w in c for w in ("id", "serial", "key"))
            rule = f"{_RATIO.format(c=c)} > 0.5" + (f" OR count(DISTINCT {c}) > 100" if named else "")
        rows.append(f"SELECT 'identifier', '{c}', 'unique_ratio', round({_RATIO.format(c=c)}, 6), {rule} FROM alarms")
    rows.append(
        "SELECT 'outage_spacing', 'event_time', 'short_gaps', count(*) FILTER (WHERE gap < 300000000)::DOUBLE, count(*) FILTER (WHERE gap < 300000000) > 0 FROM "
        "(SELECT us - lag(us) OVER (PARTITION BY enodeb_id ORDER BY us, log_serial_number) AS gap FROM alarms WHERE is_cell_unavailable = 1 AND enodeb_id <> '-')")
    return with_alarms(" UNION ALL ".join(rows))


@register("k17_row_audit", _row_audit_sql(False))
def k17(spark, sf_dir):
    rows = quality.audit_rows(_row_audit(spark, sf_dir), "target", "event_time", "enodeb_id")
    return rows.select("check", "column", "metric", *rounded("value"), "flagged")


@register("k17_row_audit_extended", _row_audit_sql(True))
def k17_extended(spark, sf_dir):
    rows = quality.audit_rows(_row_audit(spark, sf_dir), "target", "event_time", "enodeb_id", extended=True)
    return rows.select("check", "column", "metric", *rounded("value"), "flagged")


_VALID = ("previous_alarm_1", "severity_encoded", "sequence_length", "twice")


@register("k18_validate_matrix", with_towers(
    "SELECT 'missing' AS \"check\", 'previous_alarm_1' AS \"column\", 'nulls' AS metric, count(*) FILTER (WHERE previous_alarm_1 = -1)::DOUBLE AS value, "
    "count(*) FILTER (WHERE previous_alarm_1 = -1) > 0 AS flagged FROM rows18 "
    "UNION ALL SELECT 'missing', c, 'nulls', 0, false FROM (VALUES ('severity_encoded'), ('sequence_length'), ('twice'), ('month')) v(c) "
    "UNION ALL SELECT 'zero_variance', c, 'constant', (c = 'month')::INT::DOUBLE, c = 'month' FROM (VALUES ('previous_alarm_1'), ('severity_encoded'), ('sequence_length'), ('twice'), ('month')) v(c) "
    "UNION ALL SELECT 'high_correlation', 'twice', 'max_abs_correlation', 1, true "
    "UNION ALL SELECT 'class_share', 'target=' || is_cell_unavailable, 'share', round(count(*) / (SELECT count(*) FROM rows18)::DOUBLE, 6), false FROM rows18 GROUP BY is_cell_unavailable",
    sequences.CODED_SQL, sequences.LAGGED_SQL, "rows18 AS (SELECT * FROM lagged)"))
def k18(spark, sf_dir):
    from towerlens.operators import sequence
    ordered = sequences.sliced(sequences.coded(spark, sf_dir, sequences.towers))
    lags = sequence.position(sequence.lag_features(ordered, {"alarm_name_encoded": "previous_alarm"})).rows()
    rows = lags.select(
        F.when(F.col("previous_alarm_1") >= 0, F.col("previous_alarm_1")).alias("previous_alarm_1"),
        "severity_encoded", "sequence_length", (F.col("sequence_length") * 2).alias("twice"),
        F.lit(1).alias("month"), F.col("is_cell_unavailable").alias("target"))
    return quality.validate_matrix(rows).select("check", "column", "metric", *rounded("value"), "flagged")


@register("alarm_ids_per_name", with_raw("SELECT name, count(DISTINCT enodeb_id) AS ids FROM raw GROUP BY 1 ORDER BY ids DESC, name LIMIT 20"))
def ids_per_name(spark, sf_dir):
    counts = raw(spark, sf_dir).groupBy("name").agg(F.count_distinct("enodeb_id").alias("ids"))
    return counts.orderBy(F.desc("ids"), "name").limit(20)
