"""Two-hour grid features, labels and snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from towerlens import session
from towerlens.catalog.base import alarms, integers, naive, with_alarms
from towerlens.catalog.registry import Area
from towerlens.functions import text
from towerlens.operators import clean, columns, sliding
from towerlens.settings import Settings
from towerlens.sources import history

register = Area()
QUERIES, SQL = register.queries, register.sql

STEP = 7_200_000_000


def matrix(spark, sf_dir, settings: Settings | None = None, **options) -> DataFrame:
    return sliding.lookback_features(alarms(spark, sf_dir), settings, **options)


_GRID_SQL = (
    f"span AS (SELECT min(us) // {STEP} AS lo, (max(us) + {STEP} - 1) // {STEP} AS hi FROM alarms)",
    "grid AS (SELECT e.entity, g.g FROM (SELECT DISTINCT entity FROM alarms) e, "
    "(SELECT unnest(generate_series(lo, hi)) AS g FROM span) g)",
    "marked AS (SELECT *, (lower(severity) = 'critical')::INT AS crit, (lower(severity) = 'major')::INT AS maj, "
    "regexp_matches(lower(alarm_name), 'bbu|board|subrack|transmission|baseband')::INT AS bbu, "
    "regexp_matches(lower(alarm_name), 'rf|rru|vswr|feeder|antenna')::INT AS rru, "
    "regexp_matches(lower(alarm_name), 'power|mains|rectifier|battery|ac fail|dc fail')::INT AS pow, "
    "contains(lower(alarm_name), 'cell unavailable')::INT AS cu, "
    "(contains(lower(alarm_name), 'cell outage') OR contains(lower(alarm_name), 'cell down'))::INT AS co, "
    "contains(lower(alarm_name), 'cell fault')::INT AS cf, "
    "(contains(lower(alarm_name), 'service unavailable') OR contains(lower(alarm_name), 'service degradation'))::INT AS su "
    "FROM alarms)",
    "paired AS (SELECT entity, us, lag(us) OVER w AS prev_us, (crit = 1 AND lag(crit) OVER w = 1)::INT AS pair FROM marked "
    "WINDOW w AS (PARTITION BY entity ORDER BY us, log_serial_number))",
    f"buckets AS (SELECT entity, us // {STEP} AS g, count(*) AS n, sum(crit) AS crit, sum(maj) AS maj, sum(bbu) AS bbu, sum(rru) AS rru, "
    "sum(pow) AS pow, max(cu) AS cu, max(co) AS co, max(cf) AS cf, max(su) AS su FROM marked GROUP BY ALL)",
    "filled AS (SELECT grid.entity, grid.g, coalesce(n, 0) AS n, coalesce(crit, 0) AS crit, coalesce(maj, 0) AS maj, "
    "coalesce(bbu, 0) AS bbu, coalesce(rru, 0) AS rru, coalesce(pow, 0) AS pow, coalesce(cu, 0) AS cu, coalesce(co, 0) AS co, "
    "coalesce(cf, 0) AS cf, coalesce(su, 0) AS su FROM grid LEFT JOIN buckets USING (entity, g))",
)
_SHORT = {"total": "n", "critical": "crit", "major": "maj", "bbu": "bbu", "rru": "rru", "power": "pow"}


def _lookback_sql(hours: int) -> str:
    return ", ".join(
        f"coalesce(sum({short}) OVER (PARTITION BY entity ORDER BY g ROWS BETWEEN {hours // 2} PRECEDING AND 1 PRECEDING), 0)::BIGINT "
        f"AS {name}_alarms_{hours}h" for name, short in _SHORT.items())


_FIRST_SQL = (
    "firsts AS (SELECT entity, arg_min(site_id, (us, log_serial_number)) AS site_id, "
    "arg_min(node_identifier, (us, log_serial_number)) AS node_identifier, "
    "arg_min(enodeb_id, (us, log_serial_number)) AS enodeb_id, "
    "arg_min(gnodeb_id, (us, log_serial_number)) AS gnodeb_id FROM alarms GROUP BY entity)"
)


def _matrix_sql(lookbacks, select="*", tail="") -> str:
    body = ", ".join(_lookback_sql(h) for h in lookbacks)
    h0 = min(lookbacks)
    return with_alarms(
        f"SELECT {select} FROM (SELECT entity, site_id, node_identifier, enodeb_id, gnodeb_id, "
        f"make_timestamp(g * {STEP}) AS window_timestamp, {body}, "
        f"(EXISTS (SELECT 1 FROM paired p WHERE p.entity = filled.entity AND p.pair = 1 AND p.prev_us >= (g - {h0 // 2}) * {STEP} AND p.us < g * {STEP}))::INT "
        f"AS consecutive_critical_streak_{h0}h, cu AS target_cell_unavailable_2h, co AS target_cell_outage_2h, "
        "cf AS target_cell_fault_2h, su AS target_service_unavailable_2h, greatest(cu, co, cf, su) AS target_outage_next_2h "
        f"FROM filled JOIN firsts USING (entity)) {tail}", *_GRID_SQL, _FIRST_SQL)


@register("g8_lookback_features", _matrix_sql((6, 24, 336, 720)))
def g8(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    return rows.withColumn("window_timestamp", naive("window_timestamp"))


@register("g8_lookback_sparse", _matrix_sql((6, 24), tail="WHERE total_alarms_24h > 0 OR target_outage_next_2h = 1"))
def g8_sparse(spark, sf_dir):
    rows = matrix(spark, sf_dir, Settings(lookback_hours=(6, 24)), dense=False)
    kept = rows.where((F.col("total_alarms_24h") > 0) | (F.col("target_outage_next_2h") == 1))
    return kept.withColumn("window_timestamp", naive("window_timestamp"))


@register("g9_critical_streak", _matrix_sql((24, 6), select="entity, window_timestamp, consecutive_critical_streak_6h"))
def g9(spark, sf_dir):
    rows = matrix(spark, sf_dir, Settings(lookback_hours=(24, 6)))
    return rows.select("entity", naive("window_timestamp"), "consecutive_critical_streak_6h")


@register("g9_streak_first_listed", _matrix_sql((24,), select="entity, window_timestamp, consecutive_critical_streak_24h"))
def g9_first_listed(spark, sf_dir):
    rows = matrix(spark, sf_dir, Settings(lookback_hours=(24, 6)), streak_hours=24)
    return rows.select("entity", naive("window_timestamp"), "consecutive_critical_streak_24h")


_TARGETS = ("target_cell_unavailable_2h", "target_cell_outage_2h", "target_cell_fault_2h", "target_service_unavailable_2h")


@register("g10_lead_targets", _matrix_sql(
    (6,), select="entity, window_timestamp, " + ", ".join(_TARGETS) + ", target_outage_next_2h"))
def g10(spark, sf_dir):
    rows = matrix(spark, sf_dir, Settings(lookback_hours=(6,)))
    return rows.select("entity", naive("window_timestamp"), *_TARGETS, "target_outage_next_2h")


@register("g10_active_targets", _matrix_sql(
    (6,), select="entity, window_timestamp, target_cell_unavailable_2h AS target_outage_next_2h"))
def g10_active(spark, sf_dir):
    settings = Settings(active_targets=("OUTAGE_CELL_UNAVAILABLE",), active_features=(), lookback_hours=(6,))
    return matrix(spark, sf_dir, settings).select("entity", naive("window_timestamp"), "target_outage_next_2h")


@register("e7_odd_lookback", with_alarms(
    f"SELECT entity, make_timestamp(g * {STEP}) AS window_timestamp, "
    f"(SELECT count(*) FROM alarms a WHERE a.entity = grid.entity AND a.us >= g * {STEP} - 18000000000 AND a.us < g * {STEP}) AS total_alarms_5h, "
    f"(SELECT count(*) FROM alarms a WHERE a.entity = grid.entity AND a.is_cell_unavailable = 1 AND a.us >= g * {STEP} AND a.us < (g + 1) * {STEP} ) > 0 AS cu "
    "FROM grid", *_GRID_SQL[:2]))
def e7(spark, sf_dir):
    rows = matrix(spark, sf_dir, Settings(lookback_hours=(5,)))
    return rows.select(
        "entity", naive("window_timestamp"), "total_alarms_5h",
        (F.col("target_cell_unavailable_2h") == 1).alias("cu"))


@register("e6_entity_grid", with_alarms(
    f"SELECT entity, make_timestamp(g * {STEP}) AS window_timestamp FROM grid", *_GRID_SQL[:2]))
def e6(spark, sf_dir):
    return sliding.entity_grid(alarms(spark, sf_dir)).withColumn("window_timestamp", naive("window_timestamp"))


@register("f18_first_attributes", with_alarms("SELECT * FROM firsts", _FIRST_SQL))
def f18(spark, sf_dir):
    return sliding.first_attributes(alarms(spark, sf_dir))


_LAST = (
    "SELECT site_id, node_identifier, window_timestamp, {columns} FROM (SELECT {key} AS k, arg_min(site_id, (us, log_serial_number)) AS site_id, "
    "arg_min(node_identifier, (us, log_serial_number)) AS node_identifier, (SELECT max(event_time) FROM alarms) AS window_timestamp, "
    "count(*) FILTER (WHERE us >= t - 21600000000) AS total_alarms_6h, "
    "count(*) FILTER (WHERE us >= t - 21600000000 AND severity = 'Critical') AS critical_alarms_6h, "
    "count(*) FILTER (WHERE us >= t - 21600000000 AND severity = 'Major') AS major_alarms_6h, "
    "count(*) FILTER (WHERE us >= t - 21600000000 AND regexp_matches(lower(alarm_name), 'rf|rru|vswr')) AS rru_alarms_6h, "
    "count(*) FILTER (WHERE us >= t - 21600000000 AND regexp_matches(lower(alarm_name), 'bbu|board|subrack|transmission')) AS bbu_alarms_6h, "
    "count(*) FILTER (WHERE us >= t - 21600000000 AND regexp_matches(lower(alarm_name), 'power|mains|rectifier|battery')) AS power_alarms_6h, "
    "count(*) FILTER (WHERE us >= t - 86400000000) AS total_alarms_24h "
    "FROM alarms, (SELECT max(us) AS t FROM alarms) GROUP BY k, t)"
)
_POINT = (
    "total_alarms_6h", "critical_alarms_6h", "major_alarms_6h", "rru_alarms_6h", "bbu_alarms_6h",
    "power_alarms_6h", "total_alarms_24h",
)


@register("g13_latest_point", with_alarms(_LAST.format(columns=", ".join(_POINT), key="entity")))
def g13(spark, sf_dir):
    rows = sliding.latest_point_features(alarms(spark, sf_dir))
    return rows.select("site_id", "node_identifier", naive("window_timestamp"), *_POINT)


@register("g13_latest_point_by_site", with_alarms(_LAST.format(columns=", ".join(_POINT), key="site_id")))
def g13_by_site(spark, sf_dir):
    rows = sliding.latest_point_features(alarms(spark, sf_dir), entity="site_id")
    return rows.select("site_id", "node_identifier", naive("window_timestamp"), *_POINT)


@register("d5_latest_snapshot", _matrix_sql(
    (6,), select="entity, window_timestamp, total_alarms_6h", tail="QUALIFY window_timestamp = max(window_timestamp) OVER ()"))
def d5(spark, sf_dir):
    rows = sliding.newest_point_features(alarms(spark, sf_dir), Settings(lookback_hours=(6,)))
    return rows.select("entity", naive("window_timestamp"), "total_alarms_6h")


@register("d5_latest_of_matrix", _matrix_sql(
    (6,), select="entity, window_timestamp, total_alarms_6h", tail="QUALIFY window_timestamp = max(window_timestamp) OVER ()"))
def d5_matrix(spark, sf_dir):
    """The same rows taken from a matrix that was written before."""
    rows = session.cut_lineage(matrix(spark, sf_dir, Settings(lookback_hours=(6,))))
    return sliding.latest_matrix_rows(rows).select("entity", naive("window_timestamp"), "total_alarms_6h")


def priority_snapshot(spark, sf_dir) -> DataFrame:
    """Towers with alarms in the last six hours at the newest grid point, busiest first."""
    rows = sliding.newest_point_features(alarms(spark, sf_dir), Settings(lookback_hours=(6, 24)))
    busy = rows.where(F.col("total_alarms_6h") > 0)
    return busy.select(
        "entity", "site_id", "node_identifier", naive("window_timestamp"),
        *integers("total_alarms_6h", "critical_alarms_6h", "total_alarms_24h"),
        "consecutive_critical_streak_6h",
    ).orderBy(F.desc("critical_alarms_6h"), F.desc("total_alarms_6h"), "entity")


register("priority_snapshot", _matrix_sql(
    (6, 24), select="entity, site_id, node_identifier, window_timestamp, total_alarms_6h, critical_alarms_6h, total_alarms_24h, consecutive_critical_streak_6h",
    tail="WHERE total_alarms_6h > 0 QUALIFY window_timestamp = max(window_timestamp) OVER ()").replace(
        "WHERE total_alarms_6h > 0 QUALIFY window_timestamp = max(window_timestamp) OVER ()",
        f"WHERE total_alarms_6h > 0 AND window_timestamp = (SELECT make_timestamp(hi * {STEP}) FROM span)"))(priority_snapshot)


@register("h5_recent_snapshot", with_alarms(
    f"SELECT entity, make_timestamp(hi * {STEP}) AS window_timestamp, "
    f"count(*) FILTER (WHERE us >= (hi - 3) * {STEP}) AS total_alarms_6h, "
    f"count(*) FILTER (WHERE us >= (hi - 3) * {STEP} AND lower(severity) = 'critical') AS critical_alarms_6h, "
    "count(*) FILTER (WHERE regexp_matches(lower(alarm_name), 'rf|rru|vswr|feeder|antenna')) AS rru_alarms_24h, count(*) AS total_alarms_24h "
    f"FROM alarms, span WHERE us >= (hi - 12) * {STEP} AND us < hi * {STEP} GROUP BY entity, hi",
    f"span AS (SELECT (max(us // 1000000 * 1000000) + {STEP} - 1) // {STEP} AS hi FROM alarms)"))
def h5_recent(spark, sf_dir):
    """Towers alarmed in the last day, from the newest dates of the history alone."""
    path = session.scratch(spark, "history")
    history.append(alarms(spark, sf_dir), path, "batch", datetime(2024, 2, 1))
    recent = history.recent(spark, path, hours=26)
    rows = sliding.newest_point_features(
        clean.with_entity(recent), Settings(lookback_hours=(6, 24)), tie="alarm_name", active_only=True)
    return rows.where("total_alarms_24h > 0").select(
        "entity", naive("window_timestamp"), "total_alarms_6h", "critical_alarms_6h", "rru_alarms_24h", "total_alarms_24h")


_ALIGNED = ("total_alarms_6h", "rru_alarms_6h", "absent_feature", "total_alarms_24h")


@register("c15_align_features", _matrix_sql(
    (6, 24), select="entity, window_timestamp, total_alarms_6h::DOUBLE AS total_alarms_6h, rru_alarms_6h::DOUBLE AS rru_alarms_6h, "
    "0.0::DOUBLE AS absent_feature, total_alarms_24h::DOUBLE AS total_alarms_24h"))
def c15(spark, sf_dir):
    rows = matrix(spark, sf_dir, Settings(lookback_hours=(6, 24))).withColumn("window_timestamp", naive("window_timestamp"))
    return columns.align(rows, _ALIGNED, keep=("entity", "window_timestamp"))


@register("c16_predictors", _matrix_sql(
    (6,), select="sum(total_alarms_6h + critical_alarms_6h + major_alarms_6h + bbu_alarms_6h + rru_alarms_6h + power_alarms_6h "
    "+ consecutive_critical_streak_6h)::BIGINT AS checksum, 7 AS predictors"))
def c16(spark, sf_dir):
    rows = matrix(spark, sf_dir, Settings(lookback_hours=(6,))).drop("entity")
    names = columns.predictor_columns(rows)
    return rows.agg(F.sum(text.total([F.col(n) for n in names])).cast("bigint").alias("checksum")).withColumn(
        "predictors", F.lit(len(names)))
