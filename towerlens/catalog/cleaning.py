"""Cleaning, projections, predicates and scalar functions over the alarm rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from towerlens.catalog.base import (
    RAW, alarms, naive, raw, rounded, sql_any, table, with_alarms, with_raw,
)
from towerlens.catalog.registry import Area
from towerlens.functions import keywords, risk, text, timeparts
from towerlens.operators import clean, columns, encode
from towerlens.schema import NAME_CANDIDATES, TIME_CANDIDATES

register = Area()
QUERIES, SQL = register.queries, register.sql


# ---- projections ------------------------------------------------------------------

_EXPORT_HEADERS = {
    "log_serial_number": "Log Serial Number", "event_time": "Occurred On (NT)", "name": "Name",
    "severity": " Severity", "enodeb_id": "eNodeB ID", "alarm_source": "Alarm Source",
}


@register("c1_normalise_headers", with_raw(
    "SELECT log_serial_number, event_time AS occurred_on_nt, name, severity, enodeb_id, alarm_source FROM raw"))
def c1(spark, sf_dir):
    exported = raw(spark, sf_dir).select(*[F.col(c).alias(h) for c, h in _EXPORT_HEADERS.items()])
    out = columns.normalise_headers(exported)
    return out.withColumn("occurred_on_nt", naive("occurred_on_nt"))


@register("c2_name_by_position", with_raw(
    "SELECT log_serial_number, name, severity, enodeb_id FROM raw"))
def c2(spark, sf_dir):
    rows = raw(spark, sf_dir).select(
        F.col("log_serial_number").cast("string"), "name", "severity", "enodeb_id")
    # repeat the header line as data, as concatenated exports do, once per 1000 rows
    header = rows.where(F.col("log_serial_number").cast("bigint") % 1000 == 0).select(
        *[F.lit(h) for h in ("Log Serial Number", "Name", "Severity", "eNodeB ID")])
    unnamed = rows.union(header).toDF("0", "1", "2", "3")
    named = columns.name_by_position(unnamed, ("log_serial_number", "name", "severity", "enodeb_id"))
    return named.withColumn("log_serial_number", F.col("log_serial_number").try_cast("bigint"))


@register("c3_rename_present", with_raw("SELECT enodeb_id AS tower, name AS alarm, severity FROM raw"))
def c3(spark, sf_dir):
    rows = raw(spark, sf_dir).select("enodeb_id", "name", "severity")
    return columns.rename_present(rows, {"enodeb_id": "tower", "name": "alarm", "absent": "x"})


@register("c4_select_present", with_raw("SELECT log_serial_number, severity, mo_name, location_information FROM raw"))
def c4(spark, sf_dir):
    return columns.select_present(
        raw(spark, sf_dir), ("log_serial_number", "severity", "cleared_on", "mo_name", "location_information"))


@register("c5_drop_present", with_raw(
    "SELECT log_serial_number, event_time, name, severity, enodeb_id, gnodeb_id FROM raw"))
def c5(spark, sf_dir):
    kept = columns.drop_present(raw(spark, sf_dir), (
        "received_on", "alarm_source", "mo_name", "alarm_duration", "location_information", "ne_type_encoded"))
    return kept.withColumn("event_time", naive("event_time"))


@register("c6_first_present", with_raw("SELECT log_serial_number, event_time AS t, name AS n FROM raw"))
def c6(spark, sf_dir):
    rows = raw(spark, sf_dir)
    when = columns.first_present(rows, TIME_CANDIDATES, required=True)
    name = columns.first_present(rows, NAME_CANDIDATES)
    return rows.select("log_serial_number", F.col(when).cast("timestamp_ntz").alias("t"), F.col(name).alias("n"))


@register("c7_defaults", with_raw(
    "SELECT log_serial_number, 'Major' AS severity, 0.0::DOUBLE AS duration_minutes, '-' AS site_id FROM raw"))
def c7(spark, sf_dir):
    bare = raw(spark, sf_dir).select("log_serial_number")
    return columns.with_default(bare, {"severity": "Major", "duration_minutes": 0.0, "site_id": "-"})


@register("c8_cast_or_null", with_raw(
    "SELECT log_serial_number, TRY_CAST(CASE WHEN log_serial_number % 11 = 0 THEN 'not a time' "
    "ELSE strftime(event_time, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS t, "
    "TRY_CAST(enodeb_id AS INT) AS enodeb, TRY_CAST(gnodeb_id AS INT) AS gnodeb FROM raw"))
def c8(spark, sf_dir):
    bad = F.when(F.col("log_serial_number") % 11 == 0, F.lit("not a time")).otherwise(
        timeparts.text_seconds(F.col("event_time")))
    return raw(spark, sf_dir).select(
        "log_serial_number", timeparts.parse_time(bad, "string").cast("timestamp_ntz").alias("t"),
        F.col("enodeb_id").try_cast("int").alias("enodeb"), F.col("gnodeb_id").try_cast("int").alias("gnodeb"))


@register("c9_narrow_types", with_raw(
    "SELECT min(length(enodeb_id))::INT AS shortest, max(length(enodeb_id))::INT AS longest, "
    "count(DISTINCT enodeb_id) AS towers FROM raw"))
def c9(spark, sf_dir):
    # identifiers stay dictionary-encoded strings; what narrowing would need is known from one pass
    return raw(spark, sf_dir).agg(
        F.min(F.length("enodeb_id")).alias("shortest"), F.max(F.length("enodeb_id")).alias("longest"),
        F.count_distinct("enodeb_id").alias("towers"))


@register("c10_column_kinds", with_raw(
    "SELECT 'numeric' AS kind, count(log_serial_number) AS cells FROM raw "
    "UNION ALL SELECT 'categorical', count(alarm_source) + count(mo_name) + count(enodeb_id) + count(gnodeb_id) "
    "+ count(name) + count(severity) + count(alarm_duration) + count(location_information) FROM raw"))
def c10(spark, sf_dir):
    rows = raw(spark, sf_dir)
    kinds = {"numeric": columns.numeric_columns(rows), "categorical": columns.categorical_columns(rows)}
    counted = rows.agg(*[
        text.total([F.count(c) for c in names]).alias(kind) for kind, names in kinds.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("cells")) for k in kinds])
    return counted.select(F.explode(cells).alias("c")).select("c.*")


@register("c11_placeholder_to_null", with_raw(
    "SELECT log_serial_number, nullif(mo_name, '-') AS mo_name, nullif(gnodeb_id, '-') AS gnodeb_id, "
    "nullif(alarm_duration, '-') AS alarm_duration FROM raw"))
def c11(spark, sf_dir):
    rows = raw(spark, sf_dir).select("log_serial_number", "mo_name", "gnodeb_id", "alarm_duration")
    return columns.placeholders_to_null(rows)


@register("c12_fill_missing", with_raw(
    "SELECT log_serial_number, coalesce(nullif(gnodeb_id, '-'), 'Unknown') AS gnodeb_id, "
    "coalesce(CASE WHEN log_serial_number % 3 = 0 THEN log_serial_number END, 0) AS n FROM raw"))
def c12(spark, sf_dir):
    rows = raw(spark, sf_dir).select(
        "log_serial_number", "gnodeb_id",
        F.when(F.col("log_serial_number") % 3 == 0, F.col("log_serial_number")).alias("n"))
    return columns.fill_missing(columns.placeholders_to_null(rows), "Unknown", 0)


@register("c13_drop_mostly_missing", with_raw(
    "SELECT log_serial_number, nullif(mo_name, '-') AS mo_name, "
    "CASE WHEN log_serial_number % 50 = 0 THEN gnodeb_id END AS gnodeb_id FROM raw"))
def c13(spark, sf_dir):
    rare = F.col("log_serial_number") % 50 == 0
    rows = raw(spark, sf_dir).select(
        "log_serial_number", text.placeholder_to_null(F.col("mo_name")).alias("mo_name"),
        F.when(rare, F.col("gnodeb_id")).alias("gnodeb_id"), F.when(rare, F.col("name")).alias("comment"))
    return columns.drop_mostly_missing(rows, 0.95, keep=("gnodeb_id",))


@register("c14_drop_constant", with_raw("SELECT log_serial_number, name FROM raw"))
def c14(spark, sf_dir):
    rows = raw(spark, sf_dir).select(
        "log_serial_number", "name", F.lit(7).alias("month"), F.lit(None).cast("string").alias("nothing"))
    return columns.drop_constant(rows)


@register("c17_presentation", with_raw(
    "SELECT log_serial_number, enodeb_id AS \"eNodeB ID (4G)\", "
    "printf('%.1f%%', ((log_serial_number % 997) / 997.0 * 100)::DOUBLE) AS \"Outage Probability\" FROM raw"))
def c17(spark, sf_dir):
    probability = (F.col("log_serial_number") % 997) / F.lit(997.0)
    return raw(spark, sf_dir).select(
        "log_serial_number", F.col("enodeb_id").alias("eNodeB ID (4G)"),
        text.percent_text(probability).alias("Outage Probability"))


@register("c18_columnwise", with_alarms(
    "SELECT log_serial_number, hour(event_time)::INT AS h, duration_minutes * 60 AS seconds, "
    "is_bbu + is_rru + is_power AS categories FROM alarms"))
def c18(spark, sf_dir):
    return alarms(spark, sf_dir).withColumns({
        "h": F.hour("event_time"), "seconds": F.col("duration_minutes") * 60,
        "categories": F.col("is_bbu") + F.col("is_rru") + F.col("is_power"),
    }).select("log_serial_number", "h", "seconds", "categories")


@register("c19_entity_key", with_alarms("SELECT log_serial_number, site_id, node_identifier, entity FROM alarms"))
def c19(spark, sf_dir):
    return alarms(spark, sf_dir).select("log_serial_number", "site_id", "node_identifier", "entity")


# ---- predicates -------------------------------------------------------------------


@register("d1_drop_without_time", with_raw(
    "SELECT count(*) AS n FROM raw WHERE log_serial_number % 11 <> 0"))
def d1(spark, sf_dir):
    broken = F.when(F.col("log_serial_number") % 11 == 0, F.lit("-")).otherwise(
        timeparts.text_seconds(F.col("event_time")))
    rows = raw(spark, sf_dir).select(broken.alias("occurred_on"))
    return clean.with_event_time(rows).agg(F.count(F.lit(1)).alias("n"))


@register("d2_has_enodeb", with_raw(
    "SELECT log_serial_number, gnodeb_id AS enodeb_id FROM raw WHERE trim(gnodeb_id) NOT IN ('nan', '', '-')"))
def d2(spark, sf_dir):
    rows = raw(spark, sf_dir).select("log_serial_number", F.col("gnodeb_id").alias("enodeb_id"))
    return clean.has_enodeb(rows)


@register("d3_contains", with_raw(
    "SELECT log_serial_number, name FROM raw WHERE contains(lower(name), 'cell unavailable')"))
def d3(spark, sf_dir):
    return raw(spark, sf_dir).where(risk.is_outage(F.col("name"))).select("log_serial_number", "name")


@register("d4_date_boundary", with_raw(
    "SELECT CASE WHEN event_time < TIMESTAMP '2024-01-23 00:00:00' THEN 'before' ELSE 'after' END AS side, "
    "count(*) AS n FROM raw GROUP BY 1"))
def d4(spark, sf_dir):
    rows = raw(spark, sf_dir)
    boundary = F.lit("2024-01-23 00:00:00").cast("timestamp")
    sides = rows.where(F.col("event_time") < boundary).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("before").alias("side"), "n")
    after = rows.where(F.col("event_time") >= boundary).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("after").alias("side"), "n")
    return sides.unionByName(after)


@register("d6_entity_lookup", with_alarms(
    "SELECT log_serial_number, site_id, node_identifier FROM alarms "
    "WHERE site_id = (SELECT min(site_id) FROM alarms WHERE site_id <> '-') OR node_identifier = 'NODE-10_NR_B'"))
def d6(spark, sf_dir):
    rows = alarms(spark, sf_dir)
    first = rows.where(F.col("site_id") != "-").agg(F.min("site_id").alias("s"))
    return rows.where((F.col("site_id") == first.scalar()) | (F.col("node_identifier") == "NODE-10_NR_B")).select(
        "log_serial_number", "site_id", "node_identifier")


@register("d8_drop_any_null", with_raw(
    "SELECT log_serial_number FROM raw WHERE mo_name <> '-' AND gnodeb_id <> '-'"))
def d8(spark, sf_dir):
    rows = raw(spark, sf_dir).select("log_serial_number", "mo_name", "gnodeb_id")
    return columns.placeholders_to_null(rows).na.drop(subset=["mo_name", "gnodeb_id"]).select("log_serial_number")


@register("d9_class_filter", with_alarms(
    "SELECT is_cell_unavailable::INT AS target, count(*) AS n FROM alarms GROUP BY 1"))
def d9(spark, sf_dir):
    rows = alarms(spark, sf_dir)
    sides = [rows.where(F.col("is_cell_unavailable") == v).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(v).alias("target"), "n") for v in (0, 1)]
    return sides[0].unionByName(sides[1])


@register("d10_listed_identifiers", with_alarms(
    "SELECT DISTINCT site_id AS identifier FROM alarms WHERE site_id NOT IN ('-', 'nan', 'none', 'UNKNOWN') "
    "UNION ALL SELECT DISTINCT 'Identifier: ' || node_identifier FROM alarms "
    "WHERE node_identifier NOT IN ('-', 'nan', 'none', 'UNKNOWN')"))
def d10(spark, sf_dir):
    rows = alarms(spark, sf_dir)

    def listed(name):
        return rows.where(F.col(name).isNotNull() & ~F.col(name).isin("-", "nan", "none", "UNKNOWN")).select(name).distinct()

    sites = listed("site_id").select(F.col("site_id").alias("identifier"))
    nodes = listed("node_identifier").select(F.concat(F.lit("Identifier: "), "node_identifier").alias("identifier"))
    return sites.unionByName(nodes).orderBy("identifier")


@register("d11_window_closure", with_raw(
    "SELECT date_trunc('hour', event_time) AS t0, "
    "count(*) FILTER (WHERE event_time < date_trunc('hour', event_time) + INTERVAL 30 MINUTE) AS open_end, "
    "count(*) FILTER (WHERE event_time <= date_trunc('hour', event_time) + INTERVAL 30 MINUTE) AS closed_end "
    "FROM raw GROUP BY 1"))
def d11(spark, sf_dir):
    t0 = F.date_trunc("hour", "event_time")
    half = t0 + F.expr("INTERVAL '30' MINUTE")
    return raw(spark, sf_dir).groupBy(t0.cast("timestamp_ntz").alias("t0")).agg(
        F.count_if(F.col("event_time") < half).alias("open_end"),
        F.count_if(F.col("event_time") <= half).alias("closed_end"))


# ---- scalar functions -------------------------------------------------------------


@register("j1_site_identity", with_alarms("SELECT log_serial_number, site_id, node_identifier FROM flagged"))
def j1(spark, sf_dir):
    rows = clean.with_identity(raw(spark, sf_dir))
    return rows.select("log_serial_number", "site_id", "node_identifier")


@register("j2_site_pattern", "SELECT o_orderkey, regexp_matches('S' || lpad(CAST(o_orderkey AS STRING), 5, '0'), "
          "'^[A-Za-z][A-Za-z0-9]{4}[0-9]$')::INT AS is_site FROM orders")
def j2(spark, sf_dir):
    code = F.concat(F.lit("S"), F.expr("lpad(CAST(o_orderkey AS STRING), 5, '0')"))
    return table(spark, sf_dir, "orders").select("o_orderkey", code.rlike(text.SITE_PATTERN).cast("int").alias("is_site"))


def _flags_sql(profile: str, source: str) -> str:
    lists = keywords.PROFILES[profile]
    return "SELECT log_serial_number, " + ", ".join(
        f"CAST({sql_any('lower(name)', words)} AS INT) AS {flag}" for flag, words in lists.items()) + f" FROM {source}"


def _flags(profile):
    def query(spark, sf_dir):
        rows = raw(spark, sf_dir)
        return rows.select("log_serial_number", *[
            c.alias(flag) for flag, c in keywords.flags(F.col("name"), profile).items()])
    return query


register("j3_flags_cleaning", with_raw(_flags_sql("cleaning", "raw")))(_flags("cleaning"))
register("j4_flags_matrix", with_raw(_flags_sql("matrix", "raw")))(_flags("matrix"))
register("j5_flags_upload", with_raw(_flags_sql("upload", "raw")))(_flags("upload"))


@register("j6_duration_minutes", with_alarms(
    "SELECT log_serial_number, round(duration_minutes, 6) AS duration_minutes FROM flagged"))
def j6(spark, sf_dir):
    return raw(spark, sf_dir).select(
        "log_serial_number",
        F.round(text.duration_minutes(F.col("alarm_duration")), 6).alias("duration_minutes"))


@register("j7_duration_by_token", with_raw(
    "SELECT log_serial_number, round(CASE WHEN alarm_duration = '-' THEN 0 ELSE "
    "(log_serial_number % 5) * 60.0 + (log_serial_number % 60) + (log_serial_number % 47) / 60.0 END::DOUBLE, 6) AS minutes FROM raw"))
def j7(spark, sf_dir):
    minutes = text.duration_minutes_by_token(F.col("alarm_duration"))
    return raw(spark, sf_dir).select("log_serial_number", F.round(minutes, 6).alias("minutes"))


@register("j8_severity", with_alarms(
    "SELECT log_serial_number, severity, (severity = 'Critical')::INT AS is_critical, "
    "(severity = 'Major')::INT AS is_major FROM flagged"))
def j8(spark, sf_dir):
    rows = raw(spark, sf_dir).withColumn("severity", text.capitalised(F.col("severity")))
    return rows.select(
        "log_serial_number", "severity", (F.col("severity") == "Critical").cast("int").alias("is_critical"),
        (F.col("severity") == "Major").cast("int").alias("is_major"))


@register("j9_severity_rank", with_alarms(
    "SELECT log_serial_number, CASE severity WHEN 'Critical' THEN 4 WHEN 'Major' THEN 3 WHEN 'Minor' THEN 2 "
    "WHEN 'Warning' THEN 1 ELSE 0 END AS severity_encoded FROM alarms"))
def j9(spark, sf_dir):
    rank = text.severity_rank(F.col("severity")).alias("severity_encoded")
    return alarms(spark, sf_dir).select("log_serial_number", rank)


@register("j10_label_encoding", with_alarms(
    "SELECT log_serial_number, alarm_name_encoded::INT AS alarm_name_encoded, mo_name_encoded::INT AS mo_name_encoded FROM alarms "
    "JOIN (SELECT alarm_name, dense_rank() OVER (ORDER BY alarm_name) - 1 AS alarm_name_encoded FROM (SELECT DISTINCT alarm_name FROM alarms)) USING (alarm_name) "
    "JOIN (SELECT mo_name, dense_rank() OVER (ORDER BY mo_name) - 1 AS mo_name_encoded FROM (SELECT DISTINCT mo_name FROM alarms)) USING (mo_name)"))
def j10(spark, sf_dir):
    coded = encode.label_encode(alarms(spark, sf_dir), ["alarm_name", "mo_name"])
    return coded.select("log_serial_number", *[F.col(c).cast("int") for c in ("alarm_name_encoded", "mo_name_encoded")])


@register("j10_label_mapping", with_alarms(
    "SELECT mo_name AS value, (row_number() OVER (ORDER BY mo_name) - 1)::INT AS code FROM (SELECT DISTINCT mo_name FROM alarms)"))
def j10_mapping(spark, sf_dir):
    return encode.label_mapping(alarms(spark, sf_dir), "mo_name")


@register("j11_cell_id", with_raw(
    "SELECT log_serial_number, CASE WHEN log_serial_number % 5 = 0 THEN 'Tower-Level' "
    "ELSE CAST(log_serial_number % 6 AS STRING) END AS cell_id FROM raw"))
def j11(spark, sf_dir):
    return raw(spark, sf_dir).select(
        "log_serial_number", text.cell_id(F.col("location_information"), F.lit(None)).alias("cell_id"))


@register("j12_technology", with_raw(
    "SELECT log_serial_number, CASE WHEN mo_name = '-' THEN 'UNKNOWN' ELSE 'NR' END AS mo_technology, "
    "CASE WHEN contains(alarm_source, '_LTE_') THEN 'LTE' ELSE 'UNKNOWN' END AS source_technology FROM raw"))
def j12(spark, sf_dir):
    return raw(spark, sf_dir).select(
        "log_serial_number", text.technology(F.col("mo_name")).alias("mo_technology"),
        text.technology(F.col("alarm_source")).alias("source_technology"))


@register("j15_date_parts", "SELECT o_orderkey, hour(o_orderdate)::INT AS o_hour, day(o_orderdate)::INT AS o_day, "
          "(isodow(o_orderdate) - 1)::INT AS o_weekday, month(o_orderdate)::INT AS o_month, "
          "dayname(o_orderdate) AS day_name, CAST(o_orderdate::DATE AS STRING) AS o_date FROM orders")
def j15(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    return rows.select(
        "o_orderkey", *[c.alias(n) for n, c in timeparts.date_parts(F.col("t"), "o").items()],
        F.date_format("t", "EEEE").alias("day_name"), F.to_date("t").cast("string").alias("o_date"))


@register("j16_floor_ceil", with_raw(
    "SELECT log_serial_number, time_bucket(INTERVAL 2 HOUR, event_time, TIMESTAMP '1970-01-01') AS floor_2h, "
    "time_bucket(INTERVAL 2 HOUR, event_time + INTERVAL 2 HOUR - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01') AS ceil_2h, "
    "date_trunc('minute', event_time) AS floor_minute FROM raw"))
def j16(spark, sf_dir):
    us = timeparts.micros(F.col("event_time"))
    floor = timeparts.floor_index(us, timeparts.STEP) * timeparts.STEP
    ceil = timeparts.floor_index(us + timeparts.STEP - 1, timeparts.STEP) * timeparts.STEP
    return raw(spark, sf_dir).select(
        "log_serial_number", timeparts.from_micros(floor).cast("timestamp_ntz").alias("floor_2h"),
        timeparts.from_micros(ceil).cast("timestamp_ntz").alias("ceil_2h"),
        F.date_trunc("minute", "event_time").cast("timestamp_ntz").alias("floor_minute"))


@register("j17_time_text", with_raw(
    "SELECT log_serial_number, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_text FROM raw"))
def j17(spark, sf_dir):
    return raw(spark, sf_dir).select("log_serial_number", timeparts.text_seconds(F.col("event_time")).alias("event_text"))


@register("j18_node_ids", with_raw(
    "SELECT log_serial_number, CASE WHEN log_serial_number % 6 IN (0, 1, 2) THEN '-' ELSE enodeb_id END AS enodeb_id FROM raw"))
def j18(spark, sf_dir):
    messy = (
        F.when(F.col("log_serial_number") % 6 == 0, F.lit(" nan "))
        .when(F.col("log_serial_number") % 6 == 1, F.lit(""))
        .when(F.col("log_serial_number") % 6 == 2, F.lit("none"))
        .otherwise(F.concat(F.lit("  "), "enodeb_id", F.lit(" "))))
    return raw(spark, sf_dir).select("log_serial_number", text.node_id(messy).alias("enodeb_id"))


@register("j19_nested_condition", with_raw(
    "SELECT log_serial_number, CASE WHEN mo_name <> '-' THEN mo_name WHEN gnodeb_id <> '-' THEN gnodeb_id ELSE enodeb_id END AS node FROM raw"))
def j19(spark, sf_dir):
    node = F.when(F.col("mo_name") != "-", F.col("mo_name")).otherwise(
        F.when(F.col("gnodeb_id") != "-", F.col("gnodeb_id")).otherwise(F.col("enodeb_id")))
    return raw(spark, sf_dir).select("log_serial_number", node.alias("node"))


@register("j20_rounding", with_raw(
    "SELECT name, round(count(*) * 100.0 / (SELECT count(*) FROM raw), 2)::DOUBLE AS percentage, "
    "printf('%.1f%%', count(*) * 100.0::DOUBLE / (SELECT count(*) FROM raw)) AS shown FROM raw GROUP BY name"))
def j20(spark, sf_dir):
    rows = raw(spark, sf_dir)
    total = rows.agg(F.count(F.lit(1)).alias("t")).scalar()
    share = F.col("n") * F.lit(100.0) / total
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(
        "name", F.round(share, 2).alias("percentage"), F.format_string("%.1f%%", share).alias("shown"))


_SCORE = "least(value / 500.0, 1.0)"


@register("j21_tier_operations", f"SELECT event_id, CASE WHEN {_SCORE} >= 0.65 THEN 'CRITICAL' "
          f"WHEN {_SCORE} >= 0.35 THEN 'WARNING' ELSE 'NOMINAL' END AS risk_status FROM events")
def j21(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", risk.tier(F.expr(_SCORE), "operations").alias("risk_status"))


@register("j22_tier_batch", f"SELECT event_id, CASE WHEN {_SCORE} >= 0.7 THEN 'CRITICAL' "
          f"WHEN {_SCORE} >= 0.4 THEN 'WARNING' ELSE 'NORMAL' END AS risk_level FROM events")
def j22(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", risk.tier(F.expr(_SCORE), "batch").alias("risk_level"))


@register("j23_outage_label", with_raw(
    "SELECT log_serial_number, CASE WHEN contains(lower(name), 'cell unavailable') THEN 'Cell Unavailable' "
    "ELSE 'Other Alarm' END AS label FROM raw"))
def j23(spark, sf_dir):
    return raw(spark, sf_dir).select("log_serial_number", risk.outage_label(F.col("name")).alias("label"))


@register("g12_minute_dedupe", f"WITH doubled_raw AS (SELECT * FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in RAW.items())} FROM events) "
          "), twice AS (SELECT * FROM doubled_raw UNION ALL SELECT * FROM doubled_raw WHERE log_serial_number % 50 = 0) "
          "SELECT alarm_source, name, upper(left(severity, 1)) || lower(substr(severity, 2)) AS severity, min(log_serial_number) AS log_serial_number FROM ("
          "SELECT *, row_number() OVER (PARTITION BY alarm_source, mo_name, enodeb_id, date_trunc('minute', event_time), name, severity "
          "ORDER BY event_time, log_serial_number) AS rn FROM twice) WHERE rn = 1 GROUP BY ALL")
def g12(spark, sf_dir):
    rows = raw(spark, sf_dir)
    doubled = rows.unionByName(rows.where(F.col("log_serial_number") % 50 == 0))
    kept = clean.clean_alarms(doubled)
    return kept.groupBy("alarm_source", "name", "severity").agg(F.min("log_serial_number").alias("log_serial_number"))


@register("clean_alarms", with_alarms(
    "SELECT log_serial_number, event_time, site_id, node_identifier, enodeb_id, gnodeb_id, alarm_name, severity, "
    "round(duration_minutes, 6) AS duration_minutes, is_cell_unavailable, is_cell_outage, is_cell_fault, "
    "is_service_unavailable, is_bbu, is_rru, is_power, is_outage FROM alarms"))
def cleaned(spark, sf_dir):
    return clean.clean_alarms(raw(spark, sf_dir)).select(
        "log_serial_number", naive("event_time"), "site_id", "node_identifier", "enodeb_id", "gnodeb_id",
        "alarm_name", "severity", *rounded("duration_minutes"), "is_cell_unavailable", "is_cell_outage",
        "is_cell_fault", "is_service_unavailable", "is_bbu", "is_rru", "is_power", "is_outage")
