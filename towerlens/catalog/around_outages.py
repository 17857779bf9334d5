"""Precursors, co-occurrence, prevalence, bursts and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from towerlens.catalog.base import alarms, integers, naive, rounded, with_towers
from towerlens.catalog.registry import Area
from towerlens.operators import intervals

register = Area()
QUERIES, SQL = register.queries, register.sql

_SPLIT = (
    "outages AS (SELECT enodeb_id, us, event_time, log_serial_number FROM alarms WHERE contains(lower(alarm_name), 'cell unavailable'))",
    "others AS (SELECT enodeb_id, us, event_time, alarm_name FROM alarms WHERE NOT contains(lower(alarm_name), 'cell unavailable'))",
)
_PAIRS = "pairs AS (SELECT o.enodeb_id, p.alarm_name, o.event_time AS ot, p.event_time AS pt, o.us - p.us AS lead FROM outages o JOIN others p ON o.enodeb_id = p.enodeb_id AND p.us < o.us AND p.us >= o.us - 3600000000)"


@register("e1_outage_towers", with_towers(
    "SELECT log_serial_number, enodeb_id FROM alarms WHERE enodeb_id IN (SELECT enodeb_id FROM outages)", *_SPLIT))
def e1(spark, sf_dir):
    return intervals.outage_towers_only(alarms(spark, sf_dir)).select("log_serial_number", "enodeb_id")


@register("e2_precursor_pairs", with_towers(
    "SELECT enodeb_id, alarm_name AS precursor_alarm_name, ot AS unavailable_time, pt AS precursor_time, "
    "round(lead / 1e6, 6) AS lead_time_seconds, count(*) AS pairs FROM pairs GROUP BY ALL", *_SPLIT, _PAIRS))
def e2(spark, sf_dir):
    return intervals.precursor_pairs(alarms(spark, sf_dir)).select(
        "enodeb_id", "precursor_alarm_name", naive("unavailable_time"), naive("precursor_time"),
        *rounded("lead_time_seconds"), *integers("pairs"))


@register("e2_precursor_counts", with_towers(
    "SELECT alarm_name AS precursor_alarm_name, count(*) AS pairs FROM pairs GROUP BY ALL "
    "ORDER BY pairs DESC, precursor_alarm_name LIMIT 10", *_SPLIT, _PAIRS))
def e2_counts(spark, sf_dir):
    counts = intervals.precursor_counts(alarms(spark, sf_dir))
    return counts.orderBy(F.desc("pairs"), "precursor_alarm_name").limit(10)


@register("e2_lead_time_histogram", with_towers(
    "SELECT least(floor((m - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM "
    "(SELECT lead / 1e6 / 60 AS m FROM pairs WHERE alarm_name = 'BBU Board Fault'), "
    "(SELECT min(lead) / 1e6 / 60 AS lo, max(lead) / 1e6 / 60 AS hi FROM pairs WHERE alarm_name = 'BBU Board Fault') GROUP BY bin",
    *_SPLIT, _PAIRS))
def e2_histogram(spark, sf_dir):
    pairs = intervals.precursor_pairs(alarms(spark, sf_dir))
    return intervals.lead_time_histogram(pairs, "BBU Board Fault").select("bin", *integers("n"))


@register("e3_cooccurrence", with_towers(
    "SELECT b.name AS base_alarm, f.name AS following_alarm, count(DISTINCT CASE WHEN hit.fname = f.name THEN hit.id END) AS n "
    "FROM top b, top f, (SELECT x.log_serial_number AS id, x.alarm_name AS bname, y.alarm_name AS fname FROM alarms x LEFT JOIN alarms y "
    "ON x.enodeb_id = y.enodeb_id AND y.us > x.us AND y.us <= x.us + 1800000000 AND y.alarm_name IN (SELECT name FROM top)) hit "
    "WHERE hit.bname = b.name GROUP BY ALL", *_SPLIT,
    "top AS (SELECT alarm_name AS name FROM others GROUP BY alarm_name ORDER BY count(*) DESC, alarm_name LIMIT 15)"))
def e3(spark, sf_dir):
    return intervals.cooccurrence(alarms(spark, sf_dir)).select("base_alarm", "following_alarm", *integers("n"))


@register("e4_outages_with_volume", with_towers(
    "SELECT o.log_serial_number, (SELECT count(*) FROM alarms a WHERE a.enodeb_id = o.enodeb_id "
    "AND a.us // 60000000 <= o.us // 60000000 AND a.us // 60000000 > o.us // 60000000 - 60) AS rolling_alarm_count FROM outages o", *_SPLIT))
def e4(spark, sf_dir):
    return intervals.outages_with_volume(alarms(spark, sf_dir)).select(
        "log_serial_number", *integers("rolling_alarm_count"))


_CATEGORIES = {
    "RF": "rf", "SCTP": "sctp", "MAINS": "mains", "TRANSMISSION": "transmission",
    "S1": "s1", "BOARD": "board", "VSWR": "vswr", "OPTICAL": "optical module",
}


@register("e9_lead_time_prevalence", with_towers(
    "SELECT c.category, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM alarms a WHERE a.enodeb_id = o.enodeb_id "
    "AND contains(lower(a.alarm_name), c.word) AND a.us >= o.us - 21600000000 AND a.us <= o.us - 3600000000)) AS preceded, "
    "count(*) AS outages, round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM alarms a WHERE a.enodeb_id = o.enodeb_id "
    "AND contains(lower(a.alarm_name), c.word) AND a.us >= o.us - 21600000000 AND a.us <= o.us - 3600000000)) * 100.0::DOUBLE / count(*), 1) AS percentage "
    "FROM outages o, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _CATEGORIES.items()) + ") c(category, word) GROUP BY 1", *_SPLIT))
def e9(spark, sf_dir):
    return intervals.lead_time_prevalence(alarms(spark, sf_dir)).select(
        "category", *integers("preceded", "outages"), "percentage")


_MINUTES = "minutes AS (SELECT enodeb_id, us // 60000000 AS m, count(*) AS alarm_count FROM alarms GROUP BY ALL)"


@register("g7_minute_volume", with_towers(
    "SELECT enodeb_id, make_timestamp(m * 60000000) AS minute, alarm_count, sum(alarm_count) OVER (PARTITION BY enodeb_id ORDER BY m "
    "RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)::BIGINT AS rolling_alarm_count FROM minutes", _MINUTES))
def g7(spark, sf_dir):
    return intervals.minute_volume(alarms(spark, sf_dir)).select(
        "enodeb_id", naive("minute"), *integers("alarm_count", "rolling_alarm_count"))


@register("g7_dense_minutes", with_towers(
    "SELECT enodeb_id, sum(rolling)::BIGINT AS rolling_total, count(*) AS minutes, max(rolling)::BIGINT AS peak FROM (SELECT enodeb_id, m, "
    "sum(coalesce(alarm_count, 0)) OVER (PARTITION BY enodeb_id ORDER BY m ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS rolling FROM "
    "(SELECT enodeb_id, unnest(generate_series(min(m), max(m))) AS m FROM minutes GROUP BY enodeb_id) LEFT JOIN minutes USING (enodeb_id, m)) "
    "GROUP BY enodeb_id", _MINUTES))
def g7_dense(spark, sf_dir):
    rows = intervals.minute_volume(alarms(spark, sf_dir), dense=True)
    return rows.groupBy("enodeb_id").agg(
        F.sum("rolling_alarm_count").alias("rolling_total"), F.count(F.lit(1)).alias("minutes"),
        F.max("rolling_alarm_count").alias("peak"))


@register("d7_until_last_outage", with_towers(
    "SELECT log_serial_number FROM alarms JOIN (SELECT enodeb_id, max(us) AS last FROM outages GROUP BY ALL) USING (enodeb_id) WHERE us <= last", *_SPLIT))
def d7(spark, sf_dir):
    return intervals.until_last_outage(alarms(spark, sf_dir)).select("log_serial_number")


_TOP = (
    "towers AS (SELECT enodeb_id, count(*) AS other_alarm_count FROM others WHERE enodeb_id IN (SELECT enodeb_id FROM outages) "
    "GROUP BY enodeb_id ORDER BY other_alarm_count DESC, enodeb_id LIMIT 15)"
)


@register("h2_busiest_outage_towers", with_towers("SELECT * FROM towers", *_SPLIT, _TOP))
def h2(spark, sf_dir):
    return intervals.busiest_outage_towers(alarms(spark, sf_dir))


@register("g21_outage_timeline", with_towers(
    "SELECT log_serial_number, enodeb_id, event_time, CASE WHEN contains(lower(alarm_name), 'cell unavailable') THEN 'Cell Unavailable' "
    "ELSE 'Other Alarm' END AS alarm_type_category FROM alarms JOIN (SELECT enodeb_id, max(us) AS last FROM outages GROUP BY ALL) USING (enodeb_id) "
    "WHERE us <= last AND enodeb_id IN (SELECT enodeb_id FROM towers)", *_SPLIT, _TOP))
def g21(spark, sf_dir):
    return intervals.outage_timeline(alarms(spark, sf_dir)).select(
        "log_serial_number", "enodeb_id", naive("event_time"), "alarm_type_category")
