"""Event-sequence features per tower."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from towerlens.catalog.base import alarms, every_alarm, integers, raw, rounded, table, with_every_alarm, with_raw, with_towers
from towerlens.catalog.registry import Area
from towerlens.functions import text, timeparts
from towerlens.operators import clean, encode, sequence, slices

register = Area()
QUERIES, SQL = register.queries, register.sql

KEYS = ("enodeb_id",)
ORDER = ("event_time", "log_serial_number")

# Codes without a fitted encoder, so that both sides agree: positions in fixed lists.
_NAMES = (
    "BBU Board Fault", "Cell Outage", "Cell Unavailable", "Mains Input Failure",
    "RF Unit VSWR Threshold Exceeded", "S1 Interface Fault", "Service Unavailable",
)


def coded(spark, sf_dir, read) -> DataFrame:
    """Alarms with the five encoded columns the lag features use."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    return read(spark, sf_dir).withColumns({
        "alarm_name_encoded": F.array_position(names, F.col("alarm_name")).cast("int") - 1,
        "severity_encoded": text.severity_rank(F.col("severity")),
        "alarm_source_encoded": (F.col("log_serial_number") % 4).cast("int"),
        "object_type_encoded": (F.col("log_serial_number") % 3).cast("int"),
        "alarm_type_encoded": (F.col("is_bbu") + F.col("is_rru") * 2 + F.col("is_power") * 3).cast("int"),
    })


CODED_SQL = (
    "coded AS (SELECT *, list_position(['" + "','".join(_NAMES) + "'], alarm_name) - 1 AS alarm_name_encoded, "
    "CASE severity WHEN 'Critical' THEN 4 WHEN 'Major' THEN 3 WHEN 'Minor' THEN 2 WHEN 'Warning' THEN 1 ELSE 0 END AS severity_encoded, "
    "log_serial_number % 4 AS alarm_source_encoded, log_serial_number % 3 AS object_type_encoded, "
    "is_bbu + is_rru * 2 + is_power * 3 AS alarm_type_encoded FROM alarms)"
)


def _lag_sql() -> str:
    return ", ".join(
        f"coalesce(lag({column}, {i}) OVER w, -1)::INT AS {stem}_{i}"
        for column, stem in sequence.LAGGED.items() for i in range(1, 6))


LAGGED_SQL = f"lagged AS (SELECT *, {_lag_sql()} FROM coded WINDOW w AS (PARTITION BY enodeb_id ORDER BY event_time, log_serial_number))"
_W = "WINDOW w AS (PARTITION BY enodeb_id ORDER BY event_time, log_serial_number)"


def sliced(df: DataFrame) -> slices.Sliced:
    return slices.slice_groups(df, KEYS, ORDER)


def towers(spark, sf_dir) -> DataFrame:
    """Alarms of towers that have an eNodeB."""
    return clean.towers(alarms(spark, sf_dir), KEYS)


def lagged(spark, sf_dir, read) -> DataFrame:
    return sequence.lag_features(sliced(coded(spark, sf_dir, read))).rows()


_LAG_NAMES = [f"{stem}_{i}" for stem in sequence.LAGGED.values() for i in range(1, 6)]


@register("g1_lag_features", with_every_alarm(
    "SELECT log_serial_number, " + ", ".join(_LAG_NAMES) + " FROM lagged", CODED_SQL, LAGGED_SQL))
def g1(spark, sf_dir):
    return lagged(spark, sf_dir, every_alarm).select("log_serial_number", *_LAG_NAMES)


@register("g2_gap_minutes", with_every_alarm(
    "SELECT log_serial_number, coalesce((us - lag(us) OVER w)::DOUBLE / 60000000::DOUBLE, 0) AS time_gap_previous_alarm "
    "FROM alarms " + _W))
def g2(spark, sf_dir):
    rows = sequence.gap_minutes(sliced(every_alarm(spark, sf_dir))).rows()
    return rows.select("log_serial_number", "time_gap_previous_alarm")


@register("g3_position", with_every_alarm(
    "SELECT log_serial_number, row_number() OVER w - 1 AS sequence_length FROM alarms " + _W))
def g3(spark, sf_dir):
    return sequence.position(sliced(every_alarm(spark, sf_dir))).rows().select(
        "log_serial_number", *integers("sequence_length"))


@register("g4_repeat_count", with_every_alarm(
    "SELECT log_serial_number, row_number() OVER (PARTITION BY enodeb_id, alarm_name ORDER BY event_time, "
    "log_serial_number) - 1 AS alarm_repeat_count FROM alarms"))
def g4(spark, sf_dir):
    return sequence.repeat_count(sliced(every_alarm(spark, sf_dir))).rows().select(
        "log_serial_number", *integers("alarm_repeat_count"))


@register("g5_outages_before", with_every_alarm(
    "SELECT log_serial_number, coalesce(sum(is_cell_unavailable) OVER (PARTITION BY enodeb_id ORDER BY event_time, "
    "log_serial_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS previous_cell_unavailable_count FROM alarms"))
def g5(spark, sf_dir):
    return sequence.outages_before(sliced(every_alarm(spark, sf_dir))).rows().select(
        "log_serial_number", *integers("previous_cell_unavailable_count"))


_TARGET = (
    "coalesce(max(is_cell_unavailable) OVER (PARTITION BY enodeb_id ORDER BY event_time, log_serial_number "
    "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::INT AS target"
)


@register("g6_future_outage", with_every_alarm(f"SELECT log_serial_number, {_TARGET} FROM alarms"))
def g6(spark, sf_dir):
    return sequence.future_outage(sliced(every_alarm(spark, sf_dir))).rows().select("log_serial_number", "target")


@register("g6_future_outage_literal", with_every_alarm(
    "SELECT log_serial_number, coalesce(lag(m) OVER w, 0)::INT AS target FROM (SELECT *, "
    "max(is_cell_unavailable) OVER (PARTITION BY enodeb_id ORDER BY event_time, log_serial_number "
    "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM alarms) " + _W))
def g6_literal(spark, sf_dir):
    return sequence.future_outage(sliced(every_alarm(spark, sf_dir)), mode="literal").rows().select(
        "log_serial_number", "target")


_FEATURES = [
    *_LAG_NAMES, "sequence_length", "alarm_repeat_count", "previous_cell_unavailable_count", "target",
]


@register("sequence_features", with_every_alarm(
    "SELECT log_serial_number, " + ", ".join(_LAG_NAMES) + ", coalesce((us - lag(us) OVER w)::DOUBLE / 60000000::DOUBLE, 0) AS time_gap_previous_alarm, "
    "row_number() OVER w - 1 AS sequence_length, "
    "row_number() OVER (PARTITION BY enodeb_id, alarm_name ORDER BY event_time, log_serial_number) - 1 AS alarm_repeat_count, "
    "(sum(is_cell_unavailable) OVER w - is_cell_unavailable)::BIGINT AS previous_cell_unavailable_count, "
    f"{_TARGET} FROM lagged {_W}", CODED_SQL, LAGGED_SQL))
def all_features(spark, sf_dir):
    rows = sequence.sequence_features(coded(spark, sf_dir, every_alarm), KEYS, ORDER)
    return rows.select("log_serial_number", *_FEATURES, "time_gap_previous_alarm")


@register("g11_outage_spacing", with_every_alarm(
    "SELECT count(*) AS outage_rows, count(*) FILTER (WHERE gap < 300000000) AS short_gaps FROM ("
    "SELECT us - lag(us) OVER (PARTITION BY enodeb_id ORDER BY event_time, log_serial_number) AS gap "
    "FROM alarms WHERE is_cell_unavailable = 1)"))
def g11(spark, sf_dir):
    return sequence.outage_spacing(every_alarm(spark, sf_dir), KEYS, ORDER, flag="is_cell_unavailable")


def _streak_sql(stem: str) -> str:
    parts, so_far = [], []
    for i in range(1, 5):
        so_far.append(f"{stem}_{i} = {stem}_{i + 1}")
        parts.append(f"({' AND '.join(so_far)})::INT")
    return " + ".join(parts)


@register("g14_streaks", with_every_alarm(
    f"SELECT log_serial_number, {_streak_sql('previous_alarm_type')} AS consecutive_alarm_streak, "
    f"{_streak_sql('previous_alarm_source')} AS consecutive_source_streak FROM lagged", CODED_SQL, LAGGED_SQL))
def g14(spark, sf_dir):
    return lagged(spark, sf_dir, every_alarm).select(
        "log_serial_number", sequence.streak("previous_alarm_type").alias("consecutive_alarm_streak"),
        sequence.streak("previous_alarm_source").alias("consecutive_source_streak"))


_SOURCES = ", ".join(f"previous_alarm_source_{i}" for i in range(1, 6))


@register("g15_distinct_sources", with_every_alarm(
    f"SELECT log_serial_number, len(list_distinct([{_SOURCES}]))::INT AS unique_alarm_sources_5step FROM lagged",
    CODED_SQL, LAGGED_SQL))
def g15(spark, sf_dir):
    return lagged(spark, sf_dir, every_alarm).select(
        "log_serial_number", sequence.distinct_recent("previous_alarm_source").alias("unique_alarm_sources_5step"))


def _matches(weight: str) -> str:
    return " + ".join(
        f"(alarm_type_encoded = previous_alarm_type_{i})::INT * {weight.format(i=i)}" for i in range(1, 6))


@register("g16_repeat_ratio", with_every_alarm(
    f"SELECT log_serial_number, round(({_matches('1')}) / 5.0, 6)::DOUBLE AS alarm_repeat_ratio_5step FROM lagged",
    CODED_SQL, LAGGED_SQL))
def g16(spark, sf_dir):
    ratio = sequence.repeat_ratio(F.col("alarm_type_encoded"), "previous_alarm_type")
    return lagged(spark, sf_dir, every_alarm).select("log_serial_number", F.round(ratio, 6).alias("alarm_repeat_ratio_5step"))


@register("g17_weighted_repeats", with_every_alarm(
    f"SELECT log_serial_number, round(({_matches('1.0::DOUBLE / {i}')}), 6)::DOUBLE AS weighted_alarm_repeat_score FROM lagged",
    CODED_SQL, LAGGED_SQL))
def g17(spark, sf_dir):
    score = sequence.weighted_repeats(F.col("alarm_type_encoded"), "previous_alarm_type")
    return lagged(spark, sf_dir, every_alarm).select("log_serial_number", F.round(score, 6).alias("weighted_alarm_repeat_score"))


@register("g17_last_repeat", with_every_alarm(
    "SELECT log_serial_number, (alarm_type_encoded = previous_alarm_type_1)::INT::DOUBLE AS weighted_alarm_repeat_score FROM lagged",
    CODED_SQL, LAGGED_SQL))
def g17_last(spark, sf_dir):
    score = sequence.weighted_repeats(F.col("alarm_type_encoded"), "previous_alarm_type", depth=1)
    return lagged(spark, sf_dir, every_alarm).select("log_serial_number", score.alias("weighted_alarm_repeat_score"))


@register("g18_transition_frequency", with_towers(
    "SELECT log_serial_number, previous_alarm_type_1 || '->' || alarm_type_encoded AS pair, "
    "round(count(*) OVER (PARTITION BY previous_alarm_type_1, alarm_type_encoded) / (count(*) OVER ())::DOUBLE, 6) AS transition_pair_frequency "
    "FROM lagged", CODED_SQL, LAGGED_SQL))
def g18(spark, sf_dir):
    pair = text.joined([F.col("previous_alarm_type_1"), F.col("alarm_type_encoded")], "->")
    rows = lagged(spark, sf_dir, towers).select("log_serial_number", pair.alias("pair"))
    shared = sequence.with_share_of_rows(rows, F.col("pair"), "transition_pair_frequency")
    return shared.select("log_serial_number", "pair", *rounded("transition_pair_frequency"))


@register("g14_to_g18_shapes", with_towers(
    f"SELECT log_serial_number, {_streak_sql('previous_alarm_type')} AS consecutive_alarm_streak, "
    f"{_streak_sql('previous_alarm_source')} AS consecutive_source_streak, "
    f"len(list_distinct([{_SOURCES}]))::INT AS unique_alarm_sources_5step, "
    f"round(({_matches('1')}) / 5.0, 6)::DOUBLE AS alarm_repeat_ratio_5step, "
    f"round(({_matches('1.0::DOUBLE / {i}')}), 6)::DOUBLE AS weighted_alarm_repeat_score, "
    "round(count(*) OVER (PARTITION BY previous_alarm_type_1, alarm_type_encoded) / (count(*) OVER ())::DOUBLE, 6) AS transition_pair_frequency "
    "FROM lagged", CODED_SQL, LAGGED_SQL))
def shapes(spark, sf_dir):
    rows = sequence.lag_shape_features(lagged(spark, sf_dir, towers))
    return rows.select(
        "log_serial_number", "consecutive_alarm_streak", "consecutive_source_streak", "unique_alarm_sources_5step",
        *rounded("alarm_repeat_ratio_5step", "weighted_alarm_repeat_score", "transition_pair_frequency"))


def _before_sql(length: int) -> str:
    text_sql = " || ' -> ' || ".join(f"previous_alarm_{i}" for i in range(length, 0, -1))
    return with_towers(
        f"SELECT {length} AS length, {'CAST(previous_alarm_1 AS STRING)' if length == 1 else text_sql} AS sequence, count(*) AS n, "
        "round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labelled WHERE target = 1), 2) AS percentage "
        "FROM labelled WHERE target = 1 GROUP BY sequence ORDER BY n DESC, sequence LIMIT 10",
        CODED_SQL, LAGGED_SQL, f"labelled AS (SELECT *, {_TARGET} FROM lagged)")


def _before(length: int):
    def query(spark, sf_dir):
        parts = sequence.lag_features(sliced(coded(spark, sf_dir, towers)), {"alarm_name_encoded": "previous_alarm"})
        rows = sequence.future_outage(parts).rows()
        return sequence.sequences_before_outage(rows, length).withColumn("length", F.lit(length))
    return query


for _length in (1, 2, 3, 5):
    register(f"g19_sequence_of_{_length}", _before_sql(_length))(_before(_length))


@register("g20_processing_delay", with_raw(
    "SELECT log_serial_number, (log_serial_number % 90)::DOUBLE AS processing_delay_seconds FROM raw"))
def g20(spark, sf_dir):
    return raw(spark, sf_dir).select(
        "log_serial_number",
        timeparts.delay_seconds(F.col("event_time"), F.col("received_on")).alias("processing_delay_seconds"))


@register("e5_site_frequency", with_raw(
    "SELECT log_serial_number, string_split(alarm_source, '_')[1] AS mo_site_prefix, "
    "round(count(*) OVER (PARTITION BY string_split(alarm_source, '_')[1]) / (count(*) OVER ())::DOUBLE, 6) AS site_alarm_frequency FROM raw"))
def e5(spark, sf_dir):
    rows = encode.with_site_frequency(raw(spark, sf_dir).select("log_serial_number", "alarm_source"), "alarm_source")
    return rows.select("log_serial_number", "mo_site_prefix", *rounded("site_alarm_frequency"))


@register("j13_site_prefix", with_raw(
    "SELECT log_serial_number, string_split(mo_name, '_')[1] AS mo_site_prefix FROM raw"))
def j13(spark, sf_dir):
    return raw(spark, sf_dir).select("log_serial_number", text.site_prefix(F.col("mo_name")).alias("mo_site_prefix"))


# ---- larger volume: shipments as events of a supplier ------------------------------

_SHIP_W = "WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)"


@register("sequence_features_lineitem",
          "SELECT l_orderkey, l_linenumber, coalesce(lag(l_returnflag || l_linestatus, 1) OVER w, '-1') AS previous_alarm_1, "
          "coalesce(lag(l_returnflag || l_linestatus, 5) OVER w, '-1') AS previous_alarm_5, "
          "row_number() OVER w - 1 AS sequence_length, "
          "(sum((l_returnflag = 'R')::INT) OVER w - (l_returnflag = 'R')::INT)::BIGINT AS previous_outages, "
          "(sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_suppkey) > sum((l_returnflag = 'R')::INT) OVER w)::INT AS target "
          f"FROM lineitem {_SHIP_W}")
def shipments(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("l_shipdate"),
        F.concat("l_returnflag", "l_linestatus").alias("alarm"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_cell_unavailable"))
    ordered = slices.slice_groups(rows, ("l_suppkey",), ("l_shipdate", "l_orderkey", "l_linenumber"))
    haloed = slices.with_previous_rows(ordered, 5)
    previous = {
        f"previous_alarm_{i}": F.coalesce(F.lag("alarm", i).over(haloed.window()), F.lit("-1")) for i in (1, 5)}
    ordered = slices.without_ghosts(haloed.on(haloed.df.withColumns(previous)))
    ordered = sequence.future_outage(sequence.outages_before(sequence.position(ordered)))
    return ordered.rows().select(
        "l_orderkey", "l_linenumber", "previous_alarm_1", "previous_alarm_5", *integers("sequence_length"),
        F.col("previous_cell_unavailable_count").cast("bigint").alias("previous_outages"), "target")
