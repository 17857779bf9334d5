"""Frequency tables, risk tables, pivots, trends and subset selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from towerlens.functions import risk
from towerlens.operators import encode

# Weekday names in report order.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _rows(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("_rows")).scalar()


def frequency(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Value counts without nulls, most frequent first, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc(column))
    return ordered if top is None else ordered.limit(top)


def relative_frequency(df: DataFrame, column: str, places: int = 2) -> DataFrame:
    """Value counts with their percentage of the non-null rows."""
    present = df.where(F.col(column).isNotNull())
    counts = present.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percentage", F.round(F.col("n") / _rows(present) * 100, places))


def group_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    present = df.na.drop(subset=list(keys))
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def flag_sum(df: DataFrame, keys: Sequence[str], flag: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(flag).alias(name))


def distinct_count(df: DataFrame, column: str, by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.groupBy(*by).agg(count.alias("n_distinct"))


def crosstab_shares(df: DataFrame, row: str, target: str) -> DataFrame:
    """Share of target 0 and 1 within each row value."""
    rate = F.avg(F.col(target).cast("double"))
    return df.where(F.col(row).isNotNull()).groupBy(row).agg(
        (1 - rate).alias("share_0"), rate.alias("share_1"))


def conditional_risk(df: DataFrame, key: str, target: str = "target") -> DataFrame:
    """P(outage | key value) for every value."""
    return df.groupBy(key).agg(F.avg(F.col(target).cast("double")).alias("risk"), F.count(F.lit(1)).alias("n"))


def highest_risk(risks: DataFrame, key: str, top: int = 20) -> DataFrame:
    return risks.orderBy(F.desc("risk"), F.asc(key)).limit(top)


def lowest_risk(risks: DataFrame, key: str, top: int = 20) -> DataFrame:
    """Lowest positive risks; when every risk is zero, the lowest of all."""
    positive = risks.agg(F.max("risk").alias("m")).scalar() > 0
    kept = risks.where((F.col("risk") > 0) | ~positive)
    return kept.orderBy(F.asc("risk"), F.desc(key)).limit(top)


def hour_by_weekday(df: DataFrame, time_column: str = "event_time") -> DataFrame:
    """Counts per hour with one column per weekday, absent days 0."""
    timed = df.select(F.hour(time_column).alias("hour_of_day"), F.date_format(time_column, "EEEE").alias("day"))
    return timed.groupBy("hour_of_day").pivot("day", list(DAYS)).agg(F.count(F.lit(1))).na.fill(0)


def outages_by(df: DataFrame, part: Column, name: str) -> DataFrame:
    return df.groupBy(part.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def extremes(counts: DataFrame, key: str) -> DataFrame:
    """Key with the most and the fewest rows, ties to the smaller key."""
    return counts.agg(
        F.min_by(key, F.struct((-F.col("n")).alias("n"), key)).alias("peak"), F.max("n").alias("peak_n"),
        F.min_by(key, F.struct("n", key)).alias("trough"), F.min("n").alias("trough_n"),
    )


def daily_trend(matrix: DataFrame, sums: Sequence[str], time_column: str = "window_timestamp") -> DataFrame:
    day = F.to_date(time_column).alias("day")
    return matrix.groupBy(day).agg(*[F.sum(c).alias(c) for c in sums])


def tower_averages(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Mean alarms per tower, mean outages over towers with any and over all towers."""
    towers = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("alarms"), F.sum(flag).alias("outages"))
    return towers.agg(
        F.avg("alarms").alias("alarms_per_tower"),
        F.avg(F.when(F.col("outages") > 0, F.col("outages"))).alias("outages_per_affected_tower"),
        F.try_divide(F.sum("outages"), F.count(F.lit(1))).alias("outages_per_tower"),
    )


def tower_health(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Healthy and unstable towers and the worst one."""
    towers = flag_sum(df, [key], flag, "outages")
    return towers.agg(
        F.count_if(F.col("outages") == 0).alias("healthy"),
        F.count_if(F.col("outages") > 0).alias("unstable"),
        F.min_by(key, F.struct((-F.col("outages")).alias("o"), key)).alias("worst_tower"),
        F.max("outages").alias("worst_outages"),
    )


def category_contribution(df: DataFrame, code: str, previous: str, mapping, target: str = "target") -> DataFrame:
    """Alarms per category, and outage rows per category of the previous alarm, with shares."""
    labelled = df.select(
        encode.category_of(F.col(code), mapping).alias("category"),
        encode.category_of(F.col(previous), mapping).alias("previous"), F.col(target).alias("target"))
    sides = F.array(
        F.struct(F.col("category").alias("category"), F.lit(1).alias("alarms"), F.lit(0).alias("outages")),
        F.struct(F.col("previous").alias("category"), F.lit(0).alias("alarms"), F.col("target").alias("outages")))
    counts = (
        labelled.select(F.explode(sides).alias("s")).groupBy("s.category")
        .agg(F.sum("s.alarms").alias("alarms"), F.sum("s.outages").alias("outages"))
        .where((F.col("alarms") > 0) | (F.col("outages") > 0))
    )
    totals = df.agg(F.count(F.lit(1)).alias("a"), F.sum(target).alias("o"))
    alarms, outages = totals.select("a").scalar(), totals.select("o").scalar()
    return counts.withColumns({
        "alarm_percentage": F.round(F.col("alarms") / alarms * 100, 2),
        "outage_percentage": F.round(F.try_divide(F.col("outages"), outages) * 100, 2),
    })


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """Positives, negatives, their ratio with at least one positive, and the positive rate."""
    positives = F.coalesce(F.sum(F.col(target).cast("bigint")), F.lit(0))
    rows = F.count(F.lit(1))
    return df.agg(
        positives.alias("positives"), (rows - positives).alias("negatives"),
        ((rows - positives) / F.greatest(positives, F.lit(1))).alias("ratio"),
        F.try_divide(positives, rows).alias("rate"),
    )


def snapshot_kpis(scored: DataFrame, probability: str) -> DataFrame:
    level = risk.tier(F.col(probability), "operations")
    return scored.agg(
        F.count(F.lit(1)).alias("towers"),
        F.count_if(level == "CRITICAL").alias("critical"),
        F.count_if(level == "WARNING").alias("warning"),
    )


def select_towers(df: DataFrame, key: str, flag: str, outage_towers: int = 20, healthy_towers: int = 15) -> DataFrame:
    """All alarms of the towers with most outages and of the busiest towers without any."""
    towers = df.groupBy(key).agg(F.sum(flag).alias("outages"), F.count(F.lit(1)).alias("alarms"))
    worst = towers.where(F.col("outages") > 0).orderBy(F.desc("outages"), F.asc(key)).limit(outage_towers)
    busy = towers.where(F.col("outages") == 0).orderBy(F.desc("alarms"), F.asc(key)).limit(healthy_towers)
    chosen = worst.select(key).unionByName(busy.select(key))
    return df.join(chosen, key, "left_semi")


def latest_of_tower(df: DataFrame, condition: Column, top: int = 100, tie: str = "log_serial_number") -> DataFrame:
    return df.where(condition).orderBy(F.desc("event_time"), F.desc(tie)).limit(top)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column absent from one side is null there."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def file_totals(raw: DataFrame, cleaned: DataFrame, source: str = "source_file") -> DataFrame:
    """Raw, cleaned and site counts per source file."""
    before = raw.groupBy(source).agg(F.count(F.lit(1)).alias("raw_rows"))
    after = cleaned.groupBy(source).agg(
        F.count(F.lit(1)).alias("cleaned_rows"), F.count_distinct("site_id").alias("sites"),
        F.max("event_time").alias("latest"))
    return before.join(after, source, "left").na.fill(0, ["cleaned_rows", "sites"])
