"""Event-sequence features per tower: lags, gaps, positions, counts, labels, streaks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from towerlens.functions import text, timeparts
from towerlens.operators import slices
from towerlens.operators.slices import Sliced

WINDOW_SIZE = 5
#: Encoded column -> stem of its lag columns.
LAGGED = {
    "alarm_name_encoded": "previous_alarm",
    "severity_encoded": "previous_severity",
    "alarm_source_encoded": "previous_alarm_source",
    "object_type_encoded": "previous_object_type",
    "alarm_type_encoded": "previous_alarm_type",
}


def lag_features(sliced: Sliced, lagged: dict[str, str] | None = None, depth: int = WINDOW_SIZE) -> Sliced:
    """Values of the 1..depth previous alarms, -1 where there is none."""
    lagged = {c: s for c, s in (lagged or LAGGED).items() if c in sliced.df.columns}
    haloed = slices.with_previous_rows(sliced, depth)
    window = haloed.window()
    lags = {
        f"{stem}_{i}": F.coalesce(F.lag(column, i).over(window), F.lit(-1)).cast("int")
        for column, stem in lagged.items()
        for i in range(1, depth + 1)
    }
    return slices.without_ghosts(haloed.on(haloed.df.withColumns(lags)))


def gap_minutes(sliced: Sliced, time_column: str = "event_time") -> Sliced:
    """Minutes since the previous alarm of the tower, 0 for its first."""
    haloed = slices.with_previous_rows(sliced, 1)
    now = timeparts.micros(F.col(time_column))
    gap = (now - F.lag(now, 1).over(haloed.window())) / F.lit(float(timeparts.MINUTE))
    filled = F.coalesce(gap, F.lit(0.0))
    return slices.without_ghosts(haloed.on(haloed.df.withColumn("time_gap_previous_alarm", filled)))


def position(sliced: Sliced) -> Sliced:
    counted = slices.running(sliced, {"sequence_length": F.lit(1)})
    return counted.on(counted.df.withColumn("sequence_length", F.col("sequence_length") - 1))


def repeat_count(sliced: Sliced, name_column: str = "alarm_name") -> Sliced:
    """Earlier occurrences of the same alarm on the tower."""
    counted = slices.running(sliced, {"alarm_repeat_count": F.lit(1)}, extra=[name_column])
    return counted.on(counted.df.withColumn("alarm_repeat_count", F.col("alarm_repeat_count") - 1))


def outages_before(sliced: Sliced, flag: str = "is_cell_unavailable") -> Sliced:
    """Earlier outages on the tower (the tower's own, never another's)."""
    counted = slices.running(sliced, {"previous_cell_unavailable_count": F.col(flag)})
    own = F.col("previous_cell_unavailable_count") - F.col(flag)
    return counted.on(counted.df.withColumn("previous_cell_unavailable_count", own))


def future_outage(sliced: Sliced, flag: str = "is_cell_unavailable", mode: str = "documented") -> Sliced:
    """1 when an outage follows on the tower.

    The suffix is total minus prefix, so the sort of the other features is reused.
    ``mode="literal"`` looks from the previous alarm on and gives 0 to the first row.
    """
    counted = slices.running(sliced, {"_seen": F.col(flag)})
    totalled = slices.with_group_total(counted, {"_all": F.col(flag)})
    if mode == "documented":
        label = (F.col("_all") > F.col("_seen")).cast("int")
        return totalled.on(totalled.df.withColumn("target", label).drop("_seen", "_all"))
    numbered = slices.running(totalled, {"_position": F.lit(1)})
    haloed = slices.with_previous_rows(numbered, 1)
    before = F.coalesce(F.lag(flag, 1).over(haloed.window()), F.lit(0))
    ahead = F.col("_all") - F.col("_seen") + F.col(flag) + before
    label = F.when(F.col("_position") == 1, F.lit(0)).otherwise((ahead > 0).cast("int"))
    out = slices.without_ghosts(haloed.on(haloed.df.withColumn("target", label)))
    return out.on(out.df.drop("_seen", "_all", "_position"))


def sequence_features(
    alarms: DataFrame,
    keys: Sequence[str] = ("enodeb_id",),
    order: Sequence[str] = ("event_time", "log_serial_number"),
    limit: int | None = None,
) -> DataFrame:
    """All sequence features; one shuffle by tower serves every one of them."""
    sliced = slices.slice_groups(alarms, keys, order, limit)
    sliced = lag_features(sliced)
    sliced = gap_minutes(sliced, order[0])
    sliced = position(sliced)
    sliced = outages_before(sliced)
    sliced = future_outage(sliced)
    return repeat_count(sliced).rows()


# ---- features derived from the lag columns of one row -----------------------------


def _lags(stem: str, count: int = WINDOW_SIZE) -> list[Column]:
    return [F.col(f"{stem}_{i}") for i in range(1, count + 1)]


def streak(stem: str) -> Column:
    """Length 0..4 of the run of equal values that starts at the latest lag."""
    values = _lags(stem)
    equal = [values[i] == values[i + 1] for i in range(len(values) - 1)]
    length = F.lit(len(equal))
    for i in reversed(range(len(equal))):
        length = F.when(~equal[i], F.lit(i)).otherwise(length)
    return length.cast("int")


def distinct_recent(stem: str) -> Column:
    return F.size(F.array_distinct(F.array(*_lags(stem)))).cast("int")


def repeat_ratio(current: Column, stem: str) -> Column:
    return text.total([(current == lag).cast("int") for lag in _lags(stem)]) / F.lit(float(WINDOW_SIZE))


def weighted_repeats(current: Column, stem: str, depth: int = WINDOW_SIZE) -> Column:
    """Matches with the last ``depth`` values, the i-th weighted 1/i."""
    terms = [(current == lag).cast("double") / F.lit(float(i)) for i, lag in enumerate(_lags(stem, depth), 1)]
    return reduce(lambda a, b: a + b, terms)


def with_share_of_rows(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Relative frequency of ``key`` mapped back on each row.

    Counting is combined on the map side; the planner broadcasts the frequency table only
    when it measures small, and splits skewed keys otherwise.
    """
    keyed = df.withColumn("_share_key", key)
    counts = keyed.groupBy("_share_key").agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    shares = counts.select("_share_key", (F.col("_n") / total.scalar()).alias(name))
    return keyed.join(shares, "_share_key").drop("_share_key")


def lag_shape_features(df: DataFrame) -> DataFrame:
    """Streaks, diversity, repetition and the frequency of the latest transition."""
    kind = F.col("alarm_type_encoded")
    shaped = df.withColumns({
        "consecutive_alarm_streak": streak("previous_alarm_type"),
        "consecutive_source_streak": streak("previous_alarm_source"),
        "unique_alarm_sources_5step": distinct_recent("previous_alarm_source"),
        "alarm_repeat_ratio_5step": repeat_ratio(kind, "previous_alarm_type"),
        "weighted_alarm_repeat_score": weighted_repeats(kind, "previous_alarm_type"),
    })
    pair = text.joined([F.col("previous_alarm_type_1"), kind], "->")
    return with_share_of_rows(shaped, pair, "transition_pair_frequency")


def sequences_before_outage(df: DataFrame, length: int, top: int = 10) -> DataFrame:
    """Most frequent runs of ``length`` alarms before rows with target 1, with their share."""
    parts = [F.col(f"previous_alarm_{i}") for i in range(length, 0, -1)]
    lags = [f"previous_alarm_{i}" for i in range(1, WINDOW_SIZE + 1)]
    rows = df.where(F.col("target") == 1).na.drop(subset=lags)
    counts = rows.groupBy(text.joined(parts, " -> ").alias("sequence")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("rows"))
    share = F.round(F.col("n") / total.scalar() * 100, 2)
    return counts.withColumn("percentage", share).orderBy(F.desc("n"), F.asc("sequence")).limit(top)


def outage_spacing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    flag: str = "target",
    minutes: int = 5,
    limit: int | None = None,
) -> DataFrame:
    """Rows with the flag, outages closer than ``minutes`` to the one before on the tower."""
    outages = df.where(F.col(flag) == 1).select(*keys, *order)
    sliced = slices.with_previous_rows(slices.slice_groups(outages, keys, order, limit), 1)
    now = timeparts.micros(F.col(order[0]))
    gap = now - F.lag(now, 1).over(sliced.window())
    spaced = slices.without_ghosts(sliced.on(sliced.df.withColumn("_gap", gap))).rows()
    return spaced.agg(
        F.count(F.lit(1)).alias("outage_rows"),
        F.count_if(F.col("_gap") < minutes * timeparts.MINUTE).alias("short_gaps"),
    )
