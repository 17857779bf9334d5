"""What happens around outages: precursors, co-occurrence, prevalence, bursts, timelines.

Questions of the form "is there an alarm of kind X within d" are answered with running
totals over one ordering, linear in the events. Only the pair listing joins, on (tower,
time bucket), after equal alarms have been folded into counts. Rows without the key of a
tower belong to none and are left out first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from towerlens import session
from towerlens.functions import keywords, risk, timeparts
from towerlens.operators import clean, slices


def _times(df: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """Rows folded to one per (tower, time, ...) with the number of alarms as ``n``."""
    us = timeparts.micros(F.col("event_time")).alias("us")
    return df.select(*keys, us, *more).groupBy(*keys, "us", *more).agg(F.count(F.lit(1)).alias("n"))


def split_outages(alarms: DataFrame) -> tuple[DataFrame, DataFrame]:
    condition = risk.is_outage(F.col("alarm_name"))
    return alarms.where(condition), alarms.where(~condition)


def outage_towers_only(alarms: DataFrame, keys: Sequence[str] = ("enodeb_id",)) -> DataFrame:
    """All alarms of towers with at least one outage."""
    alarms = clean.towers(alarms, keys)
    towers = split_outages(alarms)[0].select(*keys).distinct()
    return alarms.join(towers, list(keys), "left_semi")


def precursor_pairs(alarms: DataFrame, keys: Sequence[str] = ("enodeb_id",), hours: int = 1) -> DataFrame:
    """Other alarms in ``[T-h, T)`` of each outage at T on the same tower.

    ``pairs`` counts the equal (outage, alarm) combinations a row stands for.
    """
    alarms = clean.towers(alarms, keys)
    width = hours * timeparts.HOUR
    outages, others = split_outages(alarms)
    bucket = lambda us: timeparts.floor_index(us, width)
    left = (
        _times(outages, keys)
        .withColumnsRenamed({"us": "outage_us", "n": "outages"})
        .withColumn("bucket", F.explode(F.sequence(
            bucket(F.col("outage_us") - width), bucket(F.col("outage_us") - 1))))
    )
    right = (
        _times(others, keys, "alarm_name")
        .withColumnsRenamed({"us": "alarm_us", "n": "alarms"})
        .withColumn("bucket", bucket(F.col("alarm_us")))
    )
    lead = F.col("outage_us") - F.col("alarm_us")
    matched = right.join(left, [*keys, "bucket"]).where((lead > 0) & (lead <= width))
    return matched.select(
        *keys,
        F.col("alarm_name").alias("precursor_alarm_name"),
        timeparts.from_micros(F.col("outage_us")).alias("unavailable_time"),
        timeparts.from_micros(F.col("alarm_us")).alias("precursor_time"),
        (lead / F.lit(float(timeparts.MICROS))).alias("lead_time_seconds"),
        (F.col("outages") * F.col("alarms")).alias("pairs"),
    )


def precursor_counts(
    alarms: DataFrame,
    keys: Sequence[str] = ("enodeb_id",),
    hours: int = 1,
    limit: int | None = None,
) -> DataFrame:
    """Precursor pairs per alarm name without listing a pair.

    The outages in ``(t, t+h]`` of an alarm at t are the difference of the running outage
    count at the two ends, so each alarm becomes two probes in the outage ordering.
    """
    alarms = clean.towers(alarms, keys)
    width = hours * timeparts.HOUR
    outage = risk.is_outage(F.col("alarm_name"))
    folded = _times(
        alarms.withColumns({"outage": outage, "other": F.when(~outage, F.col("alarm_name"))}), keys, "outage", "other")

    def entry(shift: int, sign: int) -> Column:
        return F.struct(
            (F.col("us") + shift).alias("us"), F.lit(0 if sign == 0 else 1).alias("kind"),
            F.col("other").alias("alarm_name"), (F.col("n") * sign).alias("weight"),
            (F.col("n") if sign == 0 else F.lit(0).cast("bigint")).alias("outages"))

    # one pass: an outage is itself, any other alarm is two probes
    entries = F.when(F.col("outage"), F.array(entry(0, 0))).otherwise(F.array(entry(0, -1), entry(width, 1)))
    line = session.cut_lineage(folded.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*"))
    order = ("us", "kind", "alarm_name", "weight")
    counted = slices.running(slices.slice_groups(line, keys, order, limit), {"seen": F.col("outages")})
    return (
        counted.rows().where(F.col("kind") == 1)
        .groupBy(F.col("alarm_name").alias("precursor_alarm_name"))
        .agg(F.sum(F.col("weight") * F.col("seen")).cast("bigint").alias("pairs"))
        .where(F.col("pairs") > 0)
    )


def lead_time_histogram(pairs: DataFrame, name: str, bins: int = 50) -> DataFrame:
    """Lead times in minutes of one precursor in equal-width bins, weighted by pairs."""
    minutes = pairs.where(F.col("precursor_alarm_name") == name).select(
        (F.col("lead_time_seconds") / 60).alias("value"), "pairs")
    span = minutes.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    width = (hi - lo) / bins
    index = F.least(F.floor(F.try_divide(F.col("value") - lo, width)), F.lit(bins - 1))
    return minutes.groupBy(F.coalesce(index, F.lit(0)).cast("int").alias("bin")).agg(
        F.sum("pairs").alias("n"))


def frequent_names(alarms: DataFrame, top: int = 15) -> list[str]:
    """The ``top`` most frequent alarm names other than outages, ties by name."""
    _, others = split_outages(alarms)
    rows = (
        others.groupBy("alarm_name").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("alarm_name")).limit(top).collect()
    )
    return [r["alarm_name"] for r in rows]


def cooccurrence(
    alarms: DataFrame,
    keys: Sequence[str] = ("enodeb_id",),
    top: int = 15,
    minutes: int = 30,
    limit: int | None = None,
) -> DataFrame:
    """For each pair of frequent names: alarms of the first followed by the second.

    Followed means strictly later, at most ``minutes`` later, on the same tower. Per row
    only the next occurrence of each name matters, so no pair of rows is ever formed.
    """
    alarms = clean.towers(alarms, keys)
    names = frequent_names(alarms, top)
    if not names:
        return alarms.select(
            F.lit("").alias("base_alarm"), F.lit("").alias("following_alarm"),
            F.lit(0).cast("bigint").alias("n")).limit(0)
    us = timeparts.micros(F.col("event_time")).alias("us")
    moments = (
        alarms.where(F.col("alarm_name").isin(names)).select(*keys, us, "alarm_name")
        .groupBy(*keys, "us")
        .agg(*[F.count_if(F.col("alarm_name") == name).alias(f"c{i}") for i, name in enumerate(names)])
    )
    upcoming = slices.running(
        slices.slice_groups(session.cut_lineage(moments), keys, ("us",), limit),
        {f"next{i}": F.when(F.col(f"c{i}") > 0, F.col("us")) for i in range(len(names))},
        how="min", inclusive=False, backwards=True,
    ).rows()
    bases = F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(f"c{i}").alias("n")) for i, name in enumerate(names)
    ])
    based = upcoming.withColumn("base", F.explode(F.filter(bases, lambda b: b["n"] > 0)))
    horizon = F.col("us") + minutes * timeparts.MINUTE
    totals = based.groupBy(F.col("base.name").alias("base_alarm")).agg(*[
        F.coalesce(F.sum(F.when(F.col(f"next{i}") <= horizon, F.col("base.n"))), F.lit(0)).alias(f"t{i}")
        for i in range(len(names))
    ])
    cells = F.array(*[
        F.struct(F.lit(name).alias("following_alarm"), F.col(f"t{i}").alias("n"))
        for i, name in enumerate(names)
    ])
    return totals.select("base_alarm", F.explode(cells).alias("cell")).select("base_alarm", "cell.*")


def lead_time_prevalence(
    alarms: DataFrame,
    keys: Sequence[str] = ("enodeb_id",),
    from_hours: int = 6,
    to_hours: int = 1,
    limit: int | None = None,
) -> DataFrame:
    """Share of outages with at least one alarm of a category in ``[T-6h, T-1h]``."""
    alarms = clean.towers(alarms, keys)
    categories = list(keywords.LEAD_TIME)
    us = timeparts.micros(F.col("event_time")).alias("us")
    named = alarms.select(*keys, us, keywords.lowered(F.col("alarm_name")).alias("name"))
    outage = risk.is_outage(F.col("name"))
    moments = (
        named.where(outage | keywords.has_any(F.col("name"), keywords.LEAD_TIME.values()))
        .groupBy(*keys, "us")
        .agg(
            *[F.max(F.col("name").contains(keywords.LEAD_TIME[c])).alias(c) for c in categories],
            F.count_if(outage).alias("outages"))
    )
    none = [F.lit(False).alias(c) for c in categories]
    seen_here = F.struct(
        F.col("us"), F.lit(0).alias("kind"), *categories, F.lit(0).cast("bigint").alias("outages"))
    probe = F.struct(
        (F.col("us") - to_hours * timeparts.HOUR).alias("us"), F.lit(1).alias("kind"), *none, F.col("outages"))
    entries = F.when(F.col("outages") > 0, F.array(seen_here, probe)).otherwise(F.array(seen_here))
    line = session.cut_lineage(moments.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*"))
    seen = slices.running(
        slices.slice_groups(line, keys, ("us", "kind"), limit),
        {f"last_{c}": F.when(F.col(c), F.col("us")) for c in categories}, how="max").rows()
    earliest = F.col("us") - (from_hours - to_hours) * timeparts.HOUR
    probed = seen.where(F.col("kind") == 1).agg(
        F.sum("outages").alias("outages"),
        *[F.sum(F.when(F.col(f"last_{c}") >= earliest, F.col("outages")).otherwise(0)).alias(c) for c in categories],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("preceded")) for c in categories])
    share = F.round(F.try_divide(F.col("preceded") * F.lit(100.0), F.col("outages")), 1)
    return probed.select("outages", F.explode(cells).alias("cell")).select(
        "cell.*", "outages", share.alias("percentage"))


def minute_volume(
    alarms: DataFrame,
    keys: Sequence[str] = ("enodeb_id",),
    minutes: int = 60,
    dense: bool = False,
) -> DataFrame:
    """Alarms per minute and in the last hour ``(t-60min, t]`` for each tower.

    ``dense`` adds the silent minutes between a tower's first and last alarm.
    """
    alarms = clean.towers(alarms, keys)
    minute = timeparts.floor_index(timeparts.micros(F.col("event_time")), timeparts.MINUTE)
    counts = alarms.groupBy(*keys, minute.alias("m")).agg(F.count(F.lit(1)).alias("alarm_count"))
    window = Window.partitionBy(*keys).orderBy("m")
    if dense:
        return _dense_volume(counts, keys, minutes)
    summed = counts.withColumn(
        "_cum", F.sum("alarm_count").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    older = F.max("_cum").over(window.rangeBetween(Window.unboundedPreceding, -minutes))
    return summed.select(
        *keys,
        timeparts.from_micros(F.col("m") * F.lit(timeparts.MINUTE)).alias("minute"),
        "alarm_count",
        (F.col("_cum") - F.coalesce(older, F.lit(0))).alias("rolling_alarm_count"),
    )


def _dense_volume(counts: DataFrame, keys: Sequence[str], minutes: int) -> DataFrame:
    """:func:`minute_volume` with the silent minutes.

    A minute's alarms enter the last hour at it and leave it ``minutes`` later; between two
    such changes nothing moves, so only changes are ordered and minutes are written out last.
    """
    last = F.max("m").over(Window.partitionBy(*keys))
    enters = F.struct(F.col("m").alias("g"), F.col("alarm_count").alias("change"), F.col("alarm_count").alias("here"))
    leaves = F.struct((F.col("m") + minutes).alias("g"), (-F.col("alarm_count")).alias("change"), F.lit(0).cast("bigint").alias("here"))
    changes = counts.withColumn("_last", last).select(*keys, "_last", F.explode(F.array(enters, leaves)).alias("_c"))
    changes = changes.where(F.col("_c.g") <= F.col("_last")).groupBy(*keys, F.col("_c.g").alias("g")).agg(
        F.sum("_c.change").alias("change"), F.sum("_c.here").alias("here"))
    window = Window.partitionBy(*keys).orderBy("g")
    states = changes.select(
        *keys, "g", "here", F.coalesce(F.lead("g").over(window) - 1, F.col("g")).alias("_end"),
        F.sum("change").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("rolling_alarm_count"))
    spread = states.withColumn("m", F.explode(F.sequence("g", "_end")))
    return spread.select(
        *keys, timeparts.from_micros(F.col("m") * F.lit(timeparts.MINUTE)).alias("minute"),
        F.when(F.col("m") == F.col("g"), F.col("here")).otherwise(0).alias("alarm_count"), "rolling_alarm_count")


def outages_with_volume(alarms: DataFrame, keys: Sequence[str] = ("enodeb_id",)) -> DataFrame:
    """Each outage with the rolling alarm volume of its minute."""
    alarms = clean.towers(alarms, keys)
    outages = split_outages(alarms)[0].withColumn("minute", F.date_trunc("minute", "event_time"))
    volume = minute_volume(alarms, keys).select(*keys, "minute", "rolling_alarm_count")
    return outages.join(volume, [*keys, "minute"], "left")


def until_last_outage(alarms: DataFrame, keys: Sequence[str] = ("enodeb_id",)) -> DataFrame:
    """Alarms up to the last outage of their tower; towers without one drop out."""
    alarms = clean.towers(alarms, keys)
    last = split_outages(alarms)[0].groupBy(*keys).agg(F.max("event_time").alias("_last"))
    return alarms.join(last, list(keys)).where(F.col("event_time") <= F.col("_last")).drop("_last")


def busiest_outage_towers(alarms: DataFrame, keys: Sequence[str] = ("enodeb_id",), top: int = 15) -> DataFrame:
    """Towers with an outage that have most other alarms."""
    alarms = clean.towers(alarms, keys)
    per_tower = alarms.groupBy(*keys).agg(
        F.count_if(~risk.is_outage(F.col("alarm_name"))).alias("other_alarm_count"),
        F.count_if(risk.is_outage(F.col("alarm_name"))).alias("_outages"),
    )
    kept = per_tower.where((F.col("_outages") > 0) & (F.col("other_alarm_count") > 0)).drop("_outages")
    return kept.orderBy(F.desc("other_alarm_count"), *[F.asc(k) for k in keys]).limit(top)


def outage_timeline(alarms: DataFrame, keys: Sequence[str] = ("enodeb_id",), top: int = 15) -> DataFrame:
    """Labelled alarms of the busiest outage towers up to their last outage."""
    alarms = clean.towers(alarms, keys)
    towers = busiest_outage_towers(alarms, keys, top).select(*keys)
    chosen = alarms.join(towers, list(keys), "left_semi")
    return until_last_outage(chosen, keys).withColumn(
        "alarm_type_category", risk.outage_label(F.col("alarm_name")))


