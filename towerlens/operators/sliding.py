"""Sliding lookback features, streaks and lead targets on a regular two-hour grid."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from towerlens.functions import keywords, timeparts
from towerlens.operators import columns, slices
from towerlens.settings import TARGETS, Settings

ATTRIBUTES = ("site_id", "node_identifier", "enodeb_id", "gnodeb_id")
COUNTED = ("total", "critical", "major", "bbu", "rru", "power")
#: Target column -> category flag of the events in the next two hours.
TARGET_FLAGS = {
    "target_cell_unavailable_2h": "is_cell_unavailable",
    "target_cell_outage_2h": "is_cell_outage",
    "target_cell_fault_2h": "is_cell_fault",
    "target_service_unavailable_2h": "is_service_unavailable",
}


def first_attributes(
    alarms: DataFrame,
    entity: str = "entity",
    names: Sequence[str] = ATTRIBUTES,
    order: Sequence[str] = ("event_time", "log_serial_number"),
) -> DataFrame:
    """First non-null value of each attribute per entity in time order."""
    when = F.struct(*order)
    return alarms.groupBy(entity).agg(*[
        F.min_by(name, F.when(F.col(name).isNotNull(), when)).alias(name)
        for name in names if name in alarms.columns
    ])


def flag_events(alarms: DataFrame, profile: str = "matrix") -> DataFrame:
    """Severity and category flags of the feature matrix, by its own keyword profile."""
    severity = F.lower(F.coalesce(F.col("severity"), F.lit("nan")))
    return keywords.with_flags(alarms, profile).withColumns({
        "is_critical": (severity == "critical").cast("int"),
        "is_major": (severity == "major").cast("int"),
    })


def _events(alarms: DataFrame, unit: int, tie: str, settings: Settings) -> DataFrame:
    us = timeparts.micros(F.col("event_time"))
    groups = {f"_{g}": F.col(f"is_{g}") for g in settings.feature_groups}
    return flag_events(alarms).select(
        "entity", *[a for a in ATTRIBUTES if a in alarms.columns],
        us.alias("_us"), F.col(tie).alias("_tie"),
        timeparts.floor_index(us, unit).alias("_idx"),
        F.lit(1).alias("_total"),
        F.col("is_critical").alias("_critical"),
        F.col("is_major").alias("_major"),
        *[c.alias(n) for n, c in groups.items()],
        *[F.col(flag).alias(f"_{target}") for target, flag in TARGET_FLAGS.items()],
    )


def _with_first_attributes(sliced: slices.Sliced, events: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each row with its entity's first non-null attributes in time order.

    They come from the whole of the entity's window, which the rows are sorted for anyway;
    only entities that are split over slices need an aggregate of their own.
    """
    if not names:
        return sliced.rows()
    if sliced.split:
        firsts = first_attributes(events, names=names, order=("_us", "_tie"))
        return slices.join_null_safe(sliced.rows().drop(*names), firsts, ["entity"], "inner")
    whole = sliced.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sliced.rows().withColumns({a: F.first(a, ignorenulls=True).over(whole) for a in names})


def _buckets(events: DataFrame, counted: Sequence[str], limit: int | None) -> DataFrame:
    """One row per (entity, bucket) with counts, target flags and the latest critical pair.

    ``_pair`` is the bucket of the earlier event of an adjacent critical pair whose later
    event lies in this bucket. All shuffles are by entity.
    """
    sliced = slices.slice_groups(events, ("entity",), ("_us", "_tie"), limit)
    haloed = slices.with_previous_rows(sliced, 1)
    window = haloed.window()
    pair = F.when(
        (F.col("_critical") == 1) & (F.lag("_critical", 1).over(window) == 1),
        F.lag("_idx", 1).over(window),
    )
    paired = slices.without_ghosts(haloed.on(haloed.df.withColumn("_pair", pair)))
    known = [a for a in ATTRIBUTES if a in events.columns]
    # the attributes are the same in all rows of an entity, so they add no groups
    return _with_first_attributes(paired, events, known).groupBy("entity", *known, "_idx").agg(
        *[F.sum(f"_{c}").alias(f"_{c}") for c in counted],
        *[F.max(f"_{t}").alias(f"_{t}") for t in TARGET_FLAGS],
        F.max("_pair").alias("_pair"),
    )


def _sweep(buckets: DataFrame, spans: Sequence[tuple[str, Column, Column, Column]], keys: Sequence[str]) -> DataFrame:
    """State of every span at the points where it changes, one row per (entity, point).

    A span (name, from, to, weight) adds its weight at ``from`` and takes it away at ``to``;
    spans of equal ends share a row. One running sum per name then serves every lookback.
    """
    names = list(dict.fromkeys(name for name, *_ in spans))
    changes: dict[str, tuple[Column, dict[str, Column]]] = {}
    for name, start, stop, weight in spans:
        for point, change in ((start, weight), (stop, -weight)):
            at = changes.setdefault(str(point), (point, {}))[1]
            at[name] = at[name] + change if name in at else change
    rows = [
        F.struct(point.cast("bigint").alias("_g"), *[at.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])
        for point, at in changes.values()
    ]
    exploded = buckets.select(*keys, F.explode(F.array(*rows)).alias("_change")).select(*keys, "_change.*")
    summed = exploded.where(F.col("_g").isNotNull()).groupBy(*keys, "_g").agg(*[F.sum(n).alias(n) for n in names])
    order = Window.partitionBy("entity").orderBy("_g")
    until_now = order.rowsBetween(Window.unboundedPreceding, 0)
    return summed.select(
        *keys, "_g", *[F.sum(n).over(until_now).alias(n) for n in names],
        F.lead("_g").over(order).alias("_next"), F.lag("_g").over(order).isNull().alias("_opens"))


def lookback_features(
    alarms: DataFrame,
    settings: Settings | None = None,
    tie: str = "log_serial_number",
    dense: bool = True,
    streak_hours: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Feature matrix: one row per entity and grid point.

    Counts over ``[t-h, t)`` come from an expiry sweep: a bucket adds where it enters a
    lookback and subtracts where it leaves it, so the cost is linear in the buckets whatever
    the lookback, and grid points are only written out between changes. ``dense=False`` keeps
    only points within the longest lookback of an event, which is what a large estate of
    mostly silent towers needs.
    """
    settings = settings or Settings()
    lookbacks = list(settings.lookback_hours)
    streak_hours = streak_hours or settings.streak_hours
    step_hours = timeparts.STEP_HOURS
    unit_hours = gcd(step_hours, *lookbacks, streak_hours)
    unit = unit_hours * timeparts.HOUR
    per_step = step_hours // unit_hours
    counted = ["total", "critical", "major", *settings.feature_groups]

    span = alarms.agg(
        F.min(timeparts.micros(F.col("event_time"))).alias("first_us"),
        F.max(timeparts.micros(F.col("event_time"))).alias("last_us"),
    )
    bounds = span.select(
        (timeparts.floor_index(F.col("first_us"), timeparts.STEP) * per_step).alias("lo"),
        (timeparts.floor_index(F.col("last_us") + timeparts.STEP - 1, timeparts.STEP) * per_step).alias("hi"),
    )
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()

    events = _events(alarms, unit, tie, settings)
    buckets = _buckets(events, counted, limit)
    known = [a for a in ATTRIBUTES if a in alarms.columns]
    here, after = F.col("_idx"), F.col("_idx") + 1
    streak_name = f"consecutive_critical_streak_{streak_hours}h"
    out_of_reach = F.col("_pair") + streak_hours // unit_hours + 1
    streak_end = F.when(out_of_reach > after, out_of_reach)
    spans = [
        # a bucket counts at the points after it, for as long as the lookback reaches
        *[(f"{c}_alarms_{h}h", after, after + h // unit_hours, F.col(f"_{c}")) for h in lookbacks for c in counted],
        # a pair counts until its earlier event is out of reach; a pair without reach has no span
        (streak_name, after, streak_end, streak_end.isNotNull().cast("int")),
        # a target counts at the point whose next two hours hold the bucket
        *[(t, here - (per_step - 1), after, F.col(f"_{t}")) for t in TARGET_FLAGS],
    ]
    if not dense:
        reach = max([*lookbacks, streak_hours]) // unit_hours
        spans.append(("_alive", here, here + reach + 1, F.lit(1)))
    states = _sweep(buckets, spans, ["entity", *known])

    # a state holds up to the next change; of its points those of the two-hour grid stay
    first = F.greatest(F.when(F.col("_opens") & F.lit(dense), lo).otherwise(F.col("_g")), lo)
    last = F.least(F.coalesce(F.col("_next") - 1, hi), hi)
    first, last = F.ceil(first / per_step).cast("bigint"), F.floor(last / per_step).cast("bigint")
    opening = F.col("_g")
    states = states.withColumns({"_first": first, "_last": last})
    if not dense:
        states = states.where("_alive > 0")
    points = states.where("_first <= _last").withColumn("_point", F.explode(F.sequence("_first", "_last")))
    # before an entity's first change nothing counts yet
    now = F.col("_point") * per_step >= opening
    counts = {f"{c}_alarms_{h}h": "bigint" for h in lookbacks for c in counted}
    features = {n: F.when(now, F.col(n)).otherwise(0).cast(kind) for n, kind in counts.items()}
    for name in (streak_name, *TARGET_FLAGS):
        features[name] = (now & (F.col(name) > 0)).cast("int")
    matrix = points.withColumns(features)
    active = [F.col(c) for c in settings.target_columns]
    combined = F.greatest(*active, F.lit(0)) if active else F.lit(0)
    return matrix.select(
        "entity", *known,
        timeparts.from_micros(F.col("_point") * F.lit(timeparts.STEP)).alias("window_timestamp"),
        *features,
        combined.cast("int").alias("target_outage_next_2h"),
    )


def newest_point_features(
    alarms: DataFrame,
    settings: Settings | None = None,
    tie: str = "log_serial_number",
    active_only: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """The rows of :func:`lookback_features` at its newest grid point, without the grid.

    One aggregate per tower counts what lies inside each lookback before that point.
    ``active_only`` leaves out towers without an alarm in the longest lookback, so that
    older rows are filtered before anything else; attributes are then the first ones in it.
    """
    settings = settings or Settings()
    lookbacks, streak_hours = list(settings.lookback_hours), settings.streak_hours
    unit_hours = gcd(timeparts.STEP_HOURS, *lookbacks, streak_hours)
    per_step = timeparts.STEP_HOURS // unit_hours
    newest = alarms.agg(F.max(timeparts.micros(F.col("event_time"))).alias("last_us"))
    point = newest.select((timeparts.floor_index(F.col("last_us") + timeparts.STEP - 1, timeparts.STEP) * per_step).alias("g")).scalar()
    reach = max([*lookbacks, streak_hours]) // unit_hours
    if active_only:
        start = timeparts.from_micros((point - reach) * F.lit(unit_hours * timeparts.HOUR))
        alarms = alarms.where(F.col("event_time") >= start)
    events = _events(alarms, unit_hours * timeparts.HOUR, tie, settings)
    buckets = _buckets(events, ["total", "critical", "major", *settings.feature_groups], limit)
    known = [a for a in ATTRIBUTES if a in alarms.columns]
    back = point - F.col("_idx")
    counted = ["total", "critical", "major", *settings.feature_groups]
    within = {h: back.between(1, h // unit_hours) for h in lookbacks}
    streak = (back >= 1) & (F.col("_pair") >= point - streak_hours // unit_hours)
    ahead = -back
    features = [F.sum(F.when(within[h], F.col(f"_{c}")).otherwise(0)).cast("bigint").alias(f"{c}_alarms_{h}h") for h in lookbacks for c in counted]
    targets = [F.max(F.when(ahead.between(0, per_step - 1), F.col(f"_{t}")).otherwise(0)).cast("int").alias(t) for t in TARGET_FLAGS]
    rows = buckets.groupBy("entity", *known).agg(
        *features, F.max(F.coalesce(streak, F.lit(False)).cast("int")).alias(f"consecutive_critical_streak_{streak_hours}h"), *targets)
    active = [F.col(c) for c in settings.target_columns]
    return rows.select(
        "entity", *known, timeparts.from_micros(point * F.lit(unit_hours * timeparts.HOUR)).alias("window_timestamp"),
        *[c for c in rows.columns if c not in ("entity", *known)],
        (F.greatest(*active, F.lit(0)) if active else F.lit(0)).cast("int").alias("target_outage_next_2h"))


def grid_points(alarms: DataFrame) -> DataFrame:
    """Every two-hour point from the first alarm (rounded down) to the last (rounded up)."""
    us = timeparts.micros(F.col("event_time"))
    span = alarms.agg(F.min(us).alias("a"), F.max(us).alias("b"))
    lo = timeparts.floor_index(F.col("a"), timeparts.STEP)
    hi = timeparts.floor_index(F.col("b") + timeparts.STEP - 1, timeparts.STEP)
    points = span.select(F.explode(F.sequence(lo, hi)).alias("g"))
    return points.select(timeparts.from_micros(F.col("g") * F.lit(timeparts.STEP)).alias("window_timestamp"))


def entity_grid(alarms: DataFrame) -> DataFrame:
    """Every entity at every grid point, generated per entity rather than joined."""
    points = grid_points(alarms).agg(
        F.min("window_timestamp").alias("lo"), F.max("window_timestamp").alias("hi"))
    lo, hi = points.select("lo").scalar(), points.select("hi").scalar()
    times = F.sequence(lo, hi, F.expr(f"INTERVAL '{timeparts.STEP_HOURS}' HOUR"))
    return alarms.select("entity").distinct().withColumn("window_timestamp", F.explode(times))


def latest_point_features(
    alarms: DataFrame,
    entity: str = "entity",
    order: Sequence[str] = ("event_time", "log_serial_number"),
) -> DataFrame:
    """Counts per entity in the closed windows of 6 and 24 hours up to the last event of all."""
    flagged = flag_events(alarms, "upload")
    newest = alarms.agg(F.max("event_time").alias("t")).scalar()
    rows = flagged.withColumn("window_timestamp", newest)
    at, now = timeparts.micros(F.col("event_time")), timeparts.micros(F.col("window_timestamp"))

    def within(hours: int) -> Column:
        return at >= now - F.lit(hours * timeparts.HOUR)

    short = within(6)
    counts = [F.count_if(short).alias("total_alarms_6h")] + [
        F.count_if(short & (F.col(flag) == 1)).alias(f"{name}_alarms_6h")
        for name, flag in (
            ("critical", "is_critical"), ("major", "is_major"),
            ("rru", "is_rru"), ("bbu", "is_bbu"), ("power", "is_power"),
        )
    ] + [F.count_if(within(24)).alias("total_alarms_24h")]
    firsts = [
        F.min_by(name, F.struct(*order)).alias(name)
        for name in ("site_id", "node_identifier") if name != entity and name in alarms.columns
    ]
    return rows.groupBy(entity).agg(*firsts, F.max("window_timestamp").alias("window_timestamp"), *counts)


def active_target(df: DataFrame, settings: Settings) -> DataFrame:
    """Combined label of the active targets on an existing matrix."""
    wanted = [F.col(TARGETS[t]) for t in settings.active_targets]
    label = F.greatest(*wanted, F.lit(0)) if wanted else F.lit(0)
    return df.withColumn("target_outage_next_2h", label.cast("int"))


def latest_matrix_rows(matrix: DataFrame) -> DataFrame:
    return columns.latest(matrix, "window_timestamp")
