"""Ordered work per group that stays bounded when one group holds most rows.

``Window.partitionBy(key)`` puts a whole group into one task. For groups above a row
limit the rows are range-partitioned by (key, order) instead, so that a group covers many
slices of bounded size. Windows then run per (key, slice), and the small per-slice
summaries carry running totals and border rows from slice to slice. Groups below the
limit never pay for this: their slice is 0 and nothing is carried.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from towerlens import session

SLICE = "_slice"
GHOST = "_ghost"


@dataclass(frozen=True)
class Order:
    """One sort key: a column name and its direction."""

    name: str
    descending: bool = False

    def column(self) -> Column:
        return F.desc(self.name) if self.descending else F.asc(self.name)


@dataclass(frozen=True)
class Sliced:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[Order, ...]
    split: bool

    @property
    def group(self) -> list[str]:
        return [*self.keys, SLICE] if self.split else list(self.keys)

    def window(self, *extra: str) -> WindowSpec:
        """Rows of one slice in order, optionally by further columns inside it."""
        return Window.partitionBy(*self.group, *extra).orderBy(*[o.column() for o in self.order])

    def rows(self) -> DataFrame:
        return self.df.drop(SLICE)

    def on(self, df: DataFrame) -> "Sliced":
        return Sliced(df, self.keys, self.order, self.split)


def _orders(order: Sequence[str | Order]) -> tuple[Order, ...]:
    return tuple(o if isinstance(o, Order) else Order(o) for o in order)


def join_null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Join by name where null keys meet each other."""
    own = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_right_{n}")) for n in names])
    return left.join(own, same, how).drop(*[f"_right_{n}" for n in names])


def slice_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Order],
    limit: int | None = None,
) -> Sliced:
    """Split the groups of ``keys`` that hold more than ``limit`` rows into ordered slices.

    ``order`` must be a total order within a group. One counting job on the key columns
    (combined on the map side) finds the groups; only their rows are range-partitioned,
    and the result is written to the shared folder so that slice borders never move.
    """
    limit = session.HOT_GROUP_ROWS if limit is None else limit
    orders = _orders(order)
    keys = tuple(keys)
    if not keys:
        return _slice_all(df, orders, limit)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = F.col("_n") > limit
    total, rows = counts.agg(F.sum("_n"), F.sum(F.when(large, F.col("_n")))).first()
    if rows is None:
        return Sliced(_dealt(df, keys, total or 0), keys, orders, split=False)
    hot = session.cut_lineage(counts.where(large).coalesce(1))
    hot_keys = hot.select(*keys)
    cold = _dealt(join_null_safe(df, hot_keys, keys, "left_anti"), keys, total - rows).withColumn(SLICE, F.lit(0))
    busy = _range_sliced(join_null_safe(df, hot_keys, keys, "left_semi"), keys, orders, rows, limit)
    return Sliced(cold.unionByName(busy), keys, orders, split=True)


def _dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` by its keys in as many tasks as its rows ask for; few rows are left to the planner.

    Windows and sums by the keys then run where the rows are, and what a task holds does not
    grow with the table.
    """
    if rows <= session.TASK_ROWS:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // session.TASK_ROWS)), *keys)


def _slice_all(df: DataFrame, orders: tuple[Order, ...], limit: int) -> Sliced:
    rows = df.count()
    if rows <= limit:
        return Sliced(df, (), orders, split=False)
    return Sliced(_range_sliced(df, (), orders, rows, limit), (), orders, split=True)


def _range_sliced(df: DataFrame, keys, orders, rows: int, limit: int) -> DataFrame:
    parts = max(2, -(-rows // limit) * 2)
    ranged = df.repartitionByRange(parts, *keys, *[o.column() for o in orders])
    return session.cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id() + 1))


def _carry_window(keys: Sequence[str], reverse: bool = False) -> WindowSpec:
    order = F.desc(SLICE) if reverse else F.asc(SLICE)
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


_COMBINE: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(
    sliced: Sliced,
    values: Mapping[str, Column],
    how: str = "sum",
    extra: Sequence[str] = (),
    inclusive: bool = True,
    backwards: bool = False,
) -> Sliced:
    """Add running ``sum``/``max``/``min`` columns over the ordered group.

    ``backwards`` runs from the last row to the first (the frame "everything after"),
    which keeps the cost linear. ``extra`` restarts the total for each of its values.
    """
    aggregate, combine = _COMBINE[how]
    orders = [Order(o.name, o.descending != backwards) for o in sliced.order]
    window = (
        Window.partitionBy(*sliced.group, *extra)
        .orderBy(*[o.column() for o in orders])
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    empty = F.lit(0) if how == "sum" else None
    local = {
        name: F.coalesce(aggregate(value).over(window), empty) if empty is not None else aggregate(value).over(window)
        for name, value in values.items()
    }
    if not sliced.split:
        return sliced.on(sliced.df.withColumns(local))
    groups = [*sliced.keys, *extra]
    totals = (
        sliced.df.where(F.col(SLICE) > 0)
        .groupBy(*groups, SLICE)
        .agg(*[aggregate(value).alias(f"_total_{name}") for name, value in values.items()])
    )
    carried = _carry_window(groups, backwards)
    carry = totals.select(
        *groups, SLICE,
        *[aggregate(f"_total_{name}").over(carried).alias(f"_carry_{name}") for name in values],
    )
    joined = join_null_safe(sliced.df.withColumns(local), carry, [*groups, SLICE])
    out = joined.withColumns({
        name: combine(F.col(f"_carry_{name}"), F.col(name)) for name in values
    }).drop(*[f"_carry_{name}" for name in values])
    return sliced.on(out)


def with_group_total(sliced: Sliced, values: Mapping[str, Column]) -> Sliced:
    """Add the sum of the whole group to each of its rows."""
    if not sliced.keys or sliced.split:
        totals = sliced.df.groupBy(*sliced.keys).agg(
            *[F.sum(value).alias(name) for name, value in values.items()]
        )
        df = (
            join_null_safe(sliced.df, totals, sliced.keys)
            if sliced.keys
            else sliced.df.withColumns({n: totals.select(n).scalar() for n in values})
        )
        return sliced.on(df)
    window = Window.partitionBy(*sliced.keys)
    return sliced.on(sliced.df.withColumns({n: F.sum(v).over(window) for n, v in values.items()}))


def with_previous_rows(sliced: Sliced, count: int) -> Sliced:
    """Put copies of the ``count`` rows before each slice in front of it, marked as ghosts.

    After ``lag`` up to ``count`` the ghosts are removed with :func:`without_ghosts`.
    """
    if not sliced.split:
        return sliced
    busy = sliced.df.where(F.col(SLICE) > 0)
    payload = [c for c in sliced.df.columns if c != SLICE]
    back = Window.partitionBy(*sliced.group).orderBy(
        *[Order(o.name, not o.descending).column() for o in sliced.order]
    )
    tails = (
        busy.withColumn("_back", F.row_number().over(back))
        .where(F.col("_back") <= count)
        .groupBy(*sliced.keys, SLICE)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("_at"), *payload))).alias("_tail"))
    )
    near = (
        Window.partitionBy(*sliced.keys).orderBy(F.asc(SLICE)).rowsBetween(-count, -1)
    )
    ghosts = (
        tails.select(*sliced.keys, SLICE, F.flatten(F.collect_list("_tail").over(near)).alias("_rows"))
        .select(SLICE, F.explode(F.slice("_rows", F.greatest(F.size("_rows") - (count - 1), F.lit(1)), F.lit(count))).alias("_row"))
        .select(*[F.col(f"_row.{c}").alias(c) for c in payload], SLICE, F.lit(True).alias(GHOST))
    )
    return sliced.on(sliced.df.withColumn(GHOST, F.lit(False)).unionByName(ghosts))


def without_ghosts(sliced: Sliced) -> Sliced:
    if not sliced.split:
        return sliced
    return sliced.on(sliced.df.where(~F.col(GHOST)).drop(GHOST))


def global_index(df: DataFrame, order: Sequence[str | Order], name: str, limit: int | None = None) -> DataFrame:
    """0-based position of each row in the total order, without one single-task window."""
    sliced = slice_groups(df, (), order, limit)
    numbered = running(sliced, {name: F.lit(1)})
    return numbered.rows().withColumn(name, F.col(name) - 1)
