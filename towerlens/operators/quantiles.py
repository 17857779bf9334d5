"""Exact quantiles and the summaries built on them, without a per-group value list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from towerlens import session
from towerlens.operators import columns, slices

#: Accuracy of the sketch that brackets each rank, and the margin in units of its error.
SKETCH_ACCURACY, MARGIN = 10_000, 4


def _brackets(rows: DataFrame, values: Sequence[str], probabilities: Sequence[float], by: Sequence[str], whole: bool) -> DataFrame:
    """One row per group with arrays ``_lo_c`` and ``_hi_c`` around each rank of each column
    and the number ``_rows_c`` of its values; ``whole`` brackets from minimum to maximum."""
    k, parts = len(probabilities), []
    slack = MARGIN / SKETCH_ACCURACY
    ends = [min(max(p - slack, 0.0), 1.0) for p in probabilities] + [min(max(p + slack, 0.0), 1.0) for p in probabilities]
    for c in values:
        if whole:
            lo, hi = F.array_repeat(F.min(c), k), F.array_repeat(F.max(c), k)
        else:
            sketch = F.percentile_approx(c, F.array(*[F.lit(e) for e in ends]), F.lit(SKETCH_ACCURACY))
            lo, hi = F.slice(sketch, 1, k), F.slice(sketch, k + 1, k)
        parts += [F.count(c).alias(f"_rows_{c}"), lo.alias(f"_lo_{c}"), hi.alias(f"_hi_{c}")]
    return rows.groupBy(*by).agg(*parts)


def _beside(rows: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with the brackets of its group; without groups they are one row of literals."""
    if by:
        return slices.join_null_safe(rows, brackets, by, "inner")
    row = brackets.first()
    return rows.withColumns({
        n: F.array(*[F.lit(x).cast("double") for x in row[n] or []]) if n.startswith(("_lo_", "_hi_")) else F.lit(row[n])
        for n in brackets.columns})


def _order_statistics(
    rows: DataFrame, values: Sequence[str], probabilities: Sequence[float], by: Sequence[str],
    limit: int | None, whole: bool = False,
) -> DataFrame:
    """(by, _column, _i, _rows, _lo, _hi): the values at the two ranks around each quantile.

    Only rows inside a bracket are folded to (value, count) and ordered; all others are
    counted where they are read, and only if they lie below.
    """
    brackets = session.staged(_brackets(rows, values, probabilities, by, whole), "brackets")
    places = list(range(len(probabilities)))
    wide = _beside(rows, brackets, by)
    below = wide.groupBy(*by).agg(*[
        F.count_if(F.col(c) < F.get(f"_lo_{c}", F.lit(i))).alias(f"_below_{c}_{i}") for c in values for i in places])
    inside = [
        F.when(F.col(c).between(F.get(f"_lo_{c}", F.lit(i)), F.get(f"_hi_{c}", F.lit(i))), F.struct(
            F.lit(c).alias("_column"), F.lit(i).alias("_i"), F.col(c).alias("_v")))
        for c in values for i in places]
    cells = (
        wide.select(*by, F.explode(F.array_compact(F.array(*inside))).alias("_x")).select(*by, "_x.*")
        .groupBy(*by, "_column", "_i", "_v").agg(F.count(F.lit(1)).alias("_n")))
    keys = [*by, "_column", "_i"]
    sliced = slices.slice_groups(session.staged(cells, "cells"), keys, ("_v",), limit)
    summed = slices.running(sliced, {"_cum": F.col("_n")}).rows()
    wanted = _beside(below, brackets, by).select(*by, F.explode(F.array(*[F.struct(
        F.lit(c).alias("_column"), F.lit(i).alias("_i"), F.col(f"_rows_{c}").alias("_rows"),
        F.col(f"_below_{c}_{i}").alias("_below"), (F.lit(float(p)) * (F.col(f"_rows_{c}") - 1)).alias("_place"),
    ) for c in values for i, p in enumerate(probabilities)])).alias("_w")).select(*by, "_w.*")
    reached = slices.join_null_safe(summed, wanted, keys, "inner").withColumn("_upto", F.col("_cum") + F.col("_below"))

    def at(rank: Column) -> Column:
        """Value at a rank, null where the bracket missed it."""
        return F.min(F.when((F.col("_upto") > rank) & (F.col("_below") <= rank), F.col("_v")))

    return reached.groupBy(*keys, "_rows", "_place").agg(
        at(F.floor("_place")).alias("_lo"), at(F.ceil("_place")).alias("_hi"))


def many_quantiles(
    df: DataFrame, values: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (),
    names: Sequence[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """Linearly interpolated exact quantiles of several columns, one row per (by, column).

    A distributed selection: a mergeable sketch brackets every rank, rows below a bracket
    are counted and rows inside it ordered. Neither rows nor rows x columns are shuffled,
    only the distinct values inside the brackets. A rank that its bracket should miss is
    found between minimum and maximum instead, so the result is exact in any case.
    """
    names = list(names or [f"p{round(p * 100)}" for p in probabilities])
    plain = {c: f"_c{j}" for j, c in enumerate(values)}
    rows = df.select(*by, *[F.col(c).cast("double").alias(n) for c, n in plain.items()])
    found = session.staged(_order_statistics(rows, list(plain.values()), probabilities, by, limit), "ranks")
    missed = found.where("_lo IS NULL OR _hi IS NULL").select("_column").distinct()
    again = [r[0] for r in missed.collect()]  # names of columns
    if again:
        exact = _order_statistics(rows, again, probabilities, by, limit, whole=True)
        found = found.where(~F.col("_column").isin(again)).unionByName(exact)
    part = F.col("_place") - F.floor("_place")
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part
    picked = found.groupBy(*by, "_column").agg(*[F.max(F.when(F.col("_i") == i, value)).alias(n) for i, n in enumerate(names)])
    original = F.create_map(*[F.lit(x) for c, n in plain.items() for x in (n, c)])
    return picked.select(*by, F.element_at(original, F.col("_column")).alias("column"), *names)


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Linearly interpolated exact quantiles of one column per group; groups without a value
    are left out."""
    rows = df.where(F.col(value).isNotNull())
    return many_quantiles(rows, [value], probabilities, by, names, limit).drop("column")


def long_form(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(column, value) rows of the numeric columns."""
    cells = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("value")) for n in names
    ])
    return df.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.*")


def describe(df: DataFrame, names: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per (by default every) numeric column."""
    names = list(names or columns.numeric_columns(df))
    numbers = {n: F.col(n).cast("double") for n in names}
    row = df.agg(*[F.struct(
        F.lit(n).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max")).alias(f"_{j}") for j, (n, v) in enumerate(numbers.items())])
    moments = row.select(F.explode(F.array(*row.columns)).alias("_m")).select("_m.*")
    quarters = many_quantiles(df, names, (0.25, 0.5, 0.75), names=("q25", "q50", "q75"), limit=limit)
    return moments.join(quarters, "column", "left")


def describe_text(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """count, distinct values, most frequent value and its frequency per text column."""
    names = list(names or columns.categorical_columns(df))
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in names])
    counts = (
        df.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("top"),
        F.max("n").alias("freq"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum; the last bin is closed."""
    span = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    place = F.try_divide(F.col(value) - lo, (hi - lo) / bins)
    index = F.least(F.coalesce(F.floor(place), F.lit(0)), F.lit(bins - 1)).cast("int")
    placed = df.where(F.col(value).isNotNull()).select(index.alias("bin"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def box_plot(df: DataFrame, value: str, by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and the number of outliers."""
    rows = df.where(F.col(value).isNotNull())
    quarters = quantiles(rows, value, (0.25, 0.5, 0.75), by, ("q1", "median", "q3"), limit)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    if by:
        joined = rows.join(quarters, list(by))
    else:
        joined = rows.withColumns({n: quarters.select(n).scalar() for n in ("q1", "median", "q3")})
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).cast("double").alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).cast("double").alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("n"),
    )
