"""Data-quality profiles, correlation and leakage audits as finding tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from towerlens import session
from towerlens.operators import clean, columns, explore, sequence, slices
from towerlens.schema import IDENTIFIER_COLUMNS, TARGET_COLUMNS

# Name parts that suggest an identifier, per audit.
PRODUCTION_ID_WORDS = ("id", "name", "code", "serial", "timestamp")
NOTEBOOK_ID_WORDS = ("id", "serial", "key")
EXTENDED_ID_WORDS = ("id", "name", "code", "serial", "index", "key", "address", "ip")
# Names that are never candidates in the production audit.
AUDIT_IDENTIFIERS = (
    "site_id", "node_identifier", "enodeb_id", "gnodeb_id", "window_timestamp", "alarm_id", "mo_name",
)
CORRELATION_LIMIT = 0.85
INFORMATION_LIMIT = 0.5
UNIQUE_LIMIT = 0.5
UNIQUE_COUNT_LIMIT = 100


def _unpivot(row: DataFrame, names: Sequence[str], label: str, value: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias(label), F.col(f"`{n}`").alias(value)) for n in names])
    return row.select(F.explode(cells).alias("_c")).select("_c.*")


def null_counts(df: DataFrame, only_present: bool = True) -> DataFrame:
    """Nulls per column, most first, in one aggregation."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    counts = _unpivot(row, df.columns, "column", "nulls")
    counts = counts.where(F.col("nulls") > 0) if only_present else counts
    return counts.orderBy(F.desc("nulls"), "column")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    sets = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return sets.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def profile(df: DataFrame) -> DataFrame:
    """Type, rows and non-null values per column."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    cells = F.array(*[
        F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.col(n).alias("non_null"))
        for n, t in df.dtypes
    ])
    return row.select(F.col("_rows").alias("rows"), F.explode(cells).alias("_c")).select("rows", "_c.*")


def _correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are present; null for a constant side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), spread)


#: Share of a column's spread below which what is left of it counts as constant.
NO_SPREAD = 1e-13


def co_moments(df: DataFrame, names: Sequence[str]) -> dict[str, np.ndarray]:
    """Pairwise-complete sums of every pair of columns, from one Gram matrix.

    ``n``, ``x``, ``xx`` and ``xy`` at [i, j] are sums over the rows in which both columns
    are present, of 1, of column i, of its square and of the product. A row is the vector
    (values or 0, presence, squares), so one matrix of three times the columns holds all of
    them; its partial sums are merged in a tree, and the plan does not grow with the pairs.
    Columns are shifted and scaled by mean and deviation first, which keeps the digits.
    NaN counts as absent.
    """
    doubles = {n: F.nullif(F.col(f"`{n}`").cast("double"), F.lit(float("nan"))) for n in names}
    row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(doubles.values())],
                 *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(doubles.values())]).first()
    scaled = [(v - F.lit(row[f"m{i}"] or 0.0)) / F.lit(row[f"s{i}"] or 1.0) for i, v in enumerate(doubles.values())]
    cells = [F.coalesce(z, F.lit(0.0)) for z in scaled]
    present = [z.isNotNull().cast("double") for z in scaled]
    vectors = df.select(array_to_vector(F.array(*cells, *present, *[z * z for z in cells])).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    d = len(doubles)
    return {"n": gram[d:2 * d, d:2 * d], "x": gram[:d, d:2 * d], "xx": gram[2 * d:, d:2 * d], "xy": gram[:d, :d]}


def correlation_matrix(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(first, second, correlation) for every pair of numeric columns, over the rows in which
    both are present; null where one side is constant."""
    names = list(names or columns.numeric_columns(df))
    schema = "first string, second string, correlation double"
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    m = co_moments(df, names)
    spread = m["n"] * m["xx"] - m["x"] ** 2
    flat = spread <= NO_SPREAD * np.maximum(m["n"] * m["xx"], m["n"] ** 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = (m["n"] * m["xy"] - m["x"] * m["x"].T) / np.sqrt(spread * spread.T)
    rows = [(a, b, None if flat[i, j] or flat[j, i] else float(np.clip(found[i, j], -1, 1)))
            for (i, a), (j, b) in combinations(enumerate(names), 2)]
    return df.sparkSession.createDataFrame(rows, schema)


def target_correlations(df: DataFrame, target: str, names: Sequence[str] | None = None) -> DataFrame:
    names = [n for n in (names or columns.numeric_columns(df)) if n != target]
    row = df.agg(*[_correlation(n, target).alias(n) for n in names])
    return _unpivot(row, names, "column", "correlation")


def correlated_pairs(df: DataFrame, above: float = CORRELATION_LIMIT, names: Sequence[str] | None = None) -> DataFrame:
    return correlation_matrix(df, names).where(F.abs("correlation") > above)


def contingency(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """(column, value, y, n): counts of every value of every column by target, written once.

    All tables come from one pass: rows are unfolded to (column, value, target) and folded
    to counts at once, on the map side first. Information, uniqueness, null counts and the
    correlation of a numeric column with the target are all sums over it.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])
    return session.staged(
        df.select(F.col(target).cast("string").alias("y"), F.explode(cells).alias("_c")).select("y", "_c.*")
        .groupBy("column", "value", "y").agg(F.count(F.lit(1)).alias("n")), "contingency")


def information_of(counts: DataFrame) -> DataFrame:
    """Mutual information in nats of each column of :func:`contingency` with the target."""
    pairs = counts.select("column", F.coalesce("value", F.lit("nan")).alias("x"), "y", "n").groupBy("column", "x", "y").agg(F.sum("n").alias("n"))
    xs = pairs.groupBy("column", "x").agg(F.sum("n").alias("nx"))
    ys = pairs.groupBy("column", "y").agg(F.sum("n").alias("ny"))
    totals = ys.groupBy("column").agg(F.sum("ny").alias("t"))
    joint = slices.join_null_safe(pairs.join(xs, ["column", "x"]), ys, ["column", "y"], "inner").join(totals, "column")
    term = F.col("n") / F.col("t") * F.log(
        F.col("n").cast("double") * F.col("t") / (F.col("nx").cast("double") * F.col("ny")))
    return joint.groupBy("column").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_information"))


def uniqueness_of(counts: DataFrame) -> DataFrame:
    """Distinct values, their share of the rows and the nulls of each column."""
    values = counts.groupBy("column", "value").agg(F.sum("n").alias("n"))
    return values.groupBy("column").agg(
        F.count("value").alias("uniques"), F.try_divide(F.count("value"), F.sum("n")).alias("unique_ratio"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"))


def correlations_of(counts: DataFrame) -> DataFrame:
    """Pearson correlation of each numeric column with a numeric target, over folded rows."""
    x, y, n = F.col("value").try_cast("double"), F.col("y").try_cast("double"), F.col("n").cast("double")
    present = counts.where(x.isNotNull() & y.isNotNull()).select("column", x.alias("x"), y.alias("y"), n.alias("n"))
    middle = present.groupBy("column").agg(
        F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("mx"), F.try_divide(F.sum(F.col("y") * F.col("n")), F.sum("n")).alias("my"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    spread = F.sqrt(F.sum(dx * dx * F.col("n")) * F.sum(dy * dy * F.col("n")))
    varies = F.first((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    return present.join(middle, "column").groupBy("column").agg(
        F.when(varies, F.try_divide(F.sum(dx * dy * F.col("n")), spread)).alias("correlation"))


def mutual_information(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Mutual information in nats of categorical columns with the target."""
    return information_of(contingency(df, names, target))


def unique_ratios(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Distinct values per column and their share of the rows.

    Columns are unfolded to (column, value) and folded again, so that many distinct counts
    cost one shuffle of distinct pairs rather than one expansion per column.
    """
    names = list(names or df.columns)
    cells = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in names
    ])
    values = df.select(F.explode(cells).alias("_c")).select("_c.*")
    counts = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return uniqueness_of(counts).drop("nulls")


def _named_like(words: Sequence[str]) -> Column:
    name = F.lower("column")
    found = F.lit(False)
    for word in words:
        found = found | name.contains(word)
    return found


def _finding(df: DataFrame, check: str, metric: str, value: Column, flagged: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), F.col("column"), F.lit(metric).alias("metric"),
        value.cast("double").alias("value"), F.coalesce(flagged, F.lit(False)).alias("flagged"))


def audit_matrix(df: DataFrame, target: str = "target_outage_next_2h") -> DataFrame:
    """Audit of the feature matrix: target correlation and identifier-like names.

    The other target columns are reported as twins but never flagged.
    """
    candidates = [c for c in df.columns if c != target and c not in AUDIT_IDENTIFIERS]
    numeric = [c for c in columns.numeric_columns(df) if c in candidates]
    twins = F.col("column").isin(*TARGET_COLUMNS)
    correlations = target_correlations(df, target, numeric)
    strength = F.abs("correlation")
    first = _finding(correlations, "target_correlation", "abs_correlation", strength,
                     (strength > CORRELATION_LIMIT) & ~twins)
    # names need no data: one literal row per column, attached to the single result row
    names = _unpivot(
        df.agg(*[F.lit(1.0).alias(c) for c in candidates]), candidates, "column", "one")
    second = _finding(names, "identifier_name", "name_match", _named_like(PRODUCTION_ID_WORDS).cast("int"),
                      _named_like(PRODUCTION_ID_WORDS) & ~twins)
    return first.unionByName(second)


def audit_rows(
    df: DataFrame,
    target: str = "target",
    time_column: str | None = None,
    group: str | None = None,
    extended: bool = False,
) -> DataFrame:
    """Audit of a per-alarm table: correlation, information, identifiers, outage spacing."""
    candidates = [c for c in df.columns if c not in (target, time_column)]
    numeric = [c for c in columns.numeric_columns(df) if c in candidates]
    textual = [c for c in columns.categorical_columns(df) if c in candidates]
    tie = [c for c in ("log_serial_number",) if c in df.columns]
    spaced = [c for c in (group, time_column, *tie) if c] if time_column and group else []
    # computed once, in narrow form: the contingency and the spacing both read it
    rows = session.staged(df.select(*dict.fromkeys([*candidates, target, *spaced])), "audited")
    counts = contingency(rows, candidates, target)
    findings = []
    if numeric:
        strength = F.abs("correlation")
        findings.append(_finding(
            correlations_of(counts.where(F.col("column").isin(numeric))), "target_signal", "abs_correlation", strength,
            strength > CORRELATION_LIMIT))
    if textual:
        information = F.col("mutual_information")
        findings.append(_finding(
            information_of(counts.where(F.col("column").isin(textual))), "target_signal", "mutual_information", information,
            information > INFORMATION_LIMIT))
    ratio = F.col("unique_ratio")
    if extended:
        suspicious = _named_like(EXTENDED_ID_WORDS) | (ratio > UNIQUE_LIMIT)
    else:
        suspicious = (ratio > UNIQUE_LIMIT) | (
            _named_like(NOTEBOOK_ID_WORDS) & (F.col("uniques") > UNIQUE_COUNT_LIMIT))
    findings.append(_finding(uniqueness_of(counts), "identifier", "unique_ratio", ratio, suspicious))
    if spaced:
        gaps = sequence.outage_spacing(clean.towers(rows, [group]), [group], [time_column, *tie], flag=target)
        close = F.col("short_gaps")
        findings.append(_finding(
            gaps.withColumn("column", F.lit(time_column)), "outage_spacing", "short_gaps", close, close > 0))
    return explore.union_all(findings)


def validate_matrix(df: DataFrame, target: str = "target") -> DataFrame:
    """Validation report rows: nulls, constant and correlated features, class shares, types."""
    features = df.drop(target, *IDENTIFIER_COLUMNS)
    filled = columns.fill_missing(features, "UNKNOWN", 0)
    constant = columns.constant_columns(filled)
    kept = filled.drop(*constant)
    numeric = columns.numeric_columns(kept)
    later = correlated_pairs(kept, names=numeric).groupBy(F.col("second").alias("column")).agg(
        F.max(F.abs("correlation")).alias("correlation"))
    nulls = null_counts(features, only_present=False)
    shares = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    rows = df.agg(F.count(F.lit(1)).alias("r")).scalar()
    reports = [
        _finding(nulls, "missing", "nulls", F.col("nulls"), F.col("nulls") > 0),
        _finding(nulls, "zero_variance", "constant", F.col("column").isin(constant).cast("int")
                 if constant else F.lit(0), F.col("column").isin(constant) if constant else F.lit(False)),
        _finding(later, "high_correlation", "max_abs_correlation", F.col("correlation"), F.lit(True)),
        _finding(shares.withColumn("column", F.concat(F.lit(f"{target}="), F.col(target).cast("string"))),
                 "class_share", "share", F.col("n") / rows, F.lit(False)),
    ]
    return explore.union_all(reports)
