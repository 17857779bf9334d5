"""Schema-level operators, all decided at plan time from the column list."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from towerlens.functions import text
from towerlens.schema import IDENTIFIER_COLUMNS, RAW_COLUMNS, TARGET_COLUMNS

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*text.header_names(df.columns))


def name_by_position(df: DataFrame, names: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Rename by position and drop header lines repeated as data rows."""
    if len(df.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, found {len(df.columns)}")
    named = df.toDF(*names)
    if "severity" not in names:
        return named
    return named.where(F.col("severity").isNull() | (F.lower("severity") != "severity"))


def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def select_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def drop_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def first_present(df: DataFrame, candidates: Sequence[str], required: bool = False) -> str | None:
    for name in candidates:
        if name in df.columns:
            return name
    if required:
        raise KeyError(f"none of {list(candidates)} in {df.columns}")
    return None


def column_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def with_default(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({n: F.lit(v) for n, v in defaults.items() if n not in df.columns})


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t.startswith(_NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def placeholders_to_null(df: DataFrame) -> DataFrame:
    return df.replace("-", None, subset=categorical_columns(df))


def fill_missing(df: DataFrame, text_value: str = "Unknown", number: float | None = None) -> DataFrame:
    filled = df.na.fill(text_value, subset=categorical_columns(df))
    return filled if number is None else filled.na.fill(number, subset=numeric_columns(filled))


def missing_shares(df: DataFrame) -> dict[str, float]:
    """Share of nulls per column, one aggregation for all of them."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return {c: row[c] or 0.0 for c in df.columns}


def drop_mostly_missing(df: DataFrame, above: float = 0.95, keep: Sequence[str] = ("gnodeb_id",)) -> DataFrame:
    return df.drop(*[c for c, share in missing_shares(df).items() if share > above and c not in keep])


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct non-null value (min equals max)."""
    if not df.columns:
        return []
    row = df.agg(*[
        F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in df.columns
    ]).first()
    return [c for c in df.columns if row[c]]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def align(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the expected feature columns in order, absent ones as 0.0."""
    return df.select(*keep, *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c)
        for c in expected
    ])


def predictor_columns(df: DataFrame) -> list[str]:
    excluded = set(IDENTIFIER_COLUMNS) | set(TARGET_COLUMNS)
    return [c for c in df.columns if c not in excluded]


def latest(df: DataFrame, time_column: str) -> DataFrame:
    """Rows at the greatest time, by scalar subquery so that the filter reaches the scan."""
    newest = df.agg(F.max(time_column).alias("newest"))
    return df.where(F.col(time_column) == newest.scalar())
