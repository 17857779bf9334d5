"""Codes for categorical columns and category lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from towerlens.operators import slices
from towerlens.operators.sequence import with_share_of_rows
from towerlens.functions import text


def label_mapping(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, code): distinct values in sorted order numbered from 0."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    numbered = slices.global_index(values, ("value",), "code", limit)
    return numbered.select("value", F.col("code").cast("int").alias("code"))


def label_encode(df: DataFrame, names: Sequence[str], limit: int | None = None) -> DataFrame:
    """Add ``<name>_encoded`` for each column; the planner broadcasts mappings that measure small."""
    for name in names:
        mapping = label_mapping(df, name, limit).withColumnsRenamed({"value": name, "code": f"{name}_encoded"})
        df = df.join(mapping, name, "left")
    return df


def category_of(code: Column, mapping: Mapping, default: str = "Other") -> Column:
    """Category by key from a user-supplied table small enough to be a literal."""
    if not mapping:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def with_category(df: DataFrame, key: str, table: DataFrame, default: str = "Other") -> DataFrame:
    """Category by a lookup DataFrame (key, category) of any size."""
    joined = df.join(table, key, "left")
    return joined.withColumn("category", F.coalesce("category", F.lit(default)))


def with_site_frequency(df: DataFrame, mo_name: str = "mo_name") -> DataFrame:
    """Site prefix of the managed object and its relative frequency."""
    prefixed = df.withColumn("mo_site_prefix", text.site_prefix(F.col(mo_name)))
    return with_share_of_rows(prefixed, F.col("mo_site_prefix"), "site_alarm_frequency")
