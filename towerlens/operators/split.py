"""Train/validation/test splits, tuning samples and folds that depend only on the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from towerlens.operators import slices

SHARES = {"test": 0.15, "validation": 0.15, "train": 0.70}
#: As many buckets as the hash has values.
_FINE = 2**32


def bucket(key: Column, buckets: int, seed: int = 42) -> Column:
    """Stable bucket 0..buckets-1 of a key, the same in every engine that has md5."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(buckets))


def chronological_split(
    df: DataFrame, time_column: str, boundary: str, row_key: Sequence[str], seed: int = 42,
) -> dict[str, DataFrame]:
    """Rows before and from the boundary; when one side is empty, 80/20 in hash order."""
    edge = F.lit(boundary).cast("timestamp")
    train, test = df.where(F.col(time_column) < edge), df.where(F.col(time_column) >= edge)
    if not train.isEmpty() and not test.isEmpty():
        return {"train": train, "test": test}
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in row_key])
    mixed = df.withColumn("_mix", F.md5(F.concat(key, F.lit(f"|{seed}"))))
    placed = slices.global_index(mixed, ("_mix", *row_key), "_place").drop("_mix")
    cut = F.floor(df.agg(F.count(F.lit(1)).alias("n")).scalar() * 0.8)
    return {
        "train": placed.where(F.col("_place") < cut).drop("_place"),
        "test": placed.where(F.col("_place") >= cut).drop("_place"),
    }


def group_column(df: DataFrame, row_key: str) -> str:
    """Grouping identifier: managed object, else eNodeB, else the row itself."""
    return next((c for c in ("mo_name", "enodeb_id") if c in df.columns), row_key)


def side(group: Column, shares: Mapping[str, float] = SHARES, seed: int = 42) -> Column:
    """Name of the part a group belongs to; shares are whole percents."""
    slots = [name for name, share in shares.items() for _ in range(round(share * 100))]
    if len(slots) != 100:
        raise ValueError(f"shares must add up to 100 percent, got {len(slots)}")
    return F.element_at(F.array(*[F.lit(name) for name in slots]), (bucket(group, 100, seed) + 1).cast("int"))


def group_split(
    df: DataFrame, group: str, shares: Mapping[str, float] = SHARES, seed: int = 42,
) -> dict[str, DataFrame]:
    """Parts in which no group occurs twice; a narrow filter each, no shuffle."""
    marked = side(F.col(group), shares, seed)
    return {name: df.where(marked == name) for name in shares}


def shared_groups(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Number of groups found on both sides (must be 0)."""
    both = left.select(group).distinct().join(right.select(group).distinct(), group, "left_semi")
    return both.agg(F.count(F.lit(1)).alias("shared_groups"))


def in_sample(group: Column, rows: int, max_rows: int, seed: int = 7, buckets: int = _FINE) -> Column:
    """Whether a group is among the share ``max_rows / rows``, which is cut to whole buckets."""
    return bucket(group, buckets, seed) < F.lit(max_rows * buckets // rows)


def tuning_sample(
    df: DataFrame, group: str, max_rows: int = 100_000, seed: int = 7, buckets: int = _FINE,
) -> DataFrame:
    """Whole groups adding up to about ``max_rows`` rows."""
    rows = df.count()
    if rows <= max_rows:
        return df
    return df.where(in_sample(F.col(group), rows, max_rows, seed, buckets))


def folds(df: DataFrame, row_key: Column, count: int, name: str = "fold", seed: int = 42) -> DataFrame:
    """Fold number by hash: stratified in expectation, no shuffle."""
    return df.withColumn(name, bucket(row_key, count, seed).cast("int"))


def exact_folds(
    df: DataFrame, label: str, row_key: Sequence[str], count: int, name: str = "fold",
    seed: int = 42, limit: int | None = None,
) -> DataFrame:
    """Fold sizes per label differ by at most one row."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in row_key])
    mixed = df.withColumn("_mix", F.md5(F.concat(key, F.lit(f"|{seed}"))))
    placed = slices.running(
        slices.slice_groups(mixed, (label,), ("_mix", *row_key), limit), {"_place": F.lit(1)}).rows()
    return placed.withColumn(name, F.pmod(F.col("_place") - 1, F.lit(count)).cast("int")).drop("_place", "_mix")
