"""Alarm files: CSV, Parquet and Excel, single or whole folders, with rejected files listed."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from towerlens import session
from towerlens.functions import text
from towerlens.operators import explore
from towerlens.schema import EXPORT_VARIANTS, RAW_COLUMNS
from towerlens.sources import xlsx

#: A first line is a header without the marks of an export when it has so many known names.
KNOWN_NAMES = 2


@dataclass(frozen=True)
class Loaded:
    rows: DataFrame
    rejected: DataFrame


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header line; every column is text unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", False).option("escape", '"')
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def first_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names without reading data."""
    return spark.read.parquet(path).columns


def preview(df: DataFrame, rows: int = xlsx.SNIFF_ROWS) -> DataFrame:
    return df.limit(rows)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path``, by listing alone."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("source_file"))


def _cells(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("\ufeff")]), [])


def header_of(lines: list[str], sniff: bool = True) -> tuple[int, list[str]] | None:
    """Place and normalised names of the header among the opening lines of a file.

    The first line with the marks of an export counts; without one, the first line that is
    not blank if at least two of its names are known, or, with ``sniff=False``, in any case.
    """
    if sniff:
        for at, line in enumerate(lines):
            if xlsx.is_header(_cells(line)):
                return at, text.header_names(_cells(line))
    for at, line in enumerate(lines):
        if line.strip():
            names = text.header_names(_cells(line))
            if not sniff or len({*names} & {*RAW_COLUMNS, *EXPORT_VARIANTS}) >= KNOWN_NAMES:
                return at, names
            return None
    return None


def _find_headers(sniff: bool):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [header_of(list(lines), sniff) for lines in batch["opening"]]
            yield pd.DataFrame({
                "source_file": batch["source_file"],
                "skipped": [list(lines)[:f[0] + 1] if f else None for lines, f in zip(batch["opening"], found)],
                "names": [f[1] if f else None for f in found]})
    return work


def read_delimited(spark: SparkSession, path: str, sniff: bool = True) -> Loaded:
    """CSV files of any mix of headers, united by column name in one scan.

    The header of a file is found in its first twelve lines, so title lines may stand above
    it; files without one are rejected, files without a byte are not. Lines are split by position and the cells named by
    the header of their own file, whatever the order of its columns, however many headers
    there are. Cells beyond the header are dropped, missing ones are null, blank lines and
    repeats of the header or title lines in the opening part are no rows.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"), "value",
        F.monotonically_increasing_id().alias("source_row"))
    # a header can only be in the first block of its file; at most twelve lines of each are moved
    order = Window.partitionBy("source_file").orderBy("source_row")
    opening = (
        lines.where(F.col("_block") == 0).withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= xlsx.SNIFF_ROWS).groupBy("source_file")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias("opening")))
    session.ship_package(spark)
    heads = session.staged(opening.mapInPandas(
        _find_headers(sniff), "source_file string, skipped array<string>, names array<string>"), "headers")
    good = heads.where(F.col("names").isNotNull())
    rejected = _listed(spark, path).join(good, "source_file", "left_anti").withColumn("error", F.lit("no header row found"))
    names = _ordered(r[0] for r in good.select(F.explode("names")).distinct().collect() if r[0])
    width = good.agg(F.max(F.size("names"))).first()[0] or 0
    if not names:
        return Loaded(lines.select("source_file", "source_row").limit(0), rejected)
    # the place of every output column in the file's own header, worked out once a file
    places = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.array_position("names", n).cast("int"))
    heads_by_place = good.select("source_file", "skipped", places.alias("_places"))
    data = lines.join(heads_by_place, "source_file").where(
        (F.trim("value") != "") & ((F.col("_block") > 0) | ~F.array_contains("skipped", F.col("value"))))
    split = data.withColumn("_r", F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"escape": '"'}))
    cells = split.withColumn("_cells", F.array(*[F.col(f"_r.c{i}") for i in range(width)]))
    rows = cells.select("source_file", "source_row", *[
        F.get("_cells", F.get("_places", F.lit(i)) - 1).alias(n) for i, n in enumerate(names)])
    return Loaded(rows, rejected)


def _ordered(names) -> list[str]:
    """Known columns in the order of an export, further ones by name."""
    known = [*RAW_COLUMNS, *EXPORT_VARIANTS]
    found = set(names)
    return [n for n in known if n in found] + sorted(found - set(known))


def read_titled_csv(spark: SparkSession, path: str) -> Loaded:
    """CSV exports with title lines above the header, each file with its own header."""
    return read_delimited(spark, path)


def _bad_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq
    for batch in batches:
        errors = []
        for content in batch["content"]:
            try:
                pq.read_metadata(io.BytesIO(content))
                errors.append(None)
            except Exception as error:  # noqa: BLE001 - the file is reported as it is
                errors.append(f"{type(error).__name__}: {error}")
        yield pd.DataFrame({"source_file": batch["source_file"], "error": errors})


def read_parquet_folder(spark: SparkSession, path: str) -> Loaded:
    """Parquet files united by column name; files without a readable footer are rejected.

    Only files that gave no row are opened again to tell a broken file from an empty one.
    """
    listed = _listed(spark, path)
    try:
        rows = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return Loaded(listed.limit(0), listed.withColumn("error", F.lit("no readable Parquet file")))
    rows = rows.withColumn("source_file", F.col("_metadata.file_path"))
    silent = listed.join(rows.select("source_file").distinct(), "source_file", "left_anti")
    content = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("source_file"), "content")
    checked = content.join(silent, "source_file", "left_semi").mapInPandas(_bad_footers, "source_file string, error string")
    return Loaded(rows, checked.where(F.col("error").isNotNull()))


def read_excel(spark: SparkSession, path: str, header_row: int | None = None) -> Loaded:
    """Excel exports; ``header_row=None`` looks for the header in the first twelve rows.

    Every workbook is parsed once; one that turns out broken gives no row at all.
    """
    return from_workbooks(spark.read.format("binaryFile").load(path).select("path", "content"), header_row)


def from_workbooks(books: DataFrame, header_row: int | None = None) -> Loaded:
    """As :func:`read_excel`, for workbooks given as (path, content)."""
    session.ship_package(books.sparkSession)
    sheets = session.staged(xlsx.parse(books, header_row), "sheets")
    return Loaded(xlsx.as_columns(sheets, _ordered(xlsx.headers(sheets))), xlsx.rejected(sheets))


def load_alarms(spark: SparkSession, path: str) -> Loaded:
    """Rows of a file or glob by its extension, headers found file by file."""
    if path.endswith((".xlsx", ".xls")):
        return read_excel(spark, path)
    if path.endswith(".csv"):
        return read_delimited(spark, path)
    if path.endswith(".parquet"):
        return read_parquet_folder(spark, path)
    raise ValueError(f"unknown alarm file type: {path}")


def load_folder(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("csv", "xlsx", "parquet")) -> Loaded:
    """Every alarm file of a folder, columns united by name, bad files listed."""
    parts = []
    for kind in kinds:
        pattern = f"{folder}/*.{kind}"
        if _any_file(spark, pattern):
            parts.append(load_alarms(spark, pattern))
    if not parts:
        raise FileNotFoundError(f"no alarm files in {folder}")
    return Loaded(
        explore.union_all([p.rows for p in parts]),
        explore.union_all([p.rejected for p in parts]))


def _any_file(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_through(spark: SparkSession, cache: str, source) -> DataFrame:
    """The cached Parquet when complete; otherwise ``source()`` is written there first."""
    if not session.path_exists(spark, f"{cache}/_SUCCESS"):
        source().write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def expired_files(spark: SparkSession, folder: str, as_of, days: int) -> DataFrame:
    """Raw files not modified within ``days`` before ``as_of``; nothing is deleted here."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("modificationTime")
    files = spark.read.format("binaryFile").load(folder).select(
        F.col("_metadata.file_path").alias("source_file"), "modificationTime", "length")
    return files.where(age > days * 86_400)


def set_modified(spark: SparkSession, folder: str, when: datetime) -> None:
    """Give the files of a folder a modification time (UTC), as a copy that keeps times does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stamp = int(when.replace(tzinfo=timezone.utc).timestamp() * 1000)
    for status in fs.listStatus(path):
        fs.setTimes(status.getPath(), stamp, -1)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
