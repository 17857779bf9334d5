"""The alarm history: snapshots that never change and a manifest that names the live ones.

``data/snapshot=<id>/event_date=<day>`` holds the rows that one commit wrote. A manifest
``manifest/v<number>`` is a small table (snapshot, file_source, event_date, rows) of all
that is live. A commit writes its data first and its manifest last, and the manifest takes
effect by one rename that fails where another commit came first. Readers take the newest
manifest; what a crashed writer left behind is in none and so is never read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from towerlens import session
from towerlens.operators import columns, slices
from towerlens.schema import HISTORY_SCHEMA

PARTITION = "event_date"
RETENTION_DAYS = 60
MANIFEST_SCHEMA = "snapshot string, file_source string, event_date date, rows bigint"
#: How often a commit starts again when others come first, and old manifests that are kept.
ATTEMPTS, KEPT_MANIFESTS = 8, 10
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"


class CommitConflict(RuntimeError):
    """Another commit took the next version first."""


@dataclass(frozen=True)
class Purged:
    rows: int
    dropped_dates: list[str]
    rewritten_date: str | None


# ---- folders and manifests ------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list:
    if not session.path_exists(spark, path):
        return []
    return list(_fs(spark, path).listStatus(_path(spark, path)))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed manifests, from the folder listing."""
    names = [status.getPath().getName() for status in _children(spark, f"{path}/manifest")]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def _manifest_path(path: str, version: int) -> str:
    return f"{path}/manifest/v{version:010d}"


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Live (snapshot, source, date) entries and their row counts; no data file is read."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(_manifest_path(path, known[-1] if version is None else version))


def _commit(spark: SparkSession, path: str, entries: DataFrame, base: int) -> None:
    """Make ``entries`` the manifest after version ``base``."""
    draft = f"{path}/manifest/_draft-{uuid.uuid4().hex}"
    entries.select("snapshot", "file_source", PARTITION, F.col("rows").cast("bigint")).coalesce(1).write.parquet(draft)
    _rename(spark, draft, _manifest_path(path, base + 1))


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename that fails, rather than nests, where the target is there already."""
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    qualified = [_fs(spark, p).makeQualified(_path(spark, p)) for p in (source, target)]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(*qualified, none)
    except Exception as error:  # noqa: BLE001 - only an existing target is a conflict
        if session.path_exists(spark, target):
            raise CommitConflict(target) from error
        raise


def _folder(path: str, snapshot: str, day: date | None) -> str:
    return f"{path}/data/snapshot={snapshot}/{PARTITION}={_NO_DATE if day is None else day.isoformat()}"


def _rows_of(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """Rows of the folders that ``entries`` name; dates prune folders."""
    live = entries.select("snapshot", PARTITION).distinct().collect()  # one per commit and date it touched
    if not live:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    schema = T.StructType([*HISTORY_SCHEMA.fields, T.StructField("snapshot", T.StringType())])
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    return reader.parquet(*[_folder(path, s, d) for s, d in live]).select(*HISTORY_SCHEMA.names)


def _write(rows: DataFrame, path: str) -> DataFrame:
    """Write one snapshot and return its manifest entries, counted from what was written.

    The rebalancing splits a busy date over files by size and joins quiet ones.
    """
    spark, snapshot = rows.sparkSession, f"s{uuid.uuid4().hex}"
    folder = f"{path}/data/snapshot={snapshot}"
    rows.hint("rebalance", PARTITION).sortWithinPartitions(PARTITION, "event_time").write.partitionBy(PARTITION).parquet(folder)
    written = spark.read.schema(HISTORY_SCHEMA).parquet(folder)
    return written.groupBy(F.lit(snapshot).alias("snapshot"), "file_source", PARTITION).agg(F.count(F.lit(1)).alias("rows"))


# ---- reading, appending, purging --------------------------------------------------------


def read(spark: SparkSession, path: str) -> DataFrame:
    """History rows of the newest manifest; date predicates prune partitions."""
    return _rows_of(spark, path, manifest(spark, path))


def recent(spark: SparkSession, path: str, hours: int) -> DataFrame:
    """Rows of the dates that the last ``hours`` before the newest event can lie in.

    The newest date comes from the manifest, so only the folders of those dates are read.
    """
    entries = manifest(spark, path)
    newest = entries.agg(F.max(PARTITION)).first()[0]
    if newest is None:
        return _rows_of(spark, path, entries.limit(0))
    first = newest - timedelta(days=-(-hours // 24))
    return _rows_of(spark, path, entries.where(F.col(PARTITION) >= F.lit(first)))


def to_history(alarms: DataFrame, file_source: str | None, ingested: datetime) -> DataFrame:
    """The history columns of cleaned alarms, times cut to whole seconds."""
    source = F.lit(file_source) if file_source is not None else F.col("source_file")
    return alarms.select(
        columns.column_or(alarms, "site_id", "-").cast("string").alias("site_id"),
        columns.column_or(alarms, "node_identifier", "-").cast("string").alias("node_identifier"),
        F.date_trunc("second", "event_time").alias("event_time"),
        F.col("alarm_name").cast("string").alias("alarm_name"),
        F.col("severity").cast("string").alias("severity"),
        F.coalesce(columns.column_or(alarms, "duration_minutes", 0.0).cast("double"), F.lit(0.0)).alias("duration_minutes"),
        source.alias("file_source"),
        F.date_trunc("second", F.lit(ingested).cast("timestamp")).alias("ingestion_time"),
        F.to_date("event_time").alias(PARTITION),
    )


def append(alarms: DataFrame, path: str, file_source: str | None, ingested: datetime, again: bool = False) -> int:
    """Append cleaned alarms and return how many rows came in.

    Sources in the manifest are left out unless ``again``; rows without a source are one
    source, too. A run that dies before its commit leaves nothing that is read, so it can
    simply be repeated; a commit that lost the race starts again from the new manifest.
    """
    spark = alarms.sparkSession
    for _ in range(ATTEMPTS):
        known = versions(spark, path)
        base = known[-1] if known else 0
        current = manifest(spark, path, base) if known else None
        rows = to_history(alarms, file_source, ingested)
        if current is not None and not again:
            rows = slices.join_null_safe(rows, current.select("file_source").distinct(), ["file_source"], "left_anti").select(*HISTORY_SCHEMA.names)
        entries = session.staged(_write(rows, path), "entries")
        inserted = entries.agg(F.sum("rows")).first()[0] or 0
        if not inserted:
            return 0
        try:
            _commit(spark, path, entries if current is None else current.unionByName(entries), base)
            return inserted
        except CommitConflict:
            continue
    raise CommitConflict(f"{ATTEMPTS} commits to {path} came first")


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total_records"), F.min("event_time").alias("min_date"),
        F.max("event_time").alias("max_date"), F.count_distinct("site_id").alias("site_count"))


def expired(rows: DataFrame, as_of: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows strictly older than the cutoff."""
    cutoff = as_of - timedelta(days=days)
    return rows.where((F.col(PARTITION) <= F.lit(cutoff.date())) & (F.col("event_time") < F.lit(cutoff)))


def purge(spark: SparkSession, path: str, as_of: datetime, days: int = RETENTION_DAYS) -> Purged:
    """Delete rows older than ``as_of - days`` in one commit.

    Whole dates below the cutoff leave the manifest; the rows that stay of the date the
    cutoff falls into are written as a new snapshot. Folders are deleted after the commit.
    """
    cutoff = as_of - timedelta(days=days)
    day = F.lit(cutoff.date())
    for _ in range(ATTEMPTS):
        known = versions(spark, path)
        if not known:
            return Purged(0, [], None)
        current = manifest(spark, path, known[-1])
        dead = current.where(F.col(PARTITION) < day)
        edge = current.where(F.col(PARTITION) == day)
        edge_rows = _rows_of(spark, path, edge)
        over = expired(edge_rows, as_of, days).count()
        rows = (dead.agg(F.sum("rows")).first()[0] or 0) + over
        if not rows:
            return Purged(0, [], None)
        dropped = [r[0].isoformat() for r in dead.select(PARTITION).distinct().orderBy(PARTITION).collect()]
        kept = current.where(F.col(PARTITION).isNull() | (F.col(PARTITION) >= day))
        gone = dead
        if over:
            rest = session.staged(_write(edge_rows.where(F.col("event_time") >= F.lit(cutoff)), path), "entries")
            kept = current.where(F.col(PARTITION).isNull() | (F.col(PARTITION) > day)).unionByName(rest)
            gone = dead.unionByName(edge)
        retired = [_folder(path, s, d) for s, d in gone.select("snapshot", PARTITION).distinct().collect()]
        try:
            _commit(spark, path, kept, known[-1])
        except CommitConflict:
            continue
        for folder in retired:
            _fs(spark, folder).delete(_path(spark, folder), True)
        return Purged(rows, dropped, cutoff.date().isoformat() if over else None)
    raise CommitConflict(f"{ATTEMPTS} commits to {path} came first")


def vacuum(spark: SparkSession, path: str, older_than: datetime) -> list[str]:
    """Delete snapshots and drafts that no kept manifest names and that were last written
    before ``older_than``, and all but the last ten manifests; returns what was deleted."""
    limit = int(older_than.timestamp() * 1000)
    known = versions(spark, path)
    live: set[str] = set()
    for version in known[-1:]:
        live |= {r[0] for r in manifest(spark, path, version).select("snapshot").distinct().collect()}
    spare = [s for s in _children(spark, f"{path}/data") if s.getPath().getName().split("=")[-1] not in live]
    spare += [s for s in _children(spark, f"{path}/manifest") if s.getPath().getName().startswith("_draft-")]
    spare = [s.getPath().toString() for s in spare if s.getModificationTime() < limit]
    spare += [_manifest_path(path, v) for v in known[:-KEPT_MANIFESTS]]
    for folder in spare:
        _fs(spark, folder).delete(_path(spark, folder), True)
    return spare
