"""Sources, sinks, history and incremental ingest over files Spark writes from the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from towerlens import session
from towerlens.catalog.base import alarms, naive, raw, rounded, with_alarms, with_raw
from towerlens.catalog.registry import Area
from towerlens.functions import timeparts
from towerlens.operators import clean, explore
from towerlens.settings import Settings
from towerlens.sources import files, history
from towerlens.streaming import ingest

register = Area()
QUERIES, SQL = register.queries, register.sql

AS_OF = datetime(2024, 2, 20)
INGESTED = datetime(2024, 2, 1, 12, 0, 0)
_TEXT = ("log_serial_number", "occurred_on", "alarm_source", "mo_name", "enodeb_id", "gnodeb_id", "name",
         "severity", "alarm_duration", "location_information")
_EXPORT = ("log_serial_number", "Occurred On (NT)", "Alarm Source", "MO Name", "eNodeB ID", "gNodeB ID", "Name",
           "Severity", "Alarm Duration", "Location Information")


def exported(spark, sf_dir):
    """Raw rows as an export writes them: text columns, times in whole seconds."""
    rows = raw(spark, sf_dir).withColumn("occurred_on", timeparts.text_seconds(F.col("event_time")))
    return rows.select(*[F.col(c).cast("string").alias(c) for c in _TEXT])


_EXPORTED_SQL = (
    "SELECT log_serial_number, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS occurred_on, alarm_source, severity, location_information FROM raw"
)


@register("a2_csv_round_trip", with_raw(_EXPORTED_SQL))
def a2(spark, sf_dir):
    path = session.scratch(spark, "csv")
    files.write_csv(exported(spark, sf_dir), path)
    return files.read_csv(spark, path).select(
        F.col("log_serial_number").cast("bigint").alias("log_serial_number"), "occurred_on", "alarm_source",
        "severity", "location_information")


@register("a3_parquet_round_trip", with_raw("SELECT log_serial_number, event_time, name FROM raw"))
def a3(spark, sf_dir):
    path = session.scratch(spark, "parquet")
    files.write_parquet(raw(spark, sf_dir), path)
    return files.read_parquet(spark, path).select("log_serial_number", naive("event_time"), "name")


def _sheet_xml(rows):
    from xml.sax.saxutils import escape
    body = "".join(
        "<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for v in row) + "</row>"
        for row in rows)
    return ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
            f"<sheetData>{body}</sheetData></worksheet>")


def _workbooks(batches):
    """Turn each batch of export rows into one workbook (file content as bytes)."""
    import io
    import zipfile

    import pandas as pd
    for batch in batches:
        title = [["Alarm Logs"], ["Export"], [""], ["Area"], [""]]
        rows = [*title, list(_EXPORT), *batch[list(_TEXT)].values.tolist()]
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("xl/worksheets/sheet1.xml", _sheet_xml(rows))
        yield pd.DataFrame({"path": [f"AlarmLogs_{batch[_TEXT[0]].iloc[0]}.xlsx"], "content": [buffer.getvalue()]})


@register("a1_excel_rows", with_raw(_EXPORTED_SQL))
def a1(spark, sf_dir):
    books = exported(spark, sf_dir).mapInPandas(_workbooks, "path string, content binary")
    return files.from_workbooks(session.staged(books, "books")).rows.select(
        F.col("log_serial_number").cast("bigint").alias("log_serial_number"),
        F.col("occurred_on_nt").alias("occurred_on"), "alarm_source", "severity", "location_information")


def _titled_folder(spark, sf_dir):
    path = session.scratch(spark, "titled")
    rows = exported(spark, sf_dir)
    title = "Alarm Logs\nExport of the day\n\nArea: all\n\n" + ",".join(_EXPORT)
    quoted = [F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in _TEXT]
    lines = rows.select(F.concat_ws(",", *quoted).alias("line"), "log_serial_number")
    # one file per export: a title block on top of its lines
    numbered = lines.withColumn("_file", F.pmod(F.col("log_serial_number").cast("bigint"), F.lit(4)))
    tops = numbered.select("_file").distinct().select(F.lit(title).alias("line"), F.lit("-1").alias("log_serial_number"), "_file")
    ordered = numbered.unionByName(tops).repartition("_file").sortWithinPartitions(
        "_file", F.col("log_serial_number").cast("bigint"))
    ordered.select("line", "_file").write.partitionBy("_file").text(path)
    return path


@register("a5_titled_csv", with_raw(_EXPORTED_SQL))
def a5(spark, sf_dir):
    loaded = files.read_titled_csv(spark, f"{_titled_folder(spark, sf_dir)}/*/")
    return loaded.rows.select(
        F.col("log_serial_number").cast("bigint").alias("log_serial_number"),
        F.col("occurred_on_nt").alias("occurred_on"), "alarm_source", "severity", "location_information")


@register("a4_folder_union", with_raw(_EXPORTED_SQL))
def a4(spark, sf_dir):
    """Parquet, two CSV column orders and a broken file of each kind in one folder."""
    folder = session.scratch(spark, "folder")
    rows = exported(spark, sf_dir)
    part = F.col("log_serial_number").cast("bigint") % 3
    files.write_parquet(rows.where(part == 0), f"{folder}/part.parquet")
    files.write_csv(rows.where(part == 1), f"{folder}/part.csv")
    files.write_csv(rows.where(part == 2).select(*reversed(_TEXT)), f"{folder}/turned.csv")
    for kind in ("parquet", "csv", "xlsx"):
        rows.limit(1).select(F.lit("neither header nor data").alias("value")).write.text(f"{folder}/bad.{kind}")
    loaded = files.load_folder(spark, folder)
    return loaded.rows.select(
        F.col("log_serial_number").cast("bigint").alias("log_serial_number"), "occurred_on", "alarm_source",
        "severity", "location_information")


@register("a4_rejected_files", with_raw("SELECT kind, 1::BIGINT AS files, count(*) AS lines FROM raw, (VALUES ('csv'), ('parquet'), ('xlsx')) k(kind) WHERE name = 'Cell Outage' GROUP BY kind"))
def a4_rejected(spark, sf_dir):
    """Files that are no alarm files are listed, however many lines they have."""
    folder = session.scratch(spark, "folder")
    rows = exported(spark, sf_dir)
    files.write_csv(rows, f"{folder}/part.csv")
    files.write_parquet(rows, f"{folder}/part.parquet")
    junk = rows.where("name = 'Cell Outage'").select(F.concat(F.lit("line "), "log_serial_number").alias("value")).coalesce(1)
    for kind in ("parquet", "csv", "xlsx"):
        junk.write.text(f"{folder}/bad.{kind}")
    rejected = files.load_folder(spark, folder).rejected
    text = spark.read.text(f"{folder}/bad.*").groupBy(F.col("_metadata.file_path").alias("source_file")).agg(F.count(F.lit(1)).alias("lines"))
    kind = F.regexp_extract("source_file", r"bad\.(\w+)/", 1).alias("kind")
    return rejected.join(text, "source_file").groupBy(kind).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))


@register("a6_by_extension", with_raw("SELECT count(*) AS n, count(DISTINCT name) AS names FROM raw"))
def a6(spark, sf_dir):
    path = session.scratch(spark, "export") + ".csv"
    files.write_csv(exported(spark, sf_dir), path)
    return files.load_alarms(spark, path).rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


@register("a7_read_through", with_raw("SELECT count(*) AS n, max(event_time) AS newest FROM raw"))
def a7(spark, sf_dir):
    path = session.scratch(spark, "combined")
    files.read_through(spark, path, lambda: raw(spark, sf_dir))
    again = files.read_through(spark, path, lambda: raw(spark, sf_dir).limit(0))
    return again.agg(F.count(F.lit(1)).alias("n"), F.max("event_time").alias("newest")).withColumn("newest", naive("newest"))


@register("a8_settings_active", with_alarms(
    "SELECT sum(is_bbu)::BIGINT AS bbu, sum(is_rru)::BIGINT AS rru FROM alarms"))
def a8(spark, sf_dir):
    settings = Settings.from_json({"ACTIVE_FEATURES": ["BBU_ALARM", "RRU_ALARM"]})
    return alarms(spark, sf_dir).agg(*[F.sum(f"is_{g}").alias(g) for g in settings.feature_groups])


_FOUR = ("log_serial_number", "event_time", "name", "severity")


@register("a11_schema_only", with_raw(" UNION ALL ".join(
    f"SELECT {i} AS place, '{n}' AS name, count({n}) AS filled FROM raw" for i, n in enumerate(_FOUR))))
def a11(spark, sf_dir):
    """The names come from the schema alone, the counts from the rows."""
    path = session.scratch(spark, "schema")
    files.write_parquet(raw(spark, sf_dir).select(*_FOUR), path)
    names = files.first_columns(spark, path)
    filled = files.read_parquet(spark, path).agg(*[F.count(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.col(n).alias("filled")) for i, n in enumerate(names)])
    return filled.select(F.explode(pairs).alias("c")).select("c.*")


_HISTORY_SQL = (
    "SELECT site_id, node_identifier, date_trunc('second', event_time) AS event_time, alarm_name, severity, "
    "round(duration_minutes, 6) AS duration_minutes, 'batch' AS file_source, TIMESTAMP '2024-02-01 12:00:00' AS ingestion_time FROM alarms"
)


def _history(spark, sf_dir):
    path = session.scratch(spark, "history")
    history.append(alarms(spark, sf_dir), path, "batch", INGESTED)
    return path


@register("b3_append_history", with_alarms(_HISTORY_SQL))
def b3(spark, sf_dir):
    path = _history(spark, sf_dir)
    # a second append of the same source adds nothing
    history.append(alarms(spark, sf_dir), path, "batch", INGESTED)
    return history.read(spark, path).select(
        "site_id", "node_identifier", naive("event_time"), "alarm_name", "severity",
        *rounded("duration_minutes"), "file_source", naive("ingestion_time"))


_PLAIN_HISTORY = "SELECT site_id, node_identifier, date_trunc('second', event_time) AS event_time, alarm_name, severity, CASE WHEN log_serial_number % 3 > 0 THEN 'day-' || (log_serial_number % 3) END AS file_source FROM alarms"


@register("b3_append_sources", with_alarms(_PLAIN_HISTORY))
def b3_sources(spark, sf_dir):
    """Three overlapping appends of rows with two sources and with none."""
    path = session.scratch(spark, "history")
    part = F.col("log_serial_number") % 3
    rows = alarms(spark, sf_dir).withColumn("source_file", F.when(part > 0, F.concat(F.lit("day-"), part.cast("string"))))
    for wanted in (part < 2, part != 1, part >= 0):
        history.append(rows.where(wanted), path, None, INGESTED)
    return history.read(spark, path).select("site_id", "node_identifier", naive("event_time"), "alarm_name", "severity", "file_source")


@register("b3_manifest", with_alarms(
    "SELECT 'batch' AS file_source, CAST(event_time::DATE AS STRING) AS day, count(*) AS rows FROM alarms GROUP BY ALL"))
def b3_manifest(spark, sf_dir):
    """Rows by source and date, from the manifest alone."""
    entries = history.manifest(spark, _history(spark, sf_dir))
    return entries.groupBy("file_source", F.col("event_date").cast("string").alias("day")).agg(F.sum("rows").alias("rows"))


@register("b4_purge_history", with_alarms(
    "SELECT CAST(event_time::DATE AS STRING) AS day, count(*) AS n FROM alarms WHERE date_trunc('second', event_time) >= TIMESTAMP '2024-01-15 06:30:00' GROUP BY 1"))
def b4(spark, sf_dir):
    path = _history(spark, sf_dir)
    history.purge(spark, path, datetime(2024, 2, 14, 6, 30), days=30)
    history.purge(spark, path, datetime(2024, 2, 14, 6, 30), days=30)
    return history.read(spark, path).groupBy(F.col("event_date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


@register("b4_expired_rows", with_alarms(
    "SELECT count(*) AS n FROM alarms WHERE date_trunc('second', event_time) < TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 30 DAY"))
def b4_expired(spark, sf_dir):
    path = _history(spark, sf_dir)
    return history.expired(history.read(spark, path), AS_OF, 30).agg(F.count(F.lit(1)).alias("n"))


@register("a10_history_summary", with_alarms(
    "SELECT count(*) AS total_records, date_trunc('second', min(event_time)) AS min_date, date_trunc('second', max(event_time)) AS max_date, "
    "count(DISTINCT site_id) AS site_count FROM alarms"))
def a10(spark, sf_dir):
    rows = history.read(spark, _history(spark, sf_dir))
    return history.summary(rows).select("total_records", naive("min_date"), naive("max_date"), "site_count")


@register("b5_expired_files", with_raw("SELECT log_serial_number % 4 AS part, count(*) AS rows_due FROM raw WHERE log_serial_number % 4 < 2 GROUP BY 1"))
def b5(spark, sf_dir):
    """Files of four ages; the cutoff falls between the second and the third."""
    path = session.scratch(spark, "uploads")
    rows = exported(spark, sf_dir)
    for part, day in enumerate((datetime(2023, 11, 1), datetime(2023, 12, 22), datetime(2023, 12, 23), datetime(2024, 2, 19))):
        folder = f"{path}/part-{part}"
        files.write_csv(rows.where(F.col("log_serial_number").cast("bigint") % 4 == part), folder)
        files.set_modified(spark, folder, day)
    due = files.expired_files(spark, f"{path}/*", datetime(2024, 2, 20, 12), 60).select("source_file")
    found = files.read_csv(spark, f"{path}/*").select(
        F.col("_metadata.file_path").alias("source_file"), F.col("log_serial_number").cast("bigint").alias("id"))
    return found.join(due, "source_file", "left_semi").groupBy((F.col("id") % 4).alias("part")).agg(F.count(F.lit(1)).alias("rows_due"))


def _source_rows(spark, sf_dir):
    rows = raw(spark, sf_dir)
    return rows.withColumn("source_file", F.concat(F.lit("upload-"), F.col("log_serial_number") % 5))


@register("f29_file_totals", "WITH " + with_alarms("SELECT 1")[5:].split(", alarms AS")[0] + (
    ", tagged AS (SELECT *, 'upload-' || (log_serial_number % 5) AS source_file FROM flagged), "
    "kept AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY source_file, site_id, node_identifier, date_trunc('minute', event_time), "
    "alarm_name, severity ORDER BY event_time, log_serial_number) = 1) "
    "SELECT source_file, (SELECT count(*) FROM tagged t WHERE t.source_file = kept.source_file) AS raw_rows, count(*) AS cleaned_rows, "
    "count(DISTINCT site_id) AS sites, max(event_time) AS latest FROM kept GROUP BY source_file"))
def f29(spark, sf_dir):
    rows = _source_rows(spark, sf_dir)
    cleaned = clean.first_per_minute(
        clean.clean_alarms(rows, dedupe=False), ("source_file", *clean.DEDUPE_KEY))
    return explore.file_totals(rows, cleaned).withColumn("latest", naive("latest"))


_STREAMED = (
    "streamed AS (SELECT * REPLACE (date_trunc('second', event_time) AS event_time) FROM flagged), "
    "kept AS (SELECT *, CASE WHEN site_id <> '-' THEN site_id ELSE node_identifier END AS entity FROM streamed QUALIFY row_number() OVER "
    "(PARTITION BY site_id, node_identifier, date_trunc('minute', event_time), alarm_name, severity ORDER BY event_time, log_serial_number) = 1)"
)


def _drop_folder(spark, sf_dir):
    """A folder in which every row arrives, and a tenth a second time in later files."""
    from towerlens.schema import RAW_SCHEMA
    drop = session.scratch(spark, "drop")
    rows = exported(spark, sf_dir).withColumnRenamed("name", "alarm_name")
    known = [f.name for f in RAW_SCHEMA.fields]
    full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in known])
    files.write_csv(full, f"{drop}/first")
    files.write_csv(full.where(F.col("log_serial_number").cast("bigint") % 10 == 0), f"{drop}/second")
    return ingest.open_folder(spark, f"{drop}/*", RAW_SCHEMA)


@register("l1_windowed_counts", with_alarms(
    "SELECT * FROM (SELECT entity, time_bucket(INTERVAL 2 HOUR, event_time, TIMESTAMP '1970-01-01') AS bucket_start, count(*) AS alarms FROM kept GROUP BY ALL) "
    "WHERE bucket_start <= (SELECT max(event_time) FROM kept) - INTERVAL 4 HOUR", _STREAMED))
def l1_windowed(spark, sf_dir):
    """Windows that the watermark has closed, counted in the state store."""
    base = session.scratch(spark, "windows")
    ingest.start_windowed(_drop_folder(spark, sf_dir), f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/counts").withColumn("bucket_start", naive("bucket_start"))


@register("l1_incremental_ingest", with_alarms(
    "SELECT entity, time_bucket(INTERVAL 2 HOUR, event_time, TIMESTAMP '1970-01-01') AS bucket_start, count(*) AS alarms FROM kept GROUP BY ALL", _STREAMED))
def l1(spark, sf_dir):
    stream = _drop_folder(spark, sf_dir)
    base = session.scratch(spark, "ingest")
    ingest.start(stream, f"{base}/history", f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    return ingest.bucket_counts(spark, f"{base}/counts").withColumn("bucket_start", naive("bucket_start"))
