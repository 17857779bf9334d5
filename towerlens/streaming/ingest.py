"""A drop folder of alarm files ingested batch by batch into the history.

Each micro-batch is cleaned, reduced to the first alarm per key and minute, and joined
against the history of the dates it touches, so a late or repeated row is neither lost nor
doubled: there is no watermark behind which rows vanish. Bucket counts are written as
increments and summed on read. A second, live view counts in the state store instead and
closes its windows by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from towerlens import session
from towerlens.functions import timeparts
from towerlens.operators import clean
from towerlens.sources.history import PARTITION

KEY = ["site_id", "node_identifier", "event_minute", "alarm_name", "severity"]
STORED = [
    "site_id", "node_identifier", "event_time", "event_minute", "alarm_name", "severity",
    "duration_minutes", "log_serial_number",
]


def open_folder(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "csv", files_per_batch: int | None = None) -> DataFrame:
    """File-source stream with a fixed schema."""
    reader = spark.readStream.format(fmt).schema(schema).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def prepare(batch: DataFrame) -> DataFrame:
    cleaned = clean.clean_alarms(batch)
    return cleaned.withColumns({
        "event_minute": F.date_trunc("minute", "event_time"), PARTITION: F.to_date("event_time"),
    }).select(*STORED, PARTITION)


def _committed(rows: DataFrame, done: int) -> DataFrame:
    return rows.where(F.col("batch_id") < done)


def store_batch(batch: DataFrame, batch_id: int, history: str, counts: str) -> None:
    """Append the new rows of one micro-batch; a repeated batch replaces its own output."""
    spark = batch.sparkSession
    rows = session.cut_lineage(prepare(batch))
    if session.path_exists(spark, history):
        # the dates of the batch, no more than a calendar has, prune the folders that are read
        dates = rows.where(F.col(PARTITION) >= F.lit("0001-01-01").cast("date")).select(PARTITION).distinct()
        earlier = _committed(spark.read.parquet(history), batch_id).join(F.broadcast(dates), PARTITION, "left_semi")
        rows = rows.join(earlier.select(*KEY), KEY, "left_anti")
    fresh = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    (
        fresh.hint("rebalance", PARTITION).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", PARTITION).parquet(history)
    )
    written = spark.read.parquet(history).where(F.col("batch_id") == batch_id)
    bucket = timeparts.from_micros(
        timeparts.floor_index(timeparts.micros(F.col("event_time")), timeparts.STEP) * F.lit(timeparts.STEP))
    entity = clean.with_entity(written)
    (
        entity.groupBy("batch_id", "entity", bucket.alias("bucket_start")).agg(F.count(F.lit(1)).alias("alarms"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(counts)
    )


def start(stream: DataFrame, history: str, counts: str, checkpoint: str) -> StreamingQuery:
    """Process everything present in the folder, then stop."""
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: store_batch(batch, batch_id, history, counts))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def bucket_counts(spark: SparkSession, counts: str) -> DataFrame:
    """Alarms per entity and two-hour bucket over all increments."""
    return spark.read.parquet(counts).groupBy("entity", "bucket_start").agg(F.sum("alarms").alias("alarms"))


def windowed_counts(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Live view of cleaned alarms: counts per two-hour window, each minute's repeats once.

    Windows close once the watermark has passed them; their state and the keys seen are
    dropped then, so state stays small. Rows later than ``lateness`` are left out here, while
    the history still takes them.
    """
    keyed = stream.withColumn("event_minute", F.date_trunc("minute", "event_time")).withWatermark("event_time", lateness)
    return (
        keyed.dropDuplicatesWithinWatermark(KEY)
        .groupBy(F.window("event_time", f"{timeparts.STEP_HOURS} hours"), "entity")
        .agg(F.count(F.lit(1)).alias("alarms"))
        .select("entity", F.col("window.start").alias("bucket_start"), "alarms")
    )


def start_windowed(stream: DataFrame, out: str, checkpoint: str, lateness: str = "2 hours") -> StreamingQuery:
    """Append the closed windows of everything present in the folder, then stop; a later run
    goes on from the same state."""
    cleaned = clean.with_entity(clean.clean_alarms(stream, dedupe=False))
    return (
        windowed_counts(cleaned, lateness).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    )
