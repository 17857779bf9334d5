"""Uploaded files: clean, append to the history, score every site, totals per file."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from towerlens import session
from towerlens.operators import clean, explore, scoring, training
from towerlens.sources import files, history


@dataclass(frozen=True)
class UploadResult:
    totals: DataFrame
    inserted: int
    rejected: DataFrame
    risks: DataFrame


def run(spark: SparkSession, folder: str, history_path: str, model_path: str, now: datetime) -> UploadResult:
    """All files of a folder in one job, keyed by their source file."""
    loaded = files.load_folder(spark, folder, ("csv", "xlsx"))
    per_file = ("source_file", *clean.DEDUPE_KEY)
    cleaned = clean.clean_alarms(loaded.rows, dedupe=False)
    alarms = session.cut_lineage(clean.with_entity(clean.first_per_minute(cleaned, per_file)))
    inserted = history.append(alarms, history_path, None, now)
    history.purge(spark, history_path, now)
    model = training.load_model(spark, model_path, training.HELPER_FEATURES)
    return UploadResult(
        explore.file_totals(loaded.rows, alarms), inserted, loaded.rejected,
        scoring.score_upload(alarms, model))
