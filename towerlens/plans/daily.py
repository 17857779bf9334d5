"""Daily batch: ingest, purge, features, predictions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from towerlens import session
from towerlens.operators import clean, explore
from towerlens.plans import rebuild
from towerlens.settings import Settings
from towerlens.sources import files, history


@dataclass(frozen=True)
class DailyResult:
    inserted: int
    purged: history.Purged
    predictions: DataFrame
    warnings: int
    towers: int


def ingest(raw: DataFrame, history_path: str, source: str | None, now: datetime,
           choose: bool = False) -> tuple[DataFrame, int]:
    """Clean the alarms and append them to the history.

    Without ``source`` each row is named by the file it came from, so further files add
    rows and repeated ones do not. ``choose`` keeps only the towers chosen for a model.
    """
    # kept once: selection, history and features all start from the cleaned rows
    alarms = session.cut_lineage(clean.with_entity(clean.clean_alarms(raw)))
    if choose:
        alarms = explore.select_towers(alarms, "entity", "is_cell_unavailable")
    return alarms, history.append(alarms, history_path, source, now)


def run(spark: SparkSession, folder: str, base: str, settings: Settings, now: datetime, boundary: str,
        estimator=None) -> DailyResult:
    loaded = files.load_folder(spark, folder)
    alarms, inserted = ingest(loaded.rows, f"{base}/history", None, now)
    purged = history.purge(spark, f"{base}/history", now)
    matrix = rebuild.build_features(alarms, settings, f"{base}/features")
    predictions = rebuild.score(
        spark, matrix, f"{base}/model", f"{base}/predictions", settings, boundary, estimator)
    totals = predictions.agg(
        F.sum("predicted_outage").alias("warnings"), F.count_distinct("site_id").alias("towers")).first()
    return DailyResult(inserted, purged, predictions, int(totals["warnings"] or 0), int(totals["towers"]))
