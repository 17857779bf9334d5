"""Batch, snapshot and upload scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from towerlens import session
from towerlens.functions import risk, text
from towerlens.operators import columns, quantiles, sliding

# Columns and captions of the operations queue.
QUEUE_COLUMNS = {
    "site_id": "Site ID (Strict 6-Char)",
    "node_identifier": "eNodeB / gNodeB Identifier",
    "enodeb_id": "eNodeB ID (4G)",
    "gnodeb_id": "gNodeB ID (5G)",
    "failure_probability": "Outage Probability",
    "risk_status": "Risk Status",
    "critical_alarms_6h": "Critical Alarms (6h)",
    "rru_alarms_6h": "RRU Alarms (6h)",
    "bbu_alarms_6h": "BBU Alarms (6h)",
    "consecutive_critical_streak_6h": "Critical Streak (6h)",
    "total_alarms_6h": "Total Alarms (6h)",
}


def score_matrix(matrix: DataFrame, model) -> DataFrame:
    """Predictions of the whole matrix: probability, decision and batch tier."""
    scored = model.score(matrix, "outage_probability")
    return scored.withColumns({
        "predicted_outage": (F.col("outage_probability") >= model.threshold).cast("int"),
        "risk_level": risk.tier(F.col("outage_probability"), "batch"),
    })


def probabilities(df: DataFrame, model, features: Sequence[str]) -> DataFrame:
    """Probabilities of rows that carry a fixed feature list."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise KeyError(f"missing features: {missing}")
    return model.score(df, "outage_probability")


def priority_queue(matrix: DataFrame, model) -> DataFrame:
    """Newest grid point of every tower, most endangered first."""
    newest = columns.latest(matrix, "window_timestamp")
    scored = model.score(newest, "failure_probability")
    tiered = scored.withColumn("risk_status", risk.tier(F.col("failure_probability"), "operations"))
    return tiered.orderBy(F.desc("failure_probability"), "site_id", "node_identifier")


def queue_presentation(queue: DataFrame) -> DataFrame:
    """Queue columns under their captions, the probability as text."""
    present = [c for c in QUEUE_COLUMNS if c in queue.columns]
    shown = queue.withColumn("failure_probability", text.percent_text(F.col("failure_probability")))
    return shown.select(*[F.col(c).alias(QUEUE_COLUMNS[c]) for c in present])


def score_upload(alarms: DataFrame, model, entity: str = "entity") -> DataFrame:
    """Risk per site at the last event of the upload; without a model everything is nominal."""
    points = sliding.latest_point_features(alarms, entity)
    if model is None:
        return points.withColumns({"failure_probability": F.lit(0.0), "risk_status": F.lit("NOMINAL")})
    scored = model.score(points, "failure_probability")
    tiered = scored.withColumn("risk_status", risk.tier(F.col("failure_probability"), "operations"))
    return tiered.orderBy(F.desc("failure_probability"), entity)


def probability_distribution(scored: DataFrame, probability: str = "outage_probability", bins: int = 50) -> DataFrame:
    """Histogram of the probabilities; they are scored once and kept for the range and the counts."""
    kept = session.cut_lineage(scored.select(probability))
    return quantiles.histogram(kept, probability, bins)
