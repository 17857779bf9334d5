"""Settings to features to a calibrated model to predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from towerlens.operators import columns, curves, quality, scoring, sliding, split, training
from towerlens.settings import Settings

TARGET = "target_outage_next_2h"
ROW_KEY = ("site_id", "node_identifier", "window_timestamp")


@dataclass
class Trained:
    model: training.CalibratedModel
    metrics: dict
    findings: DataFrame


def build_features(alarms: DataFrame, settings: Settings, path: str, dense: bool = True) -> DataFrame:
    """Write the feature matrix and read it back, so later stages start from Parquet."""
    matrix = sliding.lookback_features(alarms, settings, dense=dense).drop("entity")
    matrix.write.mode("overwrite").parquet(path)
    return alarms.sparkSession.read.parquet(path)


def _row_key() -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in ROW_KEY])


def evaluate(model, test: DataFrame) -> dict:
    """PR area (trapezoid), ROC area and the F1-optimal threshold on a hold-out."""
    scored = model.score(test).select("outage_probability", F.col(TARGET).alias("y"))
    points = curves.curve_points(scored, "outage_probability", "y")
    if (points.agg(F.max("p")).first()[0] or 0) == 0:
        return {"pr_auc": 0.0, "roc_auc": 0.0, "optimal_threshold": 0.5}
    areas, best = curves.areas(points).first(), curves.best_threshold(points).first()
    return {
        "pr_auc": float(areas["pr_auc"]), "roc_auc": float(areas["roc_auc"]),
        "optimal_threshold": float(best["threshold"]),
    }


def train(matrix: DataFrame, settings: Settings, boundary: str, estimator=None, folds: int = 3) -> Trained:
    """Audit, chronological split, calibrated fit, hold-out metrics."""
    if TARGET not in matrix.columns:
        raise KeyError(f"{TARGET} is not in the feature matrix")
    features = columns.predictor_columns(matrix)
    findings = quality.audit_matrix(matrix, TARGET)
    parts = split.chronological_split(matrix, "window_timestamp", boundary, ROW_KEY)
    rows = training.assemble(
        parts["train"].withColumn("row_key", _row_key()), features, TARGET, keep=("row_key",))
    model = training.calibrate(rows, features, estimator or training.boosted(), F.col("row_key"), folds)
    metrics = evaluate(model, parts["test"])
    model.metadata = {
        **metrics, "active_targets": list(settings.active_targets),
        "active_features": list(settings.active_features), "environment_mode": settings.environment_mode,
    }
    return Trained(model, metrics, findings)


def score(spark: SparkSession, matrix: DataFrame, model_path: str, output: str, settings: Settings, boundary: str,
          estimator=None) -> DataFrame:
    """Predictions of the whole matrix; trains and saves a model first when there is none."""
    model = training.load_model(spark, model_path, columns.predictor_columns(matrix))
    if model is None:
        model = train(matrix, settings, boundary, estimator).model
        model.save(spark, model_path)
    scoring.score_matrix(matrix, model).write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)


def rebuild(alarms: DataFrame, settings: Settings, base: str, boundary: str, estimator=None) -> DataFrame:
    """After a settings change: features, training and scoring anew."""
    spark = alarms.sparkSession
    matrix = build_features(alarms, settings, f"{base}/features")
    trained = train(matrix, settings, boundary, estimator)
    trained.model.save(spark, f"{base}/model")
    return score(spark, matrix, f"{base}/model", f"{base}/predictions", settings, boundary)
