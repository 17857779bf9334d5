"""The registered booster is the whole one."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from towerlens.catalog import models
from towerlens.operators import training


def matrix(spark):
    """Two-hour points of three towers around the boundary; an outage follows many alarms."""
    start = datetime.fromisoformat(models.BOUNDARY) - timedelta(hours=60)
    data = [(f"s{s}", f"n{s}", start + timedelta(hours=2 * t), (s * 7 + t * 5) % 11, (s + t) % 3, int((s * 7 + t * 5) % 11 > 7)) for s in range(3) for t in range(60)]
    return spark.createDataFrame(data, f"site_id string, node_identifier string, window_timestamp timestamp, total_alarms_6h long, critical_alarms_6h long, {models.TARGET} int")


def test_k4_fits_every_tree(spark, monkeypatch):
    """150 trees of depth 5; only the parameters are looked at, the fit here is a short one."""
    seen, fit = [], training.fit

    def short(estimator, df):
        seen.append({p.name: v for p, v in estimator.extractParamMap().items()})
        return fit(estimator.copy({estimator.maxIter: 2}), df)

    rows = matrix(spark)
    monkeypatch.setattr(models, "features", lambda spark, sf_dir: rows)
    monkeypatch.setattr(training, "fit", short)
    card = models.k4(spark, "").collect()
    assert len(card) == 1 and card[0].model == "boosted" and card[0].roc_auc > 0.9
    whole = {"maxIter": 150, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
    assert len(seen) == 1 and {k: seen[0][k] for k in whole} == whole


def test_calibrated_model_takes_the_same_booster(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(models.rebuild, "train", lambda matrix, settings, boundary, estimator: asked.append(estimator) or "model")
    monkeypatch.setattr(models, "features", lambda spark, sf_dir: spark.range(1).select(F.col("id")))
    assert models.trained(spark, "no such table") == "model"
    assert (asked[0].getMaxIter(), asked[0].getMaxDepth()) == (150, 5)
    del models._kept[spark.sparkContext.applicationId, "no such table", "trained"]
