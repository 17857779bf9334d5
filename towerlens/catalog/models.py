"""Training, calibration, search, importance and scoring over the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from towerlens import session
from towerlens.catalog.base import alarms, naive, rounded, with_alarms
from towerlens.catalog.evaluation import _SCORED
from towerlens.catalog.grids import _LAST, _POINT, _matrix_sql
from towerlens.catalog.registry import Area
from towerlens.functions import risk
from towerlens.operators import columns, explore, scoring, split, training
from towerlens.plans import rebuild
from towerlens.settings import Settings

register = Area()
QUERIES, SQL = register.queries, register.sql

BOUNDARY = "2024-01-23 00:00:00"
SETTINGS = Settings(lookback_hours=(6, 24))
TARGET = "target_outage_next_2h"
#: Trees of the second booster.
SECOND_TREES = 6

_kept: dict[tuple, object] = {}


def features(spark, sf_dir):
    """Feature matrix written once per session and table set."""
    key = (spark.sparkContext.applicationId, sf_dir, "features")
    if key not in _kept:
        path = session.scratch(spark, "features")
        rebuild.build_features(alarms(spark, sf_dir), SETTINGS, path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])


def _estimator():
    """The whole booster: 150 trees of depth 5, steps of 0.05 over 0.8 of rows and columns."""
    return training.boosted()


def trained(spark, sf_dir) -> rebuild.Trained:
    key = (spark.sparkContext.applicationId, sf_dir, "trained")
    if key not in _kept:
        _kept[key] = rebuild.train(features(spark, sf_dir), SETTINGS, BOUNDARY, _estimator())
    return _kept[key]


def _parts(spark, sf_dir):
    rows = features(spark, sf_dir)
    names = columns.predictor_columns(rows)
    parts = split.chronological_split(rows, "window_timestamp", BOUNDARY, rebuild.ROW_KEY)
    keyed = {n: df.withColumn("row_key", rebuild._row_key()) for n, df in parts.items()}
    return names, {n: training.with_weights(training.assemble(df, names, TARGET, ("row_key",))) for n, df in keyed.items()}


def _holdout(spark, sf_dir, estimator, name):
    _, parts = _parts(spark, sf_dir)
    scored = training.fit(estimator, parts["train"]).transform(parts["test"])
    return scored.select(
        F.lit(name).alias("model"), training.vector_to_array("probability")[1].alias("score"),
        F.col("label").cast("int").alias("label"))


@register("k4_boosted_trees")
def k4(spark, sf_dir):
    return training.scorecard(_holdout(spark, sf_dir, _estimator(), "boosted"), "model", "score", "label")


@register("k5_random_forest")
def k5(spark, sf_dir):
    return training.scorecard(_holdout(spark, sf_dir, training.forest(), "forest"), "model", "score", "label")


@register("k6_second_booster")
def k6(spark, sf_dir):
    second = training.boosted(iterations=SECOND_TREES, depth=4, step=0.1, columns_share="0.6")
    return training.scorecard(_holdout(spark, sf_dir, second, "second"), "model", "score", "label")


@register("k7_calibrated_metrics")
def k7(spark, sf_dir):
    metrics = trained(spark, sf_dir).metrics
    rows = features(spark, sf_dir).where(F.col("window_timestamp") >= F.lit(BOUNDARY).cast("timestamp"))
    scored = trained(spark, sf_dir).model.score(rows)
    return scored.agg(
        F.avg("outage_probability").alias("mean_probability"), F.avg(F.col(TARGET).cast("double")).alias("outage_rate"),
    ).withColumns({k: F.lit(v) for k, v in metrics.items()})


@register("k8_random_search")
def k8(spark, sf_dir):
    _, parts = _parts(spark, sf_dir)
    sample = split.tuning_sample(parts["train"], "row_key")
    folded = split.exact_folds(sample, "label", ("row_key",), 3, training.FOLD)
    space = {"maxIter": [3, 5], "maxDepth": [2, 3], "stepSize": [0.05, 0.1]}
    _, scores = training.random_search(session.cut_lineage(folded), draws=2, folds=3, space=space)
    rows = [(str(sorted(params.items())), score) for params, score in scores]
    return spark.createDataFrame(rows, "parameters string, average_precision double")


class FixedModel:
    """Stands for a fitted model where the steps around it are compared with SQL: a score from
    whole-number counts, the same in every engine."""

    threshold = 0.45

    def score(self, df, name="outage_probability"):
        points = F.col("total_alarms_6h") + 3 * F.col("critical_alarms_6h") + 2 * F.col("rru_alarms_6h")
        return df.withColumn(name, points.cast("double") / (points + F.lit(8.0)))


_POINTS = "(total_alarms_6h + 3 * critical_alarms_6h + 2 * rru_alarms_6h)"
_P = f"({_POINTS}::DOUBLE / ({_POINTS} + 8.0::DOUBLE))"


def _tier_sql(p: str, profile: str) -> str:
    critical, warning, lowest = risk.TIERS[profile]
    return f"CASE WHEN {p} >= {critical} THEN 'CRITICAL' WHEN {p} >= {warning} THEN 'WARNING' ELSE '{lowest}' END"


def _features_sql(body: str, *more: str) -> str:
    return f"WITH features AS ({_matrix_sql((6, 24))})" + "".join(f", {m}" for m in more) + f" {body}"


_HELD_OUT = f"window_timestamp >= TIMESTAMP '{BOUNDARY}'"
_PERMUTED = ("total_alarms_6h", "critical_alarms_6h", "major_alarms_6h", "bbu_alarms_6h", "rru_alarms_6h", "power_alarms_6h",
             "total_alarms_24h", "critical_alarms_24h", "major_alarms_24h", "bbu_alarms_24h", "rru_alarms_24h", "power_alarms_24h",
             "consecutive_critical_streak_6h")
_REPEATS = 10


def _permuted_sql() -> str:
    factors = ", ".join(map(str, training.FACTORS))
    replaced = ", ".join(
        f"CASE WHEN k.k // {_REPEATS} = {i} THEN m.{f} ELSE r.{f} END AS {f}" for i, f in enumerate(_PERMUTED) if f in _POINTS)
    key = "site_id || '|' || node_identifier || '|' || strftime(window_timestamp, '%Y-%m-%d %H:%M:%S')"
    return _features_sql(
        f"SELECT ['" + "', '".join(_PERMUTED) + f"'][k // {_REPEATS} + 1] AS feature, round(avg(base.ap - areas.ap), 6) AS importance "
        "FROM areas, (SELECT ap FROM areas WHERE k = -1) base WHERE k >= 0 GROUP BY 1",
        f"held AS (SELECT *, row_number() OVER (ORDER BY md5({key} || '|42'), site_id, node_identifier, window_timestamp) - 1 AS spot FROM features WHERE {_HELD_OUT})",
        "size AS (SELECT count(*) AS n FROM held)",
        f"ks AS (SELECT unnest(generate_series(-1, {len(_PERMUTED) * _REPEATS - 1})) AS k)",
        # every factor is prime; the counts here are not multiples of one
        f"places AS (SELECT h.*, k.k, CAST((h.spot::HUGEINT * ([{factors}][k.k % 10 + 1] % n) + (k.k + 1) * {training.STEP} % n) % n AS BIGINT) AS target_spot FROM held h, size, ks k WHERE k.k >= 0)",
        f"copies AS (SELECT k.k AS k, r.target_outage_next_2h AS y, {replaced} FROM held r JOIN places m ON m.target_spot = r.spot JOIN ks k ON k.k = m.k "
        f"UNION ALL SELECT -1, target_outage_next_2h, {', '.join(f for f in _PERMUTED if f in _POINTS)} FROM held)",
        f"counts AS (SELECT k, {_P} AS score, sum(y) AS pos, count(*) AS n FROM copies GROUP BY ALL)",
        "points AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS reached, sum(pos) OVER (PARTITION BY k) AS p FROM counts WINDOW w AS (PARTITION BY k ORDER BY score DESC))",
        "areas AS (SELECT k, sum(pos / p::DOUBLE * (tp / reached::DOUBLE)) AS ap FROM points GROUP BY k)")


@register("k12_permutation_importance", _permuted_sql())
def k12(spark, sf_dir):
    """All features, ten repeats, on the hold-out."""
    rows = features(spark, sf_dir).where(F.col("window_timestamp") >= F.lit(BOUNDARY).cast("timestamp"))
    assert set(_PERMUTED) == set(columns.predictor_columns(rows))
    found = training.permutation_importance(rows, _PERMUTED, FixedModel().score, TARGET, rebuild.ROW_KEY, _REPEATS)
    return found.select("feature", *rounded("importance"))


@register("k12_importance_of_trees")
def k12_trees(spark, sf_dir):
    model = trained(spark, sf_dir).model
    rows = features(spark, sf_dir).where(F.col("window_timestamp") >= F.lit(BOUNDARY).cast("timestamp"))
    return training.permutation_importance(rows, columns.predictor_columns(rows), model.score, TARGET, rebuild.ROW_KEY, repeats=2)


@register("k13_batch_scoring", _features_sql(
    f"SELECT {_tier_sql(_P, 'batch')} AS risk_level, ({_P} >= 0.45)::INT AS predicted_outage, count(*) AS n FROM features GROUP BY ALL"))
def k13(spark, sf_dir):
    scored = scoring.score_matrix(features(spark, sf_dir), FixedModel())
    return scored.groupBy("risk_level", "predicted_outage").agg(F.count(F.lit(1)).alias("n"))


@register("k14_helper_probabilities", _features_sql(
    f"SELECT site_id, round(max({_P}), 6) AS peak_probability FROM features GROUP BY 1"))
def k14(spark, sf_dir):
    scored = scoring.probabilities(features(spark, sf_dir), FixedModel(), training.HELPER_FEATURES)
    return scored.groupBy("site_id").agg(F.round(F.max("outage_probability"), 6).alias("peak_probability"))


@register("k15_upload_scoring", with_alarms(
    f"SELECT site_id, node_identifier, window_timestamp, round({_P}, 6) AS failure_probability, {_tier_sql(_P, 'operations')} AS risk_status "
    f"FROM ({_LAST.format(columns=', '.join(_POINT), key='entity')})"))
def k15(spark, sf_dir):
    rows = scoring.score_upload(alarms(spark, sf_dir), FixedModel())
    return rows.select("site_id", "node_identifier", naive("window_timestamp"), *rounded("failure_probability"), "risk_status")


@register("k15_upload_of_trees")
def k15_trees(spark, sf_dir):
    rows = scoring.score_upload(alarms(spark, sf_dir), trained(spark, sf_dir).model)
    return rows.select("site_id", "node_identifier", naive("window_timestamp"), "failure_probability", "risk_status")


@register("k15_upload_without_model", with_alarms(
    "SELECT 0.0::DOUBLE AS failure_probability, 'NOMINAL' AS risk_status, count(DISTINCT entity) AS n FROM alarms"))
def k15_without(spark, sf_dir):
    rows = scoring.score_upload(alarms(spark, sf_dir), None)
    return rows.groupBy("failure_probability", "risk_status").agg(F.count(F.lit(1)).alias("n"))


@register("a9_saved_model_scores", _features_sql("SELECT count(*) AS n, 0.0::DOUBLE AS largest_difference, true AS all_probabilities FROM features"))
def a9(spark, sf_dir):
    """A model that was saved and loaded scores every row as it did before."""
    path = session.scratch(spark, "model")
    model = trained(spark, sf_dir).model
    model.save(spark, path)
    both = training.load_model(spark, path).score(model.score(features(spark, sf_dir), "before"), "after")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_difference"),
        F.bool_and(F.col("after").between(0, 1)).alias("all_probabilities"))


@register("k20_loss_history")
def k20(spark, sf_dir):
    _, parts = _parts(spark, sf_dir)
    model = _estimator().fit(parts["train"])
    return training.loss_history(model, parts)


_NEWEST = "newest AS (SELECT * FROM features WHERE window_timestamp = (SELECT max(window_timestamp) FROM features))"


@register("h5_priority_queue", _features_sql(
    f"SELECT site_id, node_identifier, round({_P}, 6) AS failure_probability, {_tier_sql(_P, 'operations')} AS risk_status, total_alarms_6h FROM newest", _NEWEST))
def h5(spark, sf_dir):
    queue = scoring.priority_queue(features(spark, sf_dir), FixedModel())
    return queue.select("site_id", "node_identifier", *rounded("failure_probability"), "risk_status", "total_alarms_6h")


@register("h5_queue_captions")
def h5_captions(spark, sf_dir):
    queue = scoring.priority_queue(features(spark, sf_dir), trained(spark, sf_dir).model)
    return scoring.queue_presentation(queue)


@register("k21_probability_distribution", _features_sql(
    "SELECT least(floor((score - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM scores, (SELECT min(score) AS lo, max(score) AS hi FROM scores) GROUP BY 1",
    f"scores AS (SELECT {_P} AS score FROM features)"))
def k21(spark, sf_dir):
    return scoring.probability_distribution(FixedModel().score(features(spark, sf_dir)))


@register("f13_queue_kpis", _features_sql(
    f"SELECT count(*) AS towers, count(*) FILTER (WHERE {_P} >= 0.65) AS critical, count(*) FILTER (WHERE {_P} >= 0.35 AND {_P} < 0.65) AS warning FROM newest", _NEWEST))
def f13(spark, sf_dir):
    queue = scoring.priority_queue(features(spark, sf_dir), FixedModel())
    return explore.snapshot_kpis(queue, "failure_probability")


_CARD = (
    "cards AS (SELECT 'plain' AS model, score, label FROM scored UNION ALL SELECT 'inverse', 1 - score, label FROM scored)",
    "counts AS (SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM cards GROUP BY ALL)",
    "points AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n "
    "FROM counts WINDOW w AS (PARTITION BY model ORDER BY score DESC))",
    "rated AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / p::DOUBLE AS rec, fp / n::DOUBLE AS fpr, (tp - pos) / p::DOUBLE AS rec0, (fp - neg) / n::DOUBLE AS fpr0 FROM points)",
    "areas AS (SELECT model, sum((rec - rec0) * pr) AS ap, sum((fpr - fpr0) * (rec + rec0) / 2) AS roc FROM rated GROUP BY model)",
    "cells AS (SELECT model, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp, "
    "count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn FROM cards GROUP BY model)",
)


@register("k19_scorecard", "WITH " + ", ".join([_SCORED, *_CARD]) + (
    " SELECT model, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision, "
    "round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 4) AS f1, "
    "round(roc, 4) AS roc_auc, round(ap, 4) AS pr_auc FROM cells JOIN areas USING (model)"))
def k19(spark, sf_dir):
    from towerlens.catalog.evaluation import scored
    rows = scored(spark, sf_dir)
    both = rows.select(F.lit("plain").alias("model"), "score", "label").unionByName(
        rows.select(F.lit("inverse").alias("model"), (1 - F.col("score")).alias("score"), "label"))
    return training.scorecard(both, "model", "score", "label")


@register("k21_score_distribution", "WITH " + _SCORED + (
    " SELECT least(floor((score - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM scored, (SELECT min(score) AS lo, max(score) AS hi FROM scored) GROUP BY 1"))
def k21_scores(spark, sf_dir):
    from towerlens.catalog.evaluation import scored
    return scoring.probability_distribution(scored(spark, sf_dir), "score")
