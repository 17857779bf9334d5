"""Splits, folds, curves and threshold metrics on a score column."""

from __future__ import annotations

from pyspark.sql import functions as F

from towerlens import session
from towerlens.catalog.base import alarms, integers, raw, rounded, table, with_alarms, with_raw
from towerlens.catalog.registry import Area
from towerlens.operators import curves, split

register = Area()
QUERIES, SQL = register.queries, register.sql

_SCORED = (
    "scored AS (SELECT event_id, user_id, least(round(value, 2) / 500.0, 1.0)::DOUBLE AS score, (event_type = 'error')::INT AS label FROM events)"
)
_POINTS = (
    "counts AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score)",
    "points AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, "
    "sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM counts)",
    "rated AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / p::DOUBLE AS rec, fp / n::DOUBLE AS fpr FROM points)",
)


def _sql(body: str, *parts: str) -> str:
    return "WITH " + ", ".join([_SCORED, *parts]) + " " + body


def scored(spark, sf_dir):
    score = F.least(F.round("value", 2) / 500.0, F.lit(1.0))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", score.alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))


def points(spark, sf_dir):
    return curves.curve_points(scored(spark, sf_dir), "score", "label")


def _bucket_sql(key: str, buckets: int, seed: int = 42) -> str:
    return f"(('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT % {buckets})"


@register("k1_chronological_split", with_raw(
    "SELECT CASE WHEN event_time < TIMESTAMP '2024-01-23 00:00:00' THEN 'train' ELSE 'test' END AS part, count(*) AS n, "
    "sum(log_serial_number)::BIGINT AS checksum FROM raw GROUP BY 1"))
def k1(spark, sf_dir):
    parts = split.chronological_split(raw(spark, sf_dir), "event_time", "2024-01-23 00:00:00", ("log_serial_number",))
    sums = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("log_serial_number").alias("checksum"))
            for name, df in parts.items()]
    return sums[0].unionByName(sums[1])


@register("k1_fallback_split", with_raw(
    "SELECT CASE WHEN place < floor(total * 0.8) THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(log_serial_number)::BIGINT AS checksum FROM "
    "(SELECT log_serial_number, row_number() OVER (ORDER BY md5(CAST(log_serial_number AS STRING) || '|42'), log_serial_number) - 1 AS place, "
    "count(*) OVER () AS total FROM raw) GROUP BY 1"))
def k1_fallback(spark, sf_dir):
    parts = split.chronological_split(raw(spark, sf_dir), "event_time", "2030-01-01 00:00:00", ("log_serial_number",))
    sums = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("log_serial_number").alias("checksum"))
            for name, df in parts.items()]
    return sums[0].unionByName(sums[1])


_SIDE = (f"CASE WHEN {_bucket_sql('mo_name', 100)} < 15 THEN 'test' WHEN {_bucket_sql('mo_name', 100)} < 30 "
         "THEN 'validation' ELSE 'train' END")


@register("k2_group_split", with_raw(
    f"SELECT {_SIDE} AS part, count(*) AS n, count(DISTINCT mo_name) AS groups FROM raw GROUP BY 1"))
def k2(spark, sf_dir):
    rows = raw(spark, sf_dir)
    part = split.side(F.col(split.group_column(rows, "log_serial_number")))
    return rows.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("mo_name").alias("groups"))


@register("k3_tuning_sample", with_raw(
    f"SELECT log_serial_number FROM raw, (SELECT count(*) AS total FROM raw) WHERE total <= 4000 OR "
    f"{_bucket_sql('enodeb_id', 10000, 7)} < floor(4000 / total::DOUBLE * 10000)"))
def k3(spark, sf_dir):
    # the SQL cuts the share to 10,000 buckets
    return split.tuning_sample(raw(spark, sf_dir), "enodeb_id", 4000, buckets=10_000).select("log_serial_number")


@register("k9_folds", with_raw(
    f"SELECT log_serial_number, {_bucket_sql('CAST(log_serial_number AS STRING)', 5)}::INT AS fold FROM raw"))
def k9(spark, sf_dir):
    return split.folds(raw(spark, sf_dir), F.col("log_serial_number"), 5).select("log_serial_number", "fold")


@register("k9_exact_folds", with_alarms(
    "SELECT is_cell_unavailable, fold, count(*) AS n, sum(log_serial_number)::BIGINT AS checksum FROM (SELECT *, ((row_number() OVER (PARTITION BY is_cell_unavailable "
    "ORDER BY md5(CAST(log_serial_number AS STRING) || '|42'), log_serial_number) - 1) % 5)::INT AS fold FROM alarms) GROUP BY 1, 2"))
def k9_exact(spark, sf_dir):
    # written once with what the folds read: large groups are counted, ranged and sliced from it
    narrow = session.staged(alarms(spark, sf_dir).select("is_cell_unavailable", "log_serial_number"), "folds")
    rows = split.exact_folds(narrow, "is_cell_unavailable", ("log_serial_number",), 5)
    return rows.groupBy("is_cell_unavailable", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("log_serial_number").alias("checksum"))


@register("k10a_threshold_metrics", _sql(
    "SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, "
    "round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM (SELECT "
    "count(*) FILTER (WHERE label = 1 AND score >= 0.1) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.1) AS fp, "
    "count(*) FILTER (WHERE label = 0 AND score < 0.1) AS tn, count(*) FILTER (WHERE label = 1 AND score < 0.1) AS fn FROM scored)"))
def k10a(spark, sf_dir):
    rows = curves.threshold_metrics(scored(spark, sf_dir), "score", "label", 0.1)
    return rows.select("tp", "fp", "tn", "fn", *rounded("accuracy", "precision", "recall", "f1"))


@register("k10a_class_report", _sql(
    "SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM lines UNION ALL "
    "SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM lines UNION ALL "
    "SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), "
    "round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM lines",
    "cells AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.1) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.1) AS fp, "
    "count(*) FILTER (WHERE label = 0 AND score < 0.1) AS tn, count(*) FILTER (WHERE label = 1 AND score < 0.1) AS fn FROM scored)",
    "lines AS (SELECT '0' AS label, tn / (tn + fn)::DOUBLE AS p, tn / (tn + fp)::DOUBLE AS r, 2 * tn / (2 * tn + fp + fn)::DOUBLE AS f, tn + fp AS support FROM cells "
    "UNION ALL SELECT '1', tp / (tp + fp)::DOUBLE, tp / (tp + fn)::DOUBLE, 2 * tp / (2 * tp + fp + fn)::DOUBLE, tp + fn FROM cells)"))
def k10a_report(spark, sf_dir):
    rows = curves.class_report(scored(spark, sf_dir), "score", "label", 0.1)
    return rows.select("label", *rounded("precision", "recall", "f1"), *integers("support"))


@register("k10b_pr_curve", _sql(
    "SELECT round(rec, 6) AS recall, round(pr, 6) AS precision, score AS threshold FROM rated UNION ALL SELECT 0, 1, NULL", *_POINTS))
def k10b_pr(spark, sf_dir):
    return curves.pr_curve(points(spark, sf_dir)).select(*rounded("recall", "precision"), "threshold")


@register("k10b_roc_curve", _sql(
    "SELECT round(fpr, 6) AS fpr, round(rec, 6) AS tpr, score AS threshold FROM rated UNION ALL SELECT 0, 0, NULL", *_POINTS))
def k10b_roc(spark, sf_dir):
    return curves.roc_curve(points(spark, sf_dir)).select(*rounded("fpr", "tpr"), "threshold")


_AREAS = (
    "lagged AS (SELECT *, coalesce(lag(rec) OVER w, 0) AS rec0, coalesce(lag(pr) OVER w, 1) AS pr0, coalesce(lag(fpr) OVER w, 0) AS fpr0 "
    "FROM rated WINDOW w AS (ORDER BY score DESC))",
)


@register("k10b_areas", _sql(
    "SELECT round(sum((rec - rec0) * (pr + pr0) / 2), 6) AS pr_auc, round(sum((rec - rec0) * pr), 6) AS average_precision, "
    "round(sum((fpr - fpr0) * (rec + rec0) / 2), 6) AS roc_auc FROM lagged", *_POINTS, *_AREAS))
def k10b_areas(spark, sf_dir):
    return curves.areas(points(spark, sf_dir)).select(*rounded("pr_auc", "average_precision", "roc_auc"))


@register("k11_best_threshold", _sql(
    "SELECT arg_max(score, (f1, -score)) AS threshold, round(max(f1), 6) AS f1 FROM (SELECT score, 2 * pr * rec / (pr + rec + 1e-10) AS f1 FROM rated)", *_POINTS))
def k11(spark, sf_dir):
    return curves.best_threshold(points(spark, sf_dir)).select("threshold", *rounded("f1"))
