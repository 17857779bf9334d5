from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from towerlens.catalog import base
from towerlens.catalog.tables import exported
from towerlens.operators import explore, quality, scoring, sequence, slices, split, training
from towerlens.plans import daily, rebuild, upload
from towerlens.settings import Settings
from towerlens.sources import files

from conftest import DATA

SETTINGS = Settings(lookback_hours=(6, 24))
BOUNDARY = "2024-01-23 00:00:00"


@pytest.fixture(scope="module")
def matrix(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features") / "m")
    return rebuild.build_features(base.alarms(spark, DATA), SETTINGS, path)


@pytest.fixture(scope="module")
def trained(matrix):
    return rebuild.train(matrix, SETTINGS, BOUNDARY, training.boosted(iterations=4, depth=3))


def test_training_calibrates_and_round_trips(spark, matrix, trained, tmp_path):
    scored = trained.model.score(matrix)
    low, high, mean = scored.agg(F.min("outage_probability"), F.max("outage_probability"), F.avg("outage_probability")).first()
    assert 0 <= low <= high <= 1
    rate = matrix.agg(F.avg("target_outage_next_2h")).first()[0]
    assert abs(mean - rate) < 0.1
    trained.model.save(spark, str(tmp_path / "model"))
    loaded = training.load_model(spark, str(tmp_path / "model"))
    assert loaded.features == trained.model.features and loaded.threshold == trained.model.threshold
    again = loaded.score(matrix).agg(F.avg("outage_probability")).first()[0]
    assert again == pytest.approx(mean)
    assert training.load_model(spark, str(tmp_path / "absent")) is None


def test_scoring_survives_absent_features_and_adds_tiers(matrix, trained):
    reduced = matrix.drop("rru_alarms_6h")
    rows = scoring.score_matrix(reduced, trained.model)
    assert {"outage_probability", "predicted_outage", "risk_level"} <= set(rows.columns)
    assert rows.count() == matrix.count()
    with pytest.raises(KeyError):
        scoring.probabilities(reduced, trained.model, training.HELPER_FEATURES)


def test_forest_members_can_be_saved(spark, matrix, tmp_path):
    model = rebuild.train(matrix, SETTINGS, BOUNDARY, training.forest(3, 3), folds=2).model
    model.save(spark, str(tmp_path / "forest"))
    assert training.load_model(spark, str(tmp_path / "forest")).features == model.features


def test_permuting_a_useless_feature_changes_nothing(matrix):
    rows = matrix.select(*rebuild.ROW_KEY, rebuild.TARGET, "total_alarms_6h").withColumn("noise", F.lit(1.0))

    def score(df):
        return df.withColumn("outage_probability", F.col("total_alarms_6h").cast("double"))

    got = {r["feature"]: r["importance"] for r in training.permutation_importance(
        rows, ["noise", "total_alarms_6h"], score, rebuild.TARGET, rebuild.ROW_KEY, repeats=1).collect()}
    assert got["noise"] == 0.0 and got["total_alarms_6h"] != 0.0


def test_daily_and_upload(spark, trained, tmp_path):
    folder = str(tmp_path / "drop")
    files.write_csv(exported(spark, DATA), f"{folder}/day.csv")
    now = datetime(2024, 2, 20)
    result = daily.run(spark, folder, str(tmp_path / "base"), SETTINGS, now, BOUNDARY, training.boosted(iterations=2, depth=2))
    assert result.inserted > 0 and result.towers > 0 and result.predictions.count() > 0
    again = daily.ingest(files.load_folder(spark, folder).rows, str(tmp_path / "base/history"), None, now)
    assert again[1] == 0
    trained.model.save(spark, str(tmp_path / "model"))
    got = upload.run(spark, folder, str(tmp_path / "uploads"), str(tmp_path / "model"), now)
    totals = got.totals.collect()
    assert sum(r["raw_rows"] for r in totals) == 1000
    assert got.inserted == sum(r["cleaned_rows"] for r in totals)
    assert got.risks.where(~F.col("failure_probability").between(0, 1)).count() == 0
    bare = upload.run(spark, folder, str(tmp_path / "uploads2"), str(tmp_path / "none"), now)
    assert {r[0] for r in bare.risks.select("risk_status").distinct().collect()} == {"NOMINAL"}


def test_no_group_on_two_sides_and_folds_are_balanced(spark):
    rows = base.alarms(spark, DATA)
    parts = split.group_split(rows, "enodeb_id")
    assert sum(p.count() for p in parts.values()) == rows.count()
    assert split.shared_groups(parts["train"], parts["test"], "enodeb_id").first()[0] == 0
    folded = split.exact_folds(rows, "is_cell_unavailable", ("log_serial_number",), 5, limit=50)
    sizes = folded.groupBy("is_cell_unavailable", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["is_cell_unavailable"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_tower_selection_needs_outages(spark):
    data = [("a", 1), ("a", 0), ("b", 0), ("b", 0), ("b", 0), ("c", 0), ("d", 1)]
    df = spark.createDataFrame(data, "entity string, is_cell_unavailable int")
    kept = explore.select_towers(df, "entity", "is_cell_unavailable", outage_towers=20, healthy_towers=1)
    assert {r[0] for r in kept.select("entity").distinct().collect()} == {"a", "d", "b"}


def test_audit_flags_a_leak_but_not_a_constant(spark):
    df = spark.range(100).select(
        (F.col("id") % 2).cast("int").alias("target_outage_next_2h"), (F.col("id") % 2 * 3).alias("leak"),
        F.lit(1).alias("flat"), (F.col("id") % 2).cast("int").alias("target_cell_fault_2h"), F.col("id").alias("serial_no"))
    flagged = {(r["check"], r["column"]) for r in quality.audit_matrix(df).collect() if r["flagged"]}
    assert flagged == {("target_correlation", "leak"), ("identifier_name", "serial_no")}


# ---- plan shape -------------------------------------------------------------------


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    base.alarms(spark, DATA).write.parquet(str(tmp_path / "alarms"))
    return spark.read.parquet(str(tmp_path / "alarms"))


def test_cleaning_and_features_stay_in_the_jvm(spark, tmp_path):
    from towerlens.operators import sliding
    rows = stored(spark, tmp_path)
    for df in (base.alarms(spark, DATA), sliding.lookback_features(rows, SETTINGS)):
        assert "Python" not in plan(df) and "ArrowEval" not in plan(df)


def test_all_sequence_features_need_one_shuffle(spark, tmp_path):
    rows = stored(spark, tmp_path).withColumn("alarm_type_encoded", F.col("is_rru"))
    features = sequence.sequence_features(rows)
    assert plan(features).count("Exchange hashpartitioning") == 1


def test_grid_features_need_one_shuffle_and_no_cross_join(spark, tmp_path):
    from towerlens.operators import sliding
    text = plan(sliding.lookback_features(stored(spark, tmp_path), SETTINGS))
    assert text.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_dedupe_prunes_before_the_shuffle(spark):
    text = plan(base.alarms(spark, DATA))
    assert text.count("WindowGroupLimit") == 2


def test_group_counts_decide_about_slices(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), "id")
    assert slices.slice_groups(df, ("k",), ("id",), 10).split
    assert not slices.slice_groups(df, ("k",), ("id",), 100).split
