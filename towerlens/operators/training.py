"""Weighted tree ensembles, probability calibration, search, importance and loss history."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from towerlens import session
from towerlens.operators import columns, curves, slices, split

FEATURES = "features"
WEIGHT = "weight"
LABEL = "label"
FOLD = "fold"
# Ten primes below 2**32, and a step between permutations.
FACTORS = [4294967291, 4294967279, 4294967231, 4294967197, 4294967189, 4294967161, 4294967143, 4294967111, 4294967087, 4294967029]
STEP = 7_919
#: Positions of one block of permuted values, and rows that one task numbers at most.
BLOCK = 8_192
INDEX_ROWS = 250_000
#: Training rows from which on equal ones are gathered; what a row then stands for keeps the
#: whole at no fewer rows than these.
GATHER_ROWS = 1_000_000
COUNT = "stands_for"
# Features of the six-column scoring helpers.
HELPER_FEATURES = (
    "total_alarms_6h", "critical_alarms_6h", "major_alarms_6h",
    "rru_alarms_6h", "bbu_alarms_6h", "total_alarms_24h",
)
# Parameter ranges of the randomised search.
SEARCH_SPACE = {
    "maxIter": [100, 200, 300], "stepSize": [0.01, 0.03, 0.05, 0.1], "maxDepth": [4, 6, 8],
    "subsamplingRate": [0.7, 0.8, 0.9], "featureSubsetStrategy": ["0.6", "0.7", "0.8"],
}


def boosted(iterations: int = 150, depth: int = 5, step: float = 0.05, rows: float = 0.8,
            columns_share: str = "0.8", seed: int = 42) -> GBTClassifier:
    return GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=iterations, maxDepth=depth,
        stepSize=step, subsamplingRate=rows, featureSubsetStrategy=columns_share, seed=seed)


def forest(trees: int = 150, depth: int = 6, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, numTrees=trees, maxDepth=depth, seed=seed)


def linear() -> LogisticRegression:
    return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=100)


def assemble(df: DataFrame, features: Sequence[str], label: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector of the aligned columns, with the label when given."""
    extra = [*keep] + ([label] if label else [])
    aligned = columns.align(df, features, keep=extra)
    vector = VectorAssembler(inputCols=list(features), outputCol=FEATURES).transform(aligned)
    return vector.withColumn(LABEL, F.col(label).cast("double")) if label else vector


def positive_weight(df: DataFrame) -> float:
    """Negatives per positive."""
    row = df.agg(F.sum(LABEL).alias("p"), F.count(F.lit(1)).alias("n")).first()
    positives = row["p"] or 0.0
    return float((row["n"] - positives) / max(positives, 1.0))


def with_weights(df: DataFrame, weight: float | None = None) -> DataFrame:
    weight = positive_weight(df) if weight is None else weight
    return df.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, F.lit(weight)).otherwise(F.lit(1.0)))


def gathered(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``df`` with equal rows of features, label, weight and ``keep`` gathered to fewer, each
    ``COUNT`` times as heavy; up to ``GATHER_ROWS`` rows stay as they are.

    Every row counts in full. A row stands for at most one in ``GATHER_ROWS`` of all, so that
    bags drawn from the gathered rows vary no more than those of that many single rows.
    """
    keys = [FEATURES, LABEL, WEIGHT, *keep]
    rows = df.count()
    if rows <= GATHER_ROWS:
        return df.withColumn(COUNT, F.lit(1.0))
    most = -(-rows // GATHER_ROWS)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    groups = groups.withColumn("_parts", F.expr(f"(_n + {most - 1}) div {most}"))
    parts = groups.withColumn("_part", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
    share = F.expr("_n div _parts + if(_part <= _n % _parts, 1, 0)").cast("double")
    parts = session.staged(parts.select(*keys, "_part", share.alias(COUNT)), "gathered")
    # bags are drawn by place, so places must not depend on how the groups arrived
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-parts.count() // session.TASK_ROWS))
    dealt = parts.repartition(tasks, *keys, "_part").sortWithinPartitions(F.xxhash64(*keys), "_part")
    return session.staged(dealt.withColumn(WEIGHT, F.col(WEIGHT) * F.col(COUNT)).drop("_part"), "gathered")


def _weighs(estimator) -> bool:
    """Whether a row of weight n means to the estimator what n equal rows mean."""
    named = lambda name: estimator.hasParam(name) and estimator.isDefined(name)
    return (named("weightCol") and estimator.getOrDefault("weightCol") == WEIGHT
            and not (named("minInstancesPerNode") and estimator.getOrDefault("minInstancesPerNode") > 1))


def fit(estimator, df: DataFrame) -> Model:
    """Fitted model without its training summary, which would tie it to the training data."""
    if COUNT not in df.columns and WEIGHT in df.columns and _weighs(estimator):
        df = gathered(df)
    return estimator.fit(df).copy()


def _margin(prediction: str = "rawPrediction") -> Column:
    return vector_to_array(prediction)[1]


@dataclass
class CalibratedModel:
    """Average of fold models, each with its own sigmoid on the raw score."""

    members: list[tuple[Model, float, float]]
    features: list[str]
    metadata: dict = field(default_factory=dict)

    @property
    def threshold(self) -> float:
        return float(self.metadata.get("optimal_threshold", 0.5))

    def score(self, df: DataFrame, name: str = "outage_probability") -> DataFrame:
        """Add the calibrated probability; absent features count as 0."""
        vector = "_vector"
        inputs = {f"_in_{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
                  for i, c in enumerate(self.features)}
        staged = VectorAssembler(inputCols=list(inputs), outputCol=vector).transform(df.withColumns(inputs))
        parts = []
        for i, (model, slope, offset) in enumerate(self.members):
            fresh = model.copy({
                model.featuresCol: vector, model.rawPredictionCol: f"_raw_{i}",
                model.probabilityCol: "", model.predictionCol: ""})
            staged = fresh.transform(staged)
            parts.append(F.lit(1.0) / (1 + F.exp(-(F.lit(slope) * _margin(f"_raw_{i}") + F.lit(offset)))))
        average = sum(parts[1:], parts[0]) / len(parts)
        helpers = [vector, *inputs, *[f"_raw_{i}" for i in range(len(parts))]]
        return staged.withColumn(name, average).drop(*helpers)

    def save(self, spark: SparkSession, path: str) -> None:
        for i, (model, _, _) in enumerate(self.members):
            model.write().overwrite().save(f"{path}/member-{i}")
        note = {
            "kinds": [type(m).__name__ for m, _, _ in self.members],
            "sigmoids": [[a, b] for _, a, b in self.members],
            "features": self.features, "metadata": self.metadata,
        }
        spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CalibratedModel":
        note = json.loads(spark.read.text(f"{path}/note").first()[0])
        kinds = {c.__name__: c for c in (GBTClassificationModel, RandomForestClassificationModel)}
        members = [
            (kinds[kind].load(f"{path}/member-{i}"), a, b)
            for i, (kind, (a, b)) in enumerate(zip(note["kinds"], note["sigmoids"]))
        ]
        return cls(members, note["features"], note["metadata"])


@dataclass
class BareModel:
    """A plain ML pipeline without metadata: threshold 0.5, columns as found."""

    model: PipelineModel
    features: list[str]
    threshold: float = 0.5

    def score(self, df: DataFrame, name: str = "outage_probability") -> DataFrame:
        aligned = df.withColumns({
            c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
            for c in self.features})
        scored = self.model.transform(aligned)
        made = [c for c in scored.columns if c not in df.columns]
        return scored.withColumn(name, vector_to_array("probability")[1]).drop(*made)


def load_model(spark: SparkSession, path: str, features: Sequence[str] = ()) -> CalibratedModel | BareModel | None:
    """The saved model with its note, a bare pipeline, or nothing."""
    if not session.path_exists(spark, path):
        return None
    if session.path_exists(spark, f"{path}/note"):
        return CalibratedModel.load(spark, path)
    return BareModel(PipelineModel.load(path), list(features))


def calibrate(df: DataFrame, features: Sequence[str], estimator, row_key: Column, folds: int = 3) -> CalibratedModel:
    """Fit on all folds but one, fit a sigmoid on the held-out raw score, average.

    Fold numbers are a column, so the data is filtered, not copied; the sigmoid sees
    rows by their number alone, which returns weighted scores to real probabilities.
    """
    marked = with_weights(split.folds(df, row_key, folds, FOLD))
    marked = (gathered(marked, (FOLD,)) if _weighs(estimator) else marked.withColumn(COUNT, F.lit(1.0))).persist()
    members = []
    try:
        for i in range(folds):
            model = fit(estimator, marked.where(F.col(FOLD) != i))
            held = model.transform(marked.where(F.col(FOLD) == i)).select(_margin().alias("margin"), LABEL, COUNT)
            vector = VectorAssembler(inputCols=["margin"], outputCol="v").transform(held)
            sigmoid = LogisticRegression(featuresCol="v", labelCol=LABEL, weightCol=COUNT, maxIter=100).fit(vector)
            members.append((model, float(sigmoid.coefficients[0]), float(sigmoid.intercept)))
    finally:
        marked.unpersist()
    return CalibratedModel(members, list(features))


class AveragePrecision(Evaluator):
    """Step-wise average precision of the positive-class probability."""

    def __init__(self, score: str = "probability", label: str = LABEL):
        super().__init__()
        self.score, self.label = score, label

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(vector_to_array(self.score)[1].alias("s"), F.col(self.label).cast("int").alias("y"))
        row = curves.areas(curves.curve_points(rows, "s", "y")).first()
        return float(row["average_precision"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def random_search(df: DataFrame, draws: int = 10, folds: int = 5, seed: int = 42,
                  space: dict[str, list] | None = None, parallelism: int = 4):
    """Cross-validated search over random parameter draws; returns (best model, scores)."""
    chooser = random.Random(seed)
    estimator = boosted(seed=seed)
    space = space or SEARCH_SPACE
    maps = [
        {estimator.getParam(name): chooser.choice(values) for name, values in space.items()}
        for _ in range(draws)
    ]
    validator = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=AveragePrecision(), numFolds=folds,
        foldCol=FOLD, parallelism=parallelism, seed=seed)
    fitted = validator.fit(df)
    scores = [
        ({p.name: v for p, v in params.items()}, float(mean)) for params, mean in zip(maps, fitted.avgMetrics)
    ]
    return fitted.bestModel, scores


def _moved_to(at: np.ndarray, k: int, rows: int) -> np.ndarray:
    """Where permutation ``k`` puts what stands at the positions ``at``."""
    factor = next(f for f in FACTORS[k % len(FACTORS):] + FACTORS if gcd(f, rows) == 1) % rows
    # in two steps, so that no product passes 64 bits
    high, low = divmod(factor, 1 << 20)
    return ((at * high % rows << 20) + at * low + (k + 1) * STEP % rows) % rows


def _permuted_values(numbered: DataFrame, features: Sequence[str], repeats: int, rows: int) -> DataFrame:
    """``numbered`` with an array column ``_moved_i`` per feature: the values that its
    permutations bring to the row, one per repeat.

    Positions are cut into blocks. Each batch of rows sends one message per block, which
    holds position, permutation and value of all that goes there.
    """
    width = len(features) * repeats
    entry = np.dtype([("at", "<u4"), ("k", "<u4"), ("value", "<f8")])
    null = 1 << 31

    def send(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            parts, targets = [], []
            for i in range(len(features)):
                column = batch.column(i + 1)
                value = column.fill_null(0.0).to_numpy(zero_copy_only=False)
                mark = np.where(column.is_null().to_numpy(zero_copy_only=False), null, 0)
                for k in range(i * repeats, (i + 1) * repeats):
                    to = _moved_to(at, k, rows)
                    part = np.empty(len(at), entry)
                    part["at"], part["k"], part["value"] = to % BLOCK, mark | k, value
                    parts.append(part)
                    targets.append((to // BLOCK).astype(np.int32))
            if len(at):
                entries, blocks = np.concatenate(parts), np.concatenate(targets)
                order = np.argsort(blocks, kind="stable")
                found, starts = np.unique(blocks[order], return_index=True)
                entries = entries[order]
                for lo in range(0, len(found), 64):
                    ends = [*starts[lo + 1:lo + 65], len(entries)]
                    packed = [entries[x:y].tobytes() for x, y in zip(starts[lo:lo + 64], ends)]
                    yield pa.RecordBatch.from_arrays([pa.array(found[lo:lo + 64], pa.int32()), pa.array(packed, pa.binary())], ["_block", "_entries"])

    def receive(own, messages):
        value, empty = np.zeros((BLOCK, width)), np.zeros((BLOCK, width), bool)
        for packed in messages.column("_entries"):
            entries = np.frombuffer(packed.as_buffer(), entry)
            spot, k = entries["at"], entries["k"] & (null - 1)
            value[spot, k], empty[spot, k] = entries["value"], entries["k"] >= null
        at = own.column("_at").to_numpy() % BLOCK
        ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * repeats)
        for i in range(len(features)):
            here = slice(i * repeats, (i + 1) * repeats)
            values = pa.array(value[at, here].ravel(), mask=empty[at, here].ravel())
            own = own.append_column(f"_moved_{i}", pa.ListArray.from_arrays(ends, values))
        return own.drop_columns(["_block"])

    session.ship_package(numbered.sparkSession)
    values = numbered.select("_at", *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    messages = values.mapInArrow(send, "_block int, _entries binary")
    own = numbered.withColumn("_block", F.floor(F.col("_at") / BLOCK).cast("int"))
    schema = StructType(list(numbered.schema))
    for i in range(len(features)):
        schema = schema.add(f"_moved_{i}", ArrayType(DoubleType()))
    return own.groupBy("_block").cogroup(messages.groupBy("_block")).applyInArrow(receive, schema)


def permutation_importance(
    df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], label: str,
    row_key: Sequence[str], repeats: int = 10, seed: int = 42, probability: str = "outage_probability",
) -> DataFrame:
    """Mean drop in average precision when one feature is permuted.

    Rows are numbered once in hash order; permutation ``k`` gives row ``(a * FACTORS[k mod 10]
    + (k + 1) * STEP) mod n`` the value of row ``a``. The values of all permutations travel
    to their rows in one shuffle of packed blocks, each row is then written out once per
    permutation and scored where it is, unless the value is the one it had, and the curves are
    folded per permutation: the number of jobs does not grow with features or repeats.
    """
    features = list(features)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in row_key])
    mixed = df.withColumn("_mix", F.md5(F.concat(key, F.lit(f"|{seed}"))))
    indexed = slices.global_index(mixed, ("_mix", *row_key), "_at", INDEX_ROWS).drop("_mix")
    numbered = session.staged(indexed, "numbered")
    rows = numbered.count()
    if not rows or not features:
        return df.sparkSession.createDataFrame([], "feature string, importance double")
    base = score(numbered).withColumn("_base", F.col(probability)).select(*numbered.columns, "_base")
    moved = session.staged(_permuted_values(session.staged(base, "base"), features, repeats, rows), "moved")
    types, label_of = dict(df.dtypes), F.col(label).cast("int").alias("_y")
    found = [moved.select(F.lit(-1).alias("_k"), F.col("_base").alias(probability), label_of)]
    for i, feature in enumerate(features):
        # one feature at a time: only its column is replaced and only its values are read
        copies = moved.select(*df.columns, "_base", F.posexplode(f"_moved_{i}").alias("_repeat", "_value"))
        copies = copies.withColumn("_value", F.col("_value").cast(types[feature])).withColumn("_k", F.col("_repeat") + i * repeats)
        # a row that was given its own value again has its score already
        same = F.col("_value").eqNullSafe(F.col(feature))
        found.append(copies.where(same).select("_k", F.col("_base").alias(probability), label_of))
        changed = copies.where(~same).withColumn(feature, F.col("_value")).drop("_repeat", "_value", "_base")
        found.append(score(changed).select("_k", probability, label_of))
    scored = reduce(DataFrame.unionAll, found)
    found = session.staged(curves.areas(curves.curve_points(scored, probability, "_y", ("_k",)), ("_k",)), "areas")
    base = found.where("_k = -1").select("average_precision").scalar()
    names = F.array(*[F.lit(f) for f in features])
    drops = found.where("_k >= 0").select(
        F.get(names, F.floor(F.col("_k") / repeats).cast("int")).alias("feature"), (base - F.col("average_precision")).alias("drop"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance")).orderBy(F.desc("importance"), "feature")


def loss_history(model: GBTClassificationModel, parts: dict[str, DataFrame]) -> DataFrame:
    """Loss after every boosting iteration on each part."""
    rows = [
        (name, i + 1, float(loss))
        for name, df in parts.items() for i, loss in enumerate(model.evaluateEachIteration(df))
    ]
    return next(iter(parts.values())).sparkSession.createDataFrame(rows, "part string, iteration int, loss double")


def scorecard(scored: DataFrame, model: str, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Metrics per model, best average precision first; the first row is the champion."""
    scored = session.cut_lineage(scored.select(model, score, label))
    points = curves.curve_points(scored, score, label, (model,))
    areas = curves.areas(points, (model,))
    metrics = curves.threshold_metrics(scored, score, label, threshold, (model,))
    joined = metrics.join(areas, model)
    return joined.select(
        model, *[F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")],
        F.round("average_precision", 4).alias("pr_auc"),
    ).orderBy(F.desc("pr_auc"), model)
