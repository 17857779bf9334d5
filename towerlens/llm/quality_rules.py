"""Quality rules: gradient-boosted trees over document statistics.

Trees are fitted on a bounded, documented sample of labelled documents and flattened into
numpy node arrays (feature, threshold, leaf value in heap order), which score whole batches
at once. Symbol, repeated-line and repeated-word shares are constrained: more of them never
raises the score.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import common

#: Labelled rows the trees are fitted on at most, chosen by a hash of doc_id.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 3, 32, 0.2, 1.0
#: A document is rejected if its estimated chance of good quality is below this.
THRESHOLD = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "line_words")
#: -1: the score may not rise with the feature.
MONOTONE = np.array([0, 0, -1, -1, -1, 0, 0, 0, 0, 0])

_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_UPPER, _DIGITS, _MARKS = (s.encode() for s in (string.ascii_uppercase, string.digits, ".,;:!?'\"()-"))


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The contract's counts and the features of one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        last = 0  # words before this one are counted
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    size = max(1, len(raw))
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / size
    return [n, word_chars, symbols, dup_lines, repeated], [
        float(np.log1p(n)), word_chars / max(1, n), symbols / max(1, word_chars), dup_lines / max(1, len(lines)), repeated / max(1, n),
        share(_UPPER), share(_DIGITS), share(_MARKS), len(set(words)) / max(1, n), n / max(1, len(lines))]


class Trees:
    """Boosted trees of one depth as arrays: ``feature`` and ``threshold`` (trees, 2^depth - 1), ``value`` (trees, 2^depth)."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.threshold, self.value, self.start = feature, threshold, value, start

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        depth = int(np.log2(self.value.shape[1]))
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray = MONOTONE) -> Trees | None:
    """Boosted trees on logistic loss over binned features; None where one class is missing."""
    if len(y) == 0 or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    inner, leaves, width = 2**DEPTH - 1, 2**DEPTH, BINS + 1
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        feature, threshold, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(leaves)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            own = np.nonzero(node == at)[0]
            best = (1e-6, 0, np.inf, 0.0, 0.0)
            total_g, total_w = gradient[own].sum(), weight[own].sum()
            for f in range(x.shape[1]):
                if not len(own) or not len(edges[f]):
                    continue
                g = np.cumsum(np.bincount(binned[own, f], gradient[own], width))[:len(edges[f])]
                w = np.cumsum(np.bincount(binned[own, f], weight[own], width))[:len(edges[f])]
                left = np.clip(g / (w + RIDGE), low[at], high[at])
                right = np.clip((total_g - g) / (total_w - w + RIDGE), low[at], high[at])
                gain = g * left - (w + RIDGE) * left**2 / 2 + (total_g - g) * right - (total_w - w + RIDGE) * right**2 / 2
                whole = np.clip(total_g / (total_w + RIDGE), low[at], high[at])
                gain = gain - (total_g * whole - (total_w + RIDGE) * whole**2 / 2)
                gain[(w < 1) | (total_w - w < 1) | (monotone[f] * (right - left) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, edges[f][k], left[k], right[k])
            _, feature[at], threshold[at], left, right = best
            for child in (2 * at + 1, 2 * at + 2):
                low[child], high[child] = low[at], high[at]
            if np.isfinite(threshold[at]) and monotone[feature[at]]:
                middle, rising = (left + right) / 2, monotone[feature[at]] > 0
                (high if rising else low)[2 * at + 1] = middle
                (low if rising else high)[2 * at + 2] = middle
            node[own] = 2 * at + 1 + (x[own, feature[at]] > threshold[at])
        for leaf in range(leaves):
            own = node == inner + leaf
            fitted = gradient[own].sum() / (weight[own].sum() + RIDGE)
            value[leaf] = RATE * np.clip(fitted, low[inner + leaf], high[inner + leaf])
        margin += value[node - inner]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


_FIT_SCHEMA = "doc_id long, x array<double>"


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees | None:
    """Fit on at most ``rows`` labelled documents; rows without id or label are left out.

    A doc_id with several labels or texts counts once, with the largest of each.
    """
    session.ship_package(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches):
        for batch in common.chunks(batches):
            found = [statistics(t)[1] for t in common.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = own.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(run, _FIT_SCHEMA)
    sample = measured.groupBy("doc_id").agg(F.max("x").alias("x")).join(chosen, "doc_id").orderBy("doc_id").toPandas()
    if not len(sample):
        return None
    return fit(np.array(sample["x"].tolist(), float), sample["quality"].to_numpy(float))


RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with counts, score and verdict; columns of these names in the input are replaced.

    Null text counts as empty and fails the base rule. Without trees (no labels, or one
    class only) the base rule alone decides. Every row is judged on its own, so repeats and
    ties agree and an empty table stays empty.
    """
    session.ship_package(docs.sparkSession)
    added = [x.split()[0] for x in RESULT.split(", ")]
    own = docs.drop(*added).withColumn("text", F.col("text").cast("string"))
    names = own.columns

    def run(batches):
        for batch in common.chunks(batches):
            found = [statistics(t) for t in common.column(batch, "text").to_pylist()]
            counts, x = np.array([c for c, _ in found], np.int64), np.array([f for _, f in found], float)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            score = trees.score(x) if trees else np.ones(len(x))
            arrays = [*batch.columns, *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{fields}, {RESULT}")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, common.table(spark, sf_dir, "labels"))).drop("text")
