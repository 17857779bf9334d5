"""Language identification: multinomial naive Bayes over hashed character n-grams.

Spark sums the n-gram counts of every training document; the smoothed log-probability
matrix (languages x slots, a fixed number of slots) is broadcast, and tasks score batches of
whole texts by sparse products in numpy: only the slots a text has are looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import common

SLOTS, SIZES, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
FOLDS = 5

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def slots_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of all texts, one after the other, and their number per text."""
    points = [np.frombuffer(f"  {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.fromiter(map(len, points), np.int64, len(points))
    flat = np.concatenate(points).astype(np.uint64) if points else np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    grams = []
    for n in SIZES:
        mixed = np.full(len(flat), n * 0x27D4EB2F, np.uint64)
        for i in range(n):
            shifted = flat if i == 0 else np.concatenate([flat[i:], np.full(i, 32, np.uint64)])
            mixed = (mixed ^ shifted) * _FACTORS[i % 3] % np.uint64(0xFFFFFFFB)
        mixed ^= mixed >> np.uint64(15)
        grams.append((mixed & np.uint64(SLOTS - 1)).astype(np.int32))
    # an n-gram that would run into the next text starts in the last places of this one
    for i, n in enumerate(SIZES):
        for back in range(1, n):
            grams[i][ends - back] = 0
    return np.stack(grams, 1).reshape(-1), lengths * len(SIZES)


def held_out():
    """True where crc32(doc_id as text) mod 5 is 0, and for rows without id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, slot, n) over all given documents; slot -1 counts documents."""
    session.ship_package(docs.sparkSession)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in common.chunks(batches):
            found, lengths = slots_of(common.column(batch, "text").to_pylist())
            begins = np.cumsum(lengths) - lengths
            for lang, begin, n in zip(common.column(batch, "lang").to_pylist(), begins, lengths):
                if lang not in sums:
                    sums[lang] = np.zeros(SLOTS + 1, np.int64)
                own = sums[lang]
                own[:SLOTS] += np.bincount(found[begin:begin + n], minlength=SLOTS) if n > SLOTS else 0
                if n <= SLOTS:
                    np.add.at(own, found[begin:begin + n], 1)
                own[SLOTS] += 1
        for lang, own in sums.items():
            at = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == SLOTS, -1, at).astype(np.int32)), pa.array(own[at])], ["lang", "slot", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior; ``und`` and 0 for null, letterless texts or an empty model."""
        usable = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not usable or not self.langs:
            return names, scores
        found, lengths = slots_of([texts[i] for i in usable])
        begins = np.cumsum(lengths) - lengths
        total = np.stack([np.add.reduceat(w[found], begins, dtype=np.float64) for w in self.weights], 1) + self.prior
        chance = np.exp(total - total.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        for i, b, row in zip(usable, best.tolist(), chance):
            names[i], scores[i] = self.langs[b], row[b]
        return names, scores


def train(docs: DataFrame) -> Model:
    """Counts of all rows with text and lang; the driver receives languages x slots numbers."""
    usable = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    rows = counts(usable).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.zeros((len(langs), SLOTS + 1))
    at = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int) if len(rows) else np.zeros(0, int)
    table[at, rows["slot"].to_numpy(int)] = rows["n"].to_numpy(float)
    grams, documents = table[:, :SLOTS] + SMOOTHING, table[:, SLOTS]
    prior = np.log(documents / documents.sum()) if len(langs) else np.zeros(0)
    return Model(langs, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), prior)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) per row; only the text is looked at.

    Null or letterless text gives ``und`` with score 0. Repeated rows agree; ties go to the
    first language in order of name; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in common.chunks(batches):
            names, scores = sent.value.predict(common.column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
