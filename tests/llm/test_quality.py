from __future__ import annotations

import re
from collections import Counter

import numpy as np

from towerlens.llm import quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


TEXTS = [None, "", " \n", "a a a a a", "a b c x a b c a b c", "x y  z", "é#|<> \x0b\x0c\r b", "l\nl\n l\n\nl", "one two " * 40, "w%d " % 3 * 70000]


def test_counts():
    for text in TEXTS:
        assert op.statistics(text)[0] == brute(text), repr(text)[:50]


def test_query_counts_and_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op.query(spark, sf).collect()
    assert len(rows) == len(docs)
    good = bad = 0
    for r in rows:
        counts = brute(docs[r.doc_id])
        assert [r[c] for c in op.COUNTS] == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in quality and not r.base_failed:
            good += r.kept == bool(quality[r.doc_id])
            bad += r.kept != bool(quality[r.doc_id])
    assert good > 20 * bad


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 10))
    chance = 1 / (1 + np.exp(-(3 - 8 * x[:, 2] + 4 * np.sin(6 * x[:, 0]))))
    y = (rng.random(4000) < chance).astype(float)
    trees = op.fit(x[:3000], y[:3000])
    score = trees.score(x[3000:])
    order = np.argsort(score)
    rank = np.empty(1000)
    rank[order] = np.arange(1000)
    positive = y[3000:] == 1
    auc = (rank[positive].sum() - positive.sum() * (positive.sum() - 1) / 2) / (positive.sum() * (~positive).sum())
    assert auc > 0.8
    for f in (2, 3, 4):
        grid = np.repeat(x[:50], 40, 0)
        grid[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(trees.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, 5, "c") for i, t in enumerate(TEXTS)] + [(None, "good text", 1, None)], "doc_id long, text string, score int, kept string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert op.train(docs, none) is None
    one = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "doc_id long, quality int")
    assert op.train(docs, one) is None
    got = op.judge(docs, None).collect()
    assert len(got) == len(TEXTS) + 1 and all(r.kept == (not r.base_failed) for r in got)
    two = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (9, 0)], "doc_id long, quality int")
    assert op.judge(docs, op.train(docs, two)).count() == len(got)
    assert op.judge(docs.limit(0), None).collect() == []
