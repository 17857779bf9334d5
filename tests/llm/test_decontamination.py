from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Row

from towerlens.llm import decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        own = fold(text)
        for i in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[i:i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, items = fold(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                found = windows.get(tuple(own[i:i + size]))
                if found is not None:
                    hit.update(range(i, i + size))
                    items |= {str(x) for x in found if x is not None}
        out.append((doc, len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, bench, tmp_path):
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 n_words", "2 items").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return sorted((tuple(r) for r in op.query(spark, str(tmp_path)).collect()), key=str)


def test_matches_brute_force(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    got = run(spark, docs, bench, tmp_path)
    assert got == brute(docs, bench) and sum(r[5] for r in got) > 5


EDGE = [(1, None), (2, ""), (3, "..."), (4, "SHORT item"), (4, "SHORT item"), (None, "a short, item b"), (5, "x " * 50000 + "short Item"), (6, "b b b b b b b b b b b b b b"), (7, "Éa éa"), (8, "éa")]
BENCH = [(1, "short item"), (2, "b " * 11), (3, None), (4, ""), (None, "éa"), (10, "short item"), (10, "short item"), (6, "never seen " * 9)]


def test_edge_cases_and_blocks(spark, tmp_path, monkeypatch):
    assert run(spark, EDGE, BENCH, tmp_path / "one") == brute(EDGE, BENCH)
    monkeypatch.setattr(op, "BLOCK_BYTES", 20)
    assert run(spark, EDGE, BENCH, tmp_path / "many") == brute(EDGE, BENCH)
    assert run(spark, [], BENCH, tmp_path / "no_docs") == []
    assert [r[2] for r in run(spark, EDGE, [], tmp_path / "no_bench")] == [0] * len(EDGE)


def test_cut(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="Keep this. SHORT, item! and é that", items="x"), Row(doc_id=2, text=None, items="y"), Row(doc_id=3, text="clean", items=None)])
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r.doc_id: (r.text, r["items"]) for r in op.decontaminate(docs, bench).collect()}
    assert got == {1: ("Keep this. ! and é that", "x"), 2: (None, "y"), 3: ("clean", None)}


def test_suffix_array_and_index():
    rng = np.random.default_rng(3)
    for symbols, n in ((3, 400), (50, 3000), (2, 60)):
        x = np.append(rng.integers(0, symbols, n), 0)
        y = x + 10_000 * (x > 0) + np.arange(len(x)) * (x == 0)
        assert op.suffix_array(y).tolist() == sorted(range(len(y)), key=lambda i: y[i:].tolist())
        index = op.FmIndex(x, symbols)
        for size in (1, 2, 4):
            at = int(rng.integers(0, n - size))
            p = x[at:at + size]
            if (p == 0).any():
                continue
            low, high = index.search(p[::-1][None, :], np.array([size]))
            want = [i for i in range(n + 2 - size) if (x[i:i + size] == p).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want
