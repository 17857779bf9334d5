from __future__ import annotations

import os
import random
from itertools import combinations

import corpus_pipeline
from conftest import DATA
from pyspark.sql import functions as F
from towerlens.llm import common
from towerlens.llm import shingle_neardup as op


def grams(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Places of the rows that stay, by comparing every pair of shingle sets."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return list(groups.values())


def same(got, rows):
    """One row of every group stays, and it has the smallest id."""
    groups = brute(rows)
    left = list(got)
    assert len(left) == len(groups)
    for group in groups:
        low = min((d for d, _ in group if d is not None), default=None)
        found = next(r for r in left if r[0] == low and r in group)
        left.remove(found)
    assert not left


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, name int, at int")
    out = op.keep_one(frame)
    assert out.columns == frame.columns
    return [(r.doc_id, r.text) for r in out.collect()]


def variants(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    passage = [rng.choice(words) for _ in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.choice([12, 60, 200]))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own + (passage if rng.random() < 0.4 else []))))
    return rows


def test_matches_brute_force(spark):
    rows = variants(240)
    groups = brute(rows)
    assert 20 < len(groups) < 200
    same(run(spark, rows), rows)


def test_order_does_not_change_the_result(spark, monkeypatch):
    rows = variants(120, seed=4)
    monkeypatch.setattr(op, "COMMON", 10**9)
    same(run(spark, rows), rows)
    monkeypatch.setattr(op, "COMMON", 1)
    same(run(spark, rows), rows)


def test_many_unlinked_texts_on_one_shingle_make_few_pairs(spark, monkeypatch):
    """Two thousand texts share a passage of five words, eight hundred another one of forty."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    short, long = "this very passage is common", " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(14)) + " " + short) for i in range(2_000)]
    rows += [(i, " ".join(word() for _ in range(60)) + " " + long) for i in range(2_000, 2_800)]
    counted, stage = {}, common.stage

    def counting(df, label):
        found = stage(df, label)
        if label in ("pairs", "rest"):
            counted[label] = found.count()
        return found

    monkeypatch.setattr(op.common, "stage", counting)
    assert len(run(spark, rows)) == len(rows)
    assert sum(counted.values()) < len(rows)


def test_simhash_and_vantage_points_find_near_copies_first(spark, monkeypatch):
    """Long texts with one word changed link by their SimHashes; the exact check need not pair them."""
    rng = random.Random(12)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(4_000)] for _ in range(20)]
    rows = []
    for i in range(200):
        own = list(bases[i % 20])
        own[rng.randrange(4_000)] = f"v{i}"
        rows.append((i, " ".join(own)))
    counted, stage = {}, common.stage

    def counting(df, label):
        found = stage(df, label)
        if label in ("printed", "pairs", "rest"):
            counted[label] = found.count()
        return found

    monkeypatch.setattr(op.common, "stage", counting)
    same(run(spark, rows), rows)
    assert counted["printed"] >= 150 and counted.get("pairs", 0) + counted.get("rest", 0) < 20


def test_pairs_that_cannot_link_are_not_joined(spark, monkeypatch):
    """A common shingle that stands too late in the sets to leave enough overlap makes no pairs."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**9)}"
    phrase = next(p for p in (f"one phrase of all {k}" for k in range(10_000)) if 0.14 < int(op.shingles(p)[0]) / 2**64 + 0.5 < 0.17)
    rows = [(i, " ".join(word() for _ in range(300)) + " " + phrase) for i in range(200)]
    assert sum(op.shingles(phrase)[0] in op.prefix(op.shingles(t), *[op.shingles("")] * 2) for _, t in rows) > 150
    seen, verified = [], op._verified

    def counting(pairs, *more):
        seen.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(op, "LAST", 0)  # common shingles stay where their hash puts them
    monkeypatch.setattr(op, "_verified", counting)
    assert len(run(spark, rows)) == len(rows)
    assert sum(seen) < 40


def test_staged_tables_are_deleted(spark):
    root = common.session.shared_root(spark) + "/towerlens"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    frame = spark.createDataFrame(variants(60), "doc_id long, text string")
    op.keep_one(frame).collect()
    left = {x.split("-")[0] for x in set(os.listdir(root)) - before}
    assert left == {"rows", "lost"}  # the input, which was no file, and what the result reads


def test_rows_of_files_are_named_by_their_metadata(spark, tmp_path):
    rows = variants(90, seed=6)
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    text = common.keyed(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert path in str(docs.inputFiles()) and "_metadata" in text
    same([(r.doc_id, r.text) for r in op.keep_one(docs.filter("doc_id >= 0")).collect()], rows)
    both = docs.unionByName(docs)  # two readings of one row are two rows
    same([(r.doc_id, r.text) for r in op.keep_one(both).collect()], rows + rows)


def test_any_column_names(spark):
    names = ["__file", "__row", "doc_id", "_metadata", "text", "order", "at"]
    frame = spark.createDataFrame([(1, 2, 7, 3, "a b c d e f", 4, 5), (1, 2, 6, 3, "a b c d e f", 4, 5)], names)
    out = op.keep_one(frame)
    assert out.columns == names and [tuple(r) for r in out.collect()] == [(1, 2, 6, 3, "a b c d e f", 4, 5)]


def test_quality_keeps_columns_of_any_name(spark):
    docs = common.table(spark, DATA, "documents")
    plain = {r.doc_id for r in corpus_pipeline.quality(spark, docs, DATA).select("doc_id").collect()}
    named = docs.selectExpr("*", "-7 AS score", "-1 AS n_words", "'no' AS kept", "doc_id AS base_failed", "1 AS label")
    out = corpus_pipeline.quality(spark, named, DATA)
    rows = out.collect()
    assert out.columns == named.columns and {r.doc_id for r in rows} == plain
    assert all((r.score, r.n_words, r.kept, r.base_failed) == (-7, -1, "no", r.doc_id) for r in rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (7, "é ß " * 20000), (8, "a b c d e f"), (9, "a b c d e g"), (None, "alone here"), (10, "Alone  here")]
    same(run(spark, rows), rows)
    assert run(spark, []) == []


def test_one_row_of_every_group_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite other words than these here"), (2, "quite other words than these here"), (None, "no id"), (None, "no id"), (None, "No  id")]
    got = run(spark, rows)
    same(got, rows)
    assert len(got) == 3 and run(spark, [(None, None), (None, "")])[0][0] is None and len(run(spark, [(7, None), (7, None), (7, " ")])) == 1


def test_stages_of_the_pipeline(spark):
    docs = common.table(spark, DATA, "documents")
    before = common.stage(corpus_pipeline.lines(spark, common.stage(corpus_pipeline.quality(spark, docs, DATA), "q"), DATA), "l")
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_copies(spark, before, DATA)
    same([(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()], rows)
    packed = corpus_pipeline.run(spark, DATA)
    want = corpus_pipeline.pack(spark, corpus_pipeline.benchmark(spark, common.stage(kept, "k"), DATA), DATA)
    order = [F.col(c).cast("string") for c in packed.columns]
    assert packed.select(*order).exceptAll(want.select(*order)).isEmpty() and want.select(*order).exceptAll(packed.select(*order)).isEmpty() and packed.take(1)
