from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from towerlens.llm import common
from towerlens.llm import line_dedup as op


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs):
    """(doc_id, text left) by comparing every pair of lines."""
    seen = []
    for doc, text in docs:
        for n, raw in enumerate((text or "").split("\n")):
            line = re.sub(r"\s+", " ", raw.lower()).strip()
            if line:
                seen.append((doc, n, line))
    different = sorted({x[2] for x in seen})
    prints = op.line_prints(different) if different else np.zeros(0, np.uint64)
    group = {x: x for x in different}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= op.BITS
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = different[i], different[j]
        if distance(a, b) <= max(len(a), len(b)) // 5:
            group[find(a)] = find(b)
    first = {}
    for x in sorted(seen, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        first.setdefault(find(x[2]), x[:2])
    lost = {x[:2] for x in seen if first[find(x[2])] != x[:2]}
    return [(doc, None if text is None else "\n".join(r for n, r in enumerate(text.split("\n")) if (doc, n) not in lost)) for doc, text in docs]


def run(spark, docs):
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, dropped int, line int")
    out = op.dedup_lines(frame)
    assert out.columns == frame.columns
    return sorted([(r.doc_id, r.text) for r in out.collect()], key=str)


def variants(n, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    bases = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    docs = []
    for i in range(n):
        base = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2])):
            base[rng.randrange(len(base))] = rng.choice("abcxyz")
        docs.append((i, "".join(base) + "\n" + " ".join(rng.choice(words) for _ in range(8)) + "\n\n The Same  line"))
    return docs


def test_matches_brute_force(spark):
    docs = variants(150)
    got = run(spark, docs)
    assert got == sorted(brute(docs), key=str)
    assert sum(len(t) for _, t in got) < 0.7 * sum(len(t) for _, t in docs)


def test_large_buckets_take_leaders(spark, monkeypatch):
    monkeypatch.setattr(op, "SMALL", 2)
    docs = variants(120, seed=9)
    assert run(spark, docs) == sorted(brute(docs), key=str)


def test_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = [(d, t) for d, t in docs if len(t) < 3000]
    assert run(spark, docs) == sorted(brute(docs), key=str)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "\n \n"), (4, "same\nSame \n other"), (5, "other"), (6, "y" * 1500), (7, "y" * 1499 + "z"), (8, "w " * 40000), (None, "same")]
    assert run(spark, docs) == sorted(brute(docs), key=str)
    assert run(spark, [(1, "twice"), (1, "twice")]) == [(1, "twice"), (1, "twice")]
    assert run(spark, []) == []


def test_bit_sums():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 300, 0, 255, 256, 3, 0])
    hashes = rng.integers(0, 2**63, int(lengths.sum()), dtype=np.uint64)
    want, at = [], 0
    for n in lengths:
        want.append([int(sum(int(h) >> b & 1 for h in hashes[at:at + n])) for b in range(64)])
        at += n
    assert common.bit_sums(hashes, lengths).tolist() == want


def test_components(spark):
    rng = np.random.default_rng(2)
    nodes = rng.integers(-2**62, 2**62, 60).tolist()
    links = [(nodes[i], nodes[i + 1]) for i in range(20)] + [(nodes[30], nodes[i]) for i in range(31, 50)] + [(nodes[55], nodes[55])]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[n] for n in nodes[:21]}) == 1 and len({got[n] for n in nodes[30:50]}) == 1 and len(set(got.values())) == 2 and len(got) == 41


def test_query_hash(spark, tmp_path):
    docs = [(1, "a b\nc"), (2, "c\nd")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op.query(spark, str(tmp_path)).collect())
    assert got == [(1, 2, 5, hashlib.sha256(b"a b\nc").hexdigest()), (2, 1, 1, hashlib.sha256(b"d").hexdigest())]


def test_alignment_at_hand_is_an_upper_bound():
    rng = random.Random(8)
    sure = 0
    for _ in range(300):
        a = "".join(rng.choice("abc de") for _ in range(rng.randrange(120)))
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(3)] = rng.choice(["", "x", "yz"])
        b = "".join(b)
        allowed = max(len(a), len(b)) // 5
        if op.surely_similar(a, b, allowed):
            sure += 1
            assert distance(a, b) <= allowed
    assert sure > 50 and op.surely_similar("", "", 0) and not op.surely_similar("a", "b", 0)


def test_a_text_of_many_repeated_lines_takes_linear_time(spark):
    import time

    text = "\n".join(["the very same line of some words"] * 100_000 + ["", "another line altogether", "  "])
    frame = spark.createDataFrame([(1, text), (2, "the very same line of some words\nown words of this text")], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r.text for r in op.dedup_lines(frame).collect()}
    assert got == {1: "the very same line of some words\n\nanother line altogether\n  ", 2: "own words of this text"}
    assert time.time() - start < 60


def test_distance_by_columns_of_bits(monkeypatch):
    rng, found = random.Random(3), {True: 0, False: 0}
    for columns in (3, 256):
        monkeypatch.setattr(op, "COLUMNS", columns)
        for _ in range(500):
            letters = rng.choice(["ab", "abcdefgh", "aé漢😀 "])
            a = [rng.choice(letters) for _ in range(rng.randrange(40))]
            b = list(a)
            for _ in range(rng.randrange(14)):
                at = rng.randrange(len(b) + 1)
                b[at:at + rng.randrange(4)] = rng.choice(["", "x", "ab", "zzz"])
            if rng.random() < 0.2:
                b = [rng.choice(letters) for _ in range(rng.randrange(40))]
            a, b = "".join(a), "".join(b)
            exact = distance(a, b)
            for allowed in {max(0, exact - 1), exact, exact + 1, max(len(a), len(b)) // 5}:
                found[op.within(a, b, allowed)] += 1
                assert op.within(a, b, allowed) == (exact <= allowed), (a, b, allowed)
    assert min(found.values()) > 500


def test_long_texts_that_differ_are_left_early():
    """The whole table has 10,000,000,000 cells, of which 36 % are within the allowed edits."""
    import time

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    a, b = (" ".join(rng.choice(words) for _ in range(15_000))[:100_000] for _ in range(2))
    start = time.process_time()
    assert not op.within(a, b, 20_000)
    spent = time.process_time() - start
    edited = a[:50_000] + "".join(rng.sample(a[50_000:52_000], 2_000)) + a[52_000:]
    assert op.within(a[:20_000], a[100:20_000], 4_000) and op.within(edited[49_000:53_000], a[49_000:53_000], 2_000)
    assert spent < 5


def test_small_staged_tables_take_few_files(spark):
    """Rounds over a handful of links must not cost a task and a file per shuffle partition."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(0, i) for i in range(1, 2_001)], "a long, b long")
        found = common.components(links, 2_000)
        assert found.select("component").distinct().count() == 1 and found.count() == 2_001
        assert len(found.inputFiles()) == 1
        assert len(common.stage(links.distinct(), "some", common.STAGED_ROWS * 3).inputFiles()) == 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
