from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from towerlens.llm import sharding as op


def check(docs, got, shards):
    want = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs]
    assert sorted(want, key=str) == sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    assert all(0 <= s < shards for s in slots)


def test_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = op.query(spark, "/root/testdata/sf0.01").collect()
    check(docs, got, 24)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 24
    text, at = dict(docs), {}
    for r in got:
        assert at.setdefault(text[r.doc_id], r.shard) == r.shard


def test_hot_group_is_cut(spark, monkeypatch):
    monkeypatch.setattr(op, "BUCKET_ROWS", 40)
    docs = [(i, "hot text") for i in range(400)] + [(1000 + i, f"text {i} " * (i % 7)) for i in range(300)] + [(7, None), (7, ""), (None, None), (7, None)]
    got = op.shard(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int"), 5).collect()
    check(docs, got, 5)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 60


def test_fixed_capacity(spark):
    docs = [(i, "x" * (i % 50)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = op.shard(frame, None, 1000).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1000 and len(sizes) <= -(-sum(sizes.values()) // 1000) + 1
    assert op.shard(frame.limit(0)).collect() == []


def test_best_fit_takes_the_tightest():
    dealt = op.best_fit([("a", 3, 180), ("b", 2, 80), ("c", 4, 40)], 100)
    rooms = Counter()
    for name, shard, low, high in dealt:
        rooms[shard] += (high - low) * {"a": 60, "b": 40, "c": 10}[name]
    assert sorted(rooms.values()) == [100, 100, 100]
    assert op.best_fit([], 10, 3) == []
