from __future__ import annotations

import numpy as np
import xxhash

from towerlens.llm import simhash_neardup as op


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows, link=3):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= link:
                parent[find(i)] = find(j)
    lows = {}
    for i, (doc, _) in enumerate(rows):
        lows[find(i)] = min([x for x in (doc, lows.get(find(i))) if x is not None], default=None)
    return sorted(((d, f"{prints[i]:016x}", lows[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 fp", "2 component_id").write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in op.query(spark, str(tmp_path)).collect()), key=str)


def test_matches_brute_force(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_edge_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "One two"), (6, "é ß " * 20000), (None, "alone text here"), (7, "x y z")]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_tree_loses_no_pair():
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, dtype=np.uint64) for _ in range(3000)]
    points = np.unique(np.concatenate([rng.integers(0, 2**63, 3000, dtype=np.uint64), *[centres ^ np.array([flips[(i * 300 + j) % 3000] for j in range(300)]) for i in range(8)]]))
    tree = op.vantage_tree(points[::7], 4)
    rows, shards = op.route(points, *tree, 3)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    found = {i: i for i in range(len(points))}

    def find(x):
        while found[x] != x:
            x = found[x]
        return x
    at = {int(p): i for i, p in enumerate(points)}
    for shard in np.unique(shards):
        for a, b in zip(*op.shard_links(points[rows[shards == shard]], 3)):
            assert int(a ^ b).bit_count() <= 6
            found[find(at[int(a)])] = find(at[int(b)])
    for i, j in zip(*np.nonzero(near)):
        assert find(i) == find(j)
