from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import manifest as op

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, pos long"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text) -> str:
    values = [*row[:4], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    """(siblings, place in run) of each level below the root."""
    found = []
    for nodes in levels[:-1]:
        run = range(i - i % 3, min(i - i % 3 + 3, len(nodes)))
        found.append(([nodes[s] for s in run if s != i], i % 3))
        i //= 3
    return found


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row, leaf(row, row[4])))
    trees = {}
    for source, members in groups.items():
        members.sort(key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
        trees[source] = (members, up([m[1] for m in members]))
    order = sorted(trees, key=lambda s: b"" if s is None else b"1" + s.encode())
    top = up([trees[s][1][-1][0] for s in order])
    found = []
    for q, source in enumerate(order):
        members, levels = trees[source]
        for i, (row, own) in enumerate(members):
            steps = way(levels, i) + way(top, q)
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            current = leaf(row, text)
            for siblings, at in steps:
                current = h("".join([*siblings[:at], current, *siblings[at:]]))
            proof = h("".join("".join(s) for s, _ in steps))
            found.append((row[0], own, levels[-1][0], top[-1][0], proof, current, current == top[-1][0]))
    return sorted(found, key=str)


def run(spark, tmp_path, rows):
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*r, "t", "d", 7) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    got = op.query(spark, path).collect()
    return sorted([tuple(r) for r in got], key=str)


def test_documents_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "b", "b", "é", "Z", ""]), rng.choice(["en", None]), rng.choice([i, None]), f"line {i}\nnext\n") for i in range(60)]
    rows += [(100, None, "en", 1, "x"), (101, None, None, None, None), (None, "a", "en", 2, "no\nid"), (None, None, None, None, None)]
    rows += [(7, "a", "en", 3, "tie one\n"), (7, "a", "en", 3, "tie two"), (8, "b", "en", 1, "again\n"), (8, "b", "en", 1, "again\n")]
    rows += [(200, "alone", "en", 0, ""), (201, "long", "en", 1, "wörd\n" * 60_000), (-5, "long", "en", 1, "\n")]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows)
    assert 0 < sum(not r[6] for r in got) < len(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "a\nb")], [(1, None, "en", 1, "a"), (2, "s", "en", 1, "b")]])
def test_tiny_tables(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == brute(rows)


def test_missing_coordinates_are_enough_and_none_is_spare():
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 9, 10, 28, 100):
        leaves = [h(str(i)) for i in range(n)]
        levels = up(leaves)
        for size in {1, min(2, n), n // 2 or 1, n}:
            at = rng.sample(range(n), size)
            asked = op.missing(at, n)
            known = {(0, i) for i in at} | set(asked)
            assert len(known) == len(set(at)) + len(asked)
            below = {(k, i // 3**k) for i in at for k in range(len(levels))}
            for k, i in asked:
                assert (k, i) not in below and (k + 1, i // 3) in below  # a sibling, not derivable
            for k, i in below:
                assert all(c in known or c in below for c in ((k - 1, s) for s in range(3 * i, min(3 * i + 3, len(levels[k - 1])))) if k)


def test_multiproofs_of_a_subset_across_leaf_partitions(spark):
    session.ship_package(spark)
    sizes = {"1big": 7_000, "1mid": 2_188, "1one": 1, "0": 5}
    rows = [(t, i, h(f"{t}{i}")) for t, n in sizes.items() for i in range(n)]
    leaves = spark.createDataFrame(rows, "tree string, id long, digest string")
    found = op.build(leaves, ["id"])
    levels = {t: up([h(f"{t}{i}") for i in range(n)]) for t, n in sizes.items()}
    top = up([levels[t][-1][0] for t in sorted(sizes)])
    assert found.root == top[-1][0]
    wanted = found.leaves.filter("id % 701 = 3 or id = 0 or id = 6999").withColumn("claim", F.when(F.col("id") == 3, "forged").otherwise(F.col("digest")))
    got = op.prove(found, wanted).collect()
    assert len(got) == wanted.count() > 14
    for r in got:
        q = sorted(sizes).index(r.tree)
        steps = way(levels[r.tree], r.id) + way(top, q)
        assert r.proof == [s for run, _ in steps for s in run] and r.pos == r.id
        assert r.derived_root == found.root and r.subroot == levels[r.tree][-1][0]
        assert (r.folded_root == found.root) == (r.id != 3)
        assert op.fold(r.digest, r.pos, r.n, r.q, r.m, r.proof) == found.root
