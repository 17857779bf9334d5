from __future__ import annotations

import hashlib

from towerlens.llm import fixity as op


def run(spark, mine, theirs):
    schema = "record_id long, record string, status string"
    frames = [spark.createDataFrame([(*r, "s") for r in rows], schema) for rows in (mine, theirs)]
    return {r.record_id: r for r in op.audit(*frames).collect()}


def test_audit(spark):
    mine = [(i * 37 % 1000, f"r{i}") for i in range(200)] + [(-5, "neg"), (None, "no id"), (70_000, None), (3_000, "twice"), (3_000, "twice"), (3_001, "é" * 20_000)]
    theirs = [r for r in mine if r[0] not in (37, 3_001)] + [(3_001, "é" * 19_999 + "e"), (90_000, "new")]
    theirs.remove((3_000, "twice"))
    got = run(spark, mine, theirs)
    want = {i: "ok" for i, _ in mine} | {37: "missing", 3_001: "changed", 90_000: "extra", 3_000: "changed"}
    assert {i: r.status for i, r in got.items()} == want
    assert got[0].sha256 == hashlib.sha256(b"r0").hexdigest() and got[70_000].length == 0
    at = 0
    for i in sorted(i for i in want if i is not None and 0 <= i < 4096):
        assert got[i].byte_offset == at
        at += got[i].length


def test_empty_and_equal(spark):
    rows = [(1, "a"), (2, "b")]
    assert {r.status for r in run(spark, rows, rows).values()} == {"ok"}
    assert {r.status for r in run(spark, rows, []).values()} == {"missing"}
    assert {r.status for r in run(spark, [], rows).values()} == {"extra"}
    assert run(spark, [], []) == {}
