from __future__ import annotations

import zlib

import numpy as np

from towerlens.llm import language_id as op


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op.query(spark, sf).collect()
    assert len(got) == len(truth)
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(right) > 150 and sum(right) / len(right) > 0.95
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def test_edge_cases(spark, tmp_path):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat", "en"), ("der hund", "de"), (None, "fr"), ("x", None), ("", "en")] * 10)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 !? _ ½²", "de"), (103, "cat " * 100_000, "en"), (103, "cat", None), (None, "the cat", "en"), (104, "日本", "de")]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.lang_pred, r.held_out) for r in op.query(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and {(100, "und"), (101, "und"), (102, "und"), (103, "en")} <= {x[:2] for x in got}
    assert (None, "en", True) in got and {x[1] for x in got} == {"en", "de", "und"}
    none = op.train(frame.limit(0))
    assert [r.lang_pred for r in op.predict(frame.limit(3), none).collect()] == ["und"] * 3


def test_counts_match_a_plain_loop(spark):
    docs = [("a", "abc"), ("a", "abcab"), ("b", "é"), ("b", "zz" * 40_000)]
    got = {(r.lang, r.slot): r.n for r in op.counts(spark.createDataFrame(docs, "lang string, text string")).collect()}
    want = {}
    for lang, text in docs:
        found, lengths = op.slots_of([text])
        assert lengths.sum() == len(found) == 3 * (len(text) + 3)
        for slot in found.tolist():
            want[lang, slot] = want.get((lang, slot), 0) + 1
        want[lang, -1] = want.get((lang, -1), 0) + 1
    assert got == want
    both, lengths = op.slots_of(["abc", "xyz q"])
    assert np.array_equal(both[:lengths[0]], op.slots_of(["abc"])[0]) and np.array_equal(both[lengths[0]:], op.slots_of(["xyz q"])[0])
