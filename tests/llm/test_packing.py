from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from towerlens.llm import packing as op


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op.tokenizer())


TRICKY = ["", " ", "a", "  two  spaces ", "tab\t x \n y", "\n\n  \n z", "don't  'S  re's", "é à 　 x \xa0 y \x1c z", "x<|endoftext|>y  z", "日本 語", "a" * 5000, "12 345  6!!  ??", "\r\n a \r\n", "‹ › ​ x"]


def test_word_ids_equal_whole_texts(reference_tokenizer):
    ids = op.WordIds(op.tokenizer())
    for text, found in zip(TRICKY, ids.encode(TRICKY)):
        assert np.frombuffer(found, "<u2").tolist() == reference_tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, pieces, tokenizer):
    expected = sorted((d, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, _, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u2").astype("<u4"), p))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    got = []
    for doc, parts in by_doc.items():
        at, ids = 0, []
        for start, own, p in sorted(parts, key=lambda x: x[0]):
            assert start == at and len(own) == p.length > 0 and zlib.crc32(own.tobytes()) == p.ids_crc32
            at += p.length
            ids += own.tolist()
            doc_tokens = p.doc_tokens
        assert at == doc_tokens
        got.append((doc, ids))
    assert sorted(got) == expected
    for sequence, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence


def test_round_trip(spark, reference_tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    pieces = op.pack(docs.repartition(5), op.tokenizer()).collect()
    by_sequence = check(rows, pieces, reference_tokenizer)
    # every full window holds each source by its share of all tokens, within a token
    source = {d: s for d, s, _ in rows}
    tokens, windows = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        tokens[source[p.doc_id]] += p.length
        windows[p.sequence_id][source[p.doc_id]] += p.length
    total = sum(tokens.values())
    for w in range(len(by_sequence) - 40):
        for s, n in tokens.items():
            assert abs(windows[w][s] - 2048 * n / total) < 2


def test_edge_cases(spark, reference_tokenizer):
    rows = [(i, None if i % 3 else "s", t) for i, t in enumerate(TRICKY)] + [(100, "hot", "word " * 30000), (101, "x", None)]
    docs = spark.createDataFrame([(d, s, t, 1, "q") for d, s, t in rows], "doc_id long, source string, text string, n int, queue string")
    check(rows, op.pack(docs, op.tokenizer()).collect(), reference_tokenizer)
    check(rows, op.pack(docs, op.tokenizer(), {"hot": 0.9, "s": 0.1}).collect(), reference_tokenizer)
    assert op.pack(docs.limit(0), op.tokenizer()).collect() == []


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x y")] * 3 + [(None, "a", "x")], "doc_id long, source string, text string")
    assert sum(p.length for p in op.pack(docs, op.tokenizer()).collect()) == 3 * 3 + 2


@pytest.mark.parametrize("totals,targets", [([5, 1, 100_000], [1, 1, 1]), ([2048] * 3, [0.2, 0.3, 0.5]), ([10**13, 10**12, 7], [10, 1, 1e-9]), ([1] * 3000, [1] * 3000)])
def test_schedule_serves_everything_once(totals, targets):
    totals, served = np.array(totals), 0
    segments = op.schedule(totals, np.array(targets, float))
    for s, after in zip(segments, segments[1:]):
        assert s["at"] + s["n"] == after["at"]
        assert (after["base"] >= s["base"]).all()
        full = after["base"].sum() - s["base"].sum()
        assert full == s["n"] * 2048 or full & (full - 1) == 0
    last = segments[-1]
    gone = last["take"] if "take" in last else last["n"] // op.ROUND * last["part"] + op.round_table(tuple(last["part"].tolist()))[last["n"] % op.ROUND]
    assert (last["base"] + gone == totals).all()


def test_round_table_carries_deficits():
    part = op.shares(np.array([0.6, 0.3999, 0.0001, 1e-9]), op.ROUND * op.WINDOW)
    table = op.round_table(tuple(part.tolist()))
    assert (np.diff(table, axis=0) >= 0).all() and (np.diff(table, axis=0).sum(1) == op.WINDOW).all()
    assert (np.abs(table - np.arange(op.ROUND + 1)[:, None] * part / op.ROUND) <= 1).all() and (table[-1] == part).all()


def test_words_are_listed_in_one_piece():
    import time

    import pyarrow as pa

    for words in ([], [""], ["", "a", ""], ["a b", "c"], ["é\n", " ", "漢"], ["x\x00", "y"]):
        assert op.listed(pa.array(words, pa.large_string())) == words
    words = pa.array([f"word{i}" for i in range(400_000)], pa.large_string())
    start = time.process_time()
    one_by_one = words.to_pylist()
    middle = time.process_time()
    assert op.listed(words) == one_by_one
    assert time.process_time() - middle < 0.7 * (middle - start)
