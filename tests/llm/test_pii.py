from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from towerlens.llm import pii as op

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, span):
    digits = [int(c) for c in span if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if holds(k, m[0])]
    joined = ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(x[1] == k for x in found) for k in range(4)], joined


EDGE = [None, "", "a@b@c.de x@y", "@a.b a@.b a@b a@b.c.d.", "é😀 a.b@c-d.org,+1 (017) 555-7713", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.256 001.2.3.4", "4111 1111 1111 1111 4111111111111112", "9" * 3000, "1.2.3." * 300, "+1-2 +1 2 3 4 5 6 7 8 9 10 ++1 222 333 4444", "a%+@b.c%@d.e", "4111-1111-1111-1111.2.3.4"]


def test_base_on_noise():
    rng = random.Random(3)
    texts = EDGE + ["".join(rng.choice("0123456789.@+ -()ab,é") for _ in range(rng.randrange(200))) for _ in range(3000)]
    for text in texts:
        held = op.base_spans(text or "")[0]
        want = brute(text)[1]
        assert ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in held) == want, text


def test_query(spark, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate(EDGE)] + [(10_004, EDGE[4]), (None, None)]
    docs += [(20_000 + i, f"write an e-mail: user{i} [at] mail dot com or user{i}(at)mail.com") for i in range(30)]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, found int").write.parquet(str(tmp_path / "documents.parquet"))
    got = op.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    texts = {}
    for d, t in docs:
        texts.setdefault(d, t)
    added = 0
    for r in got:
        counts, joined = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        added += len(list(filter(None, r.spans.split(",")))) - sum(counts)
        if r.doc_id is not None and r.doc_id < 10_000:
            assert not (r.spans and not re.search(r"[0-9@]", texts[r.doc_id]))
    print("added", added)
    assert op.find(spark.createDataFrame(docs, "doc_id long, text string").limit(0)).collect() == []


def test_expectation_maximisation_finds_reliable_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    vote = np.zeros((20_000, 6), int)
    for i, right in enumerate((0.95, 0.9, 0.8, 0.8, 0.5, 0.7)):
        say = rng.random(20_000) < right
        vote[:, i] = np.where(rng.random(20_000) < 0.2, 0, np.where(say == truth, 1, -1))
    pattern, at = np.unique(vote, axis=0, return_inverse=True)
    chance, table, prior = op.expectation_maximisation(pattern, np.bincount(at).astype(float))
    assert ((chance[at] > 0.5) == truth).mean() > 0.95 and abs(prior - 0.3) < 0.03
    assert table[1, 0, 2] > 0.7 > table[1, 4, 2]
    x = op.features(np.zeros(len(pattern), int), pattern, np.zeros(len(pattern), int))
    weights = op.logistic(x, chance, np.bincount(at).astype(float))
    p = 1 / (1 + np.exp(-(np.append(x, np.ones((len(x), 1)), 1) @ weights)))
    assert ((p[at] > 0.5) == truth).mean() > 0.95


def test_votes_round_trip():
    for pattern in range(3**6):
        assert op.pattern_of(tuple(op.vote_of(pattern))) == pattern
