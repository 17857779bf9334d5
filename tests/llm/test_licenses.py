from __future__ import annotations

import math
import re
from collections import Counter

from towerlens.llm import license_scan as op


def terms(text):
    return Counter(re.findall(r"[^\W_]+", (text or "").lower()))


def brute(files):
    """Cosine of every line with every template, then the nearest directory."""
    n = len(files)
    vocabulary = {w for t in op.TEMPLATES.values() for w in terms(t)}
    frequency = Counter(w for _, t in files for w in set(terms(t)) & vocabulary)
    idf = lambda w: math.log((1 + n) / (1 + frequency[w])) + 1 if w in vocabulary else math.log(1 + n) + 1
    vector = lambda c: {w: k * idf(w) for w, k in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = {name: vector(terms(t)) for name, t in op.TEMPLATES.items()}
    best, holders = {}, {}
    for path, text in files:
        for line in (text or "").split("\n"):
            v = vector(terms(line))
            for name, t in templates.items():
                cosine = sum(v[w] * t[w] for w in v.keys() & t.keys()) / (size(v) * size(t)) if v else 0
                if cosine >= op.THRESHOLD - 1e-12:
                    new = (-round(cosine, 9), name, sum(terms(line).values()) * 2 >= sum(terms(text).values()))
                    best[path, text] = min(best.get((path, text), new), new)
    parent = lambda p: p.rpartition("/")[0]
    for (path, _), (low, name, whole) in best.items():
        if path is not None and (whole or re.match(r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$", path.split("/")[-1])):
            holders[parent(path)] = min(holders.get(parent(path), (low, name)), (low, name))
    out = []
    for path, text in files:
        if (path, text) in best:
            low, name, _ = best[path, text]
            out.append((path, name, -low, "own", None))
            continue
        at = None if path is None else parent(path)
        while at is not None and at not in holders:
            at = None if at == "" else parent(at)
        out.append((path, None, None, "none", None) if at is None else (path, holders[at][1], -holders[at][0], "inherited", at))
    return sorted(out, key=str)


FILES = [
    ("a/LICENSE", "Released under the MIT License.\nand much more text that is not a licence at all, none"), ("a/x.py", "code"), ("a/b/y.py", None), ("a/b/c/z.py", ""),
    ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3"), ("a/b/c/d/q", "text"), ("top", "x"), ("z/w", "All rights reserved."), ("z/v", "z"),
    ("m/n", "words before\n Licensed under the APACHE License version 2.0 \nafter all the words in this file"), ("m/o", "license"), (None, "All rights reserved."), (None, "x"),
    ("a/x.py", "code"), ("l/long", "license " * 30_000), ("l/k", "rights " + "w " * 200), ("l/half", "Licensed under the Apache License. Version two point oh"),
]


def run(spark, files):
    frame = spark.createDataFrame([(*f, "l") for f in files], "path string, text string, license string")
    return sorted([(r.path, r.license, r.cosine, r.origin, r.from_dir) for r in op.scan(frame).collect()], key=str)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] + a[3:] == b[:2] + b[3:] and (a[2] is None) == (b[2] is None) and abs((a[2] or 0) - (b[2] or 0)) < 1e-6


def test_edge_cases(spark):
    same(run(spark, FILES), brute(FILES))
    assert run(spark, []) == []


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "source", "lang", "text").collect()
    files = [(f"{r.source}/{r.lang}/{r.doc_id // 50}/{r.doc_id}.txt", r.text) for r in rows]
    got = op.query(spark, "/root/testdata/sf0.01").collect()
    same(sorted([(r.path, r.license, r.cosine, r.origin, r.from_dir) for r in got], key=str), brute(files))
    assert sum(r.origin == "own" for r in got) > 20


def test_anchors_are_needed():
    weight = {w: 1.0 for t in op.TEMPLATES.values() for w in op._terms(t)}
    found = op.anchors(op.TEMPLATES, weight, 0.8)
    for t in op.TEMPLATES.values():
        own = op._terms(t)
        rest = sum(n * n for w, n in own.items() if w not in found)
        assert math.sqrt(rest / sum(n * n for n in own.values())) < 0.8
