"""SimHash near-duplicates by vantage-point trees.

Fingerprints are partitioned by Hamming distance to vantage points. The top of the tree is
built on a bounded sample of fingerprints and names the shards; a fingerprint goes to the
inner side of a vantage point if its distance is at most the radius plus the link distance,
to the outer side if it is greater than the radius. Two fingerprints that link always meet
on one side (triangle inequality: if one lies within the radius, the other lies within
radius + link distance), so shards overlap at their boundaries and no pair is lost. Inside
a shard the same rule prunes branches down to small leaves, which are compared exactly.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import common

#: Fingerprints sampled to place the vantage points of the shards (a model of the space, not of the result).
SAMPLE = 4096
#: Distinct fingerprints a shard should hold; the number of shards follows from it.
SHARD_ROWS = 20_000
LEAF_ROWS = 512

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def text_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of the word shingles: words by ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [_hash(b" ".join(words))]
    return list(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(width))))))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text; no word or null gives 0."""
    session.ship_package(docs.sparkSession)

    def run(batches):
        for batch in common.chunks(batches):
            hashes = [text_hashes(t, width) for t in common.column(batch, "text").to_pylist()]
            lengths = np.asarray([len(h) for h in hashes], np.int64)
            flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(lengths.sum()))
            prints = common.majority(flat, lengths).view(np.int64)
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id").cast(pa.int64()), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _distance(points: np.ndarray, centre: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ centre)


def vantage_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full binary tree in heap order, from the sample."""
    centres, radii = np.zeros(2**depth - 1, np.uint64), np.full(2**depth - 1, 32, np.int64)
    parts = {0: sample}
    for node in range(2**depth - 1):
        own = parts.pop(node, sample[:0])
        if len(own):
            centres[node] = own[0]
            distance = _distance(own, own[0])
            # a quarter of the points may fall on the boundary: the median keeps both sides even
            radii[node] = int(np.median(distance))
            parts[2 * node + 1], parts[2 * node + 2] = own[distance <= radii[node]], own[distance > radii[node]]
    return centres, radii


def route(points: np.ndarray, centres: np.ndarray, radii: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of points and their shards; a point near a boundary has several."""
    rows, nodes = np.arange(len(points)), np.zeros(len(points), np.int64)
    while len(nodes) and nodes[0] < len(centres):
        distance = np.bitwise_count(points[rows] ^ centres[nodes]).astype(np.int64)
        inner, outer = distance <= radii[nodes] + link, distance > radii[nodes]
        rows, nodes = np.concatenate([rows[inner], rows[outer]]), np.concatenate([2 * nodes[inner] + 1, 2 * nodes[outer] + 2])
    return rows, nodes - len(centres)


def _leaf_links(points: np.ndarray, link: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning set of the links in one leaf, compared in blocks."""
    out = []
    for lo in range(0, len(points), LEAF_ROWS):
        rows = points[lo:lo + LEAF_ROWS]
        for at in range(lo, len(points), LEAF_ROWS):
            near = np.bitwise_count(rows[:, None] ^ points[None, at:at + LEAF_ROWS]) <= link
            left, right = np.nonzero(near)
            keep = left + lo < right + at
            left, right = left[keep], right[keep]
            if not len(left):
                continue
            # labels of a block fall to the smallest index linked; one edge per point remains
            count = len(rows) + near.shape[1]
            labels, before = np.arange(count), None
            right = right + len(rows) if at != lo else right
            while before is None or not np.array_equal(labels, before):
                before = labels.copy()
                low = np.minimum(labels[left], labels[right])
                np.minimum.at(labels, left, low)
                np.minimum.at(labels, right, low)
                labels = labels[labels]
            both = np.concatenate([rows, points[at:at + LEAF_ROWS]])
            own = np.nonzero(labels != np.arange(count))[0]
            out.append((both[labels[own]], both[own]))
    return out


def shard_links(points: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever links within ``points``, by a vantage-point tree."""
    out, stack = [], [np.unique(points)]
    while stack:
        own = stack.pop()
        if len(own) > LEAF_ROWS:
            for pick in np.linspace(0, len(own) - 1, 6).astype(int):
                distance = _distance(own, own[pick])
                radius = np.median(distance)
                inner, outer = own[distance <= radius + link], own[distance > radius]
                if max(len(inner), len(outer)) < 0.9 * len(own):
                    stack += [inner, outer]
                    break
            else:
                out += _leaf_links(own, link)
        elif len(own) > 1:
            out += _leaf_links(own, link)
    if not out:
        return points[:0], points[:0]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def links(prints: DataFrame, link: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs within ``link`` bits."""
    spark = prints.sparkSession
    session.ship_package(spark)
    distinct = common.stage(prints.select("fp").distinct(), "fingerprints")
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = max(4, int(np.ceil(np.log2(max(1, total) / SHARD_ROWS)))) if total else 1
    centres, radii = vantage_tree(sample, depth)

    def spread(batches):
        for batch in batches:
            points = common.column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
            rows, shards = route(points, centres, radii, link)
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(points[rows].view(np.int64))], ["shard", "fp"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(pdf["fp"].to_numpy(np.int64).view(np.uint64), link)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.mapInArrow(spread, "shard long, fp long").groupBy("shard").applyInPandas(solve, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, link: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest doc_id reachable.

    Null and wordless texts have fingerprint 0 and link as any other. Repeated rows appear
    as often as they came; a null doc_id is kept and only names a component of its own kind
    where no other id is in it. An empty table gives an empty result; columns other than
    doc_id and text are not read.
    """
    prints = common.stage(fingerprints(docs, width), "prints")
    per_print = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = common.components(links(prints, link))
    labelled = per_print.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    labelled = common.stage(labelled, "labelled")
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = labelled.join(lowest, "component").select("fp", "component_id")
    return prints.join(ids, "fp")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
