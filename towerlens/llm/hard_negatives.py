"""Hard negatives by a GNAT-style multiway hyperplane tree.

A tree of split points is grown over a bounded sample of the vectors; every row goes to the
nearest split point at each node and so into one leaf. For each pair (split point, sibling
subtree) one pass over all rows takes the least and greatest distance. Given the distances
from an anchor to the split points of a node, the triangle inequality bounds its distance
to every sibling, and with the norms in that subtree its inner products; a sibling whose
bounds miss the wanted window of scores (an annulus around the anchor) is never visited.
Leaves are scanned exactly, in blocks of bounded size against chunks of anchors. A first
scan of each anchor's own leaf gives the window that the second scan has to search, so the
results are exact whatever the sample was.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import common

#: Rows that the split points are chosen from; the tree, and what the driver holds, is bounded by it.
SAMPLE_ROWS = 8_192
#: Split points of a node, and sample rows below which a node becomes a leaf.
FAN, LEAF_SAMPLE = 8, 256
#: Numbers the sample holds at most (wide vectors: fewer rows), and levels of the tree.
SAMPLE_VALUES, DEPTH = 2**20, 24
#: Rows of a leaf, and anchors, that meet in one multiplication.
BLOCK_ROWS, CHUNK_ANCHORS = 2_048, 256
#: Vectors are multiplied by this and rounded down.
SCALE = 256
#: Slack for rounding in float distances; every kept leaf is scanned with exact integers.
SLACK = 1e-6
NO_ID = 2**63 - 1
LEAST, MOST = -(2**62), 2**62


# ---- points --------------------------------------------------------------------------


def points(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, vec): rows with a label and a finite vector, components floored.

    A null vec_id takes the place after all others. Written once, so that ``row`` is stable.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = df.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), vec.alias("vec"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, shorter vectors filled with zeros: absent components count as zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: floats where they are, else 64-bit, else unbounded
    integers held at the ends of 64 bits."""
    most = a.shape[1] * int(max(abs(int(a.min(initial=0))), int(a.max(initial=0)))) * int(max(abs(int(b.min(initial=0))), int(b.max(initial=0))))
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


# ---- tree ----------------------------------------------------------------------------


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Tree:
    """``centres`` of each node, ``children`` of each node (a node, or a leaf as -1 - leaf), and
    ``way``: for every leaf the (node, child) pairs above it."""

    centres: list[np.ndarray]
    children: list[list[int]]
    way: list[list[tuple[int, int]]]
    width: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if self.centres else np.full(len(x), -1, np.int64)
        while (inner := np.nonzero(at >= 0)[0]).size:
            for node in np.unique(at[inner]):
                here = np.nonzero(at == node)[0]
                nearest = distances(x[here], self.centres[node]).argmin(1)
                at[here] = np.asarray(self.children[node])[nearest]
        return -1 - at


def grow(sample: np.ndarray) -> Tree:
    """Tree over the distinct rows of ``sample``: split points of a node are taken one after
    the other, each farthest from those before. A smaller sample has smaller leaves."""
    tree = Tree([], [], [], sample.shape[1])
    leaf_rows = min(LEAF_SAMPLE, max(FAN, len(sample) * LEAF_SAMPLE // SAMPLE_ROWS))

    def add(rows: np.ndarray, way: list[tuple[int, int]]) -> int:
        if len(rows) <= leaf_rows or len(way) == DEPTH:
            tree.way.append(way)
            return -len(tree.way)
        chosen = [int(np.argmin(((rows - rows.mean(0)) ** 2).sum(1)))]
        near = distances(rows, rows[chosen])[:, 0]
        while len(chosen) < FAN and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distances(rows, rows[chosen[-1:]])[:, 0])
        node = len(tree.centres)
        tree.centres.append(rows[chosen])
        tree.children.append([])
        nearest = distances(rows, rows[chosen]).argmin(1)
        for j in range(len(chosen)):
            tree.children[node].append(add(rows[nearest == j], [*way, (node, j)]))
        return node

    add(np.unique(sample, axis=0), [])
    return tree


@dataclass
class Index:
    """``rows`` (with leaf and block, written), the tree, and per (node, child) the least and
    greatest distance to each split point of the node (``low``, ``high``) and the least and
    greatest squared norm (``norms``) over all rows below that child."""

    rows: DataFrame
    packed: DataFrame
    tree: Tree
    low: list[np.ndarray]
    high: list[np.ndarray]
    norms: list[np.ndarray]
    blocks: dict[int, int]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each anchor with each leaf: (anchors, leaves)."""
        leaves, square = len(self.tree.way), (x * x).sum(1)
        least, most = np.full((len(x), leaves), -np.inf), np.full((len(x), leaves), np.inf)
        if not self.tree.centres:
            return least, most
        near: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for node, centres in enumerate(self.tree.centres):
            d = distances(x, centres)
            closest = np.maximum(d[:, None, :] - self.high[node][None], self.low[node][None] - d[:, None, :]).max(2)
            farthest = (d[:, None, :] + self.high[node][None]).min(2)
            for j in range(len(centres)):
                near[node, j] = np.maximum(closest[:, j], 0), farthest[:, j]
        for leaf, way in enumerate(self.tree.way):
            lo, hi = np.zeros(len(x)), np.full(len(x), np.inf)
            for step in way:
                lo, hi = np.maximum(lo, near[step][0]), np.minimum(hi, near[step][1])
            n_lo, n_hi = self.norms[way[-1][0]][way[-1][1]]
            slack = SLACK * (1 + square + n_hi)
            if np.isfinite(n_hi):  # else nothing lies below
                least[:, leaf] = (square + n_lo - hi * hi) / 2 - slack
                most[:, leaf] = (square + n_hi - lo * lo) / 2 + slack
        return least, most


def _below(rows: DataFrame, wanted: int, count: int) -> DataFrame:
    """The rows whose hash is so low that about ``wanted`` of all ``count`` rows are among them."""
    return rows if wanted >= count else rows.filter(F.xxhash64("row") < F.lit(2**64 * wanted // count - 2**63))


def _sample(rows: DataFrame, most: int, count: int) -> list[list[int]]:
    """Vectors of the ``most`` rows that are first by hash.

    Of all ``rows`` every task would send its own first ``most`` to the driver; of the rows
    below a bound no more than these reach it. The bound is raised if it was too low.
    """
    wanted = most + 10 * math.isqrt(most)
    while True:
        found = _below(rows, wanted, count).select("vec").orderBy(F.xxhash64("row"), "row").limit(most).collect()
        if len(found) >= min(most, count):
            return [r[0] for r in found]
        wanted *= 2


_ASSIGNED = "row long, vec_id long, label long, vec array<long>, leaf int"


def build(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Index over all ``rows``; only the choice of split points rests on a sample."""
    session.ship_package(rows.sparkSession)
    written = common.stage(rows, "points")
    width, count = written.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)), F.count(F.lit(1))).first()
    some = _sample(written, min(sample_rows, max(FAN, SAMPLE_VALUES // max(1, width))), count)
    sample = np.zeros((len(some), width))
    for i, v in enumerate(some):
        sample[i, :len(v)] = v
    tree = grow(sample) if len(some) else Tree([], [], [[]], width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(common.column(batch, "vec"), width).astype(np.float64)
            leaf = pa.array(tree.leaf_of(x), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], [*batch.schema.names, "leaf"])

    placed = common.stage(written.mapInArrow(assign, _ASSIGNED), "leaves")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task one row for each (node, child, split point) that has rows."""
        child = {node: {} for node in range(len(tree.centres))}
        for leaf, way in enumerate(tree.way):
            for node, j in way:
                child[node][leaf] = j
        found: dict[tuple[int, int, int], list[float]] = {}
        for batch in batches:
            x = matrix(common.column(batch, "vec"), width).astype(np.float64)
            leaf, norm = common.column(batch, "leaf").to_numpy(), (x * x).sum(1)
            for node, centres in enumerate(tree.centres):
                below = pd.Series(leaf).map(child[node]).to_numpy(np.float64)
                here = ~np.isnan(below)
                if not here.any():
                    continue
                d, of, n = distances(x[here], centres), below[here].astype(int), norm[here]
                for j in np.unique(of):
                    own, m = d[of == j], n[of == j]
                    for i, (lo, hi) in enumerate(zip(own.min(0), own.max(0))):
                        old = found.get((node, int(j), i), [np.inf, -np.inf, np.inf, -np.inf])
                        found[node, int(j), i] = [min(old[0], lo), max(old[1], hi), min(old[2], m.min()), max(old[3], m.max())]
        if found:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["node", "child", "split", "lo", "hi", "n_lo", "n_hi"]), schema=_RANGES, preserve_index=False)

    partial = placed.mapInArrow(ranges, "node int, child int, split int, lo double, hi double, n_lo double, n_hi double")
    least = partial.groupBy("node", "child", "split").agg(F.min("lo"), F.max("hi"), F.min("n_lo"), F.max("n_hi"))
    low = [np.full((len(c), len(c)), np.inf) for c in tree.centres]
    high = [np.full((len(c), len(c)), -np.inf) for c in tree.centres]
    norms = [np.tile([np.inf, -np.inf], (len(c), 1)) for c in tree.centres]
    for node, j, i, lo, hi, n_lo, n_hi in least.collect():  # nodes x split points squared, bounded by the sample
        low[node][j, i], high[node][j, i], norms[node][j] = lo, hi, (n_lo, n_hi)
    counts = {r[0]: r[1] for r in placed.groupBy("leaf").count().collect()}  # leaves are bounded by the sample
    blocks = {leaf: -(-n // BLOCK_ROWS) for leaf, n in counts.items()}
    block = F.pmod(F.xxhash64("row"), _lookup(blocks, "leaf"))
    member = F.struct("row", "vec_id", "label", "vec")
    packed = placed.groupBy("leaf", block.cast("int").alias("block")).agg(F.collect_list(member).alias("members"))
    return Index(placed, common.stage(packed, "blocks"), tree, low, high, norms, blocks)


def _lookup(numbers: dict[int, int], key: str) -> Column:
    """Number of each leaf, from a literal map: no more entries than the tree has leaves."""
    if not numbers:
        return F.lit(1)
    pairs = [F.lit(x) for item in sorted(numbers.items()) for x in item]
    return F.element_at(F.create_map(*pairs), F.col(key))


_RANGES = pa.schema([("node", pa.int32()), ("child", pa.int32()), ("split", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n_lo", pa.float64()), ("n_hi", pa.float64())])


# ---- search --------------------------------------------------------------------------


_WANTED = "row long, vec_id long, label long, vec array<long>, los array<long>, his array<long>, leaf int"


def _visits(index: Index, wanted: DataFrame, home: bool) -> DataFrame:
    """``wanted`` (row, vec_id, label, vec, los, his) once for each leaf to scan: the anchor's
    own one, or all whose scores may fall into one of its windows."""
    tree = index.tree
    width, full = tree.width, sorted(index.blocks)
    lean = Index(None, None, tree, index.low, index.high, index.norms, index.blocks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_024):
                part = batch.slice(start, 1_024)
                x = matrix(common.column(part, "vec"), width).astype(np.float64)
                if home:
                    at, leaf = np.arange(len(x)), tree.leaf_of(x)
                else:
                    least, most = lean.bounds(x)
                    los, his = (common.column(part, c).to_pylist() for c in ("los", "his"))
                    hit = np.zeros(least.shape, bool)
                    for k in range(max(map(len, los), default=0)):
                        lo = np.array([v[k] if k < len(v) else np.inf for v in los], np.float64)[:, None]
                        hi = np.array([v[k] if k < len(v) else -np.inf for v in his], np.float64)[:, None]
                        hit |= (least <= hi) & (most >= lo) & (lo <= hi)
                    at, leaf = np.nonzero(hit)
                    some = np.isin(leaf, full)
                    at, leaf = at[some], leaf[some]
                rows = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(leaf, pa.int32())], [*rows.schema.names, "leaf"])

    return wanted.select("row", "vec_id", "label", "vec", "los", "his").mapInArrow(work, _WANTED)


def _merged(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join without a broadcast: the planner takes the size of these tables from packed
    files, or from anchors not yet repeated for each block, and the driver would hold them whole."""
    return left.hint("merge").join(right.hint("merge"), on)


def _scan(index: Index, visits: DataFrame, anchors: int, k: int, same: bool) -> DataFrame:
    """The first ``k`` of each window: (row, vec_id, win, score, other_id, place).

    Only rows of the anchor's label (``same``, without the anchor itself) or only others
    count. Each (block, chunk of anchors) is one multiplication that hands on k rows an
    anchor and window at most.
    """
    width = index.tree.width
    block = F.explode(F.sequence(F.lit(0), _lookup(index.blocks, "leaf") - 1)).alias("block")
    chunk = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-anchors // CHUNK_ANCHORS)))).alias("chunk")
    asked = F.struct("row", "vec_id", "label", "vec", "los", "his")
    chunks = visits.groupBy("leaf", chunk).agg(F.collect_list(asked).alias("asked")).select("leaf", block, "asked")
    joined = _merged(chunks, index.packed, ["leaf", "block"]).select("asked", "members")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _best(common.column(batch, "asked")[i].values, common.column(batch, "members")[i].values, width, k, same)

    partial = joined.mapInArrow(work, "row long, vec_id long, win int, score long, other long, other_id long")
    order = Window.partitionBy("row", "win").orderBy(F.desc("score"), "other_id", "other")
    ranked = partial.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return ranked.select("row", "vec_id", "win", "score", "other_id", "place")


def _best(asked: pa.StructArray, members: pa.StructArray, width: int, k: int, same: bool) -> pa.RecordBatch:
    """The first ``k`` of one block for every anchor and window of one chunk."""
    rows, ids, labels = (members.field(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
    order = np.lexsort((rows, ids))  # equal scores are then in order of ids
    rows, ids, labels = rows[order], ids[order], labels[order]
    x = matrix(members.field("vec"), width)[order]
    scores = products(matrix(asked.field("vec"), width), x)
    mine, own_ids, own_labels = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
    los, his = asked.field("los").to_pylist(), asked.field("his").to_pylist()
    found: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for a in range(len(mine)):
        ok = np.nonzero((labels == own_labels[a]) & (rows != mine[a]) if same else labels != own_labels[a])[0]
        own = scores[a, ok]
        for win, (lo, hi) in enumerate(zip(los[a], his[a])):
            fit = np.nonzero((own >= lo) & (own <= hi))[0]
            if not len(fit):
                continue
            if len(fit) > k:
                cut = np.partition(own[fit], len(fit) - k)[len(fit) - k]
                fit = fit[own[fit] >= cut]
                fit = fit[np.argsort(-own[fit], kind="stable")[:k]]
            at = ok[fit]
            for store, values in zip(found, (np.full(len(at), mine[a]), np.full(len(at), own_ids[a]), np.full(len(at), win), own[fit], rows[at], ids[at])):
                store.append(values)
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["row", "vec_id", "win", "score", "other", "other_id"])


def nearest(index: Index, wanted: DataFrame, anchors: int, k: int, same: bool) -> DataFrame:
    """The ``k`` highest scores inside each window (``los`` to ``his``) of each anchor.

    The k-th score of the anchor's own leaf raises the lower end of a window; the other
    leaves are then visited only where the narrowed window can be met.
    """
    home = _scan(index, _visits(index, wanted, home=True), anchors, k, same)
    kth = home.filter(F.col("place") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("_kth"))
    raised = F.transform("los", lambda lo, i: F.greatest(lo, F.coalesce(F.try_element_at("_kth", i), lo)))
    narrowed = wanted.join(kth, "row", "left").withColumn("los", F.when(F.col("_kth").isNull(), F.col("los")).otherwise(raised)).drop("_kth")
    return common.stage(_scan(index, _visits(index, narrowed, home=False), anchors, k, same), "nearest")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Hard negatives of the rows (row, vec_id, label, vec) for which ``is_anchor`` holds.

    For every anchor its first ``positives`` rows of the same label, and for each of these
    the first ``negatives`` rows of other labels whose score is between ``low`` and ``high``
    per cent of the positive's.
    """
    index = build(rows, sample_rows)
    chosen = index.rows.filter(is_anchor)
    count = chosen.count()
    everything = F.array(F.lit(LEAST)), F.array(F.lit(MOST))
    start = common.stage(chosen.select("row", "vec_id", "label", "vec", everything[0].alias("los"), everything[1].alias("his")), "anchors")
    found = nearest(index, start, count, positives, same=True)
    score = F.col("score").cast("decimal(20,0)")
    windows = found.withColumns({"lo": F.ceil(score * low / 100).cast("long"), "hi": F.floor(score * high / 100).cast("long")})
    windows = windows.filter("lo <= hi").withColumn("slot", F.col("place") - 1)
    per_anchor = windows.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "lo", "hi", "score", F.col("other_id").alias("positive_id")))).alias("_w"))
    asked = _merged(start.drop("los", "his"), per_anchor, ["row"]).withColumns({"los": F.col("_w.lo"), "his": F.col("_w.hi")})
    asked = common.stage(asked, "windows")
    negatives_found = nearest(index, asked, count, negatives, same=False)
    of = asked.select("row", F.posexplode("_w").alias("win", "_one")).select("row", "win", F.col("_one.positive_id").alias("positive_id"), F.col("_one.score").alias("positive_score"))
    return _merged(negatives_found, of, ["row", "win"]).select(
        _known("vec_id").alias("anchor_id"), _known("positive_id").alias("positive_id"), F.col("place").cast("int").alias("rank"),
        _known("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _known(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def query(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100.

    Rows with a null label, a null vector or a null or non-finite component take no part;
    an empty vector scores 0, components that a shorter vector lacks count as zero. A null
    id is no anchor and comes last among ties. Repeated rows are rows of their own: each
    may be an anchor, a positive (never its own) and a negative. An empty table gives an
    empty result; further columns are not read. Scores beyond 62 bits are held there.
    """
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(points(vectors.withColumn("label", label)), F.col("vec_id").between(-NO_ID, NO_ID - 1) & (F.col("vec_id") % 100 == 0))


SQL = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM fit a JOIN fit b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
