"""Merkle dataset manifest with octopus multiproofs.

Every row is a leaf of its group's tree, leaves in key order, three nodes to a run; the
roots of the groups are the leaves of one tree above them. Positions come from a range
partitioning and one count per (group, partition), so a group of any size spreads over
many tasks. A leaf partition is a run of 3**7 consecutive leaves: the tree is raised seven
levels at a time inside such partitions, and proofs are made there, too. A partition works
out the smallest set of node coordinates that its own leaves cannot give, fetches these
once by a join, derives the interiors that its leaves share, and writes out the proof of
each leaf from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerlens import session
from towerlens.llm import common

FAN = 3
#: Levels below the root of a leaf partition: it holds at most 3**7 = 2187 leaves.
BLOCK_LEVELS = 7
BLOCK = FAN**BLOCK_LEVELS
#: Name of the tree over the groups' roots; a group's own tree is named "0" or "1" + group.
TOP = ""
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def level_sizes(leaves: int) -> list[int]:
    """Nodes of each level, from the leaves to the one root."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


# ---- leaves and their places --------------------------------------------------------


def leaf(values: Sequence[Column]) -> Column:
    """SHA-256 over the values, each as ``bytes:value``, null as ``-``."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def place(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (from 0, by ``order`` within ``tree``) and ``n`` (leaves of the tree)."""
    ranged = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    written = common.stage(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranged")
    runs = written.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_from"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "_part", (before - F.col("_from")).alias("_shift"), F.sum("_rows").over(tree).alias("n"))
    placed = written.join(runs, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift"))
    return common.stage(placed.drop("_part", "_at", "_shift"), "placed")


# ---- nodes ---------------------------------------------------------------------------


def _raise_block(base: int):
    def work(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        nodes, first = block["digest"].tolist(), int(block["idx"].iloc[0])
        sizes = level_sizes(int(block["n"].iloc[0]))
        found = []
        for level in range(base + 1, min(base + BLOCK_LEVELS, len(sizes) - 1) + 1):
            nodes = [digest("".join(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)]
            first //= FAN
            found += [(level, first + i, d, level == len(sizes) - 1) for i, d in enumerate(nodes)]
        out = pd.DataFrame(found, columns=["level", "idx", "digest", "is_root"])
        return out.assign(tree=block["tree"].iloc[0], n=block["n"].iloc[0])[["tree", "n", "level", "idx", "digest", "is_root"]]
    return work


_NODE = "tree string, n long, level int, idx long, digest string, is_root boolean"


def grow(placed: DataFrame) -> DataFrame:
    """All nodes above the leaves ``placed`` (tree, pos, n, digest), written once."""
    most = placed.agg(F.max("n")).first()[0] or 0
    current, nodes = placed.select("tree", "n", F.col("pos").alias("idx"), "digest"), None
    for base in range(0, max(1, len(level_sizes(most)) - 1), BLOCK_LEVELS):
        block = F.floor(F.col("idx") / F.lit(BLOCK)).alias("block")
        made = common.stage(current.groupBy("tree", block).applyInPandas(_raise_block(base), _NODE), "nodes")
        current = made.filter((F.col("level") == base + BLOCK_LEVELS) & ~F.col("is_root")).select("tree", "n", "idx", "digest")
        nodes = made if nodes is None else nodes.unionByName(made)
    return nodes


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (tree, pos, n, digest, own columns), ``tops`` (tree, q, m, subroot) with the
    place of each group below the top, ``nodes`` of all trees and the ``root`` (None if empty)."""

    leaves: DataFrame
    tops: DataFrame
    nodes: DataFrame
    root: str | None


def build(leaves: DataFrame, order: Sequence[str]) -> Manifest:
    """Manifest over ``leaves`` (tree, digest, further columns); ``order`` must be total."""
    placed = place(leaves, order)
    nodes = grow(placed)
    single = placed.filter("n = 1").select("tree", "digest")
    roots = nodes.filter("is_root").select("tree", "digest").unionByName(single)
    tops = place(roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    above = grow(tops)
    last = above.filter("is_root").select("digest").unionByName(tops.filter("n = 1").select("digest")).first()
    names = tops.select(F.col("name").alias("tree"), F.col("pos").alias("q"), F.col("n").alias("m"), F.col("digest").alias("subroot"))
    top_leaves = tops.select("tree", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest", F.lit(False).alias("is_root"))
    return Manifest(placed, names, nodes.unionByName(above).unionByName(top_leaves), last[0] if last else None)


# ---- proofs --------------------------------------------------------------------------


def missing(positions: Sequence[int], leaves: int) -> list[tuple[int, int]]:
    """Smallest set of (level, index) that, with the leaves at ``positions``, gives the root
    of a tree of ``leaves`` leaves: siblings that no position lies below."""
    known, found = sorted(set(positions)), []
    for level, size in enumerate(level_sizes(leaves)[:-1]):
        parents = sorted({i // FAN for i in known})
        have = set(known)
        found += [(level, s) for p in parents for s in range(FAN * p, min(FAN * p + FAN, size)) if s not in have]
        known = parents
    return found


def _coordinates(block: pd.DataFrame) -> pd.DataFrame:
    one = block.iloc[0]
    own = [(one["tree"], level, i) for level, i in missing(block["pos"].tolist(), int(one["n"]))]
    top = [(TOP, level, i) for level, i in missing([int(one["q"])], int(one["m"]))]
    out = pd.DataFrame(own + top, columns=["at", "level", "idx"])
    return out.assign(tree=one["tree"], block=one["pos"] // BLOCK)[["tree", "block", "at", "level", "idx"]]


class Paths:
    """Nodes known to one leaf partition and the way from each of them up to the root."""

    def __init__(self, tree: str, n: int, q: int, m: int, known: dict[tuple[str, int, int], str]):
        self.tree, self.own, self.top, self.q, self.known = tree, level_sizes(n), level_sizes(m), q, known
        self.siblings: dict[tuple[str, int, int], list[str]] = {}

    def derive(self, positions: Sequence[int]) -> None:
        """Interiors above ``positions``, each hashed once."""
        self._climb(self.tree, self.own, positions)
        self.subroot = self.known[self.tree, len(self.own) - 1, 0]
        self.known[TOP, 0, self.q] = self.subroot
        self._climb(TOP, self.top, [self.q])
        self.root = self.known[TOP, len(self.top) - 1, 0]

    def _climb(self, tree: str, sizes: list[int], positions: Sequence[int]) -> None:
        at = sorted(set(positions))
        for level, size in enumerate(sizes[:-1]):
            at = sorted({i // FAN for i in at})
            for p in at:
                run = (self.known[tree, level, i] for i in range(FAN * p, min(FAN * p + FAN, size)))
                self.known[tree, level + 1, p] = digest("".join(run))

    def up(self, tree: str, level: int, i: int) -> list[str]:
        """Siblings on the way from a node to the root, left to right, level by level."""
        found = self.siblings.get((tree, level, i))
        if found is None:
            sizes = self.own if tree == self.tree else self.top
            if level == len(sizes) - 1:
                found = self.up(TOP, 0, self.q) if tree != TOP else []
            else:
                start = i - i % FAN
                run = [self.known[tree, level, s] for s in range(start, min(start + FAN, sizes[level])) if s != i]
                found = run + self.up(tree, level + 1, i // FAN)
            self.siblings[tree, level, i] = found
        return found

    def fold(self, leaf_digest: str, pos: int) -> str:
        return fold(leaf_digest, pos, self.own[0], self.q, self.top[0], self.up(self.tree, 0, pos))


def fold(leaf_digest: str, pos: int, n: int, q: int, m: int, siblings: Sequence[str]) -> str:
    """Root that a leaf at ``pos`` of ``n``, in group ``q`` of ``m``, gives with its proof."""
    current, left = leaf_digest, iter(siblings)
    for i, sizes in ((pos, level_sizes(n)), (q, level_sizes(m))):
        for size in sizes[:-1]:
            start = i - i % FAN
            current = digest("".join(current if s == i else next(left) for s in range(start, min(start + FAN, size))))
            i //= FAN
    return current


def _expand(proofs: bool):
    def work(wanted: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        if wanted.empty:
            return wanted.assign(derived_root="", proof_sha256="", folded_root="", **({"proof": None} if proofs else {}))
        one = wanted.iloc[0]
        known = {(a, int(x), int(i)): d for a, x, i, d in zip(fetched["at"], fetched["level"], fetched["idx"], fetched["digest"])}
        positions = [int(p) for p in wanted["pos"]]
        known |= {(one["tree"], 0, p): d for p, d in zip(positions, wanted["digest"])}
        paths = Paths(one["tree"], int(one["n"]), int(one["q"]), int(one["m"]), known)
        paths.derive(positions)
        ways = [paths.up(one["tree"], 0, p) for p in positions]
        same = wanted["claim"] == wanted["digest"]
        folded = [paths.root if s else paths.fold(c, p) for s, c, p in zip(same, wanted["claim"], positions)]
        out = wanted.assign(derived_root=paths.root, proof_sha256=[digest("".join(w)) for w in ways], folded_root=folded)
        return out.assign(proof=ways) if proofs else out
    return work


def prove(manifest: Manifest, wanted: DataFrame, proofs: bool = True) -> DataFrame:
    """Proofs of ``wanted``, any rows of ``manifest.leaves`` with a further column ``claim``.

    Adds subroot, place of the group (q, m), the root derived by the partition, the hash of
    the proof, the root that ``claim`` gives with it and, with ``proofs``, the proof itself.
    """
    block = F.floor(F.col("pos") / F.lit(BLOCK))
    marked = wanted.join(manifest.tops, "tree").withColumn("block", block)
    places = marked.select("tree", "block", "pos", "n", "q", "m")
    asked = common.stage(places.groupBy("tree", "block").applyInPandas(_coordinates, "tree string, block long, at string, level int, idx long"), "asked")
    levels = [r[0] for r in asked.select("level").distinct().collect()]  # at most one per level of a tree
    nodes = manifest.nodes.select(F.col("tree").alias("at"), "level", "idx", "digest")
    if asked.filter((F.col("level") == 0) & (F.col("at") != TOP)).take(1):
        nodes = nodes.unionByName(manifest.leaves.select(F.col("tree").alias("at"), F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest"))
    fetched = asked.join(nodes.filter(F.col("level").isin(levels)), ["at", "level", "idx"])
    added = T.StructType().add("derived_root", "string").add("proof_sha256", "string").add("folded_root", "string")
    if proofs:
        added = added.add("proof", T.ArrayType(T.StringType()))
    schema = T.StructType([*marked.schema.fields, *added.fields])
    return marked.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInPandas(_expand(proofs), schema)


# ---- query -----------------------------------------------------------------------------


def tree_name(group: Column) -> Column:
    """Names sort like the groups, null first; no group has the name of the top tree."""
    text = group.cast("string")
    return F.when(text.isNull(), "0").otherwise(F.concat(F.lit("1"), text))


def document_leaves(docs: DataFrame, text_now: Column) -> DataFrame:
    """(tree, doc_id, digest, claim, row): leaf of each row and the one that ``text_now`` gives."""
    values = {c: F.col(f"`{c}`") for c in COLUMNS}
    own, now = leaf(list(values.values())), leaf(list((values | {"text": text_now}).values()))
    claim = F.when(text_now.eqNullSafe(values["text"]), F.col("digest")).otherwise(now)
    found = docs.select("*", own.alias("digest")).select(tree_name(values["source"]).alias("tree"), "doc_id", "digest", claim.alias("claim"))
    return common.stage(found.withColumn("row", F.monotonically_increasing_id()), "leaves")


def query(spark, sf_dir: str) -> DataFrame:
    """Leaf, group root, root and proof of every document, and whether the row with its text
    tampered with (newlines deleted where crc32 of the id is even) still verifies.

    Nulls enter a leaf as ``-`` and a null source has a tree of its own, the first; a null
    doc_id comes first in its tree and is not tampered with. Equal ids are ordered by leaf,
    repeated rows stay rows of their own. Empty and long texts are hashed whole. An empty
    table gives an empty result; further columns are not read.
    """
    session.ship_package(spark)
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text_now = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = build(document_leaves(docs, text_now), ["doc_id", "digest", "row"])
    found = prove(manifest, manifest.leaves, proofs=False)
    root = F.lit(manifest.root).cast("string")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


_CRC = "list_reduce(list_transform(range(1, 8 * length({0}) + 1), lambda i: CASE WHEN i % 8 = 1 THEN CAST(ascii(substr({0}, CAST((i + 7) // 8 AS BIGINT), 1)) AS BIGINT) ELSE CAST(0 AS BIGINT) END), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)), CAST(4294967295 AS BIGINT))"


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({name} AS VARCHAR)) || ':' || {name} END"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: One row is one document id here: the given tables repeat none.
SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {_LEAF.format(text='text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND (({_CRC.format('CAST(doc_id AS VARCHAR)')}) & 1) = 1
      THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text='text')} END AS claim
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
own AS (
  SELECT tree, 0 AS level, pos AS idx, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM own) WHERE n > 1 GROUP BY tree, level, idx // 3),
sizes AS (SELECT tree, level, count(*) AS n FROM own GROUP BY tree, level),
subroots AS (
  SELECT o.tree, o.digest AS subroot, o.level AS depth, row_number() OVER (ORDER BY o.tree) - 1 AS q
  FROM own o JOIN sizes s ON o.tree = s.tree AND o.level = s.level WHERE s.n = 1),
top AS (
  SELECT 0 AS level, q AS idx, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, idx // 3),
tops AS (SELECT max(level) AS height FROM top),
nodes AS (
  SELECT o.tree, o.level, o.idx, o.digest FROM own o JOIN subroots s ON o.tree = s.tree WHERE o.level < s.depth
  UNION ALL
  SELECT s.tree, s.depth + t.level, t.idx, t.digest FROM top t, subroots s, tops h WHERE t.level < h.height),
ways AS (
  SELECT p.tree, p.pos, n.level, n.idx AS idx FROM placed p JOIN subroots s ON p.tree = s.tree
  JOIN nodes n ON n.tree = p.tree AND n.idx = CASE WHEN n.level < s.depth
    THEN CAST(floor(p.pos / power(3, n.level) + 1e-9) AS BIGINT)
    ELSE CAST(floor(s.q / power(3, n.level - s.depth) + 1e-9) AS BIGINT) END),
proofs AS (
  SELECT p.tree, p.pos, sha256(coalesce(string_agg(b.digest, '' ORDER BY b.level, b.idx), '')) AS proof_sha256
  FROM placed p LEFT JOIN ways w ON w.tree = p.tree AND w.pos = p.pos
  LEFT JOIN nodes b ON b.tree = w.tree AND b.level = w.level AND b.idx // 3 = w.idx // 3 AND b.idx <> w.idx
  GROUP BY p.tree, p.pos),
folded AS (
  SELECT tree, pos, 0 AS level, claim AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.level + 1, sha256(string_agg(CASE WHEN b.idx = w.idx THEN f.digest ELSE b.digest END, '' ORDER BY b.idx))
  FROM folded f JOIN ways w ON w.tree = f.tree AND w.pos = f.pos AND w.level = f.level
  JOIN nodes b ON b.tree = w.tree AND b.level = w.level AND b.idx // 3 = w.idx // 3
  GROUP BY f.tree, f.pos, f.level),
ends AS (SELECT tree, pos, arg_max(digest, level) AS folded_root FROM folded GROUP BY tree, pos),
root AS (SELECT t.digest AS root FROM top t JOIN tops h ON t.level = h.height)
SELECT p.doc_id, p.leaf, s.subroot, r.root, w.proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM placed p JOIN subroots s ON p.tree = s.tree JOIN proofs w ON w.tree = p.tree AND w.pos = p.pos
JOIN ends e ON e.tree = p.tree AND e.pos = p.pos CROSS JOIN root r
"""
