"""Near copies by SimHash and vantage-point trees, completed to exact Jaccard similarity.

Two texts link if the Jaccard similarity of their sets of five-word shingles is at least 0.8.
SimHashes of the sets meet in vantage-point trees first; those within three bits are verified
and connected. What links at more bits is found by an exact check: all shingles have one
fixed order; two sets that link share a shingle among the first fifth (plus one) of each
(prefix filter), and the first one they share stands so far in front that enough is left of
both behind it, so candidates meet on those shingles and no pair is lost.
Shingles seen often in a sample that grows with the corpus come last, the most frequent at
the very end; the order spares comparisons and never changes the result. First every set
meets one leader of each of its shingles; once those links are verified and connected, sets
outside the main component of a shingle meet the others under it. A candidate pair is first
compared by profiles, 256 counters a set whose common minimum bounds the overlap from above;
what passes is verified by the whole sets, each of which is shuffled once for every leader
it is a candidate of.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import common, simhash_neardup
from towerlens.llm.simhash_neardup import text_hashes

WIDTH = 5
#: Texts sampled to find common shingles: at least so many, and one in ``SHARE`` of a larger
#: corpus. A shingle is common from ``COMMON`` sampled texts on.
SAMPLE, SHARE, COMMON = 8_000, 64, 4
#: Common shingles that are put last at most.
LAST = 1_000_000
#: Rows of ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Counters of a profile.
COUNTERS = 256
AT = ["__file", "__row"]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The set of shingle hashes of a text, ascending."""
    return np.unique(np.asarray(text_hashes(text, width), np.uint64)).view(np.int64)


def prefix(own: np.ndarray, last: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """First fifth of a set, plus one, in the order: those in ``last`` (ascending) after all
    others, by how often they were ``seen``."""
    if not len(own):
        return own
    late = np.zeros(len(own), np.int64)
    if len(last):
        at = np.minimum(np.searchsorted(last, own), len(last) - 1)
        late = np.where(last[at] == own, seen[at], 0)
    return own[np.lexsort((own, late))][:len(own) // 5 + 1]


def profile(own: np.ndarray) -> bytes | None:
    """How many elements of a set fall to each counter; none where a counter is too small."""
    counts = np.bincount(own & (COUNTERS - 1), minlength=COUNTERS)
    return counts.astype(np.uint8).tobytes() if counts.max() <= 255 else None


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def common_shingles(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several texts of a sample, ascending, and in how many."""

    def run(batches):
        for batch in common.chunks(batches):
            found = [shingles(t, width) for t in common.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["shingle"])

    share = min(1.0, max(SAMPLE / max(1, docs.count()), 1 / SHARE))
    chosen = F.pmod(F.xxhash64(*AT), F.lit(1 << 40)) < int(share * (1 << 40))
    seen = docs.filter(chosen).select("text").mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= COMMON)
    top = seen.orderBy(F.desc("count"), "shingle").limit(LAST).toPandas().sort_values("shingle")
    return top["shingle"].to_numpy(np.int64), top["count"].to_numpy(np.int64)


def sketches(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> DataFrame:
    """(place, name, size, fp, prefix) per row of ``docs``: its set's SimHash and first shingles;
    rows with equal sets share a name."""

    def run(batches):
        for batch in common.chunks(batches):
            found = [shingles(t, width) for t in common.column(batch, "text").to_pylist()]
            names = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in found), np.uint64, len(found)).view(np.int64)
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            prints = common.majority(np.concatenate(found).view(np.uint64), sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(common.column(batch, c) for c in AT), pa.array(names), pa.array(sizes), pa.array(prints), _lists([prefix(x, *order) for x in found])], [*AT, "name", "size", "fp", "prefix"])

    return docs.select(*AT, "text").mapInArrow(run, "__file long, __row long, name long, size int, fp long, prefix array<long>")


def _small(ids: DataFrame) -> DataFrame:
    """``ids``, a staged table, to be broadcast up to a counted bound."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _sets_of(docs: DataFrame, wanted: DataFrame, names: list[str], width: int, what: str) -> DataFrame:
    """The named columns of ``wanted`` (a staged table with places) and, for each of its rows,
    the set of its text or its profile."""
    kind = "array<long>" if what == "own" else "binary"

    def run(batches):
        for batch in common.chunks(batches):
            found = [shingles(t, width) for t in common.column(batch, "text").to_pylist()]
            last = _lists(found) if what == "own" else pa.array([profile(x) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(common.column(batch, n) for n in names), last], [*names, what])

    texts = docs.select(*AT, "text").join(_small(wanted), AT).select(*names, "text")
    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names) + f", {what} {kind}")


def _likely(pairs: DataFrame, names: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Those (a, b) whose profiles allow the similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().join(names, "name")
    profiles = common.stage(_sets_of(docs, common.stage(wanted.select("name", *AT), "wanted"), ["name"], width, "profile"), "profiles")

    def run(batches):
        for batch in batches:
            a, b = (common.column(batch, c) for c in ("profile_a", "profile_b"))
            known = np.asarray([x.is_valid and y.is_valid for x, y in zip(a, b)], bool)
            rows = [np.frombuffer(b"".join(x.as_py() for x, k in zip(side, known) if k), np.uint8).reshape(-1, COUNTERS) for side in (a, b)]
            most = np.zeros(len(known), np.int64)
            most[known] = np.minimum(*rows).sum(1, dtype=np.int64)
            sizes = sum(common.column(batch, c).to_numpy().astype(np.int64) for c in ("size_a", "size_b"))
            # overlap / (sizes - overlap) >= 4 / 5 in whole numbers
            fits = ~known | (9 * most >= 4 * sizes)
            yield pa.RecordBatch.from_arrays([common.column(batch, c).filter(pa.array(fits)) for c in ("a", "b")], ["a", "b"])

    both = pairs.join(profiles.toDF("a", "profile_a"), "a").join(profiles.toDF("b", "profile_b"), "b")
    return common.stage(both.mapInArrow(run, "a long, b long"), "likely")


def _verified(pairs: DataFrame, names: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Those (a, b, size_a, size_b) whose whole sets have a Jaccard similarity of at least 0.8."""
    likely = _likely(pairs, names, docs, width)
    members = common.stage(likely.join(names.select(F.col("name").alias("b"), *AT), "b").select("a", "b", *AT), "members")
    leaders = likely.select(F.col("a").alias("name")).distinct().join(names, "name")
    leaders = common.stage(leaders.select(F.col("name").alias("a"), *AT), "leaders")
    left = _sets_of(docs, members, ["a", "b"], width, "own")
    right = _sets_of(docs, leaders, ["a"], width, "own").withColumnRenamed("own", "own_a")
    both = left.join(right, "a")
    return both.filter("9 * size(array_intersect(own, own_a)) >= 4 * (size(own) + size(own_a))").select("a", "b")


def _sized(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their sizes, where these allow the similarity."""
    size = names.select("name", "size")
    both = pairs.join(size.toDF("a", "size_a"), "a").join(size.toDF("b", "size_b"), "b")
    return both.filter("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)")


def _print_pairs(names: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b) of sets whose SimHashes differ in at most three bits: pairs that
    connect them, where sizes allow the similarity."""
    leaders = names.groupBy("fp").agg(F.min("name").alias("leader"))
    equal = names.join(leaders, "fp").filter("name <> leader").select(F.col("leader").alias("a"), F.col("name").alias("b"))
    close = simhash_neardup.links(names).distinct().toDF("fp_a", "fp_b")
    close = close.join(leaders.toDF("fp_a", "x"), "fp_a").join(leaders.toDF("fp_b", "y"), "fp_b")
    close = close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return common.stage(_sized(equal.unionByName(close).distinct(), names), "printed")


def _bound(size_a: str, at_a: str, size_b: str, at_b: str) -> str:
    """Whether two sets whose first common shingle stands at these places can link: what is
    left from there on bounds their overlap, in whole numbers."""
    return f"9 * least({size_a} - {at_a}, {size_b} - {at_b}) >= 4 * ({size_a} + {size_b})"


def set_components(sets: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, component) of the links between ``sets``; rows of one name have equal sets."""
    names = sets.groupBy("name").agg(F.min(F.struct(*AT)).alias("at"), F.first("size").alias("size"), F.first("fp").alias("fp"))
    names = common.stage(names.select("name", "size", "fp", *(F.col(f"at.{c}").alias(c) for c in AT)), "names")
    links = common.stage(_verified(_print_pairs(names), names, docs, width), "near")
    known = common.components(links)

    # equal sets meet once, by one row of theirs
    one = sets.select(*AT, "name", "size", "prefix").join(_small(names.select(*AT)), AT, "left_semi")
    one = one.join(known.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    under = Window.partitionBy("shingle")
    shared = one.select(F.posexplode("prefix").alias("at", "shingle"), "name", "size", "component").withColumns(
        {"leader": F.min(F.struct("name", "size", "at", "component")).over(under), "sets": F.count(F.lit(1)).over(under)})
    shared = common.stage(shared.filter("sets > 1").select("shingle", "name", "size", "at", "component", "leader"), "shared")
    first = shared.filter("component <> leader.component").filter(_bound("size", "at", "leader.size", "leader.at"))
    first = first.select(F.col("leader.name").alias("a"), F.col("name").alias("b"), F.col("leader.size").alias("size_a"), F.col("size").alias("size_b"))
    first = common.stage(first.distinct(), "pairs")
    links = links.unionByName(common.stage(_verified(first, names, docs, width), "near"))
    known = common.components(links)

    placed = shared.select("shingle", "name", "size", "at").join(known.withColumnRenamed("node", "name"), "name", "left")
    placed = common.stage(placed.withColumn("component", F.coalesce("component", "name")), "placed")
    counts = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    mains = counts.groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    mains = common.stage(mains.filter("parts > 1"), "mains")
    # a shingle whose sets are connected costs nothing more
    open_ = common.stage(placed.join(mains, "shingle").select("shingle", "name", "size", "at", "component", "main"), "open")
    stray = open_.filter("component <> main").select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("name", "size", "at", "component")))
    rest = open_.join(stray, "shingle").filter("component <> component_b").filter(_bound("size", "at", "size_b", "at_b"))
    ends = [F.struct(F.col("name").alias("name"), F.col("size").alias("size")), F.struct(F.col("name_b").alias("name"), F.col("size_b").alias("size"))]
    rest = rest.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"))
    rest = rest.selectExpr("x.name AS a", "y.name AS b", "x.size AS size_a", "y.size AS size_b").distinct().join(first, ["a", "b"], "left_anti")
    rest = common.stage(rest, "rest")
    if not rest.take(1):
        return known
    return common.components(links.unionByName(common.stage(_verified(rest, names, docs, width), "near")))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of every group of near copies, all columns: the one with the smallest doc_id.

    Texts without words are copies of each other; texts of up to ``width`` words are one
    shingle. Rows of one doc_id whose texts do not link are different documents. Of rows that
    tie in doc_id the smallest hash of the text stays, then any; a row without doc_id stays
    only where its group has no id. An empty table stays empty.
    """
    columns = docs.columns
    session.ship_package(docs.sparkSession)
    plain = [f"c{i}" for i in range(len(columns))]  # whatever the columns are called, none is in the way
    rows = common.keyed(docs.toDF(*plain))
    doc_id, text = (F.col(plain[columns.index(c)]) for c in ("doc_id", "text"))
    own = rows.select(*AT, doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text"))
    with common.staging() as tables:
        found = common.stage(sketches(own, common_shingles(own, width), width), "sketches")
        known = set_components(found, own, width).withColumnRenamed("node", "name")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), *AT).alias("order")
        first = found.select(*AT, "name").join(own.select(*AT, order), AT).groupBy("name").agg(F.min("order").alias("order"))
        first = first.join(known, "name", "left").groupBy(F.coalesce("component", "name").alias("component")).agg(F.min("order").alias("order"))
        kept = common.stage(first.select(*(F.col(f"order.{c}").alias(c) for c in AT)), "kept")
        lost = common.stage(found.select(*AT).join(kept, AT, "left_anti"), "lost")
        tables.keep(lost)
    return rows.join(_small(lost), AT, "left_anti").select(*plain).toDF(*columns)
