"""Sharding by best-fit decreasing.

Groups (rows of equal text) are units; a group larger than a shard's capacity is cut into
units of whole rows. Units of about the same size are interchangeable, so the driver only
sees a histogram: sizes are classed by their first eleven binary digits, a bounded number of
classes whatever the data. Best fit decreasing runs over the classes, largest first, with
the open shards in a balanced search tree by room left; each class is dealt to shards in
ranges of ranks, and Spark ranks the units of a class in parallel.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from towerlens.llm import common

SHARDS, OVERHEAD = 24, 8
#: Binary digits by which sizes are told apart: at most 2**10 classes per power of two.
DIGITS = 11
#: Rows that one bucket of a distributed ranking holds on average.
BUCKET_ROWS = 5_000


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """``df`` (a written table) with a gapless rank from 0 within ``group``; large groups are
    ranked in hash buckets of ``order``, whose starts are running counts."""
    buckets = max(1, rows // BUCKET_ROWS)
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = cut.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = sums.select(*group, "_bucket", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket")) - F.col("_n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    return cut.withColumn("_within", within).join(starts, [*group, "_bucket"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_bucket", "_start", "_within")


class Rooms:
    """Open shards ordered by (room left, shard): a balanced search tree over few entries."""

    def __init__(self, shards: int, capacity: int):
        self.entries = [(capacity, s) for s in range(shards)]

    def tightest(self, size: int) -> tuple[int, int] | None:
        at = bisect_left(self.entries, (size, -1))
        return self.entries.pop(at) if at < len(self.entries) else None

    def roomiest(self) -> tuple[int, int]:
        return self.entries.pop()

    def put(self, room: int, shard: int) -> None:
        insort(self.entries, (room, shard))


def best_fit(classes: list[tuple[int, int, int]], capacity: int, shards: int | None = None) -> list[tuple[int, int, int, int]]:
    """(class, shard, from rank, to rank) for classes (class, units, bytes), largest first.

    With ``shards`` given no further shard is opened: what fits nowhere goes to the shard
    with most room. Without it, a new shard of the same capacity opens.
    """
    rooms, opened, out = Rooms(shards or 0, capacity), shards or 0, []
    for name, units, size in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        each, rank = max(1, -(-size // units)), 0
        while rank < units:
            found = rooms.tightest(each)
            if found is None and shards is None:
                found, opened = (capacity, opened), opened + 1
            if found is None:
                room, shard = rooms.roomiest()
                take = 1
                if rooms.entries:  # level with the next shard
                    take = max(1, (room - rooms.entries[-1][0]) // each)
                take = min(take, units - rank)
            else:
                room, shard = found
                take = min(max(1, room // each), units - rank)
            out.append((name, shard, rank, rank + take))
            rank += take
            rooms.put(room - take * each, shard)
    return out


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row.

    Give ``shards`` for near-equal shards, or ``shards=None`` and a ``capacity`` in bytes to
    open as few shards as best fit decreasing needs. Equal texts share a shard unless
    together they exceed the capacity. Null text counts as empty, null ids and repeated rows
    are rows as any other, an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("key"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    own = common.stage(own, "sizes")
    rows, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return own.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    room = int(capacity) if shards is None else -(-total // shards)
    groups = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(room) / F.col("size")))
    groups = common.stage(groups.withColumn("per_unit", F.when(F.col("n") * F.col("size") > room, fits).otherwise(F.col("n"))), "groups")
    units = groups.select("key", "per_unit", "n", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("per_unit")))).alias("unit"))
    units = units.select("key", "unit", (F.least("per_unit", F.col("n") - F.col("unit") * F.col("per_unit")) * F.col("size")).alias("bytes"))
    shift = f"cast(greatest(0, length(bin(bytes)) - {DIGITS}) as int)"
    units = common.stage(units.withColumn("class", F.expr(f"concat_ws(':', {shift}, shiftright(bytes, {shift}))")), "units")
    histogram = units.groupBy("class").agg(F.count(F.lit(1)).alias("units"), F.sum("bytes").alias("bytes")).collect()
    dealt = best_fit([(r["class"], r.units, r.bytes) for r in histogram], room, shards)
    ranges = spark.createDataFrame(dealt, "class string, shard int, low long, high long")
    count = units.count()
    placed = ranked(units, ["class"], ["key", "unit"], "rank", count)
    # at most one row per class and per shard change: bounded by the number of classes
    placed = placed.join(F.broadcast(ranges), "class").filter("rank >= low and rank < high").select("key", "unit", "shard")
    large = groups.filter("per_unit < n").select("key", "per_unit")
    cut = common.stage(own.join(F.broadcast(large) if shards else large, "key", "left"), "cut")
    inside = ranked(cut.filter("per_unit is not null"), ["key"], ["row"], "rank_in", rows)
    cut = cut.filter("per_unit is null").withColumn("unit", F.lit(0).cast("long")).drop("per_unit").unionByName(
        inside.withColumn("unit", F.floor(F.col("rank_in") / F.col("per_unit"))).drop("per_unit", "rank_in"))
    found = common.stage(cut.join(placed, ["key", "unit"]).select("doc_id", "row", "size", "text_crc32", "shard"), "placed")
    return ranked(found, ["shard"], ["row"], "slot", rows).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    found = shard(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
