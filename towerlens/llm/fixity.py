"""Merkle fixity audit of WARC records.

Records are hashed into leaves by record id. A node of the next level covers a range of 16
consecutive keys of the level below and hashes their digests in order, up to one root. Two
replicas are compared from the root down: a level is joined only below nodes that differ,
so equal branches are never descended. Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from towerlens.llm import common

#: Bits of a key that one level takes away: 16 children a node.
FAN_BITS = 4
#: Bits of ids that share a volume (a WARC file of at most 4096 ids).
VOLUME_BITS = 12
NO_ID = -(2**63)


def warc_records(pages: DataFrame, prefix: str = "") -> DataFrame:
    """(record_id, record): the bytes of a WARC response record as text, null as empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col("url").cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long").alias("record_id"), F.concat(head, html, F.lit("\r\n\r\n")).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """(key, digest, length, copies, sha256): one leaf per id; repeated ids are summed up.

    The digest of an id covers how many records it has and the sums of four parts of their
    hashes, so any number of repeats is folded before the shuffle. Null ids share one leaf.
    """
    sha = F.sha2(F.coalesce(F.col("record").cast("string"), F.lit("")), 256)
    own = records.select(F.coalesce(F.col("record_id").cast("long"), F.lit(NO_ID)).alias("key"), sha.alias("sha256"), F.octet_length(F.coalesce(F.col("record").cast("string"), F.lit(""))).cast("long").alias("length"))
    parts = [F.sum(F.conv(F.substring("sha256", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    found = own.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.sum("length").alias("length"), F.min("sha256").alias("sha256"), *(p.alias(f"part{i}") for i, p in enumerate(parts)))
    digest = F.sha2(F.concat_ws(":", F.col("copies").cast("string"), F.col("length").cast("string"), "part0", "part1", "part2", "part3"), 256)
    return found.select("key", digest.alias("digest"), "length", "copies", "sha256")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of the tree from leaves to root, each (key, digest, length, ...), written once."""
    levels = [common.stage(leaves(records), "merkle")]
    span = levels[0].filter(F.col("key") != NO_ID).agg(F.min("key"), F.max("key")).first()
    bits = max(1, *(int(x if x >= 0 else ~x).bit_length() for x in span if x is not None), 1)
    for _ in range(-(-bits // FAN_BITS)):
        child = F.struct("key", "digest", "length")
        up = levels[-1].groupBy(F.shiftright("key", FAN_BITS).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        digest = F.sha2(F.concat_ws(";", F.transform("children", lambda c: F.concat_ws(":", c["key"].cast("string"), c["digest"]))), 256)
        length = F.aggregate("children", F.lit(0).cast("long"), lambda total, c: total + c["length"])
        levels.append(common.stage(up.select(F.col("up").alias("key"), digest.alias("digest"), length.alias("length")), "merkle"))
    return levels


def mismatches(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """(key, status) of leaves that differ: changed, missing or extra in the replica."""
    while len(primary) < len(replica):
        primary = [*primary, _above(primary[-1])]
    while len(replica) < len(primary):
        replica = [*replica, _above(replica[-1])]
    found = None
    for level in range(len(primary) - 1, -1, -1):
        left, right = (side[level].select("key", "digest") for side in (primary, replica))
        if found is not None:
            parents = found.select(F.col("key").alias("parent"))
            left, right = (side.join(parents, F.shiftright(side["key"], FAN_BITS) == parents["parent"], "left_semi") for side in (left, right))
        left, right = left.withColumnRenamed("digest", "mine"), right.withColumnRenamed("digest", "theirs")
        status = F.when(F.col("theirs").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("changed")
        both = left.join(right, "key", "full").filter(~F.col("mine").eqNullSafe(F.col("theirs")))
        found = common.stage(both.select("key", status.alias("status")), "mismatch")
    return found


def _above(level: DataFrame) -> DataFrame:
    """A further level over few nodes, for the replica whose ids end earlier."""
    child = F.struct("key", "digest")
    up = level.groupBy(F.shiftright("key", FAN_BITS).alias("key")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    digest = F.sha2(F.concat_ws(";", F.transform("children", lambda c: F.concat_ws(":", c["key"].cast("string"), c["digest"]))), 256)
    return common.stage(up.select("key", digest.alias("digest")), "merkle")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record id of either replica: volume, byte offset and length in the primary
    (null for extra records), hash, and status ok, changed, missing or extra.

    Inputs are (record_id, record); other columns are not read. Null records count as
    empty, null ids share one leaf (reported as null); ids that repeat are one entry whose
    length is their sum. Empty replicas make every record missing or extra.
    """
    mine, theirs = tree(primary), tree(replica)
    bad = mismatches(mine, theirs)
    volume = F.shiftright("key", VOLUME_BITS)
    order = Window.partitionBy(volume).orderBy("key")
    placed = mine[0].select("key", volume.alias("volume"), (F.sum("length").over(order) - F.col("length")).alias("byte_offset"), "length", "sha256")
    extra = theirs[0].join(bad.filter("status = 'extra'").select("key"), "key", "left_semi").select("key", volume.alias("volume"), F.lit(None).cast("long").alias("byte_offset"), "length", "sha256")
    both = placed.unionByName(extra).join(bad, "key", "left")
    return both.select(F.when(F.col("key") != NO_ID, F.col("key")).alias("record_id"), "volume", "byte_offset", "length", "sha256", F.coalesce("status", F.lit("ok")).alias("status"))


def query(spark, sf_dir: str) -> DataFrame:
    """Audit the pages against a replica with records lost, altered and added by rule."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    altered = F.when(F.col("page_id") % 89 == 3, F.concat("html", F.lit("~"))).otherwise(F.col("html"))
    replica = pages.filter("page_id % 101 <> 7").withColumn("html", altered)
    replica = replica.unionByName(pages.filter("page_id % 97 = 5").withColumn("page_id", F.col("page_id") + 1_000_000_000))
    return audit(warc_records(pages), warc_records(replica))


_RECORD = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
SQL = f"""
WITH mine AS (SELECT CAST(page_id AS BIGINT) AS record_id, {_RECORD} AS record FROM pages),
placed AS (
  SELECT record_id, record_id >> 12 AS volume, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256,
    CASE WHEN record_id % 101 = 7 THEN 'missing' WHEN record_id % 89 = 3 THEN 'changed' ELSE 'ok' END AS status
  FROM mine)
SELECT record_id, volume, CAST(sum(length) OVER (PARTITION BY volume ORDER BY record_id) - length AS BIGINT) AS byte_offset, length, sha256, status FROM placed
UNION ALL
SELECT record_id + 1000000000, (record_id + 1000000000) >> 12, CAST(NULL AS BIGINT), CAST(strlen(record) AS BIGINT), sha256(record), 'extra'
FROM mine WHERE record_id % 97 = 5
"""
