"""Fuzzy line deduplication.

Lines are normalised (lower case, white space as single spaces) and get a SimHash over their byte 5-grams.
Two lines link if their SimHashes differ in at most three bits and their edit similarity is
at least 0.8. Of five blocks of the SimHash two must then be equal, so candidates meet on
one of ten block pairs; lines whose lengths rule the similarity out are no candidates. A
small bucket gives all its candidate pairs; a large one gives a spanning forest of them, one
pair per line at most. Once those links are verified and connected, two steps look at what
is left in large buckets: first one pair, nearest in length, for every two components with
candidates between them, then, after connecting again, all candidates between components.
That keeps groups of near copies linear and loses no link between components. One occurrence
of each connected group stays, the one with the smallest (doc_id, line number).

Lines are named by 64-bit hashes of their normalised text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import common

BITS, SIMILARITY = 3, 0.8
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Lines a bucket may hold to be compared pair by pair at once.
SMALL = 32
#: Bucket rows per task.
TASK_ROWS = 400_000
#: Pairs of texts compared per task.
TASK_PAIRS = 1_000
#: Wanted lines (ids and places) that are broadcast at most; more are joined by a shuffle.
BROADCAST_LINES = 500_000
#: Bytes of text whose SimHashes are taken at once; arrays of this size stay in a core's cache.
PRINT_BYTES = 250_000
GRAM = 5
#: Edits up to which Spark's own distance is used; for longer texts columns of bits cost less.
SHORT = 64
#: Columns of the distance table between two looks at what it can still reach.
COLUMNS = 256


def line_prints(lines: list[str]) -> np.ndarray:
    """64-bit SimHash of each line over the 5-grams of its UTF-8 bytes, zero-padded at the end."""
    raw = [x.encode() for x in lines]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    pad = GRAM - 1
    buffer = np.frombuffer((b"\0" * pad).join(raw) + b"\0" * pad, np.uint8).astype(np.uint64)
    count = len(buffer) - pad
    gram = buffer[:count].copy()
    for i in range(1, GRAM):
        gram |= buffer[i:count + i] << np.uint64(8 * i)
    keep = np.ones(count, bool)
    ends = np.cumsum(lengths + pad) - pad
    for i in range(pad):
        at = ends + i
        keep[at[at < count]] = False
    gram = gram[keep]
    with np.errstate(over="ignore"):  # 64-bit mixing wraps on purpose
        gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(32)
    return common.majority(gram, lengths)


def normal_lines(text: str | None) -> list[tuple[int, str]]:
    """(line number, normalised line) of the lines that are not blank."""
    lines = ((i, " ".join(x.split())) for i, x in enumerate((text or "").lower().split("\n")))
    return [(i, x) for i, x in lines if x]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(common.row_key("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, line_no, line, fp, length): one row per line that is not blank."""
    session.ship_package(docs.sparkSession)

    def run(batches):
        for batch in common.chunks(batches, limit=PRINT_BYTES):
            found = [normal_lines(t) for t in common.column(batch, "text").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            texts = [x for own in found for _, x in own]
            if not texts:
                continue
            names = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
            numbers = np.fromiter((i for own in found for i, _ in own), np.int32, len(texts))
            lengths = np.fromiter(map(len, texts), np.int32, len(texts))
            yield pa.RecordBatch.from_arrays(
                [common.column(batch, "row_key").take(pa.array(at)), common.column(batch, "doc_id").take(pa.array(at)), pa.array(numbers), pa.array(names.view(np.int64)), pa.array(line_prints(texts).view(np.int64)), pa.array(lengths)],
                ["row_key", "doc_id", "line_no", "line", "fp", "length"])

    return _keyed(docs).mapInArrow(run, "row_key string, doc_id long, line_no int, line long, fp long, length int")


def texts_of(docs: DataFrame, different: DataFrame, pairs: DataFrame, count: int) -> DataFrame:
    """(line, text) of the lines in the ``count`` ``pairs``: each is read from the one document
    that ``different``, the table of different lines, names for it; others are not split."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    wanted = different.select("line", "at").join(ids, "line", "left_semi")
    wanted = wanted.groupBy(F.col("at.row_key").alias("row_key")).agg(F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "line")).alias("wanted"))
    wanted = common.stage(wanted, "wanted", 2 * count)
    if (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    own = _keyed(docs).select("row_key", "text").join(wanted, "row_key").select("text", "wanted")

    def run(batches):
        for batch in common.chunks(batches):
            names, texts = [], []
            for text, chosen in zip(common.column(batch, "text").to_pylist(), common.column(batch, "wanted").to_pylist()):
                parts = text.lower().split("\n")
                names += [x["line"] for x in chosen]
                texts += [" ".join(parts[x["line_no"]].split()) for x in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.string())], ["line", "text"])

    found = own.mapInArrow(run, "line long, text string")
    # rows equal in doc_id and text give a line more than once
    return common.stage(found.groupBy("line").agg(F.first("text").alias("text")), "line_texts", 2 * count)


def surely_similar(a: str, b: str, allowed: int) -> bool:
    """True only if an alignment of cost at most ``allowed`` is at hand: equal stretches, and
    between them what it takes to reach the next 16 characters that agree."""
    i = j = cost = 0
    while cost <= allowed:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            step = 256
            while step > 1 and a[i:i + step] != b[j:j + step]:
                step //= 2
            i, j = min(len(a), i + step), min(len(b), j + step)
        if i >= len(a) or j >= len(b):
            return cost + max(len(a) - i, len(b) - j) <= allowed
        for skip in (0, 1, 2, 3, 5, 8, 12, 18, 27, 40, 60, 90):
            probe = a[i + skip:i + skip + 16]
            at = b.find(probe, j, j + skip + 120) if len(probe) == 16 else -1
            if at >= 0:
                cost += max(skip, at - j)
                i, j = i + skip, at
                break
        else:
            return cost + max(len(a) - i, len(b) - j) <= allowed
    return False


def within(a: str, b: str, allowed: int) -> bool:
    """Whether the edit distance is at most ``allowed``: whole columns of the distance table as
    bits of two numbers (where a cell is one more or less than the cell above it), only where
    the rows are within ``allowed`` of the column, and no further than the distance can hold.

    Cells outside are taken as too large, which is right where it matters: a way of cost
    ``allowed`` never leaves the rows that are looked at.
    """
    n, m = len(a), len(b)
    if abs(n - m) > allowed:
        return False
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    places = {x: int.from_bytes(np.packbits(codes == ord(x), bitorder="little").tobytes(), "little") for x in set(a) & set(b)}
    lo = hi = more = less = top = 0
    for start in range(0, m, COLUMNS):
        stop = min(m, start + COLUMNS)
        first, last = max(0, start - allowed), min(n, stop + allowed)
        gone = (1 << first - lo) - 1
        top += (more & gone).bit_count() - (less & gone).bit_count()
        more, less = more >> first - lo | (1 << last - first) - (1 << hi - first), less >> first - lo
        lo, hi, full = first, last, (1 << last - first) - 1
        at = {x: places[x] >> lo & full for x in set(b[start:stop]) if x in places}
        for x in b[start:stop]:
            equal = at.get(x, 0)
            same = ((equal & more) + more ^ more | equal | less) & full
            right = ((less | full ^ (same | more)) << 1 | 1) & full
            more, less = ((same & more) << 1 | full ^ (same | right)) & full, same & right
        top += stop - start
        bits = [np.unpackbits(np.frombuffer(x.to_bytes(-(-(hi - lo) // 8), "little"), np.uint8), count=hi - lo, bitorder="little").astype(np.int64) for x in (more, less)]
        cells = top + np.cumsum(np.r_[0, bits[0] - bits[1]])
        # what is left has its difference in length to pay at least
        if (cells + np.abs(n - np.arange(lo, hi + 1) - (m - stop))).min() > allowed:
            return False
    return True if m else n <= allowed


def _verified(pairs: DataFrame, texts: DataFrame, count: int) -> DataFrame:
    """Those of ``count`` different pairs (a, b) whose texts are similar enough: most by an
    alignment at hand, the rest by their edit distance."""
    # pairs are few rows and much work, so their number sets the tasks
    pairs = pairs.repartition(max(pairs.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_PAIRS)), "a", "b")
    left = texts.select(F.col("line").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("line").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")
    # floor(0.2 * n) in whole numbers
    both = both.withColumn("allowed", F.expr("cast(greatest(char_length(text_a), char_length(text_b)) div 5 as int)"))
    both = both.filter("abs(char_length(text_a) - char_length(text_b)) <= allowed")

    def decided(a: str, b: str, allowed: int) -> bool | None:
        return True if surely_similar(a, b, allowed) else within(a, b, allowed) if allowed > SHORT else None

    def run(batches):
        for batch in batches:
            rows = zip(*(common.column(batch, c).to_pylist() for c in ("text_a", "text_b", "allowed")))
            similar = pa.array([decided(*r) for r in rows], pa.bool_())
            # texts are needed further only where nothing is decided yet
            blank = [pa.compute.if_else(similar.is_valid(), pa.scalar(""), common.column(batch, c)) for c in ("text_a", "text_b")]
            yield pa.RecordBatch.from_arrays([common.column(batch, "a"), common.column(batch, "b"), *blank, common.column(batch, "allowed"), similar], ["a", "b", "text_a", "text_b", "allowed", "similar"])

    both = both.select("a", "b", "text_a", "text_b", "allowed").mapInArrow(run, "a long, b long, text_a string, text_b string, allowed int, similar boolean")
    return both.filter("coalesce(similar, levenshtein(text_a, text_b, allowed) >= 0)").select("a", "b")


def buckets(prints: DataFrame) -> DataFrame:
    """(bucket, line, fp, length): every line under each of its ten block pairs."""
    keys = []
    for i, ((at, width), (at2, width2)) in enumerate(combinations(BLOCKS, 2)):
        first = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        second = F.shiftrightunsigned("fp", at2).bitwiseAND(F.lit((1 << width2) - 1))
        keys.append(F.shiftleft(first, width2).bitwiseOR(second).bitwiseOR(F.lit(i << 26)).cast("int"))
    return prints.select(F.explode(F.array(*keys)).alias("bucket"), "line", "fp", "length")


def near(fp: np.ndarray, length: np.ndarray, other_fp: np.ndarray, other_length: np.ndarray) -> np.ndarray:
    """Where two lines are candidates: few bits differ and their lengths allow the similarity."""
    close = np.abs(length - other_length) <= np.maximum(length, other_length) // 5
    return close & (np.bitwise_count(fp ^ other_fp) <= BITS)


def bucket_pairs(bucket: np.ndarray, line: np.ndarray, fp: np.ndarray, length: np.ndarray):
    """Near pairs (a, b) of small buckets, of large ones those that connect all near lines;
    then (bucket, line, fp, length) of each member of a large bucket."""
    order = np.lexsort((line, bucket))
    bucket, line, fp, length = bucket[order], line[order], fp[order], length[order]
    starts = np.nonzero(np.diff(bucket, prepend=bucket[:1] - 1))[0]
    sizes = np.diff(np.append(starts, len(bucket)))
    place = np.arange(len(bucket)) - np.repeat(starts, sizes)
    size = np.repeat(sizes, sizes)
    left, right = [], []
    for ahead in range(1, SMALL):
        at = np.nonzero((size <= SMALL) & (place + ahead < size))[0]
        if not len(at):
            break
        at = at[near(fp[at], length[at], fp[at + ahead], length[at + ahead])]
        left.append(at), right.append(at + ahead)
    large = np.nonzero(size > SMALL)[0]
    for start in starts[sizes > SMALL].tolist():
        todo = np.arange(start, start + int(size[start]))
        while len(todo):  # walk near lines; every line is reached over one near pair
            walk, todo = [int(todo[0])], todo[1:]
            while walk and len(todo):
                at = walk.pop()
                found = near(fp[todo], length[todo], fp[at], length[at])
                reached, todo = todo[found], todo[~found]
                left.append(np.full(len(reached), at)), right.append(reached)
                walk += reached.tolist()
    left, right = (np.concatenate([np.zeros(0, int), *x]) for x in (left, right))
    return (line[left], line[right]), (bucket[large], line[large], fp[large], length[large])


def rest_pairs(bucket, line, fp, length, component, every: bool):
    """Near pairs between different components, as two arrays of places: of every two
    components of a bucket the one nearest in length, or all of them.

    Only lines outside the main component of a bucket look around, so a bucket that is
    connected costs nothing.
    """
    order = np.lexsort((line, bucket))
    starts = np.nonzero(np.diff(bucket[order], prepend=bucket[order][:1] - 1))[0]
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for own in np.split(order, starts[1:]):
        names, which, sizes = np.unique(component[own], return_inverse=True, return_counts=True)
        if len(names) < 2:
            continue
        main, best = sizes.argmax(), {}
        for k in np.nonzero(which != main)[0].tolist():
            at = own[k]
            # two lines that both look around meet once
            ask = (which == main) | (which > which[k])
            found = np.nonzero(ask & near(fp[own], length[own], fp[at], length[at]))[0]
            if every:
                left.append(np.full(len(found), at)), right.append(own[found])
                continue
            gap = np.abs(length[own[found]] - length[at])
            found = found[np.lexsort((line[own[found]], gap))]
            for j in found[np.unique(which[found], return_index=True)[1]].tolist():
                ends = (int(which[k]), int(which[j]))
                step = (int(abs(length[own[j]] - length[at])), int(at), int(own[j]))
                best[ends] = min(best.get(ends, step), step)
        left.append(np.array([x[1] for x in best.values()], int)), right.append(np.array([x[2] for x in best.values()], int))
    return np.concatenate(left), np.concatenate(right)


def _whole(batches, *names: str) -> list[np.ndarray]:
    """The named columns of all batches of a task."""
    parts = [[common.column(batch, n).to_numpy(zero_copy_only=False) for n in names] for batch in batches]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64) for _ in names]


def _between(dense: DataFrame, tasks: int, every: bool) -> DataFrame:
    """(a, b, component_a, component_b): see ``rest_pairs``."""

    def run(batches):
        bucket, line, fp, length, component = _whole(batches, "bucket", "line", "fp", "length", "component")
        at, to = rest_pairs(bucket, line, fp.view(np.uint64), length, component, every)
        turn = line[at] > line[to]
        at, to = np.where(turn, to, at), np.where(turn, at, to)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (line[at], line[to], component[at], component[to])], ["a", "b", "component_a", "component_b"])

    found = dense.repartition(tasks, "bucket").mapInArrow(run, "a long, b long, component_a long, component_b long")
    return common.stage(found.distinct(), "rest")


def line_components(different: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component): connected components of the verified links between different lines.

    ``different`` has one row (line, fp, length, at) per different line; ``at`` names a
    document in ``docs`` and the line's number there.
    """
    session.ship_package(different.sparkSession)
    prints = different.select("line", "fp", "length")
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() * 10 // TASK_ROWS))

    def run(batches):
        bucket, line, fp, length = _whole(batches, "bucket", "line", "fp", "length")
        (a, b), (bucket, line, fp, length) = bucket_pairs(bucket, line, fp.view(np.uint64), length)
        none = lambda n: pa.nulls(n, pa.int64())
        names = ["bucket", "a", "b", "fp", "length"]
        yield pa.RecordBatch.from_arrays([none(len(a)), pa.array(a), pa.array(b), none(len(a)), none(len(a))], names)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(line), none(len(line)), pa.array(fp.view(np.int64)), pa.array(length.astype(np.int64))], names)

    found = common.stage(buckets(prints).repartition(tasks, "bucket").mapInArrow(run, "bucket long, a long, b long, fp long, length long"), "buckets")
    # a pair may be met in several buckets, from either end
    pairs = found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = common.stage(pairs, "pairs")
    count = pairs.count()
    known = common.components(_verified(pairs, texts_of(docs, different, pairs, count), count), count)
    dense = found.filter("b is null").select("bucket", F.col("a").alias("line"), "fp", "length")
    if not dense.take(1):
        return known
    dense = dense.join(known.withColumnRenamed("node", "line"), "line", "left").withColumn("component", F.coalesce("component", "line"))
    dense = common.stage(dense, "dense")
    for every in (False, True):
        rest = _between(dense, tasks, every)
        count = rest.count()
        if not count:  # components without any pair stay without one
            break
        links = _verified(rest.select("a", "b"), texts_of(docs, different, rest, count), count).join(rest, ["a", "b"])
        merged = common.components(links.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")), count)
        if not merged.take(1):
            continue
        merged = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = F.coalesce("to", "component").alias("component")
        # a line without links so far is a component of its own and becomes a node now
        alone = merged.select(F.col("component").alias("node"), F.col("to").alias("component")).join(known, "node", "left_anti")
        known = common.stage(known.join(merged, "component", "left").select("node", moved).unionByName(alone), "components")
        if not every:
            dense = common.stage(dense.join(merged, "component", "left").select("bucket", "line", "fp", "length", moved), "dense")
    return known


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(row_key, dropped): numbers of the lines each document loses."""
    first = F.min(F.struct("doc_id", "row_key", "line_no"))
    with common.staging() as tables:
        seen = common.stage(lines_of(docs), "lines")
        # a common line is folded where it is read, with the place that its text is taken from
        different = seen.groupBy("line").agg(F.first("fp").alias("fp"), F.first("length").alias("length"), F.count(F.lit(1)).alias("n"), F.min(F.struct("row_key", "line_no")).alias("at"))
        different = common.stage(different, "different")
        found = line_components(different, docs)
        grouped = different.select("line", "n").join(found.withColumnRenamed("node", "line"), "line", "left")
        # single lines are groups of their own and need no decision
        grouped = common.stage(grouped.filter("n > 1 or component is not null").select("line", F.coalesce("component", "line").alias("component")), "groups")
        within = seen.join(grouped, "line").select("component", "doc_id", "row_key", "line_no")
        within = common.stage(within, "repeats")
        # written once, so that both sides of the join are dealt anew and a hot group can be split
        keep = common.stage(within.groupBy("component").agg(first.alias("keep")), "keep")
        tables.keep(within, keep)
    lost = within.join(keep, "component").filter(F.struct("doc_id", "row_key", "line_no") != F.col("keep"))
    return lost.groupBy("row_key").agg(F.collect_set("line_no").alias("dropped"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines: ``text`` is rewritten, all rows and columns stay.

    Blank lines stay. A document that loses every line has an empty text, a null text stays
    null. The first occurrence is by doc_id (null first), then by a hash of the text. Rows
    equal in doc_id and text count as one document and get equal results. An empty table
    stays empty; other columns are only carried.
    """
    columns = docs.columns
    lost = dropped_lines(docs).toDF("__key", "__lost")
    both = docs.withColumn("__key", common.row_key("doc_id", "text")).join(lost, "__key", "left")
    # linear in the lines: the numbers that stay by a hashed difference, then one look-up each
    both = both.withColumn("__lines", F.when(F.col("__lost").isNotNull(), F.split("text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    kept = F.concat_ws("\n", F.transform(stay, lambda i: F.get("__lines", i)))
    clean = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(kept)
    return both.withColumn("text", clean).select(*[F.col(f"`{c}`") for c in columns])


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: lines and characters left, and the hash of the text left."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = dedup_lines(docs)
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""))
    return clean.select("doc_id", F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
