"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of consecutive documents of one partition. Its words become a sequence
over the alphabet of benchmark words; a word that no benchmark item has ends a run, and
runs shorter than the shortest phrase, which cannot hold an occurrence, are left out. The
sequence gets a suffix array, its Burrows-Wheeler transform a wavelet matrix; phrases are
searched backward by ranks, all phrases at once; occurrences are located by walking to the
next sampled suffix position; hit intervals of a document are merged into removal spans.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerlens import session
from towerlens.llm import common

PHRASE = 10
#: Suffix positions divisible by this are sampled.
SAMPLED = 8
#: Bytes of text a shard holds at most (or one longer document).
SHARD_BYTES = 16_000_000
#: Bytes of benchmark text searched in one pass over the documents.
BLOCK_BYTES = 32_000_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; letters, digits and all characters from U+0080 are word characters."""
    return (text or "").encode().translate(_FOLD).split()


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffix order by doubling; only suffixes that are still tied are sorted again."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    fresh = np.empty(n, bool)
    fresh[:1] = True
    fresh[1:] = x[order[1:]] != x[order[:-1]]
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    k = 1
    while True:
        starts = np.nonzero(fresh)[0]
        sizes = np.diff(np.append(starts, n))
        slots = np.nonzero(np.repeat(sizes, sizes) > 1)[0]
        if not len(slots):
            return order
        own = order[slots]
        ahead = own + k
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[own]
        new = np.lexsort((second, key))
        own, second, key = own[new], second[new], key[new]
        order[slots] = own
        same = np.zeros(len(slots), bool)
        same[1:] = (key[1:] == key[:-1]) & (second[1:] == second[:-1])
        fresh[slots] = ~same
        rank[own] = np.maximum.accumulate(np.where(~same, slots, 0))
        k *= 2


class FmIndex:
    """FM-index of a word sequence; symbol 0 ends a run and is never searched."""

    def __init__(self, x: np.ndarray, symbols: int):
        n, ends = len(x), np.nonzero(x == 0)[0]
        keyed = x + len(ends)
        keyed[ends] = np.arange(len(ends))  # every end is a symbol of its own, so suffixes differ soon
        order = suffix_array(keyed)
        last = x[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=symbols))])
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        rest = last
        for level in range(self.bits - 1, -1, -1):
            bit = (rest >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(n - int(ones[-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        marked = (order % SAMPLED == 0) | (x[order - 1] == 0)
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]
        self.last = last

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before row ``at`` of the transform."""
        low, high = np.zeros_like(at), at
        for i, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (self.bits - 1 - i)) & 1
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of phrases, given reversed: column j holds the j-th word from the end."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        for j in range(phrases.shape[1]):
            live = np.nonzero((j < lengths) & (low < high))[0]
            if not len(live):
                break
            symbol = phrases[live, j]
            low[live], high[live] = (self.first[symbol] + self.rank(symbol, side[live]) for side in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back to a sampled suffix; a run's first word is sampled too."""
        found, at, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            marked = self.marks[at + 1] > self.marks[at]
            found[todo[marked]] = self.samples[self.marks[at[marked]]] + steps
            todo, at = todo[~marked], at[~marked]
            symbol = self.last[at]
            at, steps = self.first[symbol] + self.rank(symbol, at), steps + 1
        return found


class Phrases:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words(text)]
            for i in range(max(1, len(own) - PHRASE + 1) if own else 0):
                names = owners.setdefault(tuple(own[i:i + PHRASE]), set())
                if item is not None:
                    names.add(item)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.reversed = np.zeros((len(owners), PHRASE), np.int64)
        for i, w in enumerate(owners):
            self.reversed[i, :len(w)] = w[::-1]
        self.items = [sorted(names) for names in owners.values()]
        self.shortest = int(self.lengths.min()) if len(owners) else 0

    def find(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Per document: number of words, word intervals [start, end) of occurrences, items found."""
        counts, hits, items = [], [[] for _ in texts], [set() for _ in texts]
        coded, lengths = [], []
        for text in texts:
            own = words(text)
            counts.append(len(own))
            coded.append(np.fromiter((self.symbol.get(w, 0) for w in own), np.int64, len(own)) if self.symbol else np.zeros(len(own), np.int64))
            lengths.append(len(own) + 1)
        if not len(self.lengths):
            return counts, hits, items
        flat = np.zeros(sum(lengths) + 1, np.int64)  # a 0 before, between and after documents
        begins = np.cumsum([1, *lengths])[:-1]
        for begin, own in zip(begins, coded):
            flat[begin:begin + len(own)] = own
        ends = np.nonzero(flat == 0)[0]
        run = np.diff(ends) - 1
        keep = np.nonzero(run >= self.shortest)[0]
        if not len(keep):
            return counts, hits, items
        sizes = run[keep] + 1  # with the end of the run
        new = np.cumsum(sizes) - sizes
        source = np.repeat(ends[keep] + 1 - new, sizes) + np.arange(int(sizes.sum()))
        index = FmIndex(flat[source], len(self.symbol) + 1)
        low, high = index.search(self.reversed, self.lengths)
        for some in np.array_split(np.arange(len(low)), max(1, int((high - low).sum()) // 1_000_000)):
            many = (high - low)[some]
            phrase = np.repeat(some, many)
            rows = np.repeat(low[some] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            at = source[index.locate(rows)]
            doc = np.searchsorted(begins, at, "right") - 1
            for d, p, a in zip(doc.tolist(), phrase.tolist(), (at - begins[doc]).tolist()):
                hits[d].append((a, a + int(self.lengths[p])))
                items[d].update(self.items[p])
        return counts, hits, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ADDED = [T.StructField("__n_words", T.LongType()), T.StructField("__hit_words", _SPANS), T.StructField("__items", T.ArrayType(T.StringType()))]
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(docs: DataFrame, benchmark: DataFrame, cut: bool) -> DataFrame:
    session.ship_package(docs.sparkSession)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = docs.withColumn("text", F.col("text").cast("string"))
    plain = found.schema
    for block in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows = sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        found = _pass(found, rows, plain, cut and block == blocks - 1)
    return found


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_words, hit_words (merged word intervals) and items (sorted item ids).

    Columns of these names in the input are replaced, all others stay. Null texts have no
    words; null item texts and wordless items have no window; an item without id marks
    words but is not listed. Repeated rows and ids are searched each for themselves. The
    benchmark is searched in blocks of bounded size, each in one pass over the documents.
    """
    added = ["n_words", "hit_words", "items"]
    found = _scan(docs.drop(*added), benchmark, False)
    return found.withColumnsRenamed({f"__{name}": name for name in added})


def _pass(docs: DataFrame, rows: list, plain: T.StructType, cut: bool) -> DataFrame:
    before = "__hit_words" in docs.columns
    keep = [f.name for f in plain]
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        phrases = Phrases(sent.value)

        def solve(shard):
            texts = [t for b in shard for t in common.column(b, "text").to_pylist()]
            counts, hits, items = phrases.find(texts)
            at = 0
            for b in shard:
                own = range(at, at + b.num_rows)
                at += b.num_rows
                if before:
                    for i, spans, names in zip(own, common.column(b, "__hit_words").to_pylist(), common.column(b, "__items").to_pylist()):
                        hits[i] += [(s["start"], s["end"]) for s in spans]
                        items[i].update(names)
                merged = [merge(hits[i]) for i in own]
                spans = [[{"start": x, "end": y} for x, y in m] for m in merged]
                kept = {c: common.column(b, c) for c in keep}
                if cut and any(merged):
                    kept["text"] = pa.array([cut_text(t, m) for t, m in zip(kept["text"].to_pylist(), merged)], pa.string())
                arrays = [*kept.values(), pa.array([counts[i] for i in own], pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array([sorted(items[i]) for i in own], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *(f.name for f in _ADDED)])

        shard, size = [], 0
        for batch in common.chunks(batches, limit=2_000_000):
            shard.append(batch)
            size += common.column(batch, "text").nbytes
            if size >= SHARD_BYTES:
                yield from solve(shard)
                shard, size = [], 0
        if shard:
            yield from solve(shard)

    return docs.mapInArrow(run, T.StructType([*plain.fields, *_ADDED]))


def cut_text(text: str | None, spans) -> str | None:
    """The text without its hit words and what stands between them."""
    if text is None or not spans:
        return text
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with benchmark occurrences cut out of ``text``; other columns and rows stay."""
    return _scan(docs, benchmark, True).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search(docs, common.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
