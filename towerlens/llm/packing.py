"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. Shares are whole numbers of tokens in a round of
512 windows; in each window a queue is owed its share, the part owed but not served is
carried as deficit, and after 512 windows all deficits are settled. So the schedule of any
window follows from its number, and partitions start in the middle of the stream with the
right deficits. When a queue cannot fill its share, one window is filled by what is there
and the shares are set anew; the last tokens go to windows whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Mapping
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import common

WINDOW = 2048
ROUND = 512
END = 1
#: Distinct words whose ids a worker remembers in each of two generations.
REMEMBERED = 80_000
#: New words that are encoded at once.
JOINED = 50_000
#: Bytes of text split at once: the more, the fewer look-ups of the same word.
SPLIT_BYTES = 5_000_000
#: Rows of (partition, source) starts that are broadcast at most; beyond, they are joined.
BROADCAST_ROWS = 200_000


_GAP = re.compile(r" (?=\s|$)")


class WordIds:
    """Token ids of whole texts. Byte-level BPE never merges across a space that stands
    before a word, so a text is cut there and each distinct word is encoded once. New words
    are encoded many at a time; as every token stands for a known number of bytes, the ids
    fall back to their words by running sums."""

    def __init__(self, path: str, width: int = 2):
        # Spark's tasks are the parallelism; threads of a worker's own cost more than they give
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype(f"<u{width}")
        # in the byte-level alphabet a token has one character per byte
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    @staticmethod
    def words(text: str) -> tuple[str, list[str]]:
        """What stands before the first word cut, and the words without the space before them."""
        first, *rest = text.split(" ")
        if not _GAP.search(text):
            return first, rest
        out = []
        for p in rest:
            if p and not p[0].isspace():
                out.append(p)
            elif out:  # further white space belongs to what stands before it
                out[-1] += " " + p
            else:
                first += " " + p
        return first, out

    def learn(self, new: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words of ``sizes`` bytes, each with a space before it: all ids one
        after the other, and how many each word has."""
        found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(new), JOINED):
            some = new[lo:lo + JOINED]
            parts = [" " + " ".join(some[i:i + 500]) for i in range(0, len(some), 500)]
            ids = np.concatenate([np.asarray(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[lo:lo + JOINED] + 1), "left") + 1
            found.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(found).astype(self.kind), np.concatenate(counts)

    def ids_of(self, words: list[str], sizes: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, each with the space before it: (all ids, first id of each word,
        ids of each word). ``sizes`` are bytes, ``uses`` how often each is needed now; words
        needed more than once are remembered."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        found, missed = list(map(self.known.get, words)), []
        for i in [i for i, x in enumerate(found) if x is None]:
            x = self.older.get(words[i])
            if x is None:
                found[i] = b""
                missed.append(i)
            else:
                found[i] = self.known[words[i]] = x
        fresh = np.asarray(missed, np.int64)
        some = fresh[sizes[fresh] > 0]  # the empty word has no ids
        ids, counts = self.learn([words[i] for i in some.tolist()], sizes[some])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        known = np.frombuffer(b"".join(found), self.kind)
        starts = np.cumsum(lengths) - lengths
        lengths[some], starts[some] = counts, len(known) + np.cumsum(counts) - counts
        raw, width = ids.tobytes(), self.kind.itemsize
        again = np.nonzero((uses[some] > 1) & (sizes[some] <= 64))[0]
        ends = np.cumsum(counts)
        for i, lo, hi in zip(some[again].tolist(), ((ends - counts)[again] * width).tolist(), (ends[again] * width).tolist()):
            self.known[words[i]] = raw[lo:hi]
        return np.concatenate([known, ids]), starts, lengths

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Texts are split by spaces at once and every distinct word is looked
        up once; its ids are then copied to all its places by array indexing."""
        slow = [any(s in t for s in self.special) or bool(spaced(t)) for t in texts]
        out: list[bytes] = [self._alone(t) if s else b"" for t, s in zip(texts, slow)]
        fast = [i for i, s in enumerate(slow) if not s]
        if not fast:
            return out
        split = pc.split_pattern(pa.array([texts[i] for i in fast], pa.large_string()), " ")
        bounds = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        # what stands before the first space has none before it: entries of its own
        firsts = split.values.take(pa.array(bounds[:-1])).to_pylist()
        which[bounds[:-1]] = len(coded.dictionary) + np.arange(len(fast))
        own, starts, lengths = self._distinct(coded.dictionary, np.bincount(which, minlength=len(coded.dictionary) + len(fast)))
        opening = [np.asarray(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(firsts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, opening), np.int64, len(opening))
        starts = np.r_[starts, len(own) + np.cumsum(sizes) - sizes]
        lengths, own = np.r_[lengths, sizes], np.concatenate([own, *opening])
        many = lengths[which]
        ends = np.cumsum(many)
        shift = (starts[which] - (ends - many)).astype(np.int32)  # a batch has far fewer than 2**31 ids
        ids = own[np.repeat(shift, many) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        cuts = (np.r_[0, ends][bounds] * self.kind.itemsize).tolist()
        for i, lo, hi in zip(fast, cuts, cuts[1:]):
            out[i] = ids[lo:hi]
        return out

    def _distinct(self, words: pa.Array, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`ids_of` an array of words; those not in use (openings of texts) count as empty."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        needed = uses[:len(words)] > 0
        ids, starts, lengths = self.ids_of(listed(words.filter(pa.array(needed))), sizes[needed], uses[:len(words)][needed])
        spread = np.zeros((2, len(words)), np.int64)
        spread[0, needed], spread[1, needed] = starts, lengths
        return ids, *spread

    def _alone(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.plain(text)
        first, words = self.words(text)
        opening = self.plain(first) if first else b""
        if not words:
            return opening
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        which = coded.indices.to_numpy()
        ids, starts, lengths = self._distinct(coded.dictionary, np.bincount(which))
        many = lengths[which]
        ends = np.cumsum(many)
        return opening + ids[np.repeat(starts[which] - (ends - many), many) + np.arange(ends[-1])].tobytes()


#: ASCII white space after a space.
_GAPS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c", " \x1c", " \x1d", " \x1e", " \x1f")


def spaced(text: str) -> bool:
    """Whether a space stands before white space or at the end, so that it begins no word."""
    return text.endswith(" ") or any(g in text for g in _GAPS) or (not text.isascii() and _GAP.search(text) is not None)


def listed(words: pa.Array) -> list[str]:
    """``words`` as strings: all in one piece that is split again, which costs far less than to
    make one string after the other, unless a word has a space itself."""
    if not len(words):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    found = pc.binary_join(whole, pa.scalar(" ", words.type))[0].as_py().split(" ")
    return found if len(found) == len(words) else words.to_pylist()


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def shares(weights: np.ndarray, total: int) -> np.ndarray:
    """Whole shares of ``total`` by largest remainder, at least 1 where the weight is positive."""
    own = weights > 0
    part = np.where(own, 1, 0).astype(np.int64)
    exact = weights / weights.sum() * (total - part.sum())
    part += np.floor(exact).astype(np.int64)
    rest = total - part.sum()
    order = np.argsort(-(exact - np.floor(exact)), kind="stable")
    part[[i for i in order if own[i]][:rest]] += 1
    return part


@cache
def round_table(part: tuple[int, ...]) -> np.ndarray:
    """Tokens served to each queue before each window of a round: shape (ROUND + 1, queues)."""
    part = np.array(part, np.int64)
    served, deficit = np.zeros((ROUND + 1, len(part)), np.int64), np.zeros(len(part), np.int64)
    for w in range(ROUND):
        deficit += part  # owed, in units of 1/512 token
        now = np.maximum(deficit // ROUND, 0)
        rest = WINDOW - int(now.sum())
        left = deficit - now * ROUND
        if rest > 0:
            now[np.argsort(-left, kind="stable")[:rest]] += 1
        elif rest < 0:
            full = np.nonzero(now > 0)[0]
            now[full[np.argsort(left[full], kind="stable")[:-rest]]] -= 1
        if w == ROUND - 1:
            now = part - served[w]
        deficit -= now * ROUND
        served[w + 1] = served[w] + now
    return served


def schedule(totals: np.ndarray, targets: np.ndarray) -> list[dict]:
    """Segments of equal shares: first window, number of windows, tokens served before, and
    either the shares of a round or the lengths served in the one window."""
    left, base, at, out = totals.astype(np.int64).copy(), np.zeros(len(totals), np.int64), 0, []

    def single(take: np.ndarray) -> None:
        nonlocal at
        out.append({"at": at, "n": 1, "base": base.copy(), "take": take})
        base[:], left[:], at = base + take, left - take, at + 1

    while left.sum() >= WINDOW:
        part = shares(np.where(left > 0, targets, 0.0), ROUND * WINDOW)
        table, active = round_table(tuple(part.tolist())), left > 0
        rounds = int((left[active] // part[active]).min())
        more = left - rounds * part
        windows = int(np.nonzero((table[:-1, active] <= more[active]).all(1))[0].max()) if rounds or (table[1, active] <= left[active]).all() else 0
        count = rounds * ROUND + windows
        if count:
            out.append({"at": at, "n": count, "base": base.copy(), "part": part})
            gone = rounds * part + table[windows]
            base, left, at = base + gone, left - gone, at + count
            continue
        take, want = np.zeros_like(left), WINDOW
        while want:
            free = left - take
            step = shares(np.where(free > 0, targets, 0.0), want) if (free > 0).sum() <= want else np.where(np.cumsum(free > 0) <= want, free > 0, 0)
            step = np.minimum(step, free)
            take, want = take + step, want - int(step.sum())
        single(take)
    rest = int(left.sum())
    for bit in range(WINDOW.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            before = np.minimum(np.cumsum(left), 1 << bit)
            single(np.diff(before, prepend=0))
    return out


class Cutter:
    """Cuts a document's interval of its queue into (sequence, offset, start, length)."""

    def __init__(self, segments: list[dict]):
        self.segments = segments
        self.bases = np.array([s["base"] for s in segments]) if segments else np.zeros((0, 0), np.int64)

    @staticmethod
    @cache
    def _places(part: tuple[int, ...]) -> np.ndarray:
        lengths = np.diff(round_table(part), axis=0)
        return np.cumsum(lengths, axis=1) - lengths

    def cut(self, queue: int, lo: int, hi: int):
        k = int(np.searchsorted(self.bases[:, queue], lo, "right")) - 1
        while lo < hi:
            segment = self.segments[k]
            base = int(segment["base"][queue])
            k += 1
            if "take" in segment:
                end = min(hi, base + int(segment["take"][queue]))
                if end > lo:
                    yield np.array([segment["at"]]), np.array([int(segment["take"][:queue].sum()) + lo - base]), np.array([lo]), np.array([end - lo])
                    lo = end
                continue
            part = segment["part"]
            share, table = int(part[queue]), round_table(tuple(part.tolist()))[:, queue]
            n = segment["n"]
            stop = base + (n // ROUND) * share + int(table[n % ROUND])
            end = min(hi, stop)
            if end <= lo:
                continue
            window = lambda x: (x - base) // share * ROUND + int(np.searchsorted(table, (x - base) % share, "right")) - 1
            windows = np.arange(window(lo), window(end - 1) + 1)
            begins = base + windows // ROUND * share + table[windows % ROUND]
            ends = base + windows // ROUND * share + table[windows % ROUND + 1]
            a, b = np.maximum(begins, lo), np.minimum(ends, end)
            full = b > a
            places = self._places(tuple(part.tolist()))[windows % ROUND, queue] + a - begins
            yield segment["at"] + windows[full], places[full], a[full], (b - a)[full]
            lo = end


def pack(docs: DataFrame, tokenizer_path: str, targets: Mapping[str, float] | None = None, ids: bool = True) -> DataFrame:
    """All documents in sequences of at most 2048 tokens: one row per piece.

    ``targets`` weighs sources; one not named, and without ``targets`` every one, weighs as
    much as it has tokens, so that all queues end together. The piece has its ids as bytes
    (unsigned 16-bit little-endian) unless ``ids`` is false. Null text is empty (the end id alone), null source is a
    queue of its own together with the empty name; repeated rows are packed as often as
    they come. An empty table gives no rows; columns other than doc_id, text and source are
    not read. The mixture's sources are summed on the driver; as each needs a token in a
    round, more than 1,048,576 of them are refused.
    """
    spark = docs.sparkSession
    session.ship_package(spark)

    def tokenize(batches):
        from pyspark import TaskContext

        pid, ends = TaskContext.get().partitionId(), {}
        end = np.array([END], "<u2").tobytes()
        for batch in common.chunks(batches, limit=SPLIT_BYTES):
            found = word_ids(tokenizer_path).encode([t or "" for t in common.column(batch, "text").to_pylist()])
            queues, begins = common.column(batch, "queue").to_pylist(), []
            ids = [x + end for x in found]
            for queue, x in zip(queues, ids):
                begins.append(ends.get(queue, 0))
                ends[queue] = begins[-1] + len(x) // 2
            yield pa.RecordBatch.from_arrays(
                [common.column(batch, "doc_id"), pa.array(queues, pa.string()), pa.array([pid] * len(ids), pa.int32()), pa.array(begins, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "queue", "pid", "begin", "n", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), F.col("text").cast("string").alias("text"))
    tokens = common.stage(own.mapInArrow(tokenize, "doc_id long, queue string, pid int, begin long, n long, ids binary"), "tokens")
    sums = common.stage(tokens.groupBy("queue", "pid").agg(F.sum("n").alias("n")), "queues")
    by_queue = {r.queue: r.n for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).limit(ROUND * WINDOW + 1).collect()}
    if len(by_queue) > ROUND * WINDOW:
        raise ValueError(f"a round of {ROUND * WINDOW} tokens cannot serve {len(by_queue)} sources")
    names = sorted(by_queue)
    totals = np.array([by_queue[q] for q in names], np.int64)
    whole = float(totals.sum())
    weights = np.array([float((targets or {}).get(q, by_queue[q] / max(1.0, whole))) for q in names])
    cutter, number = Cutter(schedule(totals, np.maximum(weights, 1e-12))), {q: i for i, q in enumerate(names)}
    starts = sums.select("queue", "pid", (F.sum("n").over(Window.partitionBy("queue").orderBy("pid")) - F.col("n")).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)

    columns = ["doc_id", "doc_tokens", "start", "length", "sequence_id", "offset", "ids_crc32"]

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found, pieces, crcs, docs_of, sizes = [], [], [], [], []
                for doc, queue, begin, n, base, own in zip(*(common.column(part, c).to_pylist() for c in ("doc_id", "queue", "begin", "n", "base", "ids"))):
                    at = base + begin
                    wide = memoryview(np.frombuffer(own, "<u2").astype("<u4").tobytes())
                    for windows, offsets, a, lengths in cutter.cut(number[queue], at, at + n):
                        a = a - at
                        found.append((a, lengths, windows, offsets))
                        docs_of += [doc] * len(a)
                        sizes += [n] * len(a)
                        cuts = list(zip(a.tolist(), (a + lengths).tolist()))
                        crcs += [zlib.crc32(wide[4 * x:4 * y]) for x, y in cuts]
                        if ids:
                            pieces += [own[2 * x:2 * y] for x, y in cuts]
                numbers = [np.concatenate(x).astype(np.int64) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
                arrays = [pa.array(docs_of, pa.int64()), pa.array(sizes, pa.int64()), *map(pa.array, numbers), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(pieces, pa.binary())] if ids else arrays, [*columns, "ids"] if ids else columns)

    placed = tokens.join(starts, ["queue", "pid"]).select("doc_id", "queue", "begin", "n", "base", "ids")
    return placed.mapInArrow(cut, ", ".join(f"{c} long" for c in columns) + (", ids binary" if ids else ""))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    found = pack(common.table(spark, sf_dir, "documents"), tokenizer(), ids=False)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
