"""Main text of web pages by host suffix arrays.

Each page is cut into blocks of text with what its markup says about them: inside chrome
(menus, sidebars, adverts, ...), inside an article or other main part, or nothing. Distinct
pages of one host meet in parts of bounded size; there the token streams are concatenated
and their suffixes sorted by prefix doubling up to the length sought. Equal neighbours in
that order are substrings that repeat. What is on a share of a host's pages is on that share
of some part's pages, so those of every part are candidates; each is then counted over all
pages of its host, and the tokens it covers are marked on every page. What is covered and
stands outside of the article goes as boilerplate, inside of it only what is on most pages
of the host; then the markup's own chrome goes, and the unique runs are the text.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from towerlens import session
from towerlens.llm import common

#: Tokens that a repeated substring has at least (a power of two: the doubling ends there).
LONG = 8
#: Pages of a host whose suffixes one task sorts at once, about; it changes no result.
PART_PAGES = 256
#: A substring is boilerplate outside of the article on so many distinct pages and such a
#: share of the host's distinct pages, and inside of it on these.
OUTSIDE, INSIDE = (2, 0.1), (8, 0.8)
#: Share of a block's tokens that must be covered for the block to go.
COVERED = 0.9

#: Marks of a block. FIRM chrome stays chrome inside a further article; HEAD is a header by class.
CHROME, ARTICLE, MAIN, CONTENT, FIRM, HEAD = 1, 2, 4, 8, 16, 32

# ---- blocks ----------------------------------------------------------------------------

#: Elements whose content is never text of the page.
_DROPPED = "script style noscript template svg math iframe object embed canvas video audio map select button textarea datalist title head".split()
#: Elements that are chrome by name.
_CHROME = frozenset("nav footer aside form dialog menu fieldset".split())
#: Elements that begin and end a block.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark chrome, and those that mark the main text.
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr "
    "notice notification alert newsletter subscribe subscription signup paywall popup modal overlay sidebar sidenav menu nav navbar navigation "
    "breadcrumb breadcrumbs topbar toolbar masthead header footer comment comments commentlist respond reply replies disqus discussion "
    "share sharing social related recommended recommendations pager pagination skip widget widgets login search complementary contentinfo toc "
    "adsbygoogle dialog disclaimer copyright responses".split())
_REMARKS = frozenset("comment comments commentlist respond responses reply replies disqus discussion".split())
_FIRM_WORDS = _REMARKS | frozenset("ad ads advert advertisement sponsored promo related recommended recommendations newsletter popup modal cookie consent widget".split())
_HEAD_WORDS = frozenset(("header", "masthead"))
_CONTENT_WORDS = frozenset("content article post entry story articlebody postcontent entrycontent maincontent".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(" + "|".join(_DROPPED) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _marks(name: str, rest: str) -> int:
    """What an element's name and attributes say about the text inside it."""
    kind = CHROME if name in _CHROME else ARTICLE if name == "article" else MAIN if name == "main" else 0
    if not rest or rest.isspace():
        return kind
    words: set[str] = set()
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), entities.unescape("".join(values))
        if key in ("class", "id", "role", "itemprop", "aria-label"):
            words.update(w.lower() for w in _WORD.findall(value))
            words.update(v.lower() for v in value.split())
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            kind |= CHROME | FIRM
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            kind |= CHROME | FIRM
    if name in ("html", "body", "main"):
        return kind
    if name == "article":
        return kind | CHROME | FIRM if words & _REMARKS else kind
    if words & _HEAD_WORDS and not words & _CHROME_WORDS - _HEAD_WORDS:
        return kind | HEAD
    if words & _CHROME_WORDS:
        return kind | CHROME | (FIRM if words & _FIRM_WORDS else 0)
    if words & _CONTENT_WORDS or "main" in words:
        return kind | CONTENT
    return kind


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, marks) of each block of a page, in order; white space folded, references decoded.

    Elements left open end with what encloses them; a new block element ends an open ``p``.
    A page's own ``header`` is chrome, inside an article only its headings stay.
    """
    found: list[tuple[str, int]] = []
    open_: list[tuple[str, int, bool, bool]] = []  # (element, marks, in a header of an article, in inline chrome)
    texts: list[str] = []
    marks, heading_only, muted, at = 0, False, False, 0

    def end() -> None:
        if texts:
            text = "".join(texts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                found.append((text, marks | CHROME if heading_only else marks))
            texts.clear()

    def close(name: str, until: frozenset[str] = frozenset()) -> None:
        nonlocal marks, heading_only, muted
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] == name:
                del open_[i:]
                marks, heading_only, muted = open_[-1][1:] if open_ else (0, False, False)
                return
            if open_[i][0] in until:
                return

    for piece in _PIECE.finditer(page):
        if piece.start() > at and not muted:
            texts.append(page[at:piece.start()])
        at = piece.end()
        name = piece[3] or piece[6]
        if name is None:
            continue
        name, closing, rest = name.lower(), piece[2] or piece[5], (piece[4] if piece[3] else piece[7]) or ""
        block = name in _BLOCKS
        if block:
            end()
        if closing:
            close(name)
            continue
        if name in ("br", "td", "th"):
            texts.append(" ")
        if name in _VOID:
            continue
        if block:
            close("p", _BOUNDS)
        if name == "li":
            close("li", _LISTS)
        own = _marks(name, rest)
        if name == "header" or own & HEAD:
            own, inside = own & ~HEAD, bool(marks & (ARTICLE | MAIN | CONTENT))
            heading_only = heading_only or inside
            marks |= own if inside else own | CHROME
        elif name in _HEADINGS:
            heading_only = False
            marks |= own
        elif name in ("main", "article") and not (own | marks) & FIRM and not any(o[0] in _CHROME for o in open_):
            marks = (marks & ~CHROME) | own
        else:
            marks |= own
        muted = muted or (not block and bool(own & CHROME))  # part of a line: the rest of its block stays
        open_.append((name, marks, heading_only, muted))
    if at < len(page) and not muted:
        texts.append(page[at:])
    end()
    return found


_LISTS = frozenset(("ul", "ol", "menu", "dir"))
_BOUNDS = frozenset(("article", "main", "section", "div", "body", "td", "th", "li", "blockquote", "button", "aside", "nav", "header", "footer", "form"))



# ---- suffix array ------------------------------------------------------------------------


def prefix_ranks(ids: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` tokens, by prefix doubling: sorting by it is
    the suffix array up to that length, and equal ranks share at least so long a prefix."""
    ranks, step = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1, 1
    while step < length:
        after = np.zeros_like(ranks)
        after[:-step or None] = ranks[step:] if step < len(ranks) else 0
        ranks = np.unique(ranks * (ranks.max(initial=0) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return ranks


def spread(ids: np.ndarray, page: np.ndarray, length: int = LONG) -> np.ndarray:
    """On how many distinct pages the ``length`` tokens from each token on occur.

    ``ids`` are token numbers; each page's stream must end with a token of its own.
    """
    ranks = prefix_ranks(ids, length)
    order = np.lexsort((page, ranks))  # the suffix array; equal prefixes are neighbours
    new_rank = np.r_[True, ranks[order[1:]] != ranks[order[:-1]]]
    new_page = new_rank | np.r_[True, page[order[1:]] != page[order[:-1]]]
    group = np.cumsum(new_rank) - 1
    count = np.zeros(len(ids), np.int64)
    count[order] = np.bincount(group, weights=new_page).astype(np.int64)[group]
    return count


def covered(starts: np.ndarray, length: int = LONG) -> np.ndarray:
    """For each token the greatest value of the substrings that cover it, given by their first tokens."""
    found = starts.copy()
    for back in range(1, length):  # a token is covered by the substrings that begin up to length - 1 before it
        found[back:] = np.maximum(found[back:], starts[:-back])
    return found


def repeats(ids: np.ndarray, page: np.ndarray, length: int = LONG) -> np.ndarray:
    """For each token of concatenated streams, on how many distinct pages the most widespread
    substring of ``length`` tokens that covers it occurs (0: none repeats)."""
    if len(ids) < length:
        return np.zeros(len(ids), np.int64)
    count = spread(ids, page, length)
    return covered(np.where(count > 1, count, 0), length)


class Streams:
    """Token streams of pages, given by the texts of their blocks, one after the other; a
    page ends with a token of its own. ``block`` numbers the blocks of all pages (end: -1)."""

    def __init__(self, texts: pa.Array, blocks_of: np.ndarray):
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        lengths = np.diff(split.offsets.to_numpy())
        first = np.cumsum(blocks_of) - blocks_of
        sums = np.r_[0, np.cumsum(lengths)]
        sizes = sums[first + blocks_of] - sums[first] + 1
        self.page = np.repeat(np.arange(len(sizes)), sizes)
        self.stops = np.cumsum(sizes)
        inner = np.ones(len(self.page), bool)
        inner[self.stops - 1] = False
        self.block, self.codes = np.full(len(inner), -1), np.full(len(inner), -1)
        self.block[inner], self.codes[inner] = np.repeat(np.arange(len(lengths)), lengths), coded.indices.to_numpy()
        self.distinct = coded.dictionary.to_pylist()

    @classmethod
    def of(cls, pages: list[list[str]]) -> Streams:
        return cls(pa.array([t for p in pages for t in p], pa.large_string()), np.fromiter(map(len, pages), np.int64, len(pages)))

    def ids(self) -> np.ndarray:
        ids = self.codes.copy()
        ids[self.stops - 1] = len(ids) + np.arange(len(self.stops))
        return ids

    def names(self) -> np.ndarray:
        """A 64-bit hash of the ``LONG`` tokens from each token on; only where ``whole``."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.distinct), np.uint64, len(self.distinct))
        hashes = np.r_[hashes, np.zeros(1, np.uint64)][self.codes]  # the last is that of a page's end
        names = np.zeros(len(hashes), np.uint64)
        with np.errstate(over="ignore"):  # 64-bit mixing wraps on purpose
            for k in range(min(LONG, len(names))):
                names *= np.uint64(0x9E3779B97F4A7C15)
                names[:len(names) - k] += hashes[k:]
        return names.view(np.int64)

    def whole(self) -> np.ndarray:
        """Where ``LONG`` tokens of the page are left."""
        return np.arange(len(self.page)) + LONG < self.stops[self.page]


def chosen(page_blocks: list[tuple[str, int]], outside: list[bool], inside: list[bool]) -> list[str]:
    """Texts of the blocks that stay, given which are covered by repeats outside and inside the
    main part. The main part is the page's article, else its main element, else what its
    classes name, else all; a page that would lose all of it keeps what is not chrome."""
    free = [i for i, (_, marks) in enumerate(page_blocks) if not marks & CHROME]
    for part in (ARTICLE, MAIN, CONTENT):
        if any(page_blocks[i][1] & part for i in free):
            body = [i for i in free if page_blocks[i][1] & part]
            kept = [i for i in body if not inside[i]]
            break
    else:
        body, kept = free, [i for i in free if not outside[i]]
    return [page_blocks[i][0] for i in kept or body]


def widespread(pages: list[list[str]], least: float) -> np.ndarray:
    """Names of the substrings that are on at least so many of the distinct ``pages``, ascending."""
    streams = Streams.of(pages)
    if not len(streams.page):
        return np.zeros(0, np.int64)
    return np.unique(streams.names()[streams.whole() & (spread(streams.ids(), streams.page) >= least)])


def among(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``names`` are in ``known`` (ascending)."""
    if not len(known):
        return np.zeros(len(names), bool)
    return known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names


def unique_text(pages: list[list[tuple[str, int]]], boilerplate: list[tuple[np.ndarray, np.ndarray]]) -> list[str]:
    """Main text of pages given as blocks, and for each the names of the substrings that are
    boilerplate outside and inside of the article (ascending)."""
    streams = Streams.of([[t for t, _ in p] for p in pages])
    names, whole, inner = streams.names(), streams.whole(), streams.block >= 0
    size, share = np.bincount(streams.block[inner]), []
    for known in zip(*boilerplate):
        starts = np.zeros(len(names), bool)
        for own, start, stop in zip(known, np.r_[0, streams.stops[:-1]].tolist(), streams.stops.tolist()):
            if len(own):
                starts[start:stop] = among(names[start:stop], own)
        tokens = covered(starts & whole)[inner]
        share.append((np.bincount(streams.block[inner], weights=tokens) >= COVERED * size).tolist())
    ends = np.cumsum([0, *map(len, pages)]).tolist()
    return ["\n".join(chosen(cut, *(x[lo:hi] for x in share))) for cut, lo, hi in zip(pages, ends, ends[1:])]


def main_texts(pages: list[str]) -> list[str]:
    """Main text of each page of one host."""
    cut = [blocks(p) for p in pages]
    distinct = list({tuple(t for t, _ in b): None for b in cut})
    known = tuple(widespread(distinct, max(least, part * len(distinct))) for least, part in (OUTSIDE, INSIDE))
    return unique_text(cut, [known] * len(cut))


# ---- operator ------------------------------------------------------------------------------


def host(url: Column) -> Column:
    """Host of an address, lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _parts(pages: DataFrame) -> DataFrame:
    """(host, texts, candidates, pages) of ``pages`` (host, html), staged: a row with the
    texts of the blocks of every distinct page of a part, and for each part one with the
    names of its candidates and the number of its distinct pages.

    Only hosts with more than ``PART_PAGES`` pages are counted and cut into parts, by the
    hash of their pages' texts, so that copies meet; those of one task travel once, compressed.
    """
    large = pages.groupBy("host").count().filter(F.col("count") > PART_PAGES)
    # written first, so that its size is known and the pages meet it where they are read
    parts = common.stage(large.select("host", F.ceil(F.col("count") / PART_PAGES).cast("int").alias("parts")), "parts")
    cut = pages.join(parts, "host", "left").select("host", F.coalesce("parts", F.lit(1)).alias("parts"), "html")

    def parse(batches):
        seen: set[tuple] = set()
        for batch in common.chunks(batches, "html"):
            texts = ["\n".join(t for t, _ in blocks(p)).encode() for p in common.column(batch, "html").to_pylist()]
            names = list(map(xxhash.xxh3_128_digest, texts))
            places = list(zip(common.column(batch, "host").to_pylist(), names))
            if len(seen) > 500_000:
                seen.clear()
            new = []
            for i, place in enumerate(places):
                if place not in seen:
                    seen.add(place)
                    new.append(i)
            number = common.column(batch, "parts").take(pa.array(new, pa.int64()))
            part = [int.from_bytes(names[i][:8], "little") % n for i, n in zip(new, number.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [common.column(batch, "host").take(pa.array(new, pa.int64())), number, pa.array(part, pa.int32()), pa.array([names[i] for i in new], pa.binary()), pa.array([zlib.compress(texts[i], 1) for i in new], pa.binary())],
                ["host", "parts", "part", "page", "texts"])

    def sort(group):
        packed = dict(zip(group.column("page").to_pylist(), group.column("texts").to_pylist()))
        # a block's text is never empty and has no line break
        distinct = [x.split("\n") if x else [] for x in (zlib.decompress(p).decode() for p in packed.values())]
        n, (least, share) = len(distinct), OUTSIDE
        # of several parts one may have it on a single page
        found = widespread(distinct, max(least if group.column("parts")[0].as_py() == 1 else 1, share * n - 1e-6))
        kind = pa.list_(pa.int64())
        return pa.table({
            "host": pa.array([group.column("host")[0].as_py()] * (n + 1), pa.string()), "texts": pa.array([*distinct, None], pa.list_(pa.string())),
            "candidates": pa.concat_arrays([pa.nulls(n, kind), pa.array([found], kind)]), "pages": pa.array([None] * n + [n], pa.int64())})

    # dealt by both: a join by host alone must not decide where a large host goes
    dealt = cut.mapInArrow(parse, "host string, parts int, part int, page binary, texts binary").repartition("host", "part")
    return common.stage(dealt.groupBy("host", "part").applyInArrow(sort, "host string, texts array<string>, candidates array<long>, pages long"), "streams")


def boilerplate(pages: DataFrame) -> DataFrame:
    """(host, outside, inside) of ``pages`` (host, html), staged: names of the substrings that
    are boilerplate outside and inside of a host's articles, counted over its distinct pages.

    A list has no more names than ten pages of the host have substrings.
    """
    parts = _parts(pages)
    heads = parts.filter("pages is not null").select("host", "pages", "candidates")
    sizes = heads.groupBy("host").agg(F.sum("pages").alias("pages"))
    wanted = heads.select("host", F.explode("candidates").alias("name")).groupBy("host").agg(F.array_sort(F.collect_set("name")).alias("wanted"))
    wanted = common.stage(wanted, "wanted")

    def count(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = common.column(some, "texts")
                streams = Streams(texts.flatten(), pc.list_value_length(texts).to_numpy().astype(np.int64))
                names, whole, found = streams.names(), streams.whole(), {}
                known = common.column(some, "wanted")
                for i, (host, start, stop) in enumerate(zip(common.column(some, "host").to_pylist(), np.r_[0, streams.stops[:-1]], streams.stops)):
                    own = names[start:stop][whole[start:stop]]
                    found.setdefault(host, []).append(np.unique(own[among(own, known[i].values.to_numpy())]))
                for host, lists in found.items():
                    own, n = np.unique(np.concatenate(lists), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(own), pa.string()), pa.array(own, pa.int64()), pa.array(n, pa.int64())], ["host", "name", "n"])

    on = parts.filter("pages is null").select("host", "texts").join(wanted, "host").mapInArrow(count, "host string, name long, n long")
    on = on.groupBy("host", "name").agg(F.sum("n").alias("n")).join(sizes, "host")
    enough = [F.col("n") >= F.greatest(F.lit(float(least)), F.lit(part) * F.col("pages")) for least, part in (OUTSIDE, INSIDE)]
    lists = [F.array_sort(F.collect_list(F.when(e, F.col("name")))).alias(what) for e, what in zip(enough, ("outside", "inside"))]
    return common.stage(on.filter(enough[0] | enough[1]).groupBy("host").agg(*lists), "boilerplate")


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(key, text) for ``pages`` with a column ``key``: the main text of each page."""
    session.ship_package(pages.sparkSession)
    own = pages.select("key", host(F.col(url)).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    known = boilerplate(own.select("host", "html"))

    def work(batches):
        none = np.zeros(0, np.int64)
        for batch in common.chunks(batches, "html"):
            cut = [blocks(p) for p in common.column(batch, "html").to_pylist()]
            lists = ([x.values.to_numpy() if x.is_valid else none for x in common.column(batch, c)] for c in ("outside", "inside"))
            yield pa.RecordBatch.from_arrays([common.column(batch, "key"), pa.array(unique_text(cut, list(zip(*lists))), pa.string())], ["key", "text"])

    kind = pages.schema["key"].dataType.simpleString()
    return own.join(known, "host", "left").select("key", "html", "outside", "inside").mapInArrow(work, f"key {kind}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """Main text and its length for every row of ``pages``.

    A null html counts as empty and gives an empty text; pages without a host (null or odd
    addresses) are read as one host. Repeated rows and copies of a page get the same text:
    copies count as one page when repeats are sought. Long pages are read whole. An empty
    table gives an empty result; further columns are not read.
    """
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    keyed = pages.withColumn("key", F.struct("page_id", "url"))
    found = extract(keyed)
    return found.select(F.col("key.page_id").alias("page_id"), F.col("key.url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
