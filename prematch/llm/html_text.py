"""Main text of web pages: markup to blocks, and a suffix array per host to find its boilerplate.

Every page becomes blocks of text, each in a zone that its markup gives:

    M  running text (paragraphs, headings, lists ...) of the page's article
    J  an element whose role is beyond doubt (menu, footer, advert, form, comments ...)
    A  the article, but not its running text
    S  an element whose name only hints at such a role ("share-price", "related-work")
    O  anywhere else

The streams of words of a host's pages, without M, are concatenated; suffixes
are sorted to a depth of DEPTH words, and a substring that distinct pages have is
long and repeated.  Runs go over borders of blocks.  Blocks that such substrings cover are
boilerplate and go; unique runs stay.  The markup is the check: J goes even if it is unique,
since a site's adverts and every page's comments differ, and M stays, since articles
quote and copy one another.  About A, S and O the repeats alone decide; on a host
with one page nothing repeats, and they stay.

The array is sharded: every task sorts the suffixes that it has, and sends on
one row per distinct substring of DEPTH words with the first and last page that has
it, so substrings meet over the whole host whatever its size.  Pages with the same
blocks (of M too) count as one, so a copied page does not lose its text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OTHER_BASE, WORD_BASE, Rolling, number_words, release, runs_of, signed, slices, text_buffer, word_keys, words_of, written
from .url_lists import host_of

#: Depth of the suffix array: substrings of at least so many words count as long.
DEPTH = 8
#: A block is covered if at least this share of its words is.
COVERED = 0.5
#: Verdicts on distinct streams (some hundred bytes each) up to which they are broadcast.
BROADCAST_ROWS = 50_000

# Elements and names by role.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas|audio|video|select"
JUNK_TAGS = frozenset("nav footer aside form button dialog menu head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words that name such an element, alone or as the last word of a name ("main-menu"), with words of layout behind them ("ad-box").
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner sidebar widget widgets nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager "
    "footer masthead topbar cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay share sharing social related recommended "
    "comments comment commentlist disqus replies reply toolbar".split()
)
JUNK_NAMES = frozenset("side-bar site-header page-header skip-link".split())
LAYOUT = frozenset("area bar block body bottom box button buttons cell col column container content frame group holder icon icons inner item items left link links list main outer panel primary right row secondary section slot thread top unit wrap wrapper".split())
MAIN_TAGS = frozenset(["article", "main"])
WITHOUT = ("has-", "with-", "no-", "without-", "has_", "with_", "no_")

#: Elements that hold running text.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tr td th caption figure figcaption article main center hgroup address".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?P<raw>" + RAW + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|<[!?][^>]*(?:>|$)", re.S | re.I)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _role(name: str, attrs: str, inside_main: bool) -> str:
    """"J", "S" or "" for an element: its role is beyond doubt, hinted at, or unknown."""
    if name in JUNK_TAGS or name == "header" and not inside_main:
        return "J"
    if not attrs or name in ("body", "html", "main"):
        return ""
    found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "J"
    if any(r in JUNK_ROLES for r in found.get("role", "").lower().split()):
        return "J"
    role = ""
    for given in f"{found.get('class', '')} {found.get('id', '')}".split():
        name = _CAMEL.sub("-", given).lower()
        if name.startswith(WITHOUT):
            continue
        parts = re.split(r"[-_]+", name.strip("-_"))
        junk = [k for k, x in enumerate(parts) if x in JUNK_WORDS]
        if name in JUNK_NAMES or junk and all(x in LAYOUT or x.isdigit() for x in parts[junk[-1] + 1 :]):
            return "J"
        if junk:
            role = "S"
    return role


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of a page in order; references decoded, white space in a block made one space, empty blocks left out."""
    out: list[tuple[str, str]] = []
    run: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements other than inline ones: (name, zone)
    zone = "O"

    def close() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            flows = zone != "M" or not stack or stack[-1][0] in FLOW
            out.append((zone if flows else "A", text))

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            run.append(" ")
            continue
        if name in INLINE:
            # an inline element stays in its block, unless its role is known
            role = _role(name, m["attrs"], zone == "M") if not m["end"] and zone != "J" and m["attrs"] else ""
            if role == "J":
                close()
                stack.append((name, zone))
                zone = "J"
            elif m["end"] and zone == "J" and stack and stack[-1][0] == name:
                close()
                zone = stack.pop()[1]
            elif not m["end"] and zone == "J" and stack and stack[-1][0] == name:
                stack.append((name, zone))
            continue
        close()
        if name in VOID or m["attrs"].endswith("/"):
            continue
        if not m["end"]:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                zone = stack.pop()[1]  # its end tag was left out
            stack.append((name, zone))
            if zone != "J" or name in MAIN_TAGS and next((x for x, z in reversed(stack[:-1]) if z != "J"), "") == "form":  # some sites wrap whole pages in one form
                role = _role(name, m["attrs"], zone == "M")
                if role:
                    zone = role
                elif name in MAIN_TAGS or re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", m["attrs"]):
                    zone = "M"
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    zone = stack[k][1]
                    del stack[k:]
                    break
    if at < len(page):
        run.append(page[at:])
    close()
    return out


# --- streams of pages, packed ------------------------------------------------------

_OPENER, _PACKER = zstandard.ZstdDecompressor, zstandard.ZstdCompressor


def _pack(found: list[tuple[str, str]]) -> bytes:
    return "\n".join(z + t for z, t in found).encode("utf-8", "replace")


def _unpack(raw: bytes) -> list[tuple[str, str]]:
    return [(x[0], x[1:]) for x in raw.decode().split("\n")] if raw else []


def _key(raw: bytes) -> tuple[int, int]:
    """128 bits of what a page has outside its article's running text, as two longs."""
    h = xxhash.xxh3_128_intdigest(raw)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _zoned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page_id, url, html to host, page_id, url, k1, k2 and the packed blocks."""
    packer = _PACKER(level=1)
    for batch in slices(batches):
        packed, keys = [], []
        for page in batch.column(3).to_pylist():
            found = blocks(page)
            packed.append(packer.compress(_pack(found)))
            keys.append(_key(_pack([b for b in found if b[0] != "M"])))
        cols = [*batch.columns[:3], *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["host", "page_id", "url", "k1", "k2", "packed"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html to host, k1, k2, the packed blocks outside running text, and a hash of the whole page's blocks."""
    for batch in slices(batches):
        raws, keys, pages = [], [], []
        for page in batch.column(1).to_pylist():
            found = blocks(page)
            raws.append(_pack([b for b in found if b[0] != "M"]))
            keys.append(_key(raws[-1]))
            pages.append(xxhash.xxh3_64_intdigest(_pack(found)) - (1 << 63))
        cols = [batch.column(0), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.array(raws, pa.binary()), pa.array(pages, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["host", "k1", "k2", "stream", "page"])


class Streams:
    """The words of some streams, one after another, and the hashes of their substrings of DEPTH words."""

    def __init__(self, streams: list[bytes]):
        self.blocks = [_unpack(s) for s in streams]
        data, offsets = text_buffer(pa.array([t for s in self.blocks for _, t in s], pa.string()))
        starts, ends, self.first = words_of(data, offsets)  # first word of each block
        of_stream = np.concatenate([[0], np.cumsum([len(s) for s in self.blocks])]).astype(np.int64)
        self.begin = self.first[of_stream]  # first word of each stream
        self.stream = np.repeat(np.arange(len(streams)), np.diff(self.begin))
        left = self.begin[1:][self.stream] - np.arange(len(starts)) if len(starts) else np.zeros(0, np.int64)
        self.at = np.flatnonzero(left >= DEPTH)
        self.numbers, self.left = number_words(data, starts, ends)[0], left
        self.keys = [signed(Rolling(k, base).of(self.at, self.at + DEPTH)) for k, base in zip(word_keys(data, starts, ends), (WORD_BASE, OTHER_BASE))]


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, stream, low, high (first and last page) to one row per host and distinct substring: host, w1, w2, low, high."""
    release()
    for batch in slices(batches):
        held = Streams(batch.column(1).to_pylist())
        if not len(held.at):
            continue
        hosts = batch.column(0).dictionary_encode()
        order = suffixes(held.numbers, held.at, DEPTH)
        owner = held.stream[held.at[order[0]]]
        host = hosts.indices.to_numpy()[owner]
        # the suffix array by host: equal substrings follow one another
        by = np.lexsort((order[1], host))
        rank, host, owner, place = order[1][by], host[by], owner[by], order[0][by]
        head = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (host[1:] != host[:-1])]))
        low, high = batch.column(2).to_numpy()[owner], batch.column(3).to_numpy()[owner]
        cols = [hosts.dictionary.take(pa.array(host[head])), *[pa.array(k[place[head]]) for k in held.keys], pa.array(np.minimum.reduceat(low, head)), pa.array(np.maximum.reduceat(high, head))]
        yield pa.RecordBatch.from_arrays(cols, ["host", "w1", "w2", "low", "high"])


def suffixes(numbers: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the places ``at``, sorted to a depth: (indices into at in order, the rank of each of these)."""
    rank = runs_of(numbers, depth)[at]
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, k1, k2, stream to a row for each place: host, k1, k2, at, w1, w2."""
    release()
    for batch in slices(batches):
        held = Streams(batch.column(3).to_pylist())
        if not len(held.at):
            continue
        owner = held.stream[held.at]
        take, at = pa.array(owner), (held.at - held.begin[owner]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(3)], pa.array(at), *[pa.array(k) for k in held.keys]], ["host", "k1", "k2", "at", "w1", "w2"])


def covered_blocks(sizes: list[int], at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which blocks (of so many words) of a stream are covered by substrings that begin at the given words."""
    edge = np.zeros(sum(sizes) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + depth, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return np.diff(inside[cuts]) >= COVERED * np.maximum(np.diff(cuts), 1)


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, k1, k2, stream, places to host, k1, k2 and a byte for each block: 1 if it is covered."""
    for batch in slices(batches):
        out = []
        for stream, at in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            # words as the streams have them
            sizes = [len(t.encode().split()) for _, t in _unpack(stream)]
            out.append(covered_blocks(sizes, np.array(at or [], np.int64)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["host", "k1", "k2", "covered"])


def main_text(found: list[tuple[str, str]], covered: bytes) -> tuple[str, int, int]:
    """(main text, blocks, blocks covered by repeats) of a page's blocks, with a byte for each one outside running text."""
    kept, flags = [], iter(covered)
    for zone, text in found:
        repeated = zone != "M" and next(flags, 0)
        if zone == "M" or zone != "J" and not repeated:
            kept.append(text)
    return "\n".join(kept), len(found), sum(covered)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_blocks", pa.int32()), ("n_repeated", pa.int32())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opener = _OPENER()
    for batch in slices(batches):
        made = [main_text(_unpack(opener.decompress(p)), c or b"") for p, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        cols = [*batch.columns[:2], *[pa.array([m[k] for m in made], t) for k, t in enumerate(_SCHEMA.types[2:])]]
        yield pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


# --- on Spark ----------------------------------------------------------------------


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_repeated of every row of pages (page_id, url, html).

    text is the main text as described above: character references decoded,
    white space within a block made one space, blocks joined by one newline in
    page order.  Null or empty html gives an empty text; a null URL, or one
    without a host, belongs to the host of empty name; repeated rows come back
    each time and count as one page; an empty table gives an empty result;
    other columns are ignored.  n_repeated counts the blocks that repeats cover, of those outside running text.
    """
    host = F.coalesce(host_of(F.col("url").cast("string")), F.lit(""))
    named = pages.select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    key = ["host", "k1", "k2"]
    seen = named.select("host", "html").mapInArrow(_streams, "host string, k1 long, k2 long, stream binary, page long")
    streams = written(seen.groupBy(*key).agg(F.first("stream").alias("stream"), F.min("page").alias("low"), F.max("page").alias("high")), "streams")
    parts = streams.select("host", "stream", "low", "high").mapInArrow(_substrings, "host string, w1 long, w2 long, low long, high long")
    repeated = parts.groupBy("host", "w1", "w2").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("host", "w1", "w2")
    repeated = written(repeated, "repeats")
    places = streams.select(*key, "stream").mapInArrow(_places, "host string, k1 long, k2 long, at int, w1 long, w2 long")
    found = places.join(repeated, ["host", "w1", "w2"], "left_semi").groupBy(*key).agg(F.collect_list("at").alias("at"))
    judged = streams.select(*key, "stream").join(found, key, "left").select(*key, "stream", "at").mapInArrow(_verdicts, "host string, k1 long, k2 long, covered binary")
    judged = written(judged, "verdicts")
    whole = named.mapInArrow(_zoned, "host string, page_id long, url string, k1 long, k2 long, packed binary")
    small = judged.count() <= broadcast_rows
    met = whole.join(F.broadcast(judged) if small else judged, key, "left").select("page_id", "url", "packed", "covered")
    made = met.mapInArrow(_texts, "page_id long, url string, text string, n_blocks int, n_repeated int")
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_repeated")
