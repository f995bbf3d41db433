"""Benchmark decontamination by greedy string tiling.

Seeds (runs of LEAST words) that a document shares with a test item bring the
pair together; running Karp-Rabin hashes find them.  Then the longest match of
unmarked words is marked again and again until none of LEAST words is left,
and the share of the item's words under tiles decides.  Tiles may lie in any
order, so reordered passages count in full.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BASE, Rolling, same_bytes, slices, text_buffer, word_keys, words_of, written

#: Words of a seed, and least length of a tile.
LEAST = 5
#: A document is contaminated by an item if tiles cover this share of the item's words.
COVERAGE = 0.5
#: Text bytes of the items that are sent to the executors at once; larger benchmarks go in blocks.
BLOCK_BYTES = 16 << 20


def normal(column: pa.Array) -> pa.Array:
    """Lower-case words of letters and digits, with one space between them."""
    return pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.string())), pattern=r"[^\p{L}\p{N}]+", replacement=" ")


def tiles(matches: list[tuple[int, int, int]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiling of maximal matches (item position, text position, length): the longest unmarked one first, then by positions."""
    heap = [(-n, i, j) for i, j, n in matches]
    heapq.heapify(heap)
    item, text, out = set(), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [k for k in range(n) if i + k not in item and j + k not in text]
        if len(free) == n:
            out.append((i, j, n))
            item.update(range(i, i + n))
            text.update(range(j, j + n))
            continue
        # marked in part: what is left of it competes again
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= least:
                    heapq.heappush(heap, (-(k - start), i + free[start], j + free[start]))
                start = k
    return out


def maximal(item_at: np.ndarray, text_at: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Seed hits of one pair, joined along diagonals to maximal matches."""
    order = np.lexsort((item_at, text_at - item_at))
    i, j = item_at[order], text_at[order]
    new = np.ones(len(i), bool)
    new[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(i))) + least - 1
    return [(int(a), int(b), int(n)) for a, b, n in zip(i[head], j[head], size)]


class Items:
    """Seeds of distinct item texts, sorted by hash, with the bytes that confirm them."""

    def __init__(self, texts: list[str]):
        self.keys = [hashlib.md5(t.encode()).digest() for t in texts]
        self.data, offsets = text_buffer(normal(pa.array(texts, pa.string())))
        starts, ends, first = words_of(self.data, offsets)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        at = np.flatnonzero(first[1:][doc] - np.arange(len(starts)) >= LEAST)
        hashes = Rolling(word_keys(self.data, starts, ends, 1)[0], WORD_BASE).of(at, at + LEAST)
        order = np.argsort(hashes, kind="stable")
        self.words = np.diff(first)
        self.hashes, self.item, self.at = hashes[order], doc[at][order], (at - first[doc[at]])[order]
        self.begin, self.size = starts[at][order], (ends[at + LEAST - 1] - starts[at])[order]
        bits = max(16, int(len(self.hashes) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.hashes >> self.shift] = True

    def parts(self) -> dict:
        return self.__dict__

    @classmethod
    def of(cls, parts: dict) -> Items:
        self = cls.__new__(cls)
        self.__dict__.update(parts)
        return self


_ROWS = "doc_id long, _key binary, item_words int, covered int, n_tiles int, longest int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("_key", pa.binary()), ("item_words", pa.int32()), ("covered", pa.int32()), ("n_tiles", pa.int32()), ("longest", pa.int32())])


def tile_batch(texts: pa.Array, items: Items, coverage: float) -> list[tuple]:
    """(index of the text, key of the item's text, item_words, covered, n_tiles, longest) of the pairs whose coverage suffices."""
    data, offsets = text_buffer(normal(texts))
    starts, ends, first = words_of(data, offsets)
    if not len(starts) or not len(items.hashes):
        return []
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    at = np.flatnonzero(first[1:][doc] - np.arange(len(starts)) >= LEAST)
    hashes = Rolling(word_keys(data, starts, ends, 1)[0], WORD_BASE).of(at, at + LEAST)
    maybe = np.flatnonzero(items.maybe[hashes >> items.shift])
    low, high = np.searchsorted(items.hashes, hashes[maybe], "left"), np.searchsorted(items.hashes, hashes[maybe], "right")
    count = high - low
    if not count.sum():
        return []
    seed = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    text_at = np.repeat(at[maybe], count)
    # equal hashes are seeds only if the words are equal
    size = ends[text_at + LEAST - 1] - starts[text_at]
    sure = np.flatnonzero(size == items.size[seed])
    sure = sure[same_bytes(data, starts[text_at[sure]], items.data, items.begin[seed[sure]], size[sure])]
    if not len(sure):
        return []
    seed, text_at = seed[sure], text_at[sure]
    item, item_at = items.item[seed], items.at[seed]
    order = np.lexsort((item_at, item, doc[text_at]))
    text_at, item, item_at = text_at[order], item[order], item_at[order]
    owner = doc[text_at]
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (item[1:] != item[:-1])) + 1
    rows = []
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(owner)]):
        n = int(items.words[item[s]])
        # words that any tiling could cover at most
        most = (np.minimum(np.diff(np.unique(item_at[s:e]), append=n + LEAST), LEAST)).sum()
        if most < coverage * n:
            continue
        found = tiles(maximal(item_at[s:e], text_at[s:e] - first[owner[s]]))
        covered = sum(t[2] for t in found)
        if covered >= coverage * n:
            rows.append((int(owner[s]), items.keys[item[s]], n, covered, len(found), max(t[2] for t in found)))
    return rows


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[Items]]:
    """How many blocks of about so many bytes the benchmark's distinct texts make, and these."""
    texts = benchmark.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // block_bytes))
    return blocks, (Items(sorted(r["text"] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect())) for k in range(blocks))


def _each_block(docs: DataFrame, benchmark: DataFrame, block_bytes: int, step, schema) -> Iterator[DataFrame]:
    """docs through ``step`` (items, batch -> batches) with each block of the benchmark in turn.

    One block at a time is held: with several, each result is written before the next block is sent out.
    """
    blocks, each = _blocks(benchmark, block_bytes)
    for items in each:
        shared = docs.sparkSession.sparkContext.broadcast(items.parts())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = Items.of(shared.value)
            for piece in slices(batches):
                yield from step(held, piece)

        made = docs.mapInArrow(run, schema)
        if blocks > 1:
            made = written(made, "tiled")
            shared.destroy()
        given = yield made
        docs = docs if given is None else given


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_words, covered, n_tiles, longest and coverage of every pair that reaches the threshold.

    docs (doc_id, text) are read once per block of the benchmark's (item_id,
    text) distinct texts, and never shuffled; the pairs found are joined with
    the items.  Words are runs of letters and digits in lower
    case.  Null or empty texts, and items of fewer than LEAST words, give no
    pair; rows with null ids give pairs with null ids; repeated rows of either
    table give a pair each; an empty table gives an empty result; other columns are ignored.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def step(items: Items, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = piece.column(0).to_pylist()
        rows = [(ids[i], *r) for i, *r in tile_batch(piece.column(1), items, coverage)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    found = reduce(DataFrame.unionByName, _each_block(named, benchmark, block_bytes, step, _ROWS))
    ids = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.unhex(F.md5(F.col("text").cast("string").cast("binary"))).alias("_key")).where("_key is not null")
    pairs = found.join(ids, "_key").withColumn("coverage", F.col("covered") / F.col("item_words"))
    return pairs.select("doc_id", "item_id", "item_words", "covered", "n_tiles", "longest", "coverage")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates (as ``contaminated`` finds it); null texts stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def step(items: Items, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        stay = np.ones(piece.num_rows, bool)
        stay[[r[0] for r in tile_batch(piece.column(1), items, coverage)]] = False
        yield piece.filter(pa.array(stay))

    # what one block leaves is the next one's input
    passes = _each_block(rows, benchmark, block_bytes, step, rows.schema)
    kept = next(passes)
    while True:
        try:
            kept = passes.send(kept)
        except StopIteration:
            return kept.select("row.*")
