"""Substring dedup by relative Lempel-Ziv parsing against a sharded index of the whole corpus.

The reference is the corpus itself, in order of (doc_id, position).  Each
document is cut into content-defined blocks: a block is the longest run of
``window``-word windows whose smallest 8-word phrase (the anchor) is the same
one.  Equal windows have equal anchors, so an index by anchor, over the blocks
of all documents, finds every earlier occurrence of every window.

1. Index: every batch of documents puts one row per distinct anchor in it.
   An anchor seen with one block text only settles the block at once: all its
   windows are copies of the first occurrence.
2. Boundaries: blocks under an anchor that is also seen with another block
   text (a repeated passage ends or starts inside) are looked up window by
   window.
3. Parse: greedily from left to right, a factor starts at a word whose window
   also occurs earlier, goes on as long as its source does, and the parse
   jumps to its end.  Factors have at least ``window`` words and are duplicate
   spans; at the end of each the windows that run over it are checked too, as
   the next factor only begins behind it.

Batches resolve repeats inside them before they shuffle anything, so an index
key has at most one row per batch, however often a passage occurs.  Where there
are so many batches that this is too much for one task, anchors that most of a sample of batches have are aggregated
apart, from partial results, and their rows meet those in cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, OTHER_BASE, WORD_BASE, Rolling, first_of_each, in_batches, mixed, release, signed, text_buffer, word_keys, words_of

WINDOW, ANCHOR = 20, 8
_COPY, _ASK = 1, 2
#: Rows of one index key that one task may hold: with up to so many batches there is nothing to look for.
HOT_ROWS = 100_000
#: Batches that are looked at for hot anchors, and how many of these are told apart at most; hot ones beyond are only slower.
SAMPLE_BATCHES, HOT_ANCHORS = 64, 10_000


class _Batch:
    """Words, blocks and windows of one batch of documents, in order of (doc_id, row)."""

    def __init__(self, docs: pa.Table, window: int):
        docs = docs.combine_chunks()
        ids = docs.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        if len(ids) > 1 and (ids[1:] == ids[:-1]).any() or (np.diff(ids[order]) == 0).any():
            # rows that share a doc_id: in order of their text, whichever way they came
            texts = docs.column("text").to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] is not None, texts[i] or "")), np.int64)
        if (order != np.arange(len(order))).any():
            docs = docs.take(pa.array(order))
        self.docs, self.ids, self.window = docs, docs.column("doc_id").to_numpy(), window
        self.data, self.offsets = text_buffer(docs.column("text"))
        self.starts, self.ends, self.first_word = words_of(self.data, self.offsets)
        n = len(self.starts)
        self.n_words = np.diff(self.first_word)
        self.doc_of_word = np.repeat(np.arange(len(self.ids)), self.n_words)
        self._blocks(n)

    def _blocks(self, n: int) -> None:
        window, spread = self.window, self.window - ANCHOR + 1
        index = np.arange(n)
        left = self.first_word[1:][self.doc_of_word] - index if n else index  # words from here to the document's end
        # phrases and windows are hashed from independent keys of the words, so that an anchor with a block or window is 128 bits
        keys, others = word_keys(self.data, self.starts, self.ends)
        rolled, self.rolled = Rolling(keys, WORD_BASE), Rolling(others, OTHER_BASE)
        phrase = np.full(n + window, np.iinfo(np.uint64).max, np.uint64)
        there = np.flatnonzero(left >= ANCHOR)
        phrase[there] = rolled.of(there, there + ANCHOR)
        self.starts_at = at = np.flatnonzero(left >= window)  # windows, by the word they start at
        least = phrase[at].copy()
        for k in range(1, spread):
            np.minimum(least, phrase[at + k], out=least)
        anchor = np.zeros(len(at), np.int64)
        for k in range(spread - 1, -1, -1):  # the leftmost of equal ones
            hit = phrase[at + k] == least
            anchor[hit] = at[hit] + k
        new = np.ones(len(at), bool)
        if len(at):
            new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        self.block_from = np.flatnonzero(new)  # index into windows
        self.block_len = np.diff(np.append(self.block_from, len(at)))
        self.block_of = np.cumsum(new) - 1
        s = at[self.block_from]
        self.anchor = least[self.block_from]
        offset = (anchor[self.block_from] - s).astype(np.uint64)
        self.block = mixed(self.rolled.of(s, s + self.block_len - 1 + window) ^ offset)
        # inside this batch: the first block with the same anchor and text, and whether the anchor has several texts
        self.same, kind = first_of_each(self.anchor, self.block)
        self.anchor_first, group = first_of_each(self.anchor)
        texts = np.zeros(len(group) + 1, np.int64)
        is_first = self.same == np.arange(len(self.same))
        np.add.at(texts, group[is_first], 1)
        self.several = texts[group] > 1 if len(group) else np.zeros(0, bool)

    def place(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and position in its document of words given by index."""
        doc = self.doc_of_word[words]
        return self.ids[doc], (words - self.first_word[doc]).astype(np.int32)

    def index_rows(self) -> pa.Table:
        """One row per anchor: its block and first place; no block if it has several."""
        rows = np.flatnonzero(self.anchor_first == np.arange(len(self.anchor_first)))
        ids, pos = self.place(self.starts_at[self.block_from[rows]])
        return pa.table({"anchor": signed(self.anchor[rows]), "block": pa.array(signed(self.block[rows]), mask=self.several[rows]), "doc_id": ids, "start": pos})

    def settle(self, answers: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """With the index's answers: (answer row or -1 for each block's anchor, which blocks are asked window by window)."""
        found = _lookup(answers["key"], signed(self.anchor))
        ask = self.several.copy()
        known = found >= 0
        ask[known] |= answers["kind"][found[known]] == _ASK
        return found, ask

    def asked_windows(self, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (indices) of the first copies of blocks under question, and the hash of each."""
        is_first = self.same == np.arange(len(self.same))
        windows = np.flatnonzero((ask & is_first)[self.block_of]) if len(self.block_of) else np.zeros(0, np.int64)
        at = self.starts_at[windows]
        return windows, self.rolled.of(at, at + self.window)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index into keys (distinct) for each wanted value, -1 if absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    order = np.argsort(keys, kind="stable")
    at = np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)
    return np.where(keys[order][at] == wanted, order[at], -1)


def _answers(table: pa.Table, stage: int) -> dict[str, np.ndarray]:
    cols = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("stage", "key", "kind", "ref_doc", "ref_start")}
    mine = cols.pop("stage") == stage
    return {c: v[mine] for c, v in cols.items()}


_INDEX_ROWS = "anchor long, block long, doc_id long, start int"
_WINDOW_ROWS = "hash long, anchor long, doc_id long, start int"


def _parsed() -> T.StructType:
    return T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start:int,length:int,ref_doc:long,ref_start:int>>")


def _beginning():
    """A call that collects, once per task, what earlier tasks left behind."""
    begun: list = []

    def begin() -> None:
        if not begun:
            release()
            begun.append(True)

    return begin


def _indexer(window: int):
    begin = _beginning()

    def index(table: pa.Table) -> pa.Table:
        begin()
        batch = _Batch(table, window)
        made = batch.index_rows()
        del batch
        release(False)
        return made

    return index


def _asker(window: int):
    schema = pa.schema([("hash", pa.int64()), ("anchor", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32())])

    begin = _beginning()

    def ask(docs: pa.Table, answered: pa.Table) -> pa.Table:
        begin()
        if not docs.num_rows:
            return schema.empty_table()
        batch = _Batch(docs, window)
        _, asked = batch.settle(_answers(answered, 1))
        windows, hashes = batch.asked_windows(asked)
        anchors = batch.anchor[batch.block_of[windows]]
        first, _ = first_of_each(hashes, anchors)
        mine = np.flatnonzero(first == np.arange(len(first)))
        ids, pos = batch.place(batch.starts_at[windows[mine]])
        made = pa.table({"hash": signed(hashes[mine]), "anchor": signed(anchors[mine]), "doc_id": ids, "start": pos}, schema=schema)
        del batch
        release(False)
        return made

    return ask


def _parser(window: int, layout: str, carry: bool):
    factor = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("factors", pa.list_(factor))])

    begin = _beginning()

    def parse(docs: pa.Table, answered: pa.Table) -> pa.Table:
        begin()
        if not docs.num_rows:
            return (schema.append(docs.schema.field("carried")) if carry else schema).empty_table()
        batch = _Batch(docs, window)
        copied, ref_doc, ref_start = _sources(batch, _answers(answered, 1), _answers(answered, 2))
        at = batch.starts_at[copied]
        head, length = _greedy(batch, at, ref_doc[copied], ref_start[copied])
        gone = _spans(batch, at, at[head], length)
        per_doc = np.concatenate([[0], np.cumsum(gone)])[batch.first_word]
        _, pos = batch.place(at[head])
        owners = batch.doc_of_word[at[head]]
        lists = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owners, np.arange(len(batch.ids) + 1)).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(length.astype(np.int32)), pa.array(ref_doc[copied][head], pa.int64()), pa.array(ref_start[copied][head], pa.int32())], fields=list(factor)),
        )
        made = pa.table({"doc_id": batch.ids, "n_words": batch.n_words.astype(np.int64), "n_removed": np.diff(per_doc).astype(np.int64), "kept_text": _kept(batch, gone, layout), "factors": lists}, schema=schema)
        if carry:
            made = made.append_column(batch.docs.schema.field("carried"), batch.docs.column("carried"))
        del batch
        release(False)
        return made

    return parse


def _greedy(batch: _Batch, at: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greedy parse: (index into the copied windows of each factor's first, words of each factor).

    at: first words of the copied windows, ascending, with their earliest places.  From each position the factor goes on as long as its
    source does; the next one is sought behind its end, and words without a source are stepped over.
    """
    goes_on = np.zeros(len(at), bool)
    if len(at):
        goes_on[1:] = (at[1:] == at[:-1] + 1) & (ref_doc[1:] == ref_doc[:-1]) & (ref_start[1:] == ref_start[:-1] + 1) & (batch.doc_of_word[at[1:]] == batch.doc_of_word[at[:-1]])
    chain = np.cumsum(~goes_on) - 1
    last = (np.append(np.flatnonzero(~goes_on)[1:], len(at)) - 1)[chain] if len(at) else chain
    end = at[last] + batch.window if len(at) else at  # of the factor that begins at each window
    jump = np.searchsorted(at, end).tolist()
    head, k = [], 0
    while k < len(jump):
        head.append(k)
        k = jump[k]
    head = np.array(head, np.int64)
    return head, end[head] - at[head]


def _spans(batch: _Batch, at: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words go: those under factors, and at the end of each factor those under copied windows that run over it."""
    cover = np.zeros(len(batch.starts) + 1, np.int32)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + length, -1)
    if len(at):
        factor = np.searchsorted(first, at, "right") - 1
        over = at[at + batch.window > (first + length)[factor]]
        np.add.at(cover, over, 1)
        np.add.at(cover, over + batch.window, -1)
    return np.cumsum(cover[:-1]) > 0


def _sources(batch: _Batch, index: dict, asked: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that also start earlier (indices, ascending), and the earlier place of every window (defined for those)."""
    n = len(batch.starts_at)
    copied, ref_doc, ref_start = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int32)
    found, ask = batch.settle(index)
    blocks = np.arange(len(batch.same))
    inside = np.arange(n) - batch.block_from[batch.block_of] if n else np.zeros(0, np.int64)  # windows before this one in its block

    def point_back(windows: np.ndarray, first: np.ndarray) -> None:
        copied[windows] = True
        ref_doc[windows], ref_start[windows] = batch.place(batch.starts_at[first])

    again = np.flatnonzero((batch.same != blocks)[batch.block_of]) if n else np.zeros(0, np.int64)
    point_back(again, batch.block_from[batch.same[batch.block_of[again]]] + inside[again])
    # the index knows an earlier copy of the whole block
    settled = (found >= 0) & ~ask
    if settled.any():
        kind = np.zeros(len(found), np.int8)
        kind[settled] = index["kind"][found[settled]]
        windows = np.flatnonzero((kind == _COPY)[batch.block_of])
        row = found[batch.block_of[windows]]
        copied[windows] = True
        ref_doc[windows], ref_start[windows] = index["ref_doc"][row], index["ref_start"][row] + inside[windows]
    # window by window
    windows, hashes = batch.asked_windows(ask)
    if len(windows):
        anchors = batch.anchor[batch.block_of[windows]]
        first, _ = first_of_each(hashes, anchors)
        repeat = first != np.arange(len(first))
        point_back(windows[repeat], windows[first[repeat]])
        row = _lookup(asked["key"], signed(hashes))
        known = row >= 0
        copied[windows[known]] = True
        ref_doc[windows[known]], ref_start[windows[known]] = asked["ref_doc"][row[known]], asked["ref_start"][row[known]]
    return np.flatnonzero(copied), ref_doc, ref_start


def _kept(batch: _Batch, gone: np.ndarray, layout: str) -> pa.Array:
    """Texts of the words that stay: joined by one space ("words"), or with the white space before each as it was ("text")."""
    data, size = batch.data.copy(), len(batch.data)
    if layout == "words":
        edge = np.zeros(size + 1, np.int8)
        stay = np.flatnonzero(~gone)
        edge[batch.starts[stay]] += 1
        edge[batch.ends[stay]] -= 1
        take = np.cumsum(edge[:-1], dtype=np.int8) > 0
        if len(stay) > 1:
            follows = batch.doc_of_word[stay[1:]] == batch.doc_of_word[stay[:-1]]
            gaps = batch.ends[stay[:-1]][follows]
            take[gaps] = True
            data[gaps] = 0x20
    else:
        take = np.ones(size, bool)
        out = np.flatnonzero(gone)
        if len(out):
            before = np.where(out == batch.first_word[batch.doc_of_word[out]], batch.offsets[batch.doc_of_word[out]], batch.ends[np.maximum(out - 1, 0)])
            edge = np.zeros(size + 1, np.int8)
            np.add.at(edge, before, 1)
            np.add.at(edge, batch.ends[out], -1)
            take = np.cumsum(edge[:-1], dtype=np.int32) == 0
    sizes = np.concatenate([[0], np.cumsum(take)])[batch.offsets].astype(np.int32)
    made = pa.StringArray.from_buffers(len(batch.ids), pa.py_buffer(sizes.tobytes()), pa.py_buffer(data[take].tobytes()))
    texts = batch.docs.column("text")
    return pc.if_else(pc.is_valid(texts.combine_chunks()), made, pa.scalar(None, pa.string())) if texts.null_count else made


def hot_anchors(dealt: DataFrame, batches: int, window: int, hot_rows: int) -> list[int]:
    """Anchors that, by a sample of batches, have over hot_rows rows in the index; none if there can't be such."""
    if batches <= hot_rows:
        return []
    every = max(1, batches // SAMPLE_BATCHES)
    rows = dealt.where(F.col("batch") % every == 0).groupBy("batch").applyInArrow(_indexer(window), _INDEX_ROWS)
    counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * every > hot_rows)
    return [r["anchor"] for r in counts.orderBy(F.col("n").desc(), "anchor").limit(HOT_ANCHORS).collect()]


def _with_group(rows: DataFrame, key: list[str], made: dict, hot: list[int], batch, cells: int) -> DataFrame:
    """rows with aggregates of all rows of their key; rows of hot anchors are spread over cells."""
    by = Window.partitionBy(*key)
    if not hot:
        return rows.select("*", *[a.over(by).alias(n) for n, a in made.items()])
    is_hot = F.col("anchor").isin(hot)
    cold = rows.where(~is_hot).select("*", *[a.over(by).alias(n) for n, a in made.items()])
    groups = rows.where(is_hot).groupBy(*key).agg(*[a.alias(n) for n, a in made.items()]).withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    met = rows.where(is_hot).withColumn("_cell", F.pmod(batch, F.lit(cells))).join(groups, [*key, "_cell"])
    return cold.unionByName(met.select(*cold.columns))


def parse_corpus(docs: DataFrame, window: int = WINDOW, layout: str = "text", carry: list[str] | None = None, batch_bytes: int = BATCH_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Parse every document of docs (doc_id, text) against the whole corpus and cut out what also starts earlier.

    Returns doc_id, n_words, n_removed, kept_text and factors (start, length,
    ref_doc, ref_start; in words).  A word goes if some ``window`` consecutive
    words around it also start earlier: in a smaller doc_id, or earlier in the
    same document.  Null text has no words, and null as kept_text; a row
    with a null doc_id is a document of its own; these sort first, by a hash of the text (ids below -2^62 stand for them and can't be given).  Documents shorter than a window stay whole.
    Rows that share a doc_id are separate documents, ordered by text (a
    repeated row is removed as a copy).  Of other columns, those named in carry
    come along in a struct ``carried``; an empty table gives an empty result.
    layout "words" joins what is kept by single spaces, "text" keeps the white
    space before every kept word.
    """
    if window <= ANCHOR:
        raise ValueError(f"a window must be longer than {ANCHOR} words")
    # rows without an id get one below all others, so that they are dealt out too
    own = F.lit(-(1 << 63)) + F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    named = [F.coalesce(F.col("doc_id").cast("long"), own).alias("doc_id"), F.col("text").cast("string").alias("text")]
    if carry:
        named.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"))
    dealt, parts, batches, batch = in_batches(docs.select(*named), batch_bytes)
    hot, cells = hot_anchors(dealt, batches, window, hot_rows), -(-batches // hot_rows)
    rows = dealt.groupBy("batch").applyInArrow(_indexer(window), _INDEX_ROWS)
    place = F.min(F.struct("doc_id", "start"))
    made = {"n": F.count(F.lit(1)), "n_blocks": F.count("block"), "least": F.min("block"), "most": F.max("block"), "ref": place}
    seen = _with_group(rows, ["anchor"], made, hot, batch, cells).where("n > 1 and block is not null")
    ask = (F.col("n_blocks") < F.col("n")) | (F.col("least") != F.col("most"))
    first = (F.col("ref.doc_id") == F.col("doc_id")) & (F.col("ref.start") == F.col("start"))
    known = seen.where(ask | ~first).select(
        batch, F.lit(1).alias("stage"), F.col("anchor").alias("key"), F.when(ask, _ASK).otherwise(_COPY).alias("kind"), F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start")
    )
    known = known.repartition(parts, "batch")
    asked = dealt.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(_asker(window), _WINDOW_ROWS)
    later = _with_group(asked, ["hash", "anchor"], {"ref": place}, hot, batch, cells).where((F.col("ref.doc_id") != F.col("doc_id")) | (F.col("ref.start") != F.col("start")))
    found = later.select(batch, F.lit(2).alias("stage"), F.col("hash").alias("key"), F.lit(_COPY).alias("kind"), F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start"))
    answers = known.unionByName(found).repartition(parts, "batch")
    parsed = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_parser(window, layout, bool(carry)), T.StructType([*_parsed().fields, *dealt.schema.fields[3:]]))
    least = F.lit(-(1 << 62))
    made = parsed.withColumn("doc_id", F.when(F.col("doc_id") >= least, F.col("doc_id")))
    known = lambda f: F.struct(f["start"].alias("start"), f["length"].alias("length"), F.when(f["ref_doc"] >= least, f["ref_doc"]).alias("ref_doc"), f["ref_start"].alias("ref_start"))
    return made.withColumn("factors", F.transform("factors", known))
