"""Packing by lexical retrieval: seed documents fill windows with their BM25 neighbours out of the whole corpus.

1. Every document is tokenized once, and the tokens are written to the shared folder.
2. Document frequencies of all token ids, over the whole corpus, make the term
   statistics: one number per vocabulary entry, a size that the corpus doesn't change.
3. Every document whose id is divisible by SEED_EVERY is a seed.  The corpus is
   an index in shards of SHARD_DOCS documents, each with the BM25 weights of its terms; every
   shard is asked with all seeds, in blocks of bounded size.  A document that
   several seeds find goes to the one it scores highest with, so it is used once.
4. Documents are ordered by (seed, score) and dealt out in ranges of that order.
   A seed and then its neighbours, the best first, fill windows; the last document of a window
   is cut, and its rest starts the next one, so only the last window of a task is padded.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import forget, number_words, release, same_bytes, shuffle_parts, slices, text_buffer, words_of, written

WINDOW, END = 2048, 1
#: Documents that ask, those whose id it divides, and documents of one shard of the index.
SEED_EVERY, SHARD_DOCS = 100, 512
#: Bytes of the matrix that a block of seeds makes in a task, and of the tokens of the seeds that are sent out at once.
BLOCK_BYTES, GROUP_BYTES = 96 << 20, 64 << 20
K1, B = 1.2, 0.75
#: Parts of words whose ids a task remembers, before it starts anew.
CACHE_PARTS = 500_000
#: Tokens that one task packs, at most about, and windows, at least about: it pads one of them.
TASK_TOKENS, TASK_WINDOWS = 16 << 20, 64


def vocabulary_path(path: str | None = None) -> str:
    """The tokenizer's file: the given one, or that of the public vocabularies."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_LETTER, _DIGIT, _OTHER, _WHOLE = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _unplain(data: np.ndarray) -> np.ndarray:
    """Positions that keep a word from being cut: an apostrophe, the start of a special token, and characters over 127
    other than the letters U+00C0 to U+024F that have one lower-case letter."""
    before = np.concatenate([[0], data[:-1]])
    high = (data >= 0x80) & ((data < 0xC3) | (data > 0xC9)) & ((data >= 0xC0) | (before < 0x80) | (before == 0xC2))
    sign = ((before == 0xC3) & ((data == 0x97) | (data == 0xB7))) | ((before == 0xC4) & (data == 0xB0)) | ((before == 0xC9) & (data > 0x8F))
    return np.flatnonzero(high | (data >= 0xCA) | (data == 0xC2) | sign | (data == 0x27) | ((before == 0x3C) & (data == 0x7C)))


class Words:
    """Ids of texts from the ids of their parts, each distinct part looked up once.

    The tokenizer drops white space, lower-cases, and splits text into runs of
    letters, single digits and runs of other signs before its model sees them; so
    a word is cut there first.  A word with an apostrophe, a special token or
    a character that isn't plain goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.tokenize, self.bytes = tokenizer.encode, tokenizer.model.tokenize, "".join(byte_letters())
        self.forget()

    def forget(self) -> None:
        """Start with END alone.  Known parts, by ascending key: their bytes (in the pool) and ids (in the table)."""
        self.known = np.zeros(0, np.uint64)
        self.lies, self.long, self.begin, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.pool, self.table = np.zeros(0, np.uint8), np.array([END], "<u2")

    def look_up(self, part: bytes, letters: bool) -> list[int]:
        """Ids of a run of plain letters, which is one piece for the model, or of anything else, by the whole tokenizer."""
        if not letters:
            return self.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids
        piece = part.decode() if part.isascii() else part.decode().lower().encode().decode("latin-1").translate(self.bytes)
        return [t.id for t in self.tokenize(piece)]

    def _ids_of(self, parts: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of parts into the table: (where, how many)."""
        found = [self.look_up(*p) for p in parts]
        size = np.fromiter(map(len, found), np.int64, len(found))
        begin = len(self.table) + np.cumsum(size) - size
        self.table = np.concatenate([self.table, np.fromiter(chain.from_iterable(found), np.uint16, int(size.sum()))])
        return begin, size

    def _known(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where each part is among the known ones, by its bytes; -1 if it is not."""
        if not len(self.known):
            return np.full(len(starts), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        same = (self.known[at] == keys) & (self.long[at] == ends - starts)
        hit = np.flatnonzero(same)
        same[hit] = same_bytes(low, starts[hit], self.pool, self.lies[at[hit]], self.long[at[hit]])
        return np.where(same, at, -1)

    def _learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, letters: np.ndarray) -> None:
        """Add parts whose keys are distinct and not known."""
        order = np.argsort(keys)
        starts, ends, letters = starts[order], ends[order], letters[order]
        raw = [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        begin, size = self._ids_of(list(zip(raw, letters.tolist())))
        long = ends - starts
        at = np.searchsorted(self.known, keys[order])
        for name, new in {"known": keys[order], "lies": len(self.pool) + np.cumsum(long) - long, "long": long, "begin": begin, "size": size}.items():
            setattr(self, name, np.insert(getattr(self, name), at, new))
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(raw), np.uint8)])

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, class of each byte): words cut into parts, lower-case but for those that stay whole."""
        starts, ends, _ = words_of(data, offsets)
        kind, low = _CLASS[data], _LOWER[data]
        odd = np.unique(np.searchsorted(starts, _unplain(data), "right") - 1)
        whole = np.zeros(len(data) + 1, np.int8)
        whole[starts[odd]] += 1
        whole[ends[odd]] -= 1
        whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
        kind[whole], low[whole] = _WHOLE, data[whole]
        first = np.ones(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        first[starts] = True  # words of two documents may touch
        first &= kind > 0
        begins = np.flatnonzero(first)
        # a part ends where the next one begins or its word ends
        word_end = ends[np.searchsorted(starts, begins, "right") - 1] if len(begins) else begins
        return low, begins, np.minimum(np.append(begins[1:], len(data)), word_end), kind

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a buffer, END after each; how many each has)."""
        low, starts, ends, kind = self.parts(data, offsets)
        which, one, keys = number_words(low, starts, ends)
        if len(self.known) > CACHE_PARTS:
            self.forget()
        own = (low, starts[one], ends[one])
        letters = kind[own[1]] == _LETTER
        fresh = np.arange(len(keys))
        if len(self.known):
            fresh = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)] != keys)
        if (keys[1:] <= keys[:-1]).any():  # parts that share a key
            fresh = fresh[np.unique(keys[fresh], return_index=True)[1]]
        self._learn(low, own[1][fresh], own[2][fresh], keys[fresh], letters[fresh])
        at = self._known(*own, keys)
        begins, sizes = np.append(self.begin[at], 0), np.append(self.size[at], 1)
        odd = np.flatnonzero(at < 0)  # shares its key with another part
        if len(odd):
            begins[odd], sizes[odd] = self._ids_of([(low[a:b].tobytes(), k) for a, b, k in zip(own[1][odd].tolist(), own[2][odd].tolist(), letters[odd].tolist())])
        closes = np.searchsorted(starts, offsets[1:])
        which = np.insert(which, closes, len(one))  # END closes each document
        n = sizes[which]
        total = np.cumsum(n)
        flat = self.table[np.repeat(begins[which] - total + n, n) + np.arange(total[-1] if len(total) else 0)]
        return flat, np.diff(total[closes + np.arange(len(closes))], prepend=0)


def terms_of(ids: np.ndarray) -> np.ndarray:
    """Distinct ids, ascending."""
    ordered = np.sort(ids)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new]


def _tokenizer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        for piece in slices(batches, 1024):
            flat, n = words.ids(*text_buffer(piece.column(1)))
            cuts = np.concatenate([[0], np.cumsum(n)])
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((2 * cuts).tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([piece.column(0), packed.cast(pa.binary()), pa.array(n)], ["doc_id", "ids", "n"])

    return run


def tokenized(docs: DataFrame, path: str) -> tuple[DataFrame, int]:
    """doc_id, ids (16-bit little-endian, END at the end) and n of every row (null text: END alone), and the vocabulary size."""
    size = Tokenizer.from_file(path).get_vocab_size()
    if size > 1 << 16:
        raise ValueError("token ids must fit 16 bits")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(_tokenizer(path), "doc_id long, ids binary, n long"), size


def _counter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        df = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                df[terms_of(np.frombuffer(ids.as_buffer(), "<u2"))] += 1
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(df[has])], ["id", "df"])

    return run


class Terms:
    """The statistics of the whole corpus, and BM25 weights of documents by them."""

    def __init__(self, df: np.ndarray, docs: int, mean: float):
        self.idf = np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.idf[END] = 0  # ends every document, and is no term of any
        self.mean = mean

    def weights(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(the terms that some documents have, ascending; a row for each document with a column for each of these)."""
        length = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
        terms = np.flatnonzero(np.bincount(flat, minlength=len(self.idf)))
        column = np.zeros(len(self.idf), np.int64)
        column[terms] = np.arange(len(terms))
        tf = np.bincount(np.repeat(np.arange(len(docs)) * len(terms), length) + column[flat], minlength=len(docs) * len(terms)).reshape(len(docs), len(terms)).astype(np.float32)
        norm = (K1 * (1 - B + B * length / self.mean)).astype(np.float32)[:, None]
        return terms, self.idf[terms] * tf * np.float32(K1 + 1) / (tf + norm)


class Seeds:
    """What a block of seeds asks with: their own weights, of length 1 each, so that no seed draws documents by its length alone."""

    def __init__(self, terms: Terms, seeds: list[np.ndarray]):
        known, weights = terms.weights(seeds)
        length = np.sqrt((weights * weights).sum(1, keepdims=True))
        self.by_term = np.ascontiguousarray((weights / np.maximum(length, np.float32(1e-9))).T)
        self.row = np.full(len(terms.idf), -1, np.int64)
        self.row[known] = np.arange(len(known))

    def best(self, terms: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document of a shard (its terms and weights): the seed that it scores highest with, and that score; the first of equal ones."""
        met = self.row[terms] >= 0
        scores = shard[:, met] @ self.by_term[self.row[terms[met]]]
        scores = np.rint(scores * np.float32(4096)) / np.float32(4096)  # sums of floats differ a little with the shape of a shard
        best = scores.argmax(1)
        return best, scores[np.arange(len(best)), best]


def _finder(shared):
    """Columns doc_id, ids, n, seed, score: with the better one of the seed so far and those of some blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        (df, docs, mean), blocks = shared.value
        terms = Terms(df, docs, mean)
        made: list[Seeds] = []  # kept if there is one block, else one at a time for each batch
        for batch in batches:
            best, high = batch.column(3).fill_null(0).to_numpy().copy(), batch.column(4).to_numpy(zero_copy_only=False).copy()
            texts = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(1)]
            for names, ids in blocks:
                seeds = made[0] if made else Seeds(terms, [np.frombuffer(x, "<u2") for x in ids])
                if len(blocks) == 1 and not made:
                    made.append(seeds)
                    release(False)
                names = np.array(names, np.int64)
                for at in range(0, len(texts), SHARD_DOCS):
                    to = slice(at, at + SHARD_DOCS)
                    found, score = seeds.best(*terms.weights(texts[to]))
                    take = (score > high[to]) | (score == high[to]) & (score > 0) & (names[found] < best[to])
                    best[to], high[to] = np.where(take, names[found], best[to]), np.where(take, score, high[to])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best, mask=high <= 0), pa.array(high, pa.float64())], ["doc_id", "ids", "n", "seed", "score"])
        release(False)

    return run


def claimed(tokens: DataFrame, df: np.ndarray, docs: int, mean: float, every: int = SEED_EVERY, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """tokens (doc_id, ids, n) with the seed that claims each row and the score; null and 0 if it shares no term with any.

    A row whose doc_id is divisible by ``every`` is a seed and its own.  Seeds go out
    in groups of about group_bytes, one at a time, each a pass over the tokens; a task turns
    them into matrices of about block_bytes, one at a time.
    """
    spark = tokens.sparkSession
    seeds = tokens.where(F.col("doc_id") % every == 0).groupBy("doc_id").agg(F.min("ids").alias("ids"))
    a_block = max(1, block_bytes // (4 * max(1, int((df > 0).sum()))))
    groups = -(-(seeds.agg(F.sum(F.octet_length("ids")).alias("b")).first()["b"] or 0) // group_bytes)
    own = F.col("doc_id") % every == 0
    rows = tokens.select("doc_id", "ids", "n", F.when(own, F.col("doc_id")).alias("seed"), F.when(own, F.lit(float("inf"))).otherwise(0.0).alias("score"))
    for k in range(groups):
        group = seeds.where(F.pmod(F.xxhash64("doc_id"), F.lit(groups)) == k).orderBy("doc_id").collect()
        if not group:
            continue
        blocks = [group[i : i + a_block] for i in range(0, len(group), a_block)]
        shared = spark.sparkContext.broadcast(((df, docs, mean), [([r["doc_id"] for r in b], [bytes(r["ids"]) for r in b]) for b in blocks]))
        found = written(rows.mapInArrow(_finder(shared), "doc_id long, ids binary, n long, seed long, score double"), "claimed")
        shared.destroy()
        forget(rows)
        rows = found
    return rows


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def fill(docs: Iterator[tuple[int, np.ndarray]], sequence: int, window: int = WINDOW) -> Iterator[tuple]:
    """Pieces (as in ``pack``) of documents (doc_id, ids) laid one after another into windows numbered from ``sequence``."""
    used = 0
    for doc_id, ids in docs:
        at, whole = 0, ids.astype("<u4").tobytes()
        while at < len(ids):
            take = min(window - used, len(ids) - at)
            yield doc_id, at, take, zlib.crc32(whole[4 * at : 4 * (at + take)]), len(ids), sequence, used
            at += take
            used += take
            if used == window:
                used, sequence = 0, sequence + 1


def _packer(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        task: list[int] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                if batch.num_rows and not task:
                    task.append(batch.column(0)[0].as_py())
                yield from ((i, np.frombuffer(x.as_buffer(), "<u2")) for i, x in zip(batch.column(1).to_pylist(), batch.column(2)))

        docs, held = rows(), []
        first = next(docs, None)
        if first is None:
            return
        for piece in fill(chain([first], docs), task[0] << 40, window):
            held.append(piece)
            if len(held) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_SCHEMA)
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_SCHEMA)

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, every: int = SEED_EVERY) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and END; null or empty text is END alone.  Each id is
    in exactly one piece; a sequence holds ``window`` tokens, but for the last
    one of each task.  Rows that no seed claims (no term shared with any, or a table without seeds)
    come after all others, by doc_id.  Repeated rows are packed each time, with the doc_id they have (null too);
    an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = vocabulary_path(path)
    tokens, size = tokenized(docs, path)
    tokens = written(tokens, "tokens")
    totals = tokens.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).first()
    counted = tokens.select("ids").mapInArrow(_counter(size), "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(size, np.int64)
    df[[r["id"] for r in counted]] = [r["df"] for r in counted]
    rows = claimed(tokens, df, max(1, totals["docs"]), max(1.0, (totals["n"] or 0) / max(1, totals["docs"])), every)
    if hasattr(rows, "_written_at"):  # else rows still reads them
        forget(tokens)
    n = totals["n"] or 0
    tasks = max(1, math.ceil(n / TASK_TOKENS), min(shuffle_parts(spark), n // (TASK_WINDOWS * window)))
    order = [F.col("seed").asc_nulls_last(), F.col("score").desc(), F.col("doc_id").asc(), F.col("n").asc()]
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "ids")
    return ordered.select(F.spark_partition_id().alias("task"), "doc_id", "ids").mapInArrow(_packer(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
