"""Pieces that several operators share: tables, shared-folder tables, batches, hot keys, word hashes."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prematch.sources.shared import forget, written  # noqa: F401  for the operators

#: A key counts as hot above this share of all rows, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1000
#: Text bytes that one Python task holds at a time.
BATCH_BYTES = 2 << 20
#: Text bytes of all the batches that one task works through, at least as many tasks as shuffle partitions.
TASK_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- batches and hot keys --------------------------------------------------------


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def in_batches(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int, int, Column]:
    """docs (doc_id, text, ...) with a column ``batch`` (by a hash of doc_id) before them, dealt out by it; also how many partitions and batches it has, and the batch of a doc_id.

    There are as many batches as the text bytes call for.  The frame is meant to be used several times within one plan: Spark then
    shuffles the text once and reads that exchange again.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(2, shuffle_parts(spark), math.ceil(total / TASK_BYTES))
    batches = max(parts, math.ceil(total / batch_bytes))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    return docs.select(batch, "*").repartition(parts, "batch"), parts, batches, batch


def join_hot(big: DataFrame, small: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """Equi-join whose hot keys (at most 1 / HOT_SHARE, as ``hot_keys`` finds them) go by broadcast and all others by shuffle.

    small holds one row per key, so the broadcast part has at most len(hot) rows.
    """
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = big.where(~is_hot).join(small.where(~is_hot), key, how)
    return cold.unionByName(big.where(is_hot).join(F.broadcast(small.where(is_hot)), key, how))


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: float = HOT_SHARE, least: int = 100) -> tuple[list, int]:
    """Keys with over ``share`` of all rows (so fewer than 1 / share), and the number of rows; counts has one row per key."""
    total = counts.agg(F.sum(n).alias("t")).first()["t"] or 0
    found = counts.where((F.col(n) > max(least, total * share)) & F.col(key).isNotNull()).select(key).limit(math.ceil(1 / share)).collect()
    return [r[key] for r in found], total


# --- words and their hashes, without a Python loop over words ---------------------


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_binary())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words ``[^\\x20\\x09-\\x0D]+``, and for each document the index of its first word (one more at the end)."""
    solid = ~_SPACE[data]
    at_start, at_end = solid.copy(), solid.copy()
    at_start[1:] &= ~solid[:-1]
    at_end[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    at_start[edges] = solid[edges]
    at_end[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(at_start), np.flatnonzero(at_end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = 1 << max(10, (n - 1).bit_length())
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


class Rolling:
    """Karp-Rabin hashes of any run of a sequence of 64-bit values, from one pass of prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


WORD_BASE, OTHER_BASE = 0xAF251AF3B0F025B5, 0xD1342543DE82EF95
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: For a word's last bytes: the bits that are its own.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on (zeros beyond the end) as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 2) -> list[np.ndarray]:
    """Independent 64-bit hashes of each word's bytes, one per lane.

    Eight bytes at a time go through a bijection, so no pattern of repeats (as
    with sums of powers) makes two words alike in both lanes.
    """
    size, view = ends - starts, eights(data)
    here = view[starts] & _OWN[np.minimum(size, 8)]
    keys = [mixed((mixed(size.astype(np.uint64) ^ c) ^ here) * c + c) for c in _LANES[:lanes]]
    live = np.flatnonzero(size > 8)
    at, left = starts[live] + 8, size[live] - 8
    while len(live):
        here = view[at] & _OWN[np.minimum(left, 8)]
        for key, c in zip(keys, _LANES):
            key[live] = mixed((key[live] ^ here) * c + c)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return keys


def same_bytes(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the ``size`` bytes from x_at in x those from y_at in y?"""
    a = eights(x)
    b = a if x is y else eights(y)
    same = (a[x_at] ^ b[y_at]) & _OWN[np.minimum(size, 8)] == 0
    live, at = np.flatnonzero(same & (size > 8)), 8
    while len(live):
        here = (a[x_at[live] + at] ^ b[y_at[live] + at]) & _OWN[np.minimum(size[live] - at, 8)]
        same[live[here != 0]] = False
        at += 8
        live = live[(here == 0) & (size[live] > at)]
    return same


def number_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a number for each word, one word of each number, the keys of those): equal numbers mean equal bytes, which are compared."""
    (key,) = word_keys(data, starts, ends, 1)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    first, size = one[number], ends - starts
    if not ((size == size[first]).all() and same_bytes(data, starts, data, starts[first], size).all()):
        # words that share a key: told apart by their bytes
        raw, known = data.tobytes(), {}
        number = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)
        one = np.unique(number, return_index=True)[1]
    return number, one, key[one]


def runs_of(number: np.ndarray, length: int) -> np.ndarray:
    """A number for the run of ``length`` values from each place on: equal for equal runs, without hashes.

    Ranks are doubled in length; runs that would leave the sequence count as followed by nothing.
    """
    n, size, rank = len(number), 1, number
    while size < length:
        step = min(size, length - size)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
        size += step
    return rank


def release(collect: bool = True) -> None:
    """Give freed memory back to the system: Python workers live on between tasks and share an executor's memory.

    Functions that came with earlier tasks, and the tables they made, hang together in cycles; only a collection frees them.
    """
    if collect:
        gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows of batches in smaller ones, so that little is held as Python objects at a time."""
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release(False)


def first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order: the index of the first row with the same keys, for each row, and a number for each distinct key tuple."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])  # stable
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    number = np.cumsum(new) - 1
    firsts = order[np.flatnonzero(new)]
    first, group = np.empty(n, np.int64), np.empty(n, np.int64)
    first[order] = firsts[number]
    group[order] = number
    return first, group


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
