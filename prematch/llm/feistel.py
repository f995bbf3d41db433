"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered in order of (doc_id, size, crc); a keyed Feistel network
with cycle walking permutes 0..n-1; position p goes to shard p mod shards,
slot p div shards.  Place and row can be computed from one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prematch.sources.shared import numbered

from .common import mixed

ROUNDS = 6


class Permutation:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int = 0):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mixed(np.uint64(key & ((1 << 64) - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & self.mask)
        return (right << np.uint64(self.half)) | left  # the halves swapped, so that reversed keys undo it

    def _walk(self, rows, keys: np.ndarray) -> np.ndarray:
        """Apply the network until each value is below n again."""
        x = np.atleast_1d(np.asarray(rows)).astype(np.uint64)
        if len(x) and int(x.max()) >= self.n:
            raise ValueError("row number out of range")
        x = self._once(x, keys)
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def place(self, rows) -> np.ndarray:
        """Positions of row numbers."""
        return self._walk(rows, self.keys)

    def row(self, places) -> np.ndarray:
        """Row numbers at positions."""
        return self._walk(places, self.keys[::-1])


def crc_table() -> list[int]:
    """The 256 steps of CRC-32 by its reflected polynomial, for the SQL."""
    table = []
    for step in range(256):
        for _ in range(8):
            step = step >> 1 ^ (0xEDB88320 if step & 1 else 0)
        table.append(step)
    return table


def shards(docs: DataFrame, shards: int = 8, key: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row of docs (doc_id, text).

    size is the UTF-8 bytes of the text plus 1, text_crc32 its unsigned CRC-32
    (null text: none, so 1 and 0).  Shards differ by one row at most, slots
    are gapless from 0.  The same rows, key and shard count give the same
    result in any order and partitioning; rows alike in doc_id, size and crc are
    interchangeable; null doc_ids number first.  An empty table gives an empty
    result.  Other columns are ignored.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    rows, n = numbered(facts, ["doc_id", "size", "text_crc32"])
    network = Permutation(n, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = network.place(batch.column(3).to_numpy())
            made = [pa.array((place % shards).astype(np.int32)), pa.array(place // shards)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "shard", "slot"])

    return rows.select("doc_id", "size", "text_crc32", "row_number").mapInArrow(run, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")
