import zlib

import numpy as np
import pytest
from fixtures import documents, texts

from prematch.llm import feistel


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(n):
    p = feistel.Permutation(n, 7)
    places = p.place(np.arange(n))
    assert sorted(places) == list(range(n)) and (p.row(places) == np.arange(n)).all()
    assert n < 17 or (places != feistel.Permutation(n, 8).place(np.arange(n))).any()
    with pytest.raises(ValueError):
        p.place([n])


def test_shards(docs, spark):
    got = feistel.shards(docs).toPandas()
    rows = texts()
    n = len(rows)
    want = sorted((str(float(i)) if i is not None else "nan", len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(float(i)), s, c) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32)) == want
    sizes = got.groupby("shard").size()
    assert sizes.sum() == n and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    # where a row lies can be computed, and the order of the input doesn't matter
    place = feistel.Permutation(n, 20240229).place(got.row_number.to_numpy())
    assert (place % 8 == got.shard).all() and (place // 8 == got.slot).all()
    again = feistel.shards(documents(spark, rows[::-1], 7)).toPandas()
    key = ["row_number", "size", "text_crc32", "shard", "slot"]
    assert got.sort_values("row_number")[key].values.tolist() == again.sort_values("row_number")[key].values.tolist()


def test_empty(empty):
    assert feistel.shards(empty).count() == 0
