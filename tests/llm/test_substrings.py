import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from fixtures import documents, texts

from prematch.llm import rlz
from prematch.llm.common import number_words, text_buffer, word_keys, words_of


def order(row):
    """By doc_id; rows without one first, by Spark's hash of their text."""
    i, text = row
    if i is None:
        (h,) = SparkSession.getActiveSession().createDataFrame([(text or "",)], "t string").select(F.xxhash64("t")).first()
        return (0, h & ((1 << 62) - 1), text is not None, text or "")
    return (1, i, text is not None, text or "")


def brute(rows, window=20):
    """Per row in order: (n_words, n_removed, kept words)."""
    seen, out = set(), []
    for i, text in sorted(rows, key=order):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=str)


def parsed(df, **options):
    return rlz.parse_corpus(df, **options).collect()


def test_against_brute_force(docs):
    got = parsed(docs, layout="words")
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text or "") for r in got), key=str) == brute(texts())
    assert [r.kept_text for r in got if r.doc_id == 300] == [None]


def test_few_words_many_repeats(spark):
    """A small vocabulary, so that windows overlap, repeat in one document and differ at their edges."""
    rng = random.Random(1)
    base = [rng.choice("abc") for _ in range(400)]
    rows = []
    for i in range(40):
        a = rng.randrange(300)
        rows.append((i, " ".join(base[a : a + rng.randrange(90)] + [rng.choice("abcdef") for _ in range(rng.randrange(40))] + base[a : a + rng.randrange(60)])))
    got = parsed(documents(spark, rows, 5), layout="words")
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows)


def test_hot_anchors_go_by_cells(spark):
    """A passage that all batches have: its anchors are told apart, and the result is the same."""
    from fixtures import prose

    common = prose("everywhere", 60)
    rows = [(i, f"{prose(i, 20 + i % 9)} {common if i % 3 else common[: 150 + i]} {prose(('b', i), 25)}") for i in range(90)]
    frame = documents(spark, rows, 4)
    dealt, _, batches, _ = rlz.in_batches(frame.select("doc_id", "text"), 1000)
    assert batches > 20 and rlz.hot_anchors(dealt, batches, rlz.WINDOW, 6) and not rlz.hot_anchors(dealt, batches, rlz.WINDOW, batches)
    for hot_rows in (6, rlz.HOT_ROWS):
        got = parsed(frame, layout="words", batch_bytes=1000, hot_rows=hot_rows)
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(brute(rows))


def test_factors_are_copies(docs):
    words = {}
    for i, t in texts():
        words.setdefault(i, []).append((t or "").split())
    for r in parsed(docs):
        for f in r.factors:
            mine = [w[f.start : f.start + f.length] for w in words[r.doc_id]]
            theirs = [w[f.ref_start : f.ref_start + f.length] for w in words[f.ref_doc]]
            assert f.length >= 20 and any(m == t and len(m) == f.length for m in mine for t in theirs)


def test_text_layout_and_carried_columns(docs):
    got = parsed(docs, layout="text", carry=["batch", "hash"])
    by = {r.doc_id: r for r in got}
    source = dict(texts())
    assert all(r.kept_text == source[i] for i, r in by.items() if i is not None and i < 24 and not r.n_removed)
    assert by[3].carried.batch.startswith("batch") and by[302].kept_text == " \n\t "
    assert by[201].kept_text == "" and by[201].n_removed == 60


def test_empty(empty):
    assert parsed(empty) == []


def test_word_table():
    data, offsets = text_buffer(pa.array(["ab cd", None, "\tef", "", "gh"]))
    starts, ends, first = words_of(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cd", b"ef", b"gh"]
    assert first.tolist() == [0, 2, 2, 3, 3, 4]
    assert len(np.unique(word_keys(data, starts, ends)[0])) == 4


def thue_morse(n):
    """The word of n letters and its complement: sums of powers modulo 2^64 can't tell them apart from 2^10 letters on."""
    odd = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)


@pytest.mark.parametrize("n", [1 << 10, 1 << 11, 1 << 12])
def test_crafted_words_are_told_apart(spark, n):
    one, other = thue_morse(n)
    data, offsets = text_buffer(pa.array([f"{one} {other} {one} x", f"{other}x {other}"]))
    starts, ends, _ = words_of(data, offsets)
    for key in word_keys(data, starts, ends):
        assert len(np.unique(key)) == 4
    number, first, _ = number_words(data, starts, ends)
    assert number[0] == number[2] != number[1] and number[1] == number[5] and len(first) == 4
    rest = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}")]
    got = parsed(documents(spark, rows), layout="words")
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute(rows)


def test_numbers_where_keys_collide(monkeypatch):
    from prematch.llm import common

    monkeypatch.setattr(common, "word_keys", lambda data, starts, ends, lanes: [np.zeros(len(starts), np.uint64)])
    data, offsets = text_buffer(pa.array(["ab cd ab", "cd abcdefghij abcdefghik"]))
    starts, ends, _ = words_of(data, offsets)
    assert common.number_words(data, starts, ends)[0].tolist() == [0, 1, 0, 1, 2, 3]


def test_removal_comes_from_factors(docs):
    """Without factors and their boundaries nothing is removed; with them, each removed word lies under one or runs over its end."""
    for r in parsed(docs, layout="words"):
        under = sum(f.length for f in r.factors)
        assert (r.n_removed == 0) == (under == 0) and under <= r.n_removed <= under + 19 * len(r.factors)
        ends = [(f.start, f.start + f.length) for f in r.factors]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_window_length(docs):
    with pytest.raises(ValueError):
        rlz.parse_corpus(docs, window=8)
