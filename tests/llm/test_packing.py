import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from fixtures import documents, prose, texts
from tokenizers import Tokenizer

from prematch.llm import bm25_packing as P
from prematch.llm.common import text_buffer

TOKENIZER = Tokenizer.from_file(P.vocabulary_path())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_are_the_tokenizers():
    odd = ["", "Hello, World!!", None, "it's DON'T we'll 'tis x's", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "Éa ÇA ñÑ ü×÷ 12³ ½ ÀÉ#é", "ΑΣ σ İstanbul ıIİ", "á é#́ 1́", "“quoted” — dash … ’s it’s", "日本語 テスト#かな 한국어", "\x00\x01 a\x7fb \xa0nb sp x\x1cy", "💡bulb💡1 2️⃣", "a1b22c3", "###*** &&&%$ <|", "ª º µ ŉ ǅ ǆ Ⱥ Ⱦ ɏ ɐ ß ẞ"]
    rng = random.Random(5)
    odd += ["".join(rng.choice("abZÉéßñ'’<|>#*.,1²3 \t\ń 日İıΣ×÷ɏɐ💡&-_") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    flat, n = P.Words(P.vocabulary_path()).ids(*text_buffer(pa.array(odd, pa.string())))
    cuts = np.concatenate([[0], np.cumsum(n)])
    assert all(flat[a:b].tolist() == ids_of(t) for a, b, t in zip(cuts, cuts[1:], odd))


def check(pieces, rows, window=2048):
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(ids_of(t))
    for i, g in pieces.groupby("doc_id", dropna=False):
        options = by[None if i != i else int(i)]
        for r in g.itertuples():
            assert any(len(o) == r.doc_tokens and zlib.crc32(np.array(o[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for o in options)
        assert g.length.sum() == sum(map(len, options))
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate([[0], np.cumsum(g.length)])[:-1].tolist() and g.length.sum() <= window


def test_pack(docs, spark):
    pieces = P.pack(docs).toPandas()
    check(pieces, texts())
    used = pieces.groupby("sequence_id").length.sum()
    assert (used == 2048).sum() >= len(used) - 2
    check(P.pack(documents(spark, texts()[::-1], 6)).toPandas(), texts())


def bm25(rows, every):
    """By brute force: (score of each row with each seed, seeds by row number)."""
    ids = [ids_of(t)[:-1] for _, t in rows]
    size = [len(x) + 1 for x in ids]
    mean, n = sum(size) / len(size), len(rows)
    df = Counter(t for x in ids for t in set(x))

    def weights(k):
        norm = P.K1 * (1 - P.B + P.B * size[k] / mean)
        return {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * (P.K1 + 1) / (f + norm) for t, f in Counter(ids[k]).items()}

    w = [weights(k) for k in range(n)]
    seeds = {i: k for k, (i, _) in enumerate(rows) if i is not None and i % every == 0}
    length = {s: math.sqrt(sum(x * x for x in w[k].values())) or 1.0 for s, k in seeds.items()}
    return [{s: sum(x * w[r][t] for t, x in w[k].items() if t in w[r]) / length[s] for s, k in seeds.items()} for r in range(n)]


def claims(spark, rows, every, *sizes):
    tokens = P.written(P.tokenized(documents(spark, rows), P.vocabulary_path())[0], "t")
    df = np.zeros(1 << 16, np.int64)
    for r in tokens.collect():
        df[np.unique(np.frombuffer(r.ids, "<u2"))] += 1
    total = sum(len(ids_of(t)) for _, t in rows)
    return {r.doc_id: (r.seed, r.score) for r in P.claimed(tokens, df, len(rows), total / len(rows), every, *sizes).collect()}


def test_every_document_goes_to_its_best_seed_of_the_whole_corpus(spark):
    rows = [(i, prose(i % 40, 30 + i % 7) + " " + prose(("own", i), 20)) for i in range(160)] + [(1000, None), (1001, ""), (1003, None)]
    want = bm25(rows, 10)
    for sizes in ((P.BLOCK_BYTES, P.GROUP_BYTES), (4_000, P.GROUP_BYTES), (P.BLOCK_BYTES, 500), (4_000, 1000)):  # all seeds at once, in many blocks, in many groups
        got = claims(spark, rows, 10, *sizes)
        assert len(got) == len(rows)
        for (i, _), scores in zip(rows, want):
            seed, score = got[i]
            if i % 10 == 0:
                assert seed == i and score == math.inf
            elif max(scores.values()) == 0:
                assert seed is None and score == 0
            else:
                assert abs(scores[seed] - max(scores.values())) < 2e-3 and abs(score - scores[seed]) < 2e-3


def test_windows_follow_their_seeds(spark):
    rows = [(i, prose(i % 20, 200)) for i in range(100)]
    pieces = P.pack(documents(spark, rows), 256, every=20).toPandas()
    check(pieces, rows, 256)
    order = [int(i) for i in dict.fromkeys(pieces.sort_values(["sequence_id", "offset"]).doc_id)]
    # copies of a seed follow it at once
    at = {i: k for k, i in enumerate(order)}
    assert all({order[at[s] + k] for k in range(5) if at[s] + k < len(order)} >= {s} for s in range(0, 100, 20))


def test_without_seeds(spark):
    rows = [(i, prose(i, 50)) for i in range(1, 30)]
    check(P.pack(documents(spark, rows), 128).toPandas(), rows, 128)


def test_parts_with_equal_keys(monkeypatch):
    from prematch.llm import common

    texts = ["ab cd ab", "efg ab 12 é", "abba " * 3]
    monkeypatch.setattr(common, "word_keys", lambda data, starts, ends, lanes: [np.zeros(len(starts), np.uint64)])
    words = P.Words(P.vocabulary_path())
    for _ in range(2):  # learnt, and known
        flat, n = words.ids(*text_buffer(pa.array(texts)))
        cuts = np.concatenate([[0], np.cumsum(n)])
        assert all(flat[a:b].tolist() == ids_of(t) for a, b, t in zip(cuts, cuts[1:], texts))


def test_crafted_words():
    odd = [bin(i).count("1") % 2 for i in range(1 << 11)]
    one, other = "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)
    texts = [f"{one} {other}", other, one]
    flat, n = P.Words(P.vocabulary_path()).ids(*text_buffer(pa.array(texts)))
    cuts = np.concatenate([[0], np.cumsum(n)])
    assert all(flat[a:b].tolist() == ids_of(t) for a, b, t in zip(cuts, cuts[1:], texts))


def test_empty(empty):
    assert P.pack(empty).count() == 0
