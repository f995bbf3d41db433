import random

from fixtures import documents, prose

from prematch.llm import string_tiling as S


def brute_tiles(item, text, least=5):
    """Mark the longest common run of unmarked words until none of ``least`` is left; of equals the first by item, then text position."""
    a, b, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and a[i + n] and b[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        out.append((i, j, n))
        a[i : i + n], b[j : j + n] = [False] * n, [False] * n


def test_tiling_against_brute_force(spark):
    rng = random.Random(3)
    items, docs = [], []
    for k in range(12):
        item = [rng.choice("abcdefg") for _ in range(rng.randint(5, 30))]
        cut = rng.randrange(len(item))
        text = [rng.choice("abcdefgh") for _ in range(10)] + item[cut:] + [rng.choice("abcdefgh") for _ in range(5)] + item[:cut]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(text)))
    got = {(r.doc_id, r.item_id): (r.covered, r.n_tiles) for r in S.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), coverage=0.01).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            found = brute_tiles(item.split(), text.split())
            if found and sum(t[2] for t in found) >= 0.01 * len(item.split()):
                want[d, i] = (sum(t[2] for t in found), len(found))
    assert got == want


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_leaks(spark):
    item = prose("item", 40)
    words = item.split()
    docs = [(1, prose(1) + " " + item + " " + prose(2)), (2, prose(3)), (3, " ".join(words[20:] + prose(4, 9).split() + words[:20])), (4, item.upper().replace(" ", ", ")), (5, None), (6, ""), (7, " ".join(words[:12])), (1, item), (None, item)]
    for size in (16 << 20, 10):  # at once, and in many blocks
        got = S.contaminated(documents(spark, docs), bench(spark, [(9, item), (10, prose("other", 40)), (11, None), (12, "a b"), (13, "")]), block_bytes=size).collect()
        assert sorted((str(r.doc_id), r.item_id, r.coverage) for r in got) == [("1", 9, 1.0), ("1", 9, 1.0), ("3", 9, 1.0), ("4", 9, 1.0), ("None", 9, 1.0)]
    kept = S.clean(documents(spark, docs), bench(spark, [(9, item)]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7] and kept.columns == documents(spark, docs).columns


def test_empty(spark, docs, empty):
    assert S.contaminated(empty, bench(spark, [(1, prose(0))])).count() == 0
    assert S.contaminated(docs, bench(spark, [])).count() == 0
    assert S.clean(docs, bench(spark, [])).count() == docs.count()
