import numpy as np
import xxhash
from fixtures import documents, prose, texts

from prematch.llm import graph, simhash


def fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_against_brute_force(docs):
    rows = [(i, fingerprint(t)) for i, t in texts()]
    pairs = [(a, b) for a, x in enumerate(rows) for b, y in enumerate(rows) if a < b and (x[1] ^ y[1]).bit_count() <= 2]
    group = components(range(len(rows)), pairs)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    want = sorted(((i, f, least.get(group[k])) for k, (i, f) in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.bits & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_tiles_cut_in_pieces(spark):
    rng, base = np.random.default_rng(0), 0x123456789ABCDEF0
    values = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(500)})
    bits = np.array(values, np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None]) <= 2
    want = components(range(len(bits)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    frame = spark.createDataFrame([(int(v), i) for i, v in enumerate(bits.view(np.int64))], "bits long, node long")
    for piece in (4096, 16, 3):
        got = {r.node: r.component for r in graph.components(simhash.links(frame, piece)).collect()}
        assert {n: got.get(n, n) for n in want} == want


def test_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) if i % 2 else (i, i + 1) for i in range(n)] + [(1000, 1001), (1000, 1000)], "a long, b long")
    for one_task in (0, graph.ONE_TASK):
        got = {r.node: r.component for r in graph.components(edges, one_task=one_task).collect()}
        assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_large_stars(spark):
    rows = [(10 * (i % 3), 1000 + i) for i in range(6000)] + [(0, 10), (1000, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(rows, "a long, b long"), one_task=0).collect()}
    assert got == components(sorted({x for r in rows for x in r}), rows)


def test_rows_that_share_an_id(spark):
    """Two unlike texts under one doc_id are two documents: neither takes part in the other's links."""
    a, z = prose("a", 60), prose("z", 60)
    rows = [(5, a), (5, z), (8, z), (3, a), (None, prose("n", 60)), (None, prose("n", 60))]
    got = sorted(((r.doc_id, r.bits & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    fa, fz, fn = map(fingerprint, (a, z, prose("n", 60)))
    assert (fa ^ fz).bit_count() > 2
    assert got == sorted([(5, fa, 3), (5, fz, 5), (8, fz, 5), (3, fa, 3), (None, fn, None), (None, fn, None)], key=str)


def test_representatives(docs):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids.count(401) == 2 and len(ids) == len(set(ids)) + 1  # unlike texts under one id
    assert {200, 300, 400} <= set(ids) and not {201, 202, 203, 301, 302} & set(ids)
    assert set(range(24)) <= set(ids)


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0


def test_one_long_text():
    text = " ".join(f"w{i % 977}" for i in range(70000))
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def test_order_does_not_matter(spark):
    rows = texts()
    a = sorted(map(str, simhash.near_duplicates(documents(spark, rows, 2)).collect()))
    assert a == sorted(map(str, simhash.near_duplicates(documents(spark, rows[::-1], 5)).collect()))


def words_apart(text, at):
    words = text.split()
    for k in at:
        words[k] = f"other{k}"
    return " ".join(words)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike_rows():
    rows = []
    for g in range(12):
        base = prose(("alike", g), 60 + 40 * g)
        rows += [(100 * g + k, words_apart(base, [(17 * j + 5 * k) % (50 + 40 * g) for j in range(k)])) for k in range(7)]
    return rows


def test_similar_documents_against_brute_force(spark):
    rows = alike_rows()
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    # the radius of the query finds few of them
    assert sum((fingerprint(dict(rows)[a]) ^ fingerprint(dict(rows)[b])).bit_count() > 2 for a, b in pairs) > len(pairs) / 2
    want = components(sets, pairs)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), 5, 24, 0.8).collect()}
    assert got == want and len(set(want.values())) < len(rows)


def test_large_components_in_pieces(spark):
    """Sets of one component of candidates, many pieces: chains, groups of copies and strangers; the classes are those of all pairs."""
    rng = np.random.default_rng(5)
    sets = []
    for g in range(6):
        base = rng.integers(0, 1 << 40, 60)
        for k in range(12):  # a chain: neighbours alike, ends not
            base = base.copy()
            base[rng.choice(60, 4, replace=False)] = rng.integers(0, 1 << 40, 4)
            sets.append(np.unique(base.astype(np.uint64)))
    sets += [np.unique(np.append(sets[0][:50], rng.integers(0, 1 << 40, 3).astype(np.uint64))) for _ in range(30)]
    sets += [np.unique(rng.integers(0, 1 << 40, 40).astype(np.uint64)) for _ in range(20)]
    near = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) - 1e-9
    want = components(range(len(sets)), [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if near(sets[i], sets[j])])
    assert 20 < len(set(want.values())) < 70
    held = spark.createDataFrame([(1, i, s.tobytes()) for i, s in enumerate(sets)], "component long, node long, shingles binary").repartition(3)
    for piece in (2048, 40, 9):
        got = {r.node: r.component for r in graph.components(simhash.confirmed(held, 0.8, piece)).collect()}
        assert {n: got.get(n, n) for n in want} == want, piece


def test_pipeline_stage_drops_similar_documents(spark):
    import corpus_pipeline

    rows = alike_rows()
    sets = {i: shingles(t) for i, t in rows}
    group = components(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    kept = corpus_pipeline.near_dedup(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in group if group[i] == i)


def test_similar_documents_with_odd_rows(docs, empty):
    near = simhash.representatives(docs, 5, 24, 0.8)
    ids = [r.doc_id for r in near.collect()]
    named = [i for i in ids if i is not None]
    assert named.count(401) == 2 and len(named) == len(set(named)) + 1 and ids.count(None) == 2 and set(range(24)) <= set(named)
    assert {200, 300, 400} <= set(named) and not {201, 202, 203, 210, 211, 301, 302} & set(named)
    assert simhash.near_duplicates(empty, 5, 24, 0.8).count() == 0
