"""The pipeline on a small corpus against a brute-force version of every stage."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
from fixtures import prose
from test_near import components, shingles, words_apart
from test_packing import check
from test_substrings import brute

from prematch.llm import language_id, string_tiling
from prematch.llm.common import table

FR = "le la de et les des un une pour dans que qui est sur pas au avec ce il sont plus par".split()


def corpus():
    import random

    rng = random.Random(9)
    shared, item = prose("shared", 60), prose("item", 30)
    rows = [(i, prose(i, 80), "en") for i in range(20)]
    rows += [(50 + i, " ".join(rng.choice(FR) + rng.choice(["eau", "oi", "ment", ""]) for _ in range(80)), "fr") for i in range(12)]
    rows += [(100 + i, prose("copy", 70), "en") for i in range(3)] + [(110 + i, f"{prose(('h', i), 30)} {shared} {prose(('t', i), 30)}", "en") for i in range(3)]
    # near copies: similar by their five-word shingles, though many bits of a fingerprint differ
    rows += [(140 + k, words_apart(prose("near", 160), [31 * j + 3 * k for j in range(k)]), "en") for k in range(4)]
    rows += [(120, f"{prose('lead', 40)} {item} {prose('tail', 40)}", "en"), (130, None, "en"), (131, "123 456", None)]
    return rows, item


def test_stages(spark, tmp_path):
    rows, item = corpus()
    data = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, str(tmp_path), "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "packing"]

    model = language_id.fit(docs.select("text", "lang"))
    encoders = language_id.compressors(model)
    want = {i: t for i, t, _ in rows if not language_id.classify_text(t, model, encoders)[2]}
    assert {130, 131}.isdisjoint(want) and len(want) >= len(rows) - 3

    sets = {i: shingles(t) for i, t in want.items()}
    group = components(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert {group[140 + k] for k in range(4)} == {140} and group[110] != group[111]
    stages = [want, {i: t for i, t in want.items() if group[i] == i}]
    stages.append({i: kept for i, _, _, kept in brute(list(stages[1].items()))})
    items = string_tiling.Items([item])
    ids = list(stages[2])
    leaks = {r[0] for r in string_tiling.tile_batch(pa.array([stages[2][i] for i in ids]), items, string_tiling.COVERAGE)}
    stages.append({i: t for k, (i, t) in enumerate(stages[2].items()) if k not in leaks})
    assert 120 not in stages[3] and 101 not in stages[1]

    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], stages):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = {r.doc_id: " ".join((r.text or "").split()) for r in docs.collect()}
        assert got == {i: " ".join(t.split()) for i, t in expected.items()}, name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    check(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    check(whole, [(r.doc_id, r.text) for r in docs.collect()])
    assert np.isin(whole.doc_id, list(stages[3])).all()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
