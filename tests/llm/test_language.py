from fixtures import documents, texts

from prematch.llm import language_id as L

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = L.fit(docs.where(~L.held_out()).select("text", "lang"))
    assert all(len(d) <= L.DICTIONARY_BYTES for d in model.dictionaries)
    got = L.classify(docs.where(L.held_out()), model, ["lang"]).toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.98 and got.rejected.mean() < 0.03
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_unknown_and_order(spark, docs, empty):
    model = L.fit(docs.select("text", "lang"))
    got = L.classify(docs, model).collect()
    assert len(got) == len(texts())
    for r in got:
        if r.doc_id in (300, 301, 302):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.doc_id is None or r.lang_pred in ("en", "fr")
    assert L.classify(empty, model).count() == 0
    assert L.classify_text("12 34 ...", model, L.compressors(model)) == ("und", 0.0, True)
    nothing = L.fit(empty.select("text", "lang"))
    assert {r.lang_pred for r in L.classify(docs, nothing).collect()} == {"und"}


def test_fit_ignores_order(spark):
    rows = [(i, t) for i, t in texts() if i is not None]
    a, b = (L.fit(documents(spark, rows, p).select("text", "lang")) for p in (2, 7))
    assert a == b


def test_margins():
    model = L.Model(["a", "b"], [b" hello world this is plain english text " * 20, b" bonjour le monde ceci est du texte " * 20])
    made = L.compressors(model)
    lang, score, rejected = L.classify_text("Bonjour le MONDE", model, made)
    assert lang == "b" and score > 0 and not rejected
    assert L.classify_text("zzqq", model, made)[2]
    assert L.classify_text("bonjour le monde " * 5000, model, made)[0] == "b"


def test_against_plain_compression(spark):
    """Every text as one by one with encoders made anew."""
    import zstandard

    rows = [(i, t) for i, t in texts() if t and i is not None and len(t) < 5000]
    model = L.fit(documents(spark, rows).select("text", "lang"))
    assert len(model.languages) == 2

    def size(plain, content):
        total = 0
        for k in range(0, len(plain), 4096):
            given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(level=L.LEVEL)
            total += len(zstandard.ZstdCompressor(level=L.LEVEL, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False).compress(bytes(64) + plain[k : k + 4096]))
        return total

    got = {(r.doc_id, r.text): r for r in L.classify(documents(spark, rows), model, ["doc_id", "text"]).collect()}
    for i, t in rows:
        letters = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        r = got[i, t]
        if not letters:
            assert r.lang_pred == "und"
            continue
        sizes = [size((" " + " ".join(letters) + " ").encode(), d) for d in model.dictionaries]
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        margin = (sorted(sizes)[1] - sizes[best]) / sorted(sizes)[1]
        assert (r.lang_pred, r.rejected) == (model.languages[best], margin < L.NARROW) and abs(r.score - margin / (margin + 0.05)) < 1e-12


def test_very_many_labels(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LABELS", 50)
    rows = [(f"text number {i} about label {i % 60}", f"l{i % 60:02d}") for i in range(400)] + [("mostly this", "l07")] * 5
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 50 and model.languages[0] == "l07" and "l59" not in model.languages
    monkeypatch.setattr(L, "MOST_BYTES", 50 * 100)
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 50 and max(map(len, model.dictionaries)) <= 100


def test_clashing_columns(spark, docs):
    import pytest

    with pytest.raises(ValueError):
        L.classify(docs, L.Model(["a"], [b"x"]), ["doc_id", "lang_pred"])
