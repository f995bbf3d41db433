import datetime as dt
import re

from fixtures import documents, prose, texts

from prematch.llm import adaptive_quality as A
from prematch.llm import licenses as L
from prematch.llm import url_lists as U


def facts(text):
    words = (text or "").encode().split()
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    return (len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


def test_facts(spark):
    rows = texts() + [(900, "a b\na b\n\n \nc#*\na b"), (901, "x " * 9 + "é|<y>"), (902, "w1 w2 w3 w4 w5 w6 w7 w8 " * 3)]
    got = sorted(((str(r.doc_id), *[r[c] for c in A._FACTS]) for r in A.facts(documents(spark, rows)).collect()), key=str)
    assert got == sorted(((str(i), *facts(t)) for i, t in rows), key=str)


def test_crafted_words_do_not_repeat():
    import pyarrow as pa

    from prematch.llm.common import text_buffer

    odd = [bin(i).count("1") % 2 for i in range(1 << 10)]
    one, other = "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)
    rest = "w1 w2 w3 w4 w5 w6 w7"
    texts = [f"{one} {rest} {other} {rest}", f"{one} {rest} {one} {rest}"]
    assert A.measure(*text_buffer(pa.array(texts)))["n_repeat_words"].tolist() == [0, 16]


def test_fences_follow_the_group(spark):
    clean = [(i, prose(i, 60)) for i in range(200)]
    noisy = [(1000 + i, prose(i, 60).replace(" ", "# ")) for i in range(200)]
    data = [(i, t, "en", "plain") for i, t in clean] + [(i, t, "en", "code") for i, t in noisy] + [(5000, prose(1, 60).replace(" ", "# "), "en", "plain"), (5001, prose(2, 60).replace(" ", "# "), "en", "code"), (5002, "too short", "en", "plain"), (5003, prose(3, 60), None, None)]
    got = {r.doc_id: r for r in A.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5000].kept and got[5001].kept and got[5002].base_failed and got[5003].kept
    assert sum(got[i].kept for i, _ in clean) >= 198 and sum(got[i].kept for i, _ in noisy) >= 198


def test_fences_against_sql(spark):
    """Groups large enough for fences of their own, for those of their language, and for neither; values far apart."""
    import random

    import duckdb

    from prematch.llm.queries import OP6_SQL

    rng, rows = random.Random(3), []
    for k in range(700):
        lang, source = [("en", "a"), ("en", "b"), ("fr", "a"), ("fr", "rare"), (None, "a"), ("xx", None)][min(k % 7, 5)] if k > 40 else ("en", "odd")
        text = prose(k, rng.randint(15, 90))
        if source == "b":
            text = text.replace(" ", " # ", rng.randint(0, 9))
        if rng.random() < 0.1:
            text = text.replace(" ", " %%%%%% ", rng.randint(1, 60))
        if rng.random() < 0.1:
            text = "\n".join(["the same line"] * rng.randint(2, 9) + [text])
        if rng.random() < 0.05:
            text = text.replace(" ", "x" * rng.randint(1, 40), 30)
        rows.append((k, text if k % 97 else None, lang, source))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(tuple(r) for r in A.judge(frame).select(*cols).collect())
    documents = frame.toPandas()  # noqa: F841  read by the SQL
    want = sorted(duckdb.sql(f"select {', '.join(cols)} from ({OP6_SQL})").fetchall())
    assert got == want
    large = {r.source for r in A.fences(A.sketches(A.facts(frame)), ["lang", "source"]).where(f"size >= {A.LEAST_GROUP}").collect()}
    assert {"a", "b"} <= large and sum(not k and not f for *_, f, k in got) >= 20


def test_buckets(spark):
    values = [0, 1, 100, 127, 128, 129, 255, 256, 259, 260, 10**6, (1 << 62) + 12345]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", A.bucket(A.F.col("v")).alias("b")).collect()
    assert all(r.b <= r.v and r.v - r.b <= r.v / 64 for r in rows) and [r.b for r in rows[:7]] == [0, 1, 100, 127, 128, 128, 254]


def test_sketches_merge(spark):
    whole = A.facts(documents(spark)).cache()
    a, b = whole.where("doc_id % 2 = 0"), whole.where("doc_id % 2 = 1 or doc_id is null")
    key = ["lang", "source"]
    merged = A.merged(A.sketches(a).unionByName(A.sketches(b)), key)
    assert sorted(map(str, merged.collect())) == sorted(map(str, A.sketches(whole).select(*merged.columns).collect()))


def test_quality_edges(docs, empty):
    got = A.judge(docs).collect()
    assert len(got) == len(texts()) and A.judge(empty).count() == 0
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 20)


def found(text):
    return [(r[0], r[1]) for r in L.Scanner(L.TEMPLATES).scan(text)]


def test_licenses():
    assert found("x\nReleased under the MIT License.\ny") == [(1, "MIT")]
    assert found("Licensed under the Apache License, Version 2.0.") == [(0, "Apache-2.0")]
    assert found("licensed UNDER the apache license -- version 2.0") == [(0, "Apache-2.0")]
    assert found("Licensed under the Apache License, Version 1.1.") == []
    assert found("Licensed under CC BY-NC 4.0.") == [(0, "CC-BY-NC-4.0")] and found("Licensed under CC BY-SA 4.0.") == [(0, "CC-BY-SA-4.0")]
    for denied in ("Not licensed under the MIT License.", "This is not licensed under the MIT License.", "This work isn't released under the MIT License.", "No longer licensed under the MIT License."):
        assert found(denied) == []
    assert found("We do not sell.\nReleased under the MIT License.") == [(1, "MIT")] and found("Why not? Released under the MIT License.") == [(0, "MIT")]
    assert found("SPDX-License-Identifier: MIT") == [(0, "MIT")] and found("// SPDX-License-Identifier: Apache-2.0\nint x;") == [(0, "Apache-2.0")]
    assert found("The licence of this work is CC BY 4.0") == [(0, "CC-BY-4.0")] and found("The licence of this work is CC BY-SA 4.0.") == [(0, "CC-BY-SA-4.0")]
    assert found("He holds a driving license and all of that.") == [] and found(None) == [] and found("") == []
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    assert (0, "MIT") in found(wrapped)


def test_whole_license_texts():
    texts = dict((n, t) for n, t in reversed(L._FULL))
    for name, text in L._FULL:
        assert found(text) == [(0, name)], name
    wrap = lambda t: re.sub(r"(.{50,70}) ", r"\1\n * ", t)
    assert found(f"x = 1\n{wrap(texts['BSD-3-Clause'])}") == [(1, "BSD-3-Clause")]
    assert found(prose(1, 300) + "\n\n" + wrap(texts["ISC"]) + "\n" + prose(2, 300) + "\n" + wrap(texts["MIT"]) + prose(3, 100)) == [(2, "ISC"), (2 + wrap(texts["ISC"]).count("\n") + 2, "MIT")]
    assert found(L._WARRANTY) == [(0, "MIT")]


def test_places_are_found_whatever_the_lines():
    gpl = dict((n, t) for n, t in L._NOTICES if "redistribute" in t)
    long_line = prose(5, 400)
    assert found(f"{long_line} {gpl['GPL-3.0']} {long_line}") == [(0, "GPL-3.0")] and found(f"{gpl['GPL-2.0']} {long_line}") == [(0, "GPL-2.0")]
    both = "Released under the MIT License. Licensed under CC BY 4.0."
    assert found(both) == [(0, "MIT"), (0, "CC-BY-4.0")] and found(f"{long_line} {both} {long_line} {both}") == [(0, "MIT"), (0, "CC-BY-4.0")] * 2
    assert found("\n".join([prose(6, 5000), "All rights reserved."])) == [(1, "Proprietary")]


def test_scan_against_comparing_everything():
    """Without the ranking by compression, every template at every place: the same finds on texts with changed notices."""
    import random

    rng, scanner = random.Random(7), L.Scanner(L.TEMPLATES)
    every = L.Scanner(L.TEMPLATES)
    every.rank = lambda block, size: [(1.0, i) for i in every.sizes[size]]
    n = 0
    for k in range(40):
        name, notice = rng.choice(L.TEMPLATES)
        w = notice.split()
        for _ in range(rng.randint(0, max(0, len(w) // 12))):
            w[rng.randrange(len(w))] = rng.choice(["some", "other", "word"])
        text = f"{prose(k, 40)}\n{' '.join(w)}\n{prose(('after', k), 40)}"
        a, b = ([x[:2] for x in s.scan(text)] for s in (scanner, every))
        assert a == b, (name, text)
        n += len(a)
    assert n > 20


def test_license_rows(spark, docs, empty):
    rows = [(1, "All rights reserved."), (1, "All rights reserved."), (2, None), (None, "Released under the MIT License.")]
    got = L.scan(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.license, r.alike) for r in got) == [("1", "Proprietary", 1.0), ("1", "Proprietary", 1.0), ("None", "MIT", 1.0)]
    assert L.scan(docs).count() == 0 and L.scan(empty).count() == 0


def entries(spark, rows):
    return spark.createDataFrame(rows, "pattern string, list_name string, action string, since string").selectExpr("pattern", "list_name", "action", "cast(since as date) as since")


def test_url_lists(spark):
    lists = entries(spark, [("Bad.example", "x", "block", "2024-02-01"), ("bad.example", "x", "remove", "2024-03-01"), ("bad.example/ok", "x", "allow", "2024-01-01"), ("sub.bad.example", "y", "allow", "2024-02-10"), ("bad.example", "a", "block", "2024-06-01"), ("bad.example", "b", "block", "2024-06-01"), (None, "x", "block", "2024-01-01"), ("dup.example", "x", "block", "2024-01-01"), ("dup.example", "x", "allow", "2024-01-01")])
    day = lambda m, d: dt.date(2024, m, d)
    rows = [(1, "http://bad.example/a", day(1, 31)), (2, "HTTP://user@WWW.BAD.example.:80/a", day(2, 1)), (3, "http://bad.example", day(3, 1)), (4, "http://bad.example//ok/x?q", day(2, 5)), (5, "http://sub.bad.example/", day(2, 11)), (6, "http://notbad.example/", day(2, 5)), (7, None, day(2, 5)), (8, "http://bad.example", None), (9, "bad.example", day(2, 5)), (10, "http://bad.example/okay", day(7, 1)), (11, "http://dup.example", day(7, 1)), (11, "http://dup.example", day(7, 1))]
    captures = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, fetched_on date, id string")
    want = {1: ("none", None), 2: ("block", "bad.example"), 3: ("none", None), 4: ("allow", "bad.example/ok"), 5: ("allow", "sub.bad.example"), 6: ("none", None), 7: ("none", None), 8: ("none", None), 9: ("none", None), 10: ("block", "bad.example"), 11: ("block", "dup.example")}
    for limit in (U.BROADCAST_ROWS, 0):
        made = U.evaluate(captures, lists, limit)
        got = made.collect()
        assert made.columns[:4] == ["page_id", "url", "fetched_on", "id"] and len(got) == 12
        assert {r.page_id: (r.verdict, r.pattern) for r in got} == want
        assert [(r.list_name, r.valid_from) for r in got if r.page_id == 10] == [("a", day(6, 1))]
    assert {r.verdict for r in U.evaluate(captures, lists.limit(0)).collect()} == {"none"} and U.evaluate(captures.limit(0), lists).count() == 0
