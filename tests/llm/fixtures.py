"""Documents with what operators must stand: nulls, empty and long texts, copies, repeated rows, clashing column names."""

import random

EN = "the of and to in that is was for with on as are by this from have not they which one had but were all there when can said use each".split()


def prose(seed, n=120):
    rng = random.Random(str(seed))
    words = [rng.choice(EN) if rng.random() < 0.3 else "".join(rng.choice(["ba", "ri", "to", "ne", "lu", "ska", "mo", "vi"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def texts():
    shared = prose("shared", 45)
    out = [(i, prose(i, 30 + 7 * i % 90)) for i in range(24)]
    out += [(100 + i, f"{prose(('a', i), 25)}\n{shared}\t {prose(('b', i), 25)}") for i in range(5)]
    out += [(200 + i, prose("copy", 60)) for i in range(4)]
    out += [(210, prose("copy", 60) + " one more"), (211, prose("copy", 60).upper())]
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "Two words"), (305, "naïve Élan 12 «x» y"), (306, "same " * 400), (307, prose("long", 30000))]
    out += [(400, prose(400, 50))] * 3 + [(401, prose("x", 40)), (401, prose("y", 40)), (None, prose("copy", 60)), (None, None)]
    return out


#: Extra columns, several named like columns that operators make.
EXTRA = ["batch", "bits", "node", "row", "carried", "kept", "lang_pred", "size", "part", "n", "hash", "text_", "n_words"]


def documents(spark, rows=None, parts=3):
    rows = texts() if rows is None else rows
    langs = ["en", "fr", None]
    data = [(i, t, langs[k % 3], f"src{k % 2}" if k % 5 else None, None if t is None else len(t), *[f"{c}{k}" for c in EXTRA]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(parts)
