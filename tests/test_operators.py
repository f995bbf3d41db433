import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prematch import schema
from prematch.functions import scalars
from prematch.functions import windows as W
from prematch.operators import asof, checks, clean, entity, features, history, ml, splits


def column(spark, values, c, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(c).collect()]


def test_fixed_lists():
    assert len(schema.NUMERIC_FEATURES) == 64 and len(schema.CATEGORICAL) == 5
    assert len(schema.FLIPPED) == 18 and len(schema.SWAPPED) == 30 and len(schema.CLEAN_COLUMNS) == 27
    assert len(schema.RAW_COLUMNS) == 39 and schema.RAW_COLUMNS[1:4] == ["ATP", "Location", "Tournament"]


def test_strings(spark):
    assert column(spark, ["  a \t b ", "", None, "a b"], scalars.clean_string("x")) == ["a b", None, None, "a b"]
    assert column(spark, ["tent", " indoor", None, "OUTDOOR"], scalars.court("x")) == ["Unknown", "Indoor", "Unknown", "Outdoor"]
    assert column(spark, [" CLAY ", "sand"], scalars.surface("x")) == ["Clay", "Unknown"]
    assert column(spark, ["The Final", "Semi-Finals", None, "Playoff"], scalars.round_name("x")) == ["Final", "Semifinals", "Unknown", "Playoff"]
    assert column(spark, ["Masters 1000", "Grand  Slam", "Cup"], scalars.series("x")) == ["Masters1000", "GrandSlam", "Cup"]
    assert column(spark, [" completed ", "Completed", "Retired", None], scalars.completed("x")) == [True, True, False, None]
    assert column(spark, ["U", "R", None], scalars.hand("x")) == [None, "R", None]
    assert column(spark, ["raw/2021.xlsx", "x"], scalars.year_in("x")) == [2021, None]


def test_numbers_and_dates(spark):
    assert column(spark, [0.5, 1.5, 2.5, -0.5, None], scalars.whole("x"), "double") == [0, 2, 2, 0, None]
    assert column(spark, ["1.5", "x", "NaN", None], scalars.number("x")) == [1.5, None, None, None]
    assert column(spark, [0.0, -1.0, 3.0], scalars.positive("x"), "double") == [None, None, 3.0]
    assert column(spark, [0.0, -1.0], scalars.not_negative("x"), "double") == [0.0, None]
    assert column(spark, [1.0, 1.01, None], scalars.odds("x"), "double") == [None, 1.01, None]
    assert column(spark, [2.0, 0.0, None], scalars.implied("x"), "double") == [0.5, None, None]
    assert [str(v) for v in column(spark, [0.0, 1.5], scalars.flipped("x"), "double")] == ["0.0", "-1.5"]
    assert column(spark, ["20200231", "20200229", None], scalars.to_date("x", "yyyyMMdd")) == [None, dt.date(2020, 2, 29), None]
    assert column(spark, ["2020-01-05", "someday"], scalars.to_date("x")) == [dt.date(2020, 1, 5), None]


def test_pair_key(spark):
    rows = spark.createDataFrame([("b", "a"), ("a", "b"), (None, "a"), ("a", "a")], "a string, b string")
    got = rows.select(scalars.pair_key("a", "b").alias("k"), scalars.first_in_pair("a", "b").alias("f")).collect()
    assert [(r.k, r.f) for r in got] == [("a||b", 0), ("a||b", 1), ("a||nan", 0), ("a||a", 1)]


def test_format_cell():
    assert [scalars.format_cell(v) for v in (None, "nan", 3.0, "2.50000001", "abc", "x" * 60)] == ["∅", "∅", "3", "2.5", "abc", "x" * 47 + "…"]
    assert scalars.parse_number("inf") is None and scalars.parse_number("1e3") == 1000.0


@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=9))
def test_indel_ratio_is_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    want = 100.0 * 2 * rows[-1][-1] / (len(a) + len(b)) if a or b else 100.0
    assert scalars.indel_ratio(a, b) == pytest.approx(want)


def test_indel_ratio_fixtures():
    assert scalars.indel_ratio("herbert p", "herbert") == 87.5
    assert scalars.indel_ratio("federrer", "federer") == pytest.approx(93.33333)


def test_shifted_running_total(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, None, 3.0, 4.0, None])] + [("b", 9, 5.0), ("b", 10, 6.0)], "k string, i int, x double")
    got = rows.withColumn("t", W.running_total("x", ["k"], ["i"])).withColumn("c", W.previous("t", ["k"], ["i"])).orderBy("k", "i").collect()
    assert [r.c for r in got] == [None, 1.0, None, 4.0, 8.0, None, 5.0]


def bouts(spark, rows):
    return spark.createDataFrame([(i, dt.date(2020, 1, d), s, w, l) for i, (d, s, w, l) in enumerate(rows)], "match_id long, match_date date, surface string, winner_name string, loser_name string")


def test_recent_five_and_null_surface(spark):
    wins = [1, 1, 0, 1, 1, 1, 0]
    m = bouts(spark, [(i + 1, None if i == 3 else "Clay", "a" if w else f"o{i}", f"o{i}" if w else "a") for i, w in enumerate(wins)])
    got = history.player_history(m).where("player = 'a'").orderBy("match_id").collect()
    assert [r.recent5_wins_before for r in got] == [0, 1, 2, 2, 3, 4, 4]
    assert got[3].surface_matches_before is None and got[4].surface_matches_before == 3.0
    assert [r.days_since_last_match for r in got] == [None] + [1.0] * 6


def test_strict_leaves_same_day_out(spark):
    m = bouts(spark, [(1, "Clay", "a", "b"), (1, "Clay", "a", "c"), (2, "Clay", "a", "d")])
    a = lambda strict: [r.matches_before for r in history.player_history(m, strict=strict).where("player = 'a'").orderBy("match_id").collect()]
    assert a(False) == [0, 1, 2] and a(True) == [0, 0, 2]


def test_head_to_head(spark):
    got = history.attach_head_to_head(bouts(spark, [(1, "x", "A", "B"), (2, "x", "B", "A"), (3, "x", "A", "B")])).orderBy("match_id").collect()
    assert [r.h2h_matches_before for r in got] == [0, 1, 2]
    assert [r.winner_h2h_wins_before for r in got] == [0, 0, 1] and [r.loser_h2h_wins_before for r in got] == [0, 1, 1]
    assert [r.winner_h2h_win_rate_before for r in got] == [None, 0, 0.5] and [r.loser_h2h_win_rate_before for r in got] == [None, 1, 0.5]


def test_no_future_leak(spark):
    base = [(d, "Clay", f"p{d % 3}", f"p{(d + 1) % 3}") for d in range(1, 15)]
    other = base[:8] + [(d, "Grass", l, w) for d, _, w, l in base[8:]]
    early = lambda rows: sorted(map(str, history.attach_head_to_head(history.attach_history(bouts(spark, rows))).where("match_date < date'2020-01-09'").collect()))
    assert early(base) == early(other)


def test_asof_strict_ties_and_nulls(spark):
    day = lambda d: dt.date(2020, 1, d)
    right = spark.createDataFrame([("a", day(1), 1, 1.0), ("a", day(1), 2, None), ("a", day(5), 3, 3.0)], "k string, d date, id int, v double")
    left = spark.createDataFrame([(0, "a", day(1)), (1, "a", day(3)), (2, "a", day(5)), (3, "z", day(9)), (4, None, day(9)), (5, "a", day(6)), (6, "a", None)], "i int, k string, t date")
    got = {r.i: (r.v, r.d) for r in asof.asof_join(left, right, ["k"], "t", "d", ["v"], ["id"]).collect()}
    assert got == {0: (None, None), 1: (None, day(1)), 2: (None, day(1)), 3: (None, None), 4: (None, None), 5: (3.0, day(5)), 6: (None, None)}
    loose = {r.i: r.d for r in asof.asof_join(left, right, ["k"], "t", "d", ["v"], ["id"], strict=False).collect()}
    assert loose[0] == day(1) and loose[2] == day(5)
    first = {r.i: r.v for r in asof.asof_join(left, right, ["k"], "t", "d", ["v"], ["id"], first_of_day=True).collect()}
    assert first[1] == 1.0


PLAYERS = [("1", "Rafael Nadal"), ("2", "Roger Federer"), ("3", "Alexander Zverev"), ("4", "Mischa Zverev"), ("5", "Pierre Hugues Herbert"), ("6", "Andrey Kuznetsov"), ("7", "Alex Kuznetsov")]
NAMES = ["Nadal R.", "Federer", "Zverev A.", "Zverev", "Kuznetsov A.", "Nadal X.", "Herbert P.H.", "Federrer R.", "..."]


def resolved(spark, fuzzy):
    players = spark.createDataFrame(PLAYERS, "player_id string, full_name string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return {r.tennis_data_name: r for r in entity.resolve_names(names, players, fuzzy=fuzzy).collect()}


def test_name_ladder_exact(spark):
    got = resolved(spark, False)
    assert {n: (r.match_method, r.player_id) for n, r in got.items()} == {
        "Nadal R.": ("exact_surname_initial", "1"),
        "Federer": ("exact_surname_initial", "2"),
        "Zverev A.": ("exact_surname_initial", "3"),
        "Zverev": ("ambiguous_surname_initial", None),
        "Kuznetsov A.": ("ambiguous_surname_initial", None),
        "Nadal X.": ("unmatched", None),
        "Herbert P.H.": ("unmatched", None),
        "Federrer R.": ("unmatched", None),
        "...": ("invalid_name", None),
    }
    assert (got["Herbert P.H."].tennis_data_surname, got["Herbert P.H."].tennis_data_initial) == ("herbert p", "h")


def test_name_ladder_fuzzy(spark):
    got = resolved(spark, True)
    assert (got["Federrer R."].match_method, got["Federrer R."].player_id) == ("fuzzy_surname", "2")
    assert got["Federrer R."].score == pytest.approx(93.33333)
    assert (got["Nadal X."].match_method, got["Nadal X."].score) == ("fuzzy_ambiguous_or_low_score", 100.0)
    assert got["Herbert P.H."].match_method == "fuzzy_ambiguous_or_low_score" and got["..."].match_method == "invalid_name"


def test_nearest_surnames_against_all(spark):
    import random

    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(250)})
    names = spark.createDataFrame([(w, w, "") for w in words[:120]], "tennis_data_name string, tennis_data_surname string, tennis_data_initial string")
    known = spark.createDataFrame([(w, f"o{k % 17}") for k, w in enumerate(words[60:])], "surname string, _order string")
    want = {}
    for a in words[:120]:
        ranked = sorted((-scalars.indel_ratio(a, b), f"o{k % 17}", b) for k, b in enumerate(words[60:]))
        want[a] = (ranked[0][2], -ranked[0][0], -ranked[1][0])
    for block in (50_000, 30):
        got = {r.tennis_data_name: (r.best, r.score, r.second) for r in entity.nearest_surnames(names, known, block).collect()}
        assert got == want


def test_scores_of_names_that_stay_unresolved(spark):
    players = spark.createDataFrame([("1", "Rafael Nadal"), ("2", "Roger Federer")], "player_id string, full_name string")
    names = spark.createDataFrame([("Qwz T.",), ("Nade R.",)], "name string")
    got = {r.tennis_data_name: r for r in entity.resolve_names(names, players).collect()}
    for name, surname in (("Qwz T.", "qwz"), ("Nade R.", "nade")):
        scores = sorted((scalars.indel_ratio(surname, x) for x in ("nadal", "federer")), reverse=True)
        assert (got[name].match_method, [got[name].score, got[name].second_score]) == ("fuzzy_ambiguous_or_low_score", scores)


def test_players(spark):
    rows = spark.createDataFrame([(" 7 ", "Ana", "Ost", "U", "180", "19900131"), ("7", "Zoe", "B", "R", "x", "bad")], "player_id string, name_first string, name_last string, hand string, ht string, dob string")
    (one,) = entity.player_dimension(rows).collect()
    assert (one.player_id, one.full_name, one.hand, one.height, one.birth_date) == ("7", "Ana Ost", None, 180.0, dt.date(1990, 1, 31))


def test_rare_and_round(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["x", "x", "x", None, None, None, "y"])], "i int, tournament string")
    assert [r.tournament_bucket for r in features.rare_bucket(rows, "tournament", 3).orderBy("i").collect()] == ["x"] * 3 + ["other"] * 4
    assert column(spark, ["Final", "1st Round", "Round Robin", None], features.round_ordinal("x")) == [6.0, 0.0, -1.0, -1.0]


def test_mirror_is_an_involution(spark):
    m = features.add_features(history.attach_history(bouts(spark, [(d, "Clay", f"p{d % 3}", f"p{(d + 1) % 3}") for d in range(1, 9)])))
    once = features.mirrored(m)
    lost = once.where("player_a_win = 0").drop("player_a_win")
    back = features.mirrored(lost).where("player_a_win = 0").drop("player_a_win")
    assert sorted(map(str, back.collect())) == sorted(map(str, once.where("player_a_win = 1").drop("player_a_win").collect()))
    assert "=-0.0," not in " ".join(map(str, once.collect()))


def test_exclusions(spark):
    m = features.mirrored(features.add_features(bouts(spark, [(1, "Clay", "a", "b")]).withColumn("atp", F.lit(1))))
    assert features.feature_matrix(m, exclude=["surface"]).columns == ["atp", "player_a_win"]
    with pytest.raises(ValueError):
        features.feature_matrix(m, exclude=["nothing"])


def test_exact_medians(spark):
    import random
    import statistics

    rng = random.Random(4)
    columns = {
        "even": [float(rng.randint(0, 10**6)) for _ in range(3000)],
        "ties": [float(rng.randint(0, 2)) for _ in range(2999)] + [None],
        "few": [3.0, 1.0] + [None] * 2998,
        "one": [7.5] + [None] * 2999,
        "none": [None] * 3000,
        "wide": [10.0 ** rng.randint(-200, 200) * rng.choice([-1, 1]) for _ in range(3000)],
        "nan": [float("nan")] * 1000 + [float(i) for i in range(2000)],
    }
    rows = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    got = ml.exact_medians(rows, list(columns))
    for c, values in columns.items():
        known = [v for v in values if v is not None and v == v]
        assert got[c] == (statistics.median(known) if known else None), c


def test_class_weights(spark):
    rows = spark.createDataFrame([(1.0,)] * 6 + [(0.0,)] * 2, "label double")
    assert {(r.label, r.weight) for r in ml.with_class_weights(rows).collect()} == {(1.0, 8 / 12), (0.0, 8 / 4)}


def dates(spark, n):
    return spark.createDataFrame([(i, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(n)], "i int, d date")


def test_chunks_and_folds(spark):
    sizes = lambda n, k: [r["count"] for r in splits.date_chunks(dates(spark, n), "d", k).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes(7, 6) == [2, 1, 1, 1, 1, 1] and sizes(17, 6) == [3] * 5 + [2] and sizes(100, 6) == [17] * 4 + [16] * 2
    folded = splits.date_folds(dates(spark, 20), "d", 4)
    for f in range(1, 5):
        train, test = splits.fold(folded, f)
        assert train.agg(F.max("d")).first()[0] < test.agg(F.min("d")).first()[0]
    with pytest.raises(ValueError):
        splits.date_folds(dates(spark, 3), "d", 3)


def test_holdout_and_row_splits(spark):
    train, held = splits.holdout(dates(spark, 20), "d", 0.15)
    assert (train.count(), held.count()) == (17, 3)
    assert splits.row_splits(10, 3) == [(4, 6), (6, 8), (8, 10)]
    assert [splits.split_count(n) for n in (999, 1000, 5000)] == [3, 4, 5]


def raw_rows(spark):
    row = {c: None for c in schema.RAW_TO_CLEAN} | {"source_year": "2020", "Date": "2020-01-05", "Winner": " A  B. ", "Loser": "C D.", "Comment": "Completed", "WRank": "0", "LRank": "3", "AvgW": "1.5", "AvgL": "1.0", "Best of": "2.5"}
    rows = [row, dict(row), row | {"Comment": "Retired"}, row | {"Date": "bad"}, row | {"Loser": "A B."}, row | {"Winner": " "}, row | {"Loser": "E F.", "AvgW": None}]
    return spark.createDataFrame([tuple(r[c] for c in schema.RAW_TO_CLEAN) for r in rows], ", ".join(f"`{c}` string" for c in schema.RAW_TO_CLEAN))


def test_normalize(spark):
    got = {r.loser_name: r for r in clean.normalize(raw_rows(spark)).collect()}
    assert set(got) == {"C D.", "E F."} and got["C D."].winner_name == "A B."
    assert (got["C D."].winner_rank, got["C D."].loser_rank, got["C D."].best_of, got["C D."].avg_loser) == (None, 3.0, 2, None)
    assert (got["C D."].has_any_market_odds, got["E F."].has_any_market_odds) == (1, 0)
    one = clean.clean_counters(raw_rows(spark)).first().asDict()
    assert one == {"input_rows": 7, "removed_exact_duplicates": 1, "removed_not_completed": 1, "removed_invalid_dates": 1, "removed_missing_players": 1, "removed_invalid_rows": 1, "output_rows": 2}
    with pytest.raises(ValueError):
        clean.normalize(raw_rows(spark).drop("Winner"))


def test_keyed_matches(spark):
    got = clean.keyed_matches(raw_rows(spark).withColumn("n", F.monotonically_increasing_id()), ["n"])
    assert got.count() == 4  # exact comment, dated, first of each key; names are not cleaned here


def test_checks(spark):
    rows = spark.createDataFrame([(1, 0.5, 20.0), (2, 1.5, 10.0)], "i int, winner_ace_rate_before double, winner_age_years double")
    with pytest.raises(ValueError):
        checks.validate(rows)
    checks.validate(rows.where("i = 1"))
    assert {w["column_name"] for w in checks.warn(rows)} == {"winner_ace_rate_before", "winner_age_years"}
    with pytest.raises(ValueError):
        checks.join_one_to_one(rows, rows.unionByName(rows), ["i"])
    assert {r.column_name: r.pct for r in checks.coverage(rows.withColumn("x", F.when(F.col("i") == 1, 1)), ["x", "i"]).collect()} == {"x": 50.0, "i": 100.0}


def test_preprocessing(spark):
    train = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "b"), (10.0, "a"), (None, None)], "x double, c string")
    prep = ml.fit_preprocessor(train, ["x"], ["c"])
    assert prep.medians == {"x": 2.5} and prep.modes == {"c": "a"} and prep.names() == ["x", "c_a", "c_b"]
    two = ml.fit_preprocessor(spark.createDataFrame([(1.0,), (3.0,)], "x double"), ["x"], [], scale=True)
    assert two.deviations == {"x": 1.0} and two.means == {"x": 2.0}
    new = spark.createDataFrame([(None, "zzz")], "x double, c string")
    assert prep.transform(new, []).first().features.toArray().tolist() == [2.5, 0.0, 0.0]


def test_pruning():
    leaf = lambda a, b: ml.Node([a, b])
    tree = lambda: ml.Node([50.0, 50.0], 0, 0.5, ml.Node([45.0, 5.0], 1, 0.5, leaf(25.0, 3.0), leaf(20.0, 2.0)), leaf(5.0, 45.0))
    assert ml.prune(tree(), 0.0).leaves() == 3
    assert ml.prune(tree(), 0.001).leaves() == 2 and ml.prune(tree(), 0.9).leaves() == 1
    assert ml.require_split(tree(), 60).leaves() == 2
    assert list(ml.importances(tree(), ["a", "b"]))[0] == "a" and "a <= 0.50" in ml.tree_text(tree(), ["a", "b"])


def test_search_tree(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i // 4), float(i % 4 - 1.5), "u" if i % 3 else None, int(i % 4 >= 2)) for i in range(240)]
    df = spark.createDataFrame(rows, "d date, x double, c string, y int")
    found = ml.search_tree(df, "d", ["x"], ["c"], "y", folds=2, grid={"max_depth": [2], "min_samples_leaf": [1], "min_samples_split": [2], "ccp_alpha": [0.0, 0.001]})
    assert found["holdout_accuracy"] == 1.0 and found["leaves"] == 2 and found["best_params"]["ccp_alpha"] == 0.0
