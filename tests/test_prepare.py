import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from prematch import schema
from prematch.operators import checks, splits
from prematch.plans import prepare


def raw(spark, n=1500):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        r = dict.fromkeys(schema.RAW_TO_CLEAN) | {"Date": str(dt.date(2024, 1, 1) + dt.timedelta(days=i)), "Tournament": "Cup", "Series": rng.choice(["ATP250", "Masters 1000"]), "Court": "Indoor", "Surface": rng.choice(["Clay", None]), "Round": "The Final", "Best of": "3", "Winner": f"w{i}", "Loser": f"l{i}", "WRank": str(rng.randint(1, 50)), "LRank": None if i % 9 == 0 else str(rng.randint(1, 90)), "WPts": "10", "LPts": "5", "Comment": "Completed" if i % 10 else "Retired", "AvgW": "1.5", "AvgL": "2.5"}
        rows.append((i, *[r[c] for c in schema.RAW_TO_CLEAN]))
    return spark.createDataFrame(rows, "n long, " + ", ".join(f"`{c}` string" for c in schema.RAW_TO_CLEAN))


def test_prepare(spark):
    got = prepare.prepare(raw(spark), ["n"], "2026-12-31", "2027-06-30", odds=True)
    summary = {r.part: r for r in got.summary.collect()}
    assert set(summary) == {"train", "validation", "test"} and sum(r.n_rows for r in summary.values()) == 1350
    rows = got.rows.collect()
    assert all((r.player_1[0] == "w") == (r.player_1_wins == 1) and (r.player_1[1:], r.player_2[0]) == (r.player_2[1:], "l" if r.player_1_wins else "w") for r in rows)
    assert all(r.rank_difference is None or r.rank_difference == r.player_1_rank - r.player_2_rank for r in rows)
    vectors = got.vectors.where("part = 'train'").collect()
    width = len(got.preprocessor.names())
    assert all(len(r.features) == width for r in vectors)
    mean = sum(r.features[got.preprocessor.names().index("player_1_rank")] for r in vectors) / len(vectors)
    assert abs(mean) < 1e-9
    assert sorted(map(str, prepare.modeling_rows(raw(spark).repartition(5), ["n"]).collect())) == sorted(map(str, prepare.modeling_rows(raw(spark), ["n"]).collect()))


def test_period_and_checks(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 31), 1), (dt.date(2025, 1, 1), 0), (dt.date(2026, 1, 1), 1), (None, 0)], "d date, y int").withColumn("part", splits.period("d"))
    assert [r.part for r in df.orderBy(F.col("d").asc_nulls_last()).collect()] == ["train", "validation", "test", None]
    with pytest.raises(ValueError):
        checks.check_prepared(df, ["Winner"], "y", "d", "part")
    with pytest.raises(ValueError):
        checks.check_prepared(df, ["x"], "y", "d", "part")  # one label in training
