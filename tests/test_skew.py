"""Hot keys worked on month by month give what one window per key gives."""

import datetime as dt
import random

import pytest

from prematch import schema
from prematch.functions import skew
from prematch.operators import asof, history, serve


@pytest.fixture(scope="module")
def matches(spark):
    rng = random.Random(4)
    names = ["a", "b", "c", "d"]
    rows = []
    for i in range(400):
        w, l = rng.sample(names if i % 3 else ["a", "b"], 2)  # noqa: E741
        rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(420)), rng.choice(["Clay", "Hard", None]), w, l))
    return spark.createDataFrame(rows, "match_id long, match_date date, surface string, winner_name string, loser_name string").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("strict", [False, True])
def test_history(matches, strict):
    same(history.player_history(matches, strict=strict, hot=[]), history.player_history(matches, strict=strict, hot=["a", "c"]))


def test_head_to_head(matches):
    same(history.attach_head_to_head(matches, hot=[]), history.attach_head_to_head(matches, hot=["a||b"]))


def test_serve(spark):
    rng = random.Random(6)
    stats = [f"{s}_{c}" for s in "wl" for c in schema.SERVE]
    rows = [(i, dt.date(2020, 1 + rng.randrange(12), 1), *rng.sample(["a", "b", "c"], 2), *[None if rng.random() < 0.2 else float(rng.randrange(9)) for _ in stats]) for i in range(150)]
    past = spark.createDataFrame(rows, "match_num long, tourney_date date, winner_id string, loser_id string, " + ", ".join(f"`{s}` double" for s in stats))
    same(serve.serve_totals(past, hot=[]), serve.serve_totals(past, hot=["a", "b"]))


@pytest.mark.parametrize("strict", [True, False])
def test_asof(spark, strict):
    rng = random.Random(7)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(300))
    left = spark.createDataFrame([(i, rng.choice(["a", "b", None]), day()) for i in range(200)], "i int, k string, t date")
    right = spark.createDataFrame([(rng.choice(["a", "b"]), day(), i, None if i % 5 == 0 else float(i)) for i in range(25)], "k string, d date, id int, v double")
    run = lambda hot: asof.asof_join(left, right, ["k"], "t", "d", ["v"], ["id"], strict=strict, hot=hot)
    same(run([]), run(["a"]))


def test_hot_keys(spark):
    df = spark.range(1000).selectExpr("case when id < 600 then 'x' else cast(id as string) end as k")
    assert skew.hot_keys(df, "k") == [] and skew.hot_keys(df, "k", floor=100) == ["x"]
