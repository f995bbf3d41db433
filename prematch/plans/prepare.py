"""The exploratory path: raw matches to neutral sides, periods and encoded vectors, with its checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prematch.operators import checks, clean, features, ml, splits

NUMERIC = ["best_of", "player_1_rank", "player_2_rank", "player_1_points", "player_2_points", "rank_difference", "points_difference", "month"]
ODDS = ["avg_odds_1", "avg_odds_2"]
CATEGORICAL = ["series", "court", "surface", "round"]
TARGET = "player_1_wins"


@dataclass
class Prepared:
    rows: DataFrame
    vectors: DataFrame
    summary: DataFrame
    preprocessor: ml.Preprocessor


def modeling_rows(raw: DataFrame, order: list[str]) -> DataFrame:
    """One row per valid match with random sides, differences and month."""
    valid = clean.keyed_matches(raw, order)
    key = F.concat_ws("|", F.col("Date").cast("string"), "Tournament", "Winner", "Loser")
    named = valid.select(
        key.alias("match_key"),
        F.col("Date").alias("match_date"),
        *[F.col(f"`{c}`").alias(n) for c, n in (("Tournament", "tournament"), ("Series", "series"), ("Court", "court"), ("Surface", "surface"), ("Round", "round"), ("Best of", "best_of"))],
        "Winner", "Loser", "WRank", "LRank", "WPts", "LPts", "AvgW", "AvgL",
    )
    pairs = {"player_{}": ("Winner", "Loser"), "player_{}_rank": ("WRank", "LRank"), "player_{}_points": ("WPts", "LPts"), "avg_odds_{}": ("AvgW", "AvgL")}
    made = features.oriented(named, "match_key", ["match_date", "tournament", "series", "court", "surface", "round", "best_of"], pairs)
    return made.withColumns(
        {
            "rank_difference": F.col("player_1_rank") - F.col("player_2_rank"),
            "points_difference": F.col("player_1_points") - F.col("player_2_points"),
            "month": F.month("match_date").cast("tinyint"),
        }
    )


def prepare(raw: DataFrame, order: list[str], train_end: str = "2024-12-31", validation_end: str = "2025-12-31", odds: bool = False) -> Prepared:
    """Split by date, fit imputation, scaling and encoding on the training period alone, transform all, and check the result."""
    rows = modeling_rows(raw, order).withColumn("part", splits.period("match_date", train_end, validation_end))
    numeric = [*NUMERIC, *(ODDS if odds else [])]
    checks.check_prepared(rows, [*numeric, *CATEGORICAL], TARGET, "match_date", "part")
    fitted = ml.fit_preprocessor(rows.where("part = 'train'"), numeric, CATEGORICAL, scale=True)
    vectors = fitted.transform(rows, ["match_key", "part", TARGET])
    summary = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(TARGET).cast("double")).alias("player_1_win_rate"))
    return Prepared(rows, vectors, summary, fitted)
