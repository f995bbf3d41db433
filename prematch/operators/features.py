"""Model features, the mirrored training set and the feature matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prematch import schema
from prematch.functions import scalars
from prematch.sources.shared import numbered


def rare_bucket(df: DataFrame, column: str, least: int, name: str | None = None) -> DataFrame:
    """df with the column's value where it occurs at least ``least`` times, else "other" (missing always).

    Counts are aggregated before they are joined, so a frequent value does not
    gather in one task; Spark broadcasts the table of values while it is small.
    """
    name = name or f"{column}_bucket"
    often = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_value")
    return df.join(often, F.col(column) == F.col("_value"), "left").withColumn(name, F.coalesce("_value", F.lit("other"))).drop("_value")


def round_ordinal(column: Column | str = "round") -> Column:
    """Position of a round from 0 to 6, -1 for others and missing, as a double."""
    c = F.col(column) if isinstance(column, str) else column
    known = F.create_map(*[F.lit(x) for k, v in schema.ROUND_ORDINAL.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(known, F.coalesce(c, F.lit(""))), F.lit(-1.0))


def market(df: DataFrame) -> dict[str, Column]:
    """Implied probabilities of both sides, as far as the odds are there."""
    return {f"{s}_implied_prob_avg": scalars.implied(f"avg_{s}") for s in ("winner", "loser") if f"avg_{s}" in df.columns}


def add_features(df: DataFrame, rare: int = 20) -> DataFrame:
    """df with round ordinal, missing flags, market, differences and rare-value buckets, each where its columns exist."""
    first: dict[str, Column] = {"round_ordinal": round_ordinal()} if "round" in df.columns else {}
    first |= {f"{c}_missing": scalars.missing(c) for c in ("winner_rank", "loser_rank", "winner_points", "loser_points") if c in df.columns}
    first |= market(df)
    df = df.withColumns(first) if first else df
    have, made = set(df.columns), {}
    for name, less, more in (("rank_diff", "winner_rank", "loser_rank"), ("points_diff", "loser_points", "winner_points"), ("implied_prob_diff_avg", "loser_implied_prob_avg", "winner_implied_prob_avg")):
        if {less, more} <= have:
            made[name] = F.col(more) - F.col(less)
    for suffix, name in schema.DIFFERENCES.items():
        if {f"winner_{suffix}", f"loser_{suffix}"} <= have:
            made[name] = F.col(f"winner_{suffix}") - F.col(f"loser_{suffix}")
    df = df.withColumns(made) if made else df
    return rare_buckets(df, rare)


def rare_buckets(df: DataFrame, least: int) -> DataFrame:
    """df with the buckets it can have and doesn't have yet; cheapest on the plain matches, before their histories."""
    for column in ("tournament", "location"):
        if column in df.columns and f"{column}_bucket" not in df.columns:
            df = rare_bucket(df, column, least)
    return df


def mirrored(df: DataFrame) -> DataFrame:
    """Two rows per match from one scan: as it is with player_a_win 1, and with sides swapped and differences negated with 0."""
    turned = {}
    for s in schema.SWAPPED:
        if f"winner_{s}" in df.columns and f"loser_{s}" in df.columns:
            turned |= {f"winner_{s}": F.col(f"loser_{s}"), f"loser_{s}": F.col(f"winner_{s}")}
    turned |= {c: scalars.flipped(c) for c in schema.FLIPPED if c in df.columns}
    types = dict(df.dtypes)
    own = F.struct(*[F.col(c) for c in df.columns], F.lit(1).alias("player_a_win"))
    other = F.struct(*[turned.get(c, F.col(c)).cast(types[c]).alias(c) for c in df.columns], F.lit(0).alias("player_a_win"))
    return df.select(F.inline(F.array(own, other)))


def matrix_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """The numeric and categorical features that df has, in order."""
    if "player_a_win" not in df.columns:
        raise ValueError("missing target column player_a_win")
    return [c for c in schema.NUMERIC_FEATURES if c in df.columns], [c for c in schema.CATEGORICAL if c in df.columns]


def feature_matrix(df: DataFrame, keys: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Keys, features and target; exclude names features to leave out (each must be one)."""
    numeric, categorical = matrix_columns(df)
    unknown = sorted(set(exclude or []) - set(numeric) - set(categorical))
    if unknown:
        raise ValueError(f"not features: {unknown}")
    kept = [c for c in (*numeric, *categorical) if c not in (exclude or [])]
    return df.select(*(keys or []), *kept, F.col("player_a_win").cast("int"))


def oriented(matches: DataFrame, key: str, shared: list[str], pairs: dict[str, tuple[str, str]], coin: Column | None = None) -> DataFrame:
    """One row per match with random sides: for each pair player_1's and player_2's value, and player_1_wins."""
    heads = scalars.coin(key) if coin is None else coin
    rows = matches.withColumn("_heads", heads)
    cols = []
    for name, (w, l) in pairs.items():  # noqa: E741
        cols += [F.when(F.col("_heads") == 1, F.col(w)).otherwise(F.col(l)).alias(name.format(1)), F.when(F.col("_heads") == 1, F.col(l)).otherwise(F.col(w)).alias(name.format(2))]
    return rows.select(key, *shared, *cols, F.col("_heads").cast("tinyint").alias("player_1_wins"))


def row_numbers(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Global 0-based numbers in the given total order, missing values last; no single task sees all rows."""
    return numbered(df, [F.col(c).asc_nulls_last() for c in order], name)[0]
