"""Raw matches to cleaned ones, and the keyed variant of the exploratory path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prematch import schema
from prematch.functions import scalars


def require(df: DataFrame, columns: list[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")


def first_rows(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the first by the given order (nulls in a key are equal)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def sort_nulls_last(df: DataFrame, columns: list[str]) -> DataFrame:
    """A total order wants a unique column at the end; Spark's sort is not stable."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def _renamed(raw: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return raw.select(*[F.col(f"`{old}`").alias(new) for old, new in schema.RAW_TO_CLEAN.items()], *keep)


#: Strings that are cleaned before anything is made of them.
_STRINGS = ["location", "tournament", "series", "court", "surface", "round", "winner_name", "loser_name"]


def _typed(df: DataFrame) -> DataFrame:
    """Every string is cleaned once, in a step of its own; what is made of it reads the result."""
    text = df.withColumns({c: scalars.clean_string(c) for c in _STRINGS})
    made: dict[str, Column] = {c: scalars.number(c) for c in schema.NUMERIC}
    made |= {c: scalars.whole(scalars.number(c)) for c in schema.INTEGERS}
    made |= {c: F.coalesce(c, F.lit("Unknown")) for c in ("location", "tournament")}
    made |= {"series": scalars.known_spelling("series", schema.SERIES), "round": scalars.known_spelling("round", schema.ROUNDS)}
    made |= {"court": scalars.allowed_title("court", schema.COURTS), "surface": scalars.allowed_title("surface", schema.SURFACES)}
    made |= {"date": scalars.to_date("date")}
    return text.withColumns(made)


def _valid(df: DataFrame) -> DataFrame:
    made: dict[str, Column] = {f"{s}_rank": scalars.positive(f"{s}_rank") for s in ("winner", "loser")}
    made |= {f"{s}_points": scalars.not_negative(f"{s}_points") for s in ("winner", "loser")}
    made |= {c: scalars.odds(c) for c in schema.ODDS}
    return df.withColumns(made).withColumn("has_any_market_odds", scalars.any_present(schema.ODDS))


def normalize(raw: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Completed matches of two named, different players on a readable date, in the columns of schema.CLEAN_COLUMNS.

    Rows that are alike in all columns count once; those named in keep come along, in front.
    """
    return normalize_distinct(raw.dropDuplicates(), keep)


def normalize_distinct(raw: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``normalize`` for rows without repeats."""
    require(raw, list(schema.RAW_TO_CLEAN))
    done = _renamed(raw, keep).where(scalars.completed("comment"))
    typed = _typed(done).dropna(subset=["date", "winner_name", "loser_name"]).where("winner_name != loser_name")
    return _valid(typed).select(*keep, *schema.CLEAN_COLUMNS)


def ordered(clean: DataFrame) -> DataFrame:
    """The order in which cleaned matches are stored."""
    return sort_nulls_last(clean, ["date", "source_year", "atp", "tournament", "winner_name", "loser_name"])


def clean_counters(raw: DataFrame) -> DataFrame:
    """One row: how many rows each step of ``normalize`` takes away (missing players count cells, not rows)."""
    require(raw, list(schema.RAW_TO_CLEAN))
    copies = raw.groupBy(*[F.col(f"`{c}`") for c in raw.columns]).agg(F.count(F.lit(1)).alias("_n"))
    typed = _typed(_renamed(copies, ["_n"]))
    done = F.coalesce(scalars.completed("comment"), F.lit(False))
    dated = done & F.col("date").isNotNull()
    named = dated & F.col("winner_name").isNotNull() & F.col("loser_name").isNotNull()
    count = lambda c: F.count_if(c)
    return typed.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("input_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("removed_exact_duplicates"),
        count(~done).alias("removed_not_completed"),
        count(done & F.col("date").isNull()).alias("removed_invalid_dates"),
        (count(dated & F.col("winner_name").isNull()) + count(dated & F.col("loser_name").isNull())).alias("removed_missing_players"),
        count(named & (F.col("winner_name") == F.col("loser_name"))).alias("removed_invalid_rows"),
        count(named & (F.col("winner_name") != F.col("loser_name"))).alias("output_rows"),
    )


def keyed_matches(raw: DataFrame, order: list[str]) -> DataFrame:
    """The exploratory path: the comment exactly "Completed", date and players present, the first row of each
    (Date, Tournament, Winner, Loser) by the given order, seven columns made numeric."""
    require(raw, ["Date", "Tournament", "Series", "Court", "Surface", "Round", "Best of", "Winner", "Loser", "WRank", "LRank", "WPts", "LPts", "Comment", "AvgW", "AvgL"])
    kept = raw.withColumn("Date", scalars.to_date("Date")).where(F.col("Comment") == "Completed").dropna(subset=["Date", "Winner", "Loser"])
    one = first_rows(kept, ["Date", "Tournament", "Winner", "Loser"], [F.col(c) for c in order])
    return one.withColumns({c: scalars.number(F.col(f"`{c}`")) for c in ("Best of", "WRank", "LRank", "WPts", "LPts", "AvgW", "AvgL")})
