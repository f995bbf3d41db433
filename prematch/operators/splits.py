"""Splits by date: holdout, expanding folds, fixed periods, folds by row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_dates(df: DataFrame, date: str) -> DataFrame:
    """The distinct dates: at most one row per day, so an ordered window over them stays small."""
    return df.where(F.col(date).isNotNull()).select(F.col(date).cast("date").alias(date)).distinct()


def date_chunks(df: DataFrame, date: str, chunks: int) -> DataFrame:
    """(date, chunk): distinct dates in order, in chunks of equal size, larger ones first."""
    return distinct_dates(df, date).withColumn("chunk", F.ntile(chunks).over(Window.orderBy(date)) - 1)


def date_folds(df: DataFrame, date: str, folds: int) -> DataFrame:
    """df with ``chunk``: fold f of 1..folds trains on chunks below f and tests on chunk f."""
    chunks = date_chunks(df, date, folds + 1)
    if chunks.limit(folds + 1).count() < folds + 1:
        raise ValueError(f"{folds} folds need at least {folds + 1} distinct dates")
    return df.join(F.broadcast(chunks), date)


def fold(df: DataFrame, f: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of fold f."""
    return df.where(F.col("chunk") < f).drop("chunk"), df.where(F.col("chunk") == f).drop("chunk")


def cutoff_date(df: DataFrame, date: str, fraction: float) -> dt.date:
    """The first date of the last ``fraction`` of distinct dates."""
    dates = distinct_dates(df, date)
    at = int(dates.count() * (1 - fraction))
    row = dates.withColumn("_at", F.row_number().over(Window.orderBy(date)) - 1).where(F.col("_at") == at).first()
    if row is None:
        raise ValueError("no date left for the holdout")
    return row[date]


def holdout(df: DataFrame, date: str, fraction: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(train, holdout): before the cut-off date, and from it on."""
    cut = F.lit(cutoff_date(df, date, fraction))
    return df.where(F.col(date) < cut), df.where(F.col(date) >= cut)


def period(date: Column | str, train_end: str = "2024-12-31", validation_end: str = "2025-12-31") -> Column:
    """"train" up to one date, "validation" up to another, "test" after."""
    day = F.col(date) if isinstance(date, str) else date
    first, second = F.lit(train_end).cast("date"), F.lit(validation_end).cast("date")
    return F.when(day <= first, "train").when(day <= second, "validation").when(day > second, "test")


def split_count(n: int) -> int:
    """Folds by row for n rows: 3 under 1,000, 4 under 5,000, else 5."""
    return 3 if n < 1000 else 4 if n < 5000 else 5


def row_splits(n: int, folds: int) -> list[tuple[int, int]]:
    """(first, end) of each fold's test rows; what comes before them trains."""
    size = n // (folds + 1)
    return [(n - (folds - i) * size, n - (folds - i - 1) * size) for i in range(folds)]


def row_folds(numbered: DataFrame, row_id: str, n: int, folds: int | None = None) -> DataFrame:
    """(fold, part, and all columns) of rows numbered from 0: each fold's train and test rows."""
    bounds = row_splits(n, folds or split_count(n))
    options = F.array(*[F.struct(F.lit(i + 1).alias("fold"), F.when(F.col(row_id) < a, "train").when(F.col(row_id) < b, "test").alias("part")) for i, (a, b) in enumerate(bounds)])
    return numbered.select("*", F.explode(options).alias("_f")).where("_f.part is not null").select("_f.fold", "_f.part", *numbered.columns)
