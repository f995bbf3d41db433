"""Windows over hot keys: a key with very many rows is cut into months, and what earlier months left is carried over.

A window over (key) sends all rows of a key to one task.  For keys above
``floor`` rows and a thousandth of all (so fewer than a thousand keys) the
window runs over (key, month) instead; one row per hot key and month then
carries totals, last values and tails into the following months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that a task sorts comfortably.
FLOOR = 5_000_000
SHARE = 1 / 1000
CHUNK = "_chunk"


def plan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a frame's size, without running anything."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def hot_keys(df: DataFrame, key: str, floor: int = FLOOR) -> list:
    """Keys with over ``floor`` rows and over SHARE of all; no job runs for a frame that by Spark's estimate is too small to have one (8 bytes a row)."""
    if plan_bytes(df) < 8 * floor:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor)
    rows = counts.orderBy(F.col("n").desc()).limit(int(1 / SHARE)).collect()
    return [r[key] for r in rows]


def chunked(df: DataFrame, key: str, date: str, hot: list) -> DataFrame:
    """df with CHUNK: the month for hot keys, 0 for all others."""
    month = F.year(date) * 12 + F.month(date)
    return df.withColumn(CHUNK, F.when(F.col(key).isin(hot), F.coalesce(month, F.lit(-1))).otherwise(0) if hot else F.lit(0))


def carried(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """(keys, CHUNK, names): sums over all earlier months of the same keys, for months that have any."""
    months = df.where(F.col(CHUNK) != 0).groupBy(*keys, CHUNK).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return months.select(*keys, CHUNK, *[F.sum(n).over(before).alias(n) for n in totals])


def last_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], n: int = 1) -> DataFrame:
    """(keys, CHUNK, tail): the last n rows of every hot month in order, as structs of columns."""
    at = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order]))
    top = df.where(F.col(CHUNK) != 0).withColumn("_at", at).where(F.col("_at") <= n)
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("_at")).alias("_at"), *[F.col(c) for c in columns])))
    return top.groupBy(*keys, CHUNK).agg(pairs.alias("tail"))


def earlier_tail(tails: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    """(keys, CHUNK, tail): the last n rows of all earlier months; each of the last n months has one at least."""
    back = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-n, -1)
    joined = F.flatten(F.collect_list("tail").over(back))
    return tails.select(*keys, CHUNK, F.slice(joined, F.greatest(F.size(joined) - n + 1, F.lit(1)), n).alias("tail"))


def attach(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys and CHUNK; more has a row per hot key and month."""
    return df.join(more, [*keys, CHUNK], "left")
