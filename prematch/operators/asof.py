"""As-of join: for each row the latest earlier row of the same key on the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prematch.functions import skew


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, payload: list[str], tiebreak: list[str], strict: bool = True, first_of_day: bool = False, hot: list | None = None) -> DataFrame:
    """left with the payload columns and ``right_on`` of the right row with the greatest ``right_on`` before ``left_on``.

    Of right rows on one day the last by tiebreak counts (the first with
    first_of_day), whether or not its payload is null.  Left rows with a null key or day,
    or without an earlier right row, get nulls.  One shuffle: both sides meet in
    one window, and the right side is reduced to one row per key and day
    before it.  Hot values of the first key go month by month: the last right row of
    earlier months is carried into the next.
    """
    pick = F.min_by if first_of_day else F.max_by
    values = F.struct(F.col(right_on).alias(right_on), *[F.col(c) for c in payload])
    order = F.struct(*[F.col(c) for c in tiebreak])
    known = right.where(F.col(right_on).isNotNull())
    for k in by:
        known = known.where(F.col(k).isNotNull())
    days = known.groupBy(*by, F.col(right_on).alias("_on")).agg(pick(values, order).alias("_values"))
    row = F.struct(*[F.col(c) for c in left.columns])
    # at the same time the left row (0) comes first if the join is strict
    first, second = (0, 1) if strict else (1, 0)
    asked = left.select(*by, F.col(left_on).alias("_on"), F.lit(first).alias("_side"), row.alias("_row"))
    told = days.select(*by, "_on", F.lit(second).alias("_side"), "_values")
    both = asked.unionByName(told, allowMissingColumns=True)
    hot = skew.hot_keys(both, by[0]) if hot is None else hot
    cut = skew.chunked(both, by[0], "_on", hot)
    group = [*by, skew.CHUNK] if hot else by
    back = Window.partitionBy(*group).orderBy("_on", "_side").rowsBetween(Window.unboundedPreceding, -1)
    usable = F.col("_on").isNotNull()
    for k in by:
        usable &= F.col(k).isNotNull()
    found = F.last("_values", ignorenulls=True).over(back)
    met = cut.withColumn("_found", F.when(usable, found)).where(F.col("_side") == first)
    if hot:
        # one value per hot key and month; months without a right row hand on what they got
        months = cut.where(F.col(skew.CHUNK) != 0).groupBy(*group).agg(F.max_by("_values", F.when(F.col("_values").isNotNull(), F.col("_on"))).alias("_last"))
        earlier = Window.partitionBy(*by).orderBy(skew.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        handed = months.select(*group, F.last("_last", ignorenulls=True).over(earlier).alias("_handed"))
        met = skew.attach(met, handed, by).withColumn("_found", F.when(usable, F.coalesce("_found", "_handed")))
    return met.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in [right_on, *payload]])
