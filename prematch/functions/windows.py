"""Point-in-time window columns: what was known before the current row.

Every function takes the partition columns and a total order (end it with a
unique id).  Windows over (player) and (player, surface) need one shuffle
together, as a partitioning by player serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _over(by: list[str], order: list[str], strict_on: str | None) -> WindowSpec:
    """All earlier rows; with strict_on (a date), those of earlier days only."""
    if strict_on:
        return Window.partitionBy(*by).orderBy(F.unix_date(strict_on)).rangeBetween(Window.unboundedPreceding, -1)
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def prior_count(by: list[str], order: list[str], strict_on: str | None = None) -> Column:
    """Earlier rows of the group, as a double."""
    if strict_on:
        return F.count(F.lit(1)).over(_over(by, order, strict_on)).cast("double")
    return (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("double")


def prior_sum(x: Column | str, by: list[str], order: list[str], strict_on: str | None = None) -> Column:
    """Sum of x over earlier rows; 0 for the first."""
    return F.coalesce(F.sum(x).over(_over(by, order, strict_on)), F.lit(0.0)).cast("double")


def recent_sum(x: Column | str, n: int, by: list[str], order: list[str]) -> Column:
    """Sum of x over the n rows before this one; 0 for the first."""
    return F.coalesce(F.sum(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)), F.lit(0.0)).cast("double")


def share(top: Column, bottom: Column) -> Column:
    """top / bottom, null unless bottom is above 0."""
    return F.when(bottom > 0, top / bottom)


def running_total(x: str, by: list[str], order: list[str]) -> Column:
    """Sum of x up to and including this row, null where x is null."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(F.col(x).isNotNull(), F.sum(x).over(run))


def previous(x: str, by: list[str], order: list[str]) -> Column:
    """x of the group's previous row, null or not.

    Over a running total this hands on the null of a previous row without a
    value, where a sum over earlier rows would skip it.
    """
    return F.lag(x).over(Window.partitionBy(*by).orderBy(*order))


def days_since(date: str, by: list[str], order: list[str]) -> Column:
    """Whole days since the group's previous row, as a double; 0 on the same day."""
    return F.datediff(date, F.lag(date).over(Window.partitionBy(*by).orderBy(*order))).cast("double")
