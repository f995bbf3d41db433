"""Checks and reports: one aggregation each, raised or returned on the driver."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prematch import schema

_log = logging.getLogger("prematch")


def out_of_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(column_name, n_low, n_high): values below and above their bounds, for the columns df has."""
    have = [c for c in bounds if c in df.columns]
    counts = df.agg(*[F.count_if(F.col(c) < bounds[c][0]).alias(f"{c}__low") for c in have], *[F.count_if(F.col(c) > bounds[c][1]).alias(f"{c}__high") for c in have])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__low").alias("n_low"), F.col(f"{c}__high").alias("n_high")) for c in have])))


def rate_bounds(columns: list[str]) -> dict[str, tuple[float, float]]:
    """0 to 1 for every rate before a match."""
    return {c: (0.0, 1.0) for c in columns if c.endswith("_rate_before")}


def age_bounds(columns: list[str], least: float = 14.0, most: float = 60.0) -> dict[str, tuple[float, float]]:
    return {c: (least, most) for c in columns if c in ("winner_age_years", "loser_age_years")}


def validate(df: DataFrame) -> None:
    """Raise if a rate leaves [0, 1] or an age [14, 60]."""
    bounds = rate_bounds(df.columns) | age_bounds(df.columns)
    bad = [r.asDict() for r in out_of_range(df, bounds).where("n_low > 0 or n_high > 0").collect()] if bounds else []
    if bad:
        raise ValueError(f"values out of range: {bad}")


def warn(df: DataFrame) -> list[dict]:
    """Log and return what leaves [0, 1] (rates) or [12, 60] (ages), without raising."""
    rates = [f"{s}_{r}_before" for s in ("winner", "loser") for r in schema.SERVE_RATES if r.endswith("_rate")]
    bounds = rate_bounds([c for c in rates if c in df.columns]) | age_bounds(df.columns, 12.0)
    bad = [r.asDict() for r in out_of_range(df, bounds).where("n_low > 0 or n_high > 0").collect()] if bounds else []
    for row in bad:
        _log.warning("out of range: %s", row)
    return bad


def assert_unique(df: DataFrame, key: list[str]) -> None:
    """Raise if two rows share a key (a one-to-one join is only that if both sides pass)."""
    again = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"key {key} is not unique, e.g. {again[0].asDict()}")


def join_one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join on a key that must be unique on both sides."""
    assert_unique(left, key)
    assert_unique(right, key)
    return left.join(right, key, "left")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, pct): share of rows with a value, in percent, in one aggregation."""
    have = [c for c in columns if c in df.columns]
    one = df.agg(*[(100.0 * F.count(c) / F.count(F.lit(1))).alias(c) for c in have])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("pct")) for c in have])))


def check_prepared(df: DataFrame, features: list[str], target: str, date: str, part: str) -> None:
    """Periods in order and disjoint, both labels, balance of 0.45 to 0.55 in training, no outcome column, all values finite."""
    forbidden = {"Winner", "Loser", "Wsets", "Lsets", "Comment"} & set(features)
    if forbidden:
        raise ValueError(f"outcome columns among the features: {sorted(forbidden)}")
    parts = {r[part]: r for r in df.groupBy(part).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.avg(target).alias("share"), F.count_distinct(target).alias("labels")).collect()}
    for a, b in (("train", "validation"), ("validation", "test")):
        if a in parts and b in parts and not parts[a]["last"] < parts[b]["first"]:
            raise ValueError(f"{a} and {b} overlap")
    if "train" in parts and (parts["train"]["labels"] != 2 or not 0.45 <= parts["train"]["share"] <= 0.55):
        raise ValueError("training labels are missing or out of balance")
    numeric = [c for c, t in df.dtypes if c in features and t in ("double", "float")]
    odd = [F.count_if(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))).alias(c) for c in numeric]
    if odd and any(df.agg(*odd).first()):
        raise ValueError("values that are not finite")
