"""Service statistics of the external history, as they stood before each of its matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prematch import schema
from prematch.functions import scalars, skew
from prematch.functions import windows as W
from prematch.operators.asof import asof_join

_COUNTERS = list(schema.SERVE.values())


def serve_sides(history: DataFrame, match_id: str = "match_num") -> DataFrame:
    """One row per match and player: match id, date, player, side and the nine counters (null where a column is absent)."""
    rows = []
    for side, short in (("winner", "w"), ("loser", "l")):
        own = []
        for source, name in schema.SERVE.items():
            there = f"{short}_{source}"
            own.append((scalars.number(there) if there in history.columns else F.lit(None).cast("double")).alias(name))
        rows.append(F.struct(F.col(match_id).alias("match_id"), F.col("tourney_date"), F.col(f"{side}_id").alias("player"), F.lit(side).alias("side"), *own))
    return history.select(F.inline(F.array(*rows)))


def serve_totals(history: DataFrame, match_id: str = "match_num", hot: list | None = None) -> DataFrame:
    """The nine running totals as of the player's previous match (null where that match lacks the statistic); hot players go month by month."""
    order = ["tourney_date", "match_id"]
    sides = serve_sides(history, match_id)
    hot = skew.hot_keys(sides, "player") if hot is None else hot
    cut = skew.chunked(sides, "player", "tourney_date", hot)
    by = ["player", skew.CHUNK] if hot else ["player"]
    rows = cut.withColumns({f"_{c}": W.running_total(c, by, order) for c in _COUNTERS})
    keep = ["match_id", "tourney_date", "player", "side"]
    if not hot:
        return rows.select(*keep, *[W.previous(f"_{c}", by, order).alias(f"{c}_cum_before") for c in _COUNTERS])
    # the totals of earlier months, and the last row before this month
    before = skew.carried(cut, ["player"], {f"_b_{c}": F.col(c) for c in _COUNTERS})
    tails = skew.earlier_tail(skew.last_rows(cut, ["player"], order, _COUNTERS), ["player"])
    met = skew.attach(skew.attach(rows.withColumns({f"_p_{c}": W.previous(f"_{c}", by, order) for c in _COUNTERS} | {"_at": W.prior_count(by, order)}), before, ["player"]), tails, ["player"])
    last = F.try_element_at("tail", F.lit(-1))
    own = lambda c: F.col(f"_p_{c}") + F.coalesce(f"_b_{c}", F.lit(0.0))
    handed = lambda c: F.when(last[c].isNotNull(), F.col(f"_b_{c}"))
    return met.select(*keep, *[F.when(F.col("_at") > 0, own(c)).otherwise(handed(c)).alias(f"{c}_cum_before") for c in _COUNTERS])


def serve_rates(history: DataFrame, match_id: str = "match_num") -> DataFrame:
    """The seven rates of schema.SERVE_RATES before each match and player; null over a total of 0."""
    t = {c: F.col(f"{c}_cum_before") for c in _COUNTERS}
    made = [
        scalars.rate(t["ace"], t["svpt"]),
        scalars.rate(t["df"], t["svpt"]),
        scalars.rate(t["first_in"], t["svpt"]),
        scalars.rate(t["first_won"], t["first_in"]),
        scalars.rate(t["second_won"], t["svpt"] - t["first_in"]),
        scalars.rate(t["bp_saved"], t["bp_faced"]),
        scalars.rate(t["bp_faced"], t["sv_games"]),
    ]
    return serve_totals(history, match_id).select("match_id", "tourney_date", "player", "side", *[m.alias(f"{r}_before") for r, m in zip(schema.SERVE_RATES, made)])


def attach_serve(matches: DataFrame, rates: DataFrame, match_id: str = "match_id", date: str = "match_date", key: str = "name") -> DataFrame:
    """matches with ``winner_`` and ``loser_`` rates: those of the player's latest history row strictly before the match.

    Both sides go through one as-of join; the match rides on the winner's row.
    """
    columns = [f"{r}_before" for r in schema.SERVE_RATES]
    match = F.struct(*[F.col(c) for c in matches.columns])
    rows = [F.struct(F.col(match_id).alias("_id"), F.col(date).alias("_date"), F.lit(s).alias("_side_of"), F.col(f"{s}_{key}").alias("player"), (match if s == "winner" else F.when(F.lit(False), match)).alias("_match")) for s in ("winner", "loser")]
    asked = matches.select(F.inline(F.array(*rows)))
    found = asof_join(asked, rates, ["player"], "_date", "tourney_date", columns, ["match_id", "side"])
    own = F.struct(*columns)
    wide = found.groupBy("_id").agg(F.first("_match", ignorenulls=True).alias("m"), *[F.first(F.when(F.col("_side_of") == s, own), ignorenulls=True).alias(s) for s in ("winner", "loser")])
    return wide.select("m.*", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("winner", "loser") for c in columns])
