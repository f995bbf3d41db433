"""Histories of participants and of pairs, as they stood before each match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prematch import schema
from prematch.functions import scalars, skew
from prematch.functions import windows as W

SIDES = ("winner", "loser")


def sides(matches: DataFrame, columns: list[str], suffixes: tuple[str, ...] = ("name",), whole: bool = False) -> DataFrame:
    """Two rows per match from one scan: the shared columns, ``side``, ``is_win`` and for each suffix the side's own value.

    With whole, the winner's row also carries the match as a struct ``match``.
    """
    rows = []
    for side in SIDES:
        own = [F.col(f"{side}_{s}").alias("player" if s == "name" else s) for s in suffixes]
        cols = [*[F.col(c) for c in columns], F.lit(side).alias("side"), F.lit(1.0 if side == "winner" else 0.0).alias("is_win"), *own]
        if whole:
            match = F.struct(*[F.col(c) for c in matches.columns])
            cols.append((match if side == "winner" else F.when(F.lit(False), match)).alias("match"))
        rows.append(F.struct(*cols))
    return matches.select(F.inline(F.array(*rows)))


def with_history(rows: DataFrame, order: list[str], date: str, strict: bool = False, hot: list | None = None) -> DataFrame:
    """rows (player, surface, is_win, ...) with the ten columns of schema.HISTORY.

    Earlier means earlier in the given order, same-day matches included; strict
    leaves same-day matches out of counts and sums.  A null surface has no
    surface history.  Hot players (found, or given) are worked on month by month.
    """
    hot = skew.hot_keys(rows, "player") if hot is None else hot
    if hot:
        return _in_months(rows, order, date, strict, hot)
    return _finished(_counted(rows, order, date, strict, []), rows.columns)


def _counted(rows: DataFrame, order: list[str], date: str, strict: bool, more: list[str]) -> DataFrame:
    """Counts, sums and gaps within (player, more)."""
    day = date if strict else None
    player, ground = ["player", *more], ["player", *more, "surface"]
    return rows.withColumns(
        {
            "matches_before": W.prior_count(player, order, day),
            "wins_before": W.prior_sum("is_win", player, order, day),
            "recent5_wins_before": W.recent_sum("is_win", 5, player, order),
            "surface_matches_before": W.prior_count(ground, order, day),
            "surface_wins_before": W.prior_sum("is_win", ground, order, day),
            "days_since_last_match": W.days_since(date, player, order),
            "_earlier": W.prior_count(player, order),
        }
    )


def _finished(counted: DataFrame, columns: list[str]) -> DataFrame:
    on_ground = F.col("surface").isNotNull()
    made = counted.withColumns({c: F.when(on_ground, F.col(c)) for c in ("surface_matches_before", "surface_wins_before")} | {"recent5_matches_before": F.least("_earlier", F.lit(5.0))})
    made = made.withColumns(
        {
            "win_rate_before": W.share(F.col("wins_before"), F.col("matches_before")),
            "recent5_win_rate_before": W.share(F.col("recent5_wins_before"), F.col("recent5_matches_before")),
            "surface_win_rate_before": W.share(F.col("surface_wins_before"), F.col("surface_matches_before")),
        }
    )
    return made.select(*columns, *schema.HISTORY)


def _in_months(rows: DataFrame, order: list[str], date: str, strict: bool, hot: list) -> DataFrame:
    cut = skew.chunked(rows, "player", date, hot)
    player, ground = ["player"], ["player", "surface"]
    totals = {"_n": F.lit(1.0), "_w": F.col("is_win")}
    before = skew.carried(cut, player, totals)
    on_ground = skew.carried(cut.where("surface is not null"), ground, {"_sn": F.lit(1.0), "_sw": F.col("is_win")})
    tails = skew.earlier_tail(skew.last_rows(cut, player, order, ["is_win", date], 5), player, 5)
    met = _counted(cut, order, date, strict, [skew.CHUNK])
    met = skew.attach(skew.attach(skew.attach(met, before, player), on_ground, ground), tails, player)
    none = F.lit(0.0)
    # of the last five, those that this month does not have yet
    short = F.greatest(5 - F.col("_earlier"), none).cast("int")
    taken = F.aggregate(F.slice("tail", F.greatest(F.size("tail") - short + 1, F.lit(1)), short), none, lambda acc, x: acc + x["is_win"])
    met = met.withColumns(
        {
            "recent5_wins_before": F.col("recent5_wins_before") + F.when(F.size("tail") > 0, taken).otherwise(none),
            "days_since_last_match": F.coalesce("days_since_last_match", F.when(F.col("_earlier") == 0, F.datediff(date, F.try_element_at("tail", F.lit(-1))[date]).cast("double"))),
            "matches_before": F.col("matches_before") + F.coalesce("_n", none),
            "wins_before": F.col("wins_before") + F.coalesce("_w", none),
            "surface_matches_before": F.col("surface_matches_before") + F.coalesce("_sn", none),
            "surface_wins_before": F.col("surface_wins_before") + F.coalesce("_sw", none),
            "_earlier": F.col("_earlier") + F.coalesce("_n", none),
        }
    )
    return _finished(met, rows.columns)


def player_history(matches: DataFrame, match_id: str = "match_id", date: str = "match_date", strict: bool = False, hot: list | None = None) -> DataFrame:
    """One row per match and side with the player's history before the match."""
    return with_history(sides(matches, [match_id, date, "surface"]), [date, match_id], date, strict, hot)


def attach_history(matches: DataFrame, match_id: str = "match_id", date: str = "match_date", strict: bool = False) -> DataFrame:
    """matches with ``winner_`` and ``loser_`` columns of schema.HISTORY.

    The match rides along on the winner's row, so the sides meet in one
    aggregation by match_id and matches is scanned once.
    """
    long = with_history(sides(matches, [match_id, date, "surface"], whole=True), [date, match_id], date, strict)
    own = F.struct(*schema.HISTORY)
    wide = long.groupBy(F.col(match_id).alias("_id")).agg(F.first("match", ignorenulls=True).alias("m"), *[F.first(F.when(F.col("side") == s, own), ignorenulls=True).alias(s) for s in SIDES])
    return wide.select("m.*", *[F.col(f"{s}.{h}").alias(f"{s}_{h}") for s in SIDES for h in schema.HISTORY])


def attach_head_to_head(matches: DataFrame, match_id: str = "match_id", date: str = "match_date", hot: list | None = None) -> DataFrame:
    """matches with the pair's earlier meetings and each side's wins and win rate in them; hot pairs go month by month."""
    order = [date, match_id]
    keyed = matches.withColumns({"_pair": scalars.pair_key("winner_name", "loser_name"), "_first": scalars.first_in_pair("winner_name", "loser_name")})
    hot = skew.hot_keys(keyed, "_pair") if hot is None else hot
    cut = skew.chunked(keyed, "_pair", date, hot)
    pair = ["_pair", skew.CHUNK] if hot else ["_pair"]
    met = cut.withColumns({"h2h_matches_before": W.prior_count(pair, order), "_wins": W.prior_sum(F.col("_first").cast("double"), pair, order)})
    if hot:
        met = skew.attach(met, skew.carried(cut, ["_pair"], {"_n": F.lit(1.0), "_w": F.col("_first").cast("double")}), ["_pair"])
        met = met.withColumns({"h2h_matches_before": F.col("h2h_matches_before") + F.coalesce("_n", F.lit(0.0)), "_wins": F.col("_wins") + F.coalesce("_w", F.lit(0.0))})
    winner = F.when(F.col("_first") == 1, F.col("_wins")).otherwise(F.col("h2h_matches_before") - F.col("_wins"))
    met = met.withColumn("winner_h2h_wins_before", winner).withColumn("loser_h2h_wins_before", F.col("h2h_matches_before") - F.col("winner_h2h_wins_before"))
    rates = {f"{s}_h2h_win_rate_before": W.share(F.col(f"{s}_h2h_wins_before"), F.col("h2h_matches_before")) for s in SIDES}
    return met.withColumns(rates).select(*matches.columns, "h2h_matches_before", *[f"{s}_h2h_wins_before" for s in SIDES], *rates)
