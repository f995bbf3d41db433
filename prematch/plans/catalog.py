"""Named queries over the test tables, each with an independent DuckDB query where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prematch import schema
from prematch.functions import scalars
from prematch.operators import checks, clean, entity, features, history, ml, serve, splits
from prematch.plans import views
from prematch.sources import manifest, shared, store, tables, xlsx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- SQL building blocks for the oracle ---------------------------------------------------

_B = f"bouts as ({views.BOUTS})"
_S = f"serve as ({views.SERVE})"
_R = f"raw as ({views.RAW_TWICE})"


def _cl(x: str) -> str:
    return rf"nullif(trim(regexp_replace({x}, '\s+', ' ', 'g')), '')"


def _map(x: str, spellings: dict[str, str], other: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in spellings.items()) + f" else {other} end"


def _title(x: str, allowed: list[str]) -> str:
    return f"case lower({_cl(x)}) " + " ".join(f"when '{a.lower()}' then '{a}'" for a in allowed) + " else 'Unknown' end"


_TYPED = f"""
done as (select distinct * from raw where lower({_cl("comment")}) = 'completed'),
typed as (
  select match_id, cast(round_even(try_cast(source_year as double), 0) as bigint) as source_year, cast(round_even(try_cast(atp as double), 0) as bigint) as atp,
    coalesce({_cl("location")}, 'Unknown') as location, coalesce({_cl("tournament")}, 'Unknown') as tournament, try_cast(date as date) as date,
    {_map(f"coalesce({_cl('series')}, 'Unknown')", schema.SERIES, f"coalesce({_cl('series')}, 'Unknown')")} as series,
    {_title("court", schema.COURTS)} as court, {_title("surface", schema.SURFACES)} as surface,
    {_map(f"coalesce({_cl('round')}, 'Unknown')", schema.ROUNDS, f"coalesce({_cl('round')}, 'Unknown')")} as round,
    cast(round_even(try_cast(best_of as double), 0) as bigint) as best_of, {_cl("winner_name")} as winner_name, {_cl("loser_name")} as loser_name,
    {", ".join(f"try_cast({c} as double) as {c}" for c in schema.NUMERIC if c not in schema.INTEGERS)}
  from done
)"""
_VALID = ", ".join(
    [f"case when {s}_rank > 0 then {s}_rank end as {s}_rank" for s in ("winner", "loser")]
    + [f"case when {s}_points >= 0 then {s}_points end as {s}_points" for s in ("winner", "loser")]
    + [f"case when {c} > 1.0 then {c} end as {c}" for c in schema.ODDS]
)


@query(
    f"""with {_R}, {_TYPED}, valid as (
  select * replace ({_VALID}) from typed where date is not null and winner_name is not null and loser_name is not null and winner_name != loser_name
) select match_id, {", ".join(f"cast({c} as double) as {c}" if c in ("atp", "best_of") else c for c in schema.CLEAN_COLUMNS if c != "has_any_market_odds")},
  cast(coalesce({", ".join(schema.ODDS)}) is not null as int) as has_any_market_odds from valid"""
)
def q_bouts_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning: duplicates, completed only, names, dates, numbers, null-outs."""
    made = clean.normalize(views.raw(spark, sf_dir), keep=["match_id"])
    return made.withColumns({c: F.col(c).cast("double") for c in ("atp", "best_of")})  # whole numbers or null: compared as doubles


@query(
    f"""with {_R}, one as (select distinct * from raw), marked as (
  select *, coalesce(lower({_cl("comment")}) = 'completed', false) as done, try_cast(date as date) as d, {_cl("winner_name")} as w, {_cl("loser_name")} as l from one
) select cast((select count(*) from raw) as bigint) as input_rows, cast((select count(*) from raw) - count(*) as bigint) as removed_exact_duplicates,
  count(*) filter (where not done) as removed_not_completed, count(*) filter (where done and d is null) as removed_invalid_dates,
  count(*) filter (where done and d is not null and w is null) + count(*) filter (where done and d is not null and l is null) as removed_missing_players,
  count(*) filter (where done and d is not null and w = l) as removed_invalid_rows,
  count(*) filter (where done and d is not null and w != l) as output_rows from marked"""
)
def q_clean_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cleaning step takes away."""
    return clean.clean_counters(views.raw(spark, sf_dir))


@query(f"with {_B} select source_year, count(*) as n from bouts group by source_year")
def q_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bouts(spark, sf_dir).groupBy("source_year").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_B} select surface, count(*) as n from bouts group by surface")
def q_value_counts_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with missing as a value of its own."""
    return views.bouts(spark, sf_dir).groupBy("surface").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {_R} select "date" as d, tournament, winner_name, loser_name, match_id from raw
where comment = 'completed' and "date" is not null and winner_name is not null and loser_name is not null
qualify row_number() over (partition by "date", tournament, winner_name, loser_name order by match_id, comment) = 1"""
)
def q_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key in a given order."""
    raw = views.over(spark, sf_dir, views.RAW_TWICE).where("comment = 'completed'").dropna(subset=["date", "winner_name", "loser_name"])
    one = clean.first_rows(raw, ["date", "tournament", "winner_name", "loser_name"], [F.col("match_id"), F.col("comment")])
    return one.select(F.col("date").alias("d"), "tournament", "winner_name", "loser_name", "match_id")


# --- history --------------------------------------------------------------------------------

_LONG = f"""{_B}, long as (
  select match_id, match_date, surface, 'winner' as side, cast(1 as double) as is_win, winner_name as player from bouts
  union all select match_id, match_date, surface, 'loser', cast(0 as double), loser_name from bouts
), counted as (
  select *, cast(count(*) over p as double) - 1 as matches_before, sum(is_win) over p - is_win as wins_before,
    coalesce(sum(is_win) over (partition by player order by match_date, match_id rows between 5 preceding and 1 preceding), 0) as recent5_wins_before,
    case when surface is not null then cast(count(*) over s as double) - 1 end as surface_matches_before,
    case when surface is not null then sum(is_win) over s - is_win end as surface_wins_before,
    cast(match_date - lag(match_date) over (partition by player order by match_date, match_id) as double) as days_since_last_match
  from long
  window p as (partition by player order by match_date, match_id rows between unbounded preceding and current row),
         s as (partition by player, surface order by match_date, match_id rows between unbounded preceding and current row)
), hist as (
  select *, least(matches_before, 5) as recent5_matches_before,
    case when matches_before > 0 then wins_before / matches_before end as win_rate_before,
    case when matches_before > 0 then recent5_wins_before / least(matches_before, 5) end as recent5_win_rate_before,
    case when surface_matches_before > 0 then surface_wins_before / surface_matches_before end as surface_win_rate_before
  from counted
)"""
_PLAYER = ["matches_before", "wins_before", "win_rate_before", "recent5_matches_before", "recent5_wins_before", "recent5_win_rate_before", "days_since_last_match"]
_GROUND = ["surface_matches_before", "surface_wins_before", "surface_win_rate_before"]


@query(f"with {_LONG} select match_id, side, player, {', '.join(_PLAYER)} from hist")
def q_player_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's record before each match."""
    return history.player_history(views.bouts(spark, sf_dir)).select("match_id", "side", "player", *_PLAYER)


@query(f"with {_LONG} select match_id, side, player, surface, {', '.join(_GROUND)} from hist")
def q_surface_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record on the match's surface; none where the surface is missing."""
    return history.player_history(views.bouts(spark, sf_dir)).select("match_id", "side", "player", "surface", *_GROUND)


@query(
    f"""with {_LONG}, days as (
  select player, match_date, sum(is_win) as wins, count(*) as n from hist group by all
), upto as (
  select player, match_date, coalesce(sum(n) over w, 0) as n, coalesce(sum(wins) over w, 0) as wins from days
  window w as (partition by player order by match_date rows between unbounded preceding and 1 preceding)
) select h.match_id, h.side, h.player, cast(u.n as double) as matches_before, cast(u.wins as double) as wins_before
from hist h join upto u on u.player = h.player and u.match_date = h.match_date"""
)
def q_strict_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of earlier days only."""
    return history.player_history(views.bouts(spark, sf_dir), strict=True).select("match_id", "side", "player", "matches_before", "wins_before")


_WIDE = (
    "wide as (select b.*, "
    + ", ".join(f"{s[0]}.{c} as {s}_{c}" for s in ("winner", "loser") for c in schema.HISTORY)
    + " from bouts b join hist w on w.match_id = b.match_id and w.side = 'winner' join hist l on l.match_id = b.match_id and l.side = 'loser')"
)


@query(f"with {_LONG}, {_WIDE} select * from wide")
def q_history_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with both players' records."""
    return history.attach_history(views.bouts(spark, sf_dir))


def _h2h(source: str) -> str:
    return f"""paired as (
  select *, least(winner_name, loser_name) || '||' || greatest(winner_name, loser_name) as pair, cast(winner_name <= loser_name as int) as is_first from {source}
), met as (
  select * exclude (pair, is_first), is_first, cast(count(*) over p as double) - 1 as h2h_matches_before, cast(sum(is_first) over p - is_first as double) as first_wins
  from paired window p as (partition by pair order by match_date, match_id rows between unbounded preceding and current row)
), sided as (
  select *, case when is_first = 1 then first_wins else h2h_matches_before - first_wins end as winner_h2h_wins_before,
    case when is_first = 1 then h2h_matches_before - first_wins else first_wins end as loser_h2h_wins_before from met
), h2h as (
  select * exclude (is_first, first_wins), case when h2h_matches_before > 0 then winner_h2h_wins_before / h2h_matches_before end as winner_h2h_win_rate_before,
    case when h2h_matches_before > 0 then loser_h2h_wins_before / h2h_matches_before end as loser_h2h_win_rate_before from sided
)"""


_H2H_COLS = ["h2h_matches_before", "winner_h2h_wins_before", "loser_h2h_wins_before", "winner_h2h_win_rate_before", "loser_h2h_win_rate_before"]


@query(f"with {_B}, {_h2h('bouts')} select match_id, {', '.join(_H2H_COLS)} from h2h")
def q_head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier meetings of the pair."""
    return history.attach_head_to_head(views.bouts(spark, sf_dir)).select("match_id", *_H2H_COLS)


# --- features ---------------------------------------------------------------------------------

RARE = 50


@query(f"with {_B} select match_id, tournament, case when count(*) over (partition by tournament) >= {RARE} and tournament is not null then tournament else 'other' end as tournament_bucket from bouts")
def q_rare_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rare_bucket(views.bouts(spark, sf_dir), "tournament", RARE).select("match_id", "tournament", "tournament_bucket")


_ORDINAL = "case {0} " + " ".join(f"when '{k}' then {float(v)}" for k, v in schema.ROUND_ORDINAL.items()) + " else -1.0 end"
_ROUND_NAME = _map(f"coalesce({_cl('round')}, 'Unknown')", schema.ROUNDS, f"coalesce({_cl('round')}, 'Unknown')")


@query(f"with {_B} select match_id, {_ROUND_NAME} as round, cast({_ORDINAL.format(_ROUND_NAME)} as double) as round_ordinal from bouts")
def q_round_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = views.bouts(spark, sf_dir).withColumn("round", scalars.round_name("round"))
    return named.select("match_id", "round", features.round_ordinal().alias("round_ordinal"))


@query(
    f"""with {_B} select match_id, 1.0 / w as winner_implied_prob_avg, 1.0 / l as loser_implied_prob_avg, 1.0 / w - 1.0 / l as implied_prob_diff_avg
from (select match_id, case when avg_winner > 1.0 then avg_winner end as w, case when avg_loser > 1.0 then avg_loser end as l from bouts)"""
)
def q_implied_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = views.bouts(spark, sf_dir).withColumns({c: scalars.odds(c) for c in ("avg_winner", "avg_loser")})
    made = valid.select("match_id", *[c.alias(n) for n, c in features.market(valid).items()])
    return made.withColumn("implied_prob_diff_avg", F.col("winner_implied_prob_avg") - F.col("loser_implied_prob_avg"))


@query(
    f"""with {_B} select match_id, cast(winner_rank <= 0 as int) as winner_rank_missing, cast(loser_rank <= 0 as int) as loser_rank_missing,
cast(winner_points < 0 as int) as winner_points_missing, cast(loser_points < 0 as int) as loser_points_missing from bouts"""
)
def q_missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bouts(spark, sf_dir)
    made = {f"{s}_rank": scalars.positive(f"{s}_rank") for s in ("winner", "loser")} | {f"{s}_points": scalars.not_negative(f"{s}_points") for s in ("winner", "loser")}
    return b.withColumns(made).select("match_id", *[scalars.missing(c).alias(f"{c}_missing") for c in made])


# --- service statistics and the as-of join ------------------------------------------------------

_COUNTERS = list(schema.SERVE.values())
_SERVE_LONG = f"""{_S}, slong as (
  {" union all ".join(f"select match_num as match_id, tourney_date, {side}_id as player, '{side}' as side, " + ", ".join(f'"{short}_{src}" as {c}' for src, c in schema.SERVE.items()) + " from serve" for side, short in (("winner", "w"), ("loser", "l")))}
), stotal as (
  select match_id, tourney_date, player, side, {", ".join(f"case when {c} is not null then sum({c}) over p end as t_{c}" for c in _COUNTERS)}
  from slong window p as (partition by player order by tourney_date, match_id rows between unbounded preceding and current row)
), scum as (
  select match_id, tourney_date, player, side, {", ".join(f"lag(t_{c}) over (partition by player order by tourney_date, match_id) as {c}_cum_before" for c in _COUNTERS)} from stotal
)"""
_RATES = {
    "ace_rate": ("ace", "svpt_cum_before"),
    "df_rate": ("df", "svpt_cum_before"),
    "first_in_rate": ("first_in", "svpt_cum_before"),
    "first_won_rate": ("first_won", "first_in_cum_before"),
    "second_won_rate": ("second_won", "svpt_cum_before - first_in_cum_before"),
    "bp_saved_rate": ("bp_saved", "bp_faced_cum_before"),
    "bp_faced_per_sv_game": ("bp_faced", "sv_games_cum_before"),
}
_SRATES = f"srates as (select match_id, tourney_date, player, side, {', '.join(f'{a}_cum_before / nullif({b}, 0) as {r}_before' for r, (a, b) in _RATES.items())} from scum)"
_RATE_COLS = [f"{r}_before" for r in schema.SERVE_RATES]


@query(f"with {_SERVE_LONG} select * from scum")
def q_serve_cum_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals as of the previous match, nulls handed on."""
    return serve.serve_totals(views.serve(spark, sf_dir))


@query(f"with {_SERVE_LONG}, {_SRATES} select * from srates")
def q_serve_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.serve_rates(views.serve(spark, sf_dir))


_ASOF = f"""{_B}, {_SERVE_LONG}, {_SRATES}, daily as materialized (
  select * from srates qualify row_number() over (partition by player, tourney_date order by match_id desc, side desc) = 1
), asked as (
  select match_id, match_date, 'winner' as side, winner_name as player from bouts union all select match_id, match_date, 'loser', loser_name from bouts
), found as (
  select a.match_id, a.side, {", ".join(f"d.{c}" for c in _RATE_COLS)} from asked a asof left join daily d on a.player = d.player and a.match_date > d.tourney_date
)"""


_ASOF_WIDE = f"select match_id, {', '.join(f'max({c}) filter (where side = {s!r}) as {s}_{c}' for s in ('winner', 'loser') for c in _RATE_COLS)} from found group by match_id"


@query(f"with {_ASOF} {_ASOF_WIDE}")
def q_asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side's latest service rates strictly before the match."""
    made = serve.attach_serve(views.bouts(spark, sf_dir).select("match_id", "match_date", "winner_name", "loser_name"), serve.serve_rates(views.serve(spark, sf_dir)))
    return made.select("match_id", *[f"{s}_{c}" for s in ("winner", "loser") for c in _RATE_COLS])


_COVERED = [f"{s}_{c}" for s in ("winner", "loser") for c in _RATE_COLS]


@query(
    f"with {_ASOF}, wide as materialized ({_ASOF_WIDE}) "
    + " union all ".join(f"select '{c}' as column_name, 100.0::double * count({c}) / count(*) as pct from wide" for c in _COVERED)
)
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of matches with each service rate."""
    return checks.coverage(q_asof_features(spark, sf_dir), _COVERED)


# --- the training set ---------------------------------------------------------------------------


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bouts(spark, sf_dir).withColumns(
        {f"{s}_rank": scalars.positive(f"{s}_rank") for s in ("winner", "loser")}
        | {f"{s}_points": scalars.not_negative(f"{s}_points") for s in ("winner", "loser")}
        | {f"avg_{s}": scalars.odds(f"avg_{s}") for s in ("winner", "loser")}
        | {"round": scalars.round_name("round"), "court": scalars.court("court")}
    )
    known = features.rare_buckets(b.withColumn("has_any_market_odds", scalars.any_present(["avg_winner", "avg_loser"])), RARE)
    return features.add_features(history.attach_head_to_head(history.attach_history(known)), RARE)


_DIFFS = {k: v for k, v in schema.DIFFERENCES.items() if k in (*schema.HISTORY, "h2h_win_rate_before")}
_FEATURES = f"""{_LONG}, {_WIDE}, {_h2h("wide")}, valid as (
  select * replace (
    {", ".join(f"case when {s}_rank > 0 then {s}_rank end as {s}_rank, case when {s}_points >= 0 then {s}_points end as {s}_points, case when avg_{s} > 1.0 then avg_{s} end as avg_{s}" for s in ("winner", "loser"))},
    {_ROUND_NAME} as round, {_title("court", schema.COURTS)} as court) from h2h
), feat as (
  select *, cast(coalesce(avg_winner, avg_loser) is not null as int) as has_any_market_odds, cast({_ORDINAL.format("round")} as double) as round_ordinal,
    {", ".join(f"cast({s}_{x} is null as int) as {s}_{x}_missing" for s in ("winner", "loser") for x in ("rank", "points"))},
    1.0 / avg_winner as winner_implied_prob_avg, 1.0 / avg_loser as loser_implied_prob_avg, 1.0 / avg_winner - 1.0 / avg_loser as implied_prob_diff_avg,
    loser_rank - winner_rank as rank_diff, winner_points - loser_points as points_diff,
    {", ".join(f"winner_{k} - loser_{k} as {v}" for k, v in _DIFFS.items())},
    case when count(*) over (partition by tournament) >= {RARE} then tournament else 'other' end as tournament_bucket
  from valid
)"""
_SWAPS = [s for s in schema.SWAPPED if s in ("rank", "points", "rank_missing", "points_missing", *schema.HISTORY, "h2h_wins_before", "h2h_win_rate_before", "implied_prob_avg", "name")]
_FLIPS = ["rank_diff", "points_diff", "implied_prob_diff_avg", *_DIFFS.values()]
_MIRROR = f"""{_FEATURES}, mirror as (
  select *, 1 as player_a_win from feat
  union all by name
  select * replace ({", ".join([f"loser_{s} as winner_{s}, winner_{s} as loser_{s}" for s in _SWAPS] + [f"0.0 - {c} as {c}" for c in _FLIPS])}), 0 as player_a_win from feat
)"""


@query(f"with {_MIRROR} select * from mirror")
def q_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both orientations of every match with all features."""
    return features.mirrored(_features(spark, sf_dir))


_NUMERIC = [c for c in schema.NUMERIC_FEATURES if c in ("source_year", "atp", "round_ordinal", "has_any_market_odds", "h2h_matches_before", *_FLIPS, *[f"{s}_{x}" for s in ("winner", "loser") for x in _SWAPS])]


@query(f"with {_MIRROR} select match_id, {', '.join(_NUMERIC)}, court, surface, tournament_bucket, player_a_win from mirror")
def q_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and target by name."""
    return features.feature_matrix(features.mirrored(_features(spark, sf_dir)), ["match_id"])


_RATE_NAMES = [f"{s}_{x}" for s in ("winner", "loser") for x in ("win_rate_before", "recent5_win_rate_before", "surface_win_rate_before")]


@query(f"with {_LONG}, {_WIDE} " + " union all ".join(f"select '{c}' as column_name, count(*) filter (where {c} < 0) as n_low, count(*) filter (where {c} > 1) as n_high from wide" for c in _RATE_NAMES))
def q_validate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates outside 0 to 1, by column."""
    wide = history.attach_history(views.bouts(spark, sf_dir))
    return checks.out_of_range(wide, checks.rate_bounds(wide.columns))


# --- names and biographies -----------------------------------------------------------------------

#: Suppliers as players: "First Surname" from their numbers, so that surnames repeat.
_PLAYERS = """select cast(s_suppkey as varchar(20)) as player_id, concat(case s_suppkey % 4 when 0 then 'Ana' when 1 then 'Ben' when 2 then 'Al' else 'Eve' end, ' Nr', cast(s_suppkey % 61 as varchar(20)), case when s_suppkey % 3 = 0 then '-Ost' else '' end) as full_name,
  case s_suppkey % 3 when 0 then 'R' when 1 then 'L' else 'U' end as hand, cast(170 + s_suppkey % 40 as double) as height, cast('1970-01-01' as date) as birth_date from supplier"""
#: Customers as names to resolve: "Surname I.", some with accents of case, hyphens, no initial, or nothing.
_NAMES = """select distinct case c_custkey % 7 when 0 then concat('nr', cast(c_custkey % 80 as varchar(20))) when 1 then concat('NR', cast(c_custkey % 80 as varchar(20)), '-OST A.') when 2 then '...'
  when 3 then concat('Nr', cast(c_custkey % 80 as varchar(20)), ' O''st E.') else concat('Nr', cast(c_custkey % 80 as varchar(20)), ' B.') end as name from customer"""


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PLAYERS.replace("from supplier", "from {supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NAMES.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def _norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate(replace(lower({x}), '''', ''), '-_.', '   '), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


_PARTS = f"""n as (select name, {_norm_sql("name")} as t from ({_NAMES})), parts as (
  select name, case when contains(t, ' ') then regexp_replace(t, ' [^ ]*$', '') else t end as surname, case when contains(t, ' ') then left(regexp_extract(t, '[^ ]*$'), 1) else '' end as initial from n
)"""


@query(f"with {_PARTS} select name, surname, initial from parts")
def q_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surname and initial of "Surname I."."""
    n = _names(spark, sf_dir).withColumn("t", scalars.ascii_words("name"))
    surname, initial = scalars.surname_first("t")
    return n.select("name", surname.alias("surname"), initial.alias("initial"))


_KNOWN = f"""k0 as (select player_id, full_name, {_norm_sql("full_name")} as t from ({_PLAYERS})), known as (
  select player_id, full_name, case when contains(t, ' ') then regexp_replace(t, '^[^ ]* ', '') else t end as surname, left(t, 1) as initial from k0
)"""


@query(
    f"""with {_PARTS}, {_KNOWN}, tried as (
  select p.name, p.surname, p.initial, count(k.player_id) as n, min(k.player_id) as player_id, min(k.full_name) as full_name
  from parts p left join known k on p.surname = k.surname and k.surname != '' and (p.initial = '' or p.initial = k.initial) group by all
) select name as tennis_data_name, surname as tennis_data_surname, initial as tennis_data_initial, case when n = 1 and surname != '' then full_name end as sackmann_name,
  case when n = 1 and surname != '' then player_id end as player_id,
  case when surname = '' then 'invalid_name' when n = 1 then 'exact_surname_initial' when n > 1 then 'ambiguous_surname_initial' else 'unmatched' end as match_method,
  case when surname != '' and n > 0 then cast(100 as double) end as score, cast(null as double) as second_score from tried"""
)
def q_name_resolution_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of exact matches."""
    return entity.resolve_names(_names(spark, sf_dir), _players(spark, sf_dir), fuzzy=False, ascii_only=True)


#: Similarity by a bit-parallel common subsequence, one step per letter, of every name without an exact player with every surname.
_FUZZY = f"""with recursive {_PARTS}, {_KNOWN}, tried as (
  select p.name, p.surname, p.initial, count(k.player_id) as n, min(k.player_id) as player_id, min(k.full_name) as full_name
  from parts p left join known k on p.surname = k.surname and k.surname != '' and (p.initial = '' or p.initial = k.initial) group by all
), still as (select * from tried where n = 0 and surname != ''),
surnames as (select surname as b, min(player_id) as ord from known where surname != '' group by surname),
pairs as (
  select distinct s.surname as a, u.b, u.ord from still s, surnames u
), step as (
  select a, b, ord, 0 as j, (1::bigint << len(a)) - 1 as state from pairs
  union all
  select a, b, ord, j + 1, ((state + (state & m)) | (state - (state & m))) & ((1::bigint << len(a)) - 1) from (
    select *, list_aggregate(list_transform(range(len(a)), lambda i: case when substr(a, i::int + 1, 1) = substr(b, j + 1, 1) then 1::bigint << i else 0::bigint end), 'bit_or') as m
    from step where j < len(b)
  )
), scored as (
  select a, b, ord, 100.0::double * 2 * (len(a) - bit_count(state)) / (len(a) + len(b)) as score from step where j = len(b)
), ranked as (
  select *, row_number() over (partition by a order by score desc, ord, b) as place from scored
), best as (
  select s.name, s.initial, x.score, y.score as second, x.b as best
  from still s left join ranked x on x.a = s.surname and x.place = 1 left join ranked y on y.a = s.surname and y.place = 2
), fits as (
  select b.name, b.score, b.second, count(k.player_id) as n, min(k.player_id) as player_id, min(k.full_name) as full_name
  from best b left join known k on k.surname = b.best and (b.initial = '' or b.initial = k.initial) group by all
), judged as (select *, score >= 92 and (second is null or score - second >= 5) and n = 1 as win from fits)
select t.name as tennis_data_name, t.surname as tennis_data_surname, t.initial as tennis_data_initial,
  case when j.win then j.full_name when t.surname != '' and t.n = 1 then t.full_name end as sackmann_name,
  case when j.win then j.player_id when t.surname != '' and t.n = 1 then t.player_id end as player_id,
  case when j.win then 'fuzzy_surname' when j.name is not null then 'fuzzy_ambiguous_or_low_score' when t.surname = '' then 'invalid_name'
    when t.n = 1 then 'exact_surname_initial' else 'ambiguous_surname_initial' end as match_method,
  case when j.name is not null then j.score when t.surname != '' then 100.0::double end as score, j.second as second_score
from tried t left join judged j on j.name = t.name"""


@query(_FUZZY)
def q_name_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder, near spellings included."""
    return entity.resolve_names(_names(spark, sf_dir), _players(spark, sf_dir))


@query(
    f"""with {_B}, p as ({_PLAYERS}), ids as (select concat('P', player_id) as name, player_id from p),
looked as (select b.match_id, b.match_date, w.player_id as winner_sackmann_id, l.player_id as loser_sackmann_id from bouts b left join ids w on w.name = b.winner_name left join ids l on l.name = b.loser_name)
select k.match_id, k.winner_sackmann_id, k.loser_sackmann_id, w.height as winner_height, nullif(w.hand, 'U') as winner_hand, cast(k.match_date - w.birth_date as double) / 365.25 as winner_age_years,
  l.height as loser_height, nullif(l.hand, 'U') as loser_hand, cast(k.match_date - l.birth_date as double) / 365.25 as loser_age_years
from looked k left join p w on w.player_id = k.winner_sackmann_id left join p l on l.player_id = k.loser_sackmann_id"""
)
def q_bio_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to ids to height, hand and age."""
    players = _players(spark, sf_dir).withColumn("hand", scalars.hand("hand"))
    review = players.select(F.concat(F.lit("P"), "player_id").alias("tennis_data_name"), "player_id")
    matches = views.bouts(spark, sf_dir).select("match_id", "match_date", "winner_name", "loser_name")
    made = entity.attach_biography(entity.attach_ids(matches, review), players)
    return made.select("match_id", *[f"{s}_{c}" for s in ("winner", "loser") for c in ("sackmann_id", "height", "hand", "age_years")])


_BIO = ORACLE["q_bio_lookup"]


@query(
    f"with bio as ({_BIO}) "
    + " union all ".join(f"select '{s}_age_years' as column_name, count(*) filter (where {s}_age_years < 26) as n_low, count(*) filter (where {s}_age_years > 30) as n_high from bio" for s in ("winner", "loser"))
)
def q_validate_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages outside given bounds, by column."""
    bio = q_bio_lookup(spark, sf_dir)
    return checks.out_of_range(bio, checks.age_bounds(bio.columns, 26.0, 30.0))


# --- splits -------------------------------------------------------------------------------------


@query(f"with {_B}, d as (select distinct match_date from bouts), c as (select match_date, ntile(6) over (order by match_date) - 1 as chunk from d) select b.match_id, b.match_date, cast(c.chunk as int) as chunk from bouts b join c using (match_date)")
def q_date_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of distinct dates for expanding folds."""
    return splits.date_folds(views.bouts(spark, sf_dir).select("match_id", "match_date"), "match_date", 5).select("match_id", "match_date", "chunk")


@query(
    f"""with {_B}, d as (select match_date, row_number() over (order by match_date) - 1 as pos, count(*) over () as n from (select distinct match_date from bouts)),
cut as (select match_date from d where pos = cast(floor(n * (1 - 0.15)) as bigint)) select match_id, match_date, case when match_date < (select match_date from cut) then 'train' else 'holdout' end as part from bouts"""
)
def q_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 15 % of dates held out."""
    train, held = splits.holdout(views.bouts(spark, sf_dir).select("match_id", "match_date"), "match_date")
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("holdout")))


def _ts_folds() -> str:
    n = "(select count(*) from bouts)"
    k = f"(case when {n} < 1000 then 3 when {n} < 5000 then 4 else 5 end)"
    return f"""with {_B}, numbered as (select match_id, row_number() over (order by match_date, match_id) - 1 as row_id, {n} as n, {k} as k from bouts),
folds as (select *, unnest(range(1, k + 1)) as fold from numbered), bounds as (select *, n - (k - fold + 1) * (n // (k + 1)) as lo, n - (k - fold) * (n // (k + 1)) as hi from folds)
select cast(fold as int) as fold, case when row_id < lo then 'train' else 'test' end as part, row_id, match_id from bounds where row_id < hi"""


@query(_ts_folds())
def q_ts_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds by row number."""
    b = views.bouts(spark, sf_dir).select("match_id", "match_date")
    numbered = features.row_numbers(b, ["match_date", "match_id"])
    return splits.row_folds(numbered, "row_id", b.count()).select("fold", "part", "row_id", "match_id")


@query(f"with {_B} select case when match_date <= date '1998-12-31' then 'train' when match_date <= date '1999-12-31' then 'validation' else 'test' end as part, count(*) as n, avg(cast(winner_rank < loser_rank as int)) as favourite_share from bouts group by 1")
def q_fixed_date_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and class balance of periods."""
    parts = views.bouts(spark, sf_dir).withColumn("part", splits.period("match_date", "1998-12-31", "1999-12-31"))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("winner_rank") < F.col("loser_rank")).cast("int")).alias("favourite_share"))


@query(
    f"""with {_B}, c as (select *, cast((match_id * 2654435761) % 1000 < 500 as int) as heads from bouts)
select match_id, surface, case when heads = 1 then winner_name else loser_name end as player_1, case when heads = 1 then loser_name else winner_name end as player_2,
  case when heads = 1 then winner_rank else loser_rank end as player_1_rank, case when heads = 1 then loser_rank else winner_rank end as player_2_rank,
  cast(heads as tinyint) as player_1_wins, case when heads = 1 then winner_rank - loser_rank else loser_rank - winner_rank end as rank_difference, cast(month(match_date) as tinyint) as month from c"""
)
def q_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random sides from an arithmetic coin."""
    coin = ((F.col("match_id") * F.lit(2654435761)) % 1000 < 500).cast("int")
    made = features.oriented(views.bouts(spark, sf_dir), "match_id", ["surface", "match_date"], {"player_{}": ("winner_name", "loser_name"), "player_{}_rank": ("winner_rank", "loser_rank")}, coin)
    return made.withColumns({"rank_difference": F.col("player_1_rank") - F.col("player_2_rank"), "month": F.month("match_date").cast("tinyint")}).drop("match_date")


# --- tables ---------------------------------------------------------------------------------------


@query("select c_custkey as id, c_name as name, c_acctbal as balance, cast(null as varchar) as brand from customer union all select s_suppkey, s_name, s_acctbal, null from supplier union all select p_partkey, p_name, null, p_brand from part")
def q_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables with different columns."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return tables.union_by_name(
        [
            read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
            read("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
            read("part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        ]
    ).select("id", "name", "balance", "brand")


@query(f"with {_B} select match_id, surface, row_number() over (order by surface nulls last, match_id) - 1 as row_id from bouts")
def q_sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in an order that puts missing values last."""
    return features.row_numbers(views.bouts(spark, sf_dir).select("match_id", "surface"), ["surface", "match_id"])


@query(f"with {_B} select match_id, match_date from bouts order by match_date, match_id limit 500 offset 700")
def q_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the viewer."""
    return tables.page(views.bouts(spark, sf_dir).select("match_id", "match_date"), 700, 500, ["match_date", "match_id"])


_IMPUTED = "select match_id, case when winner_rank > 0 then winner_rank end as x, surface from bouts"


@query(
    f"""with {_B}, v as ({_IMPUTED}), s as (select median(x) as med from v), m as (select surface from v where surface is not null group by surface order by count(*) desc, surface limit 1)
select match_id, coalesce(x, med) as x, coalesce(v.surface, m.surface) as surface from v, s, m"""
)
def q_impute_median_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median and smallest mode fill what is missing."""
    rows = views.bouts(spark, sf_dir).select("match_id", scalars.positive("winner_rank").alias("x"), "surface")
    return ml.fit_preprocessor(rows, ["x"], ["surface"]).imputed(rows)


@query(f"with {_B}, v as ({_IMPUTED}), f as (select match_id, coalesce(x, (select median(x) from v)) as x from v) select match_id, round((x - (select avg(x) from f)) / (select stddev_pop(x) from f), 9) as x from f")
def q_scale_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred and scaled by the population deviation."""
    rows = views.bouts(spark, sf_dir).select("match_id", scalars.positive("winner_rank").alias("x"))
    return ml.fit_preprocessor(rows, ["x"], [], scale=True).scaled(rows).select("match_id", F.round("x", 9).alias("x"))


@query(f"with {_B} select match_id, cast(coalesce(court, '') = ' indoor' as double) as court_indoor, cast(court = 'OUTDOOR' as double) as court_outdoor, cast(court = 'tent' as double) as court_tent from bouts where match_date >= date '1999-01-01'")
def q_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of the categories seen in training."""
    b = views.bouts(spark, sf_dir).select("match_id", "match_date", "court")
    prep = ml.fit_preprocessor(b.where("match_date < date '1999-01-01'"), [], ["court"])
    test = b.where("match_date >= date '1999-01-01'")
    cols = prep.encoded(test)
    return test.select("match_id", cols["court_ indoor"].alias("court_indoor"), cols["court_OUTDOOR"].alias("court_outdoor"), cols["court_tent"].alias("court_tent"))


_RULE = "select cast(o_orderstatus = 'F' as int) as label, cast(o_totalprice > 100000 as int) as prediction from orders"


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.over(spark, sf_dir, _RULE)


@query(f"select label, prediction, count(*) as n from ({_RULE}) group by all")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix of a rule."""
    return ml.confusion(_ruled(spark, sf_dir), "label", "prediction")


@query(
    f"""with r as ({_RULE}), k as (select 0 as label union all select 1), c as (
  select k.label, count(*) filter (where r.label = k.label) as support, count(*) filter (where r.prediction = k.label) as said, count(*) filter (where r.label = k.label and r.prediction = k.label) as hit from k, r group by k.label
), p as (select label, support, coalesce(hit / nullif(said, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall from c)
select label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1, support from p where support > 0 or precision > 0"""
)
def q_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and support of a rule."""
    return ml.classification_report(_ruled(spark, sf_dir), "label", "prediction")


# --- sources ----------------------------------------------------------------------------------------


@query("select cast(c_custkey as varchar) as id, case when c_custkey % 5 = 0 then null else c_name || ', \"the\" ' || c_custkey end as name, cast(c_acctbal as double) as balance from customer")
def q_csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read again, with quotes, separators and the tokens of missing values."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.when(F.col("c_custkey") % 5 == 0, F.element_at(F.array(F.lit("NA"), F.lit("null"), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int"))).otherwise(F.concat("c_name", F.lit(', "the" '), F.col("c_custkey")))
    path = shared.folder(spark, "customers.csv")
    rows.select(F.col("c_custkey").alias("id"), name.alias("name"), F.col("c_acctbal").alias("balance")).write.option("header", True).option("escape", '"').csv(path)
    return tables.read_csv(spark, path).select("id", "name", scalars.number("balance").alias("balance"))


_YEARLY = ["match_num", "tourney_date", "winner_id", "loser_id", "w_ace"]


@query(f"with {_S} select cast(match_num as varchar) as match_num, tourney_date, winner_id, loser_id, w_ace from serve where year(tourney_date) in (1993, 1995, 1996)")
def q_history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly CSV files whose columns come in another order each; one year is a web page, one lacks a column, one is not there."""
    rows, folder = views.serve(spark, sf_dir).select(*_YEARLY), shared.folder(spark, "history")
    for k, year in enumerate((1993, 1995, 1996, 1997)):
        columns = [*_YEARLY[k:], *_YEARLY[:k]] if year < 1997 else _YEARLY[1:]
        tables.write_csv(rows.where(F.year("tourney_date") == year).select(*columns), f"{folder}/atp_matches_{year}.csv", single=True)
    store.write(f"{folder}/atp_matches_1994.csv", iter([b"<!DOCTYPE html>\n<p>404</p>\n"]))
    found, _ = tables.history_years(spark, folder, 1992, 1998, tuple(_YEARLY[:4]))
    return found.select("match_num", scalars.to_date("tourney_date").alias("tourney_date"), "winner_id", "loser_id", scalars.number("w_ace").alias("w_ace"))


@query(
    "select '2020' as source_year, cast(r_regionkey as varchar) as atp, r_name as location, cast(null as varchar) as winner from region "
    "union all select '2021', null, null, n_name from nation"
)
def q_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly workbooks with different columns, one of them empty, as one table."""
    folder = shared.folder(spark, "workbooks")
    regions, nations = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("region", "nation"))  # 5 and 25 rows
    xlsx.write_xlsx(f"{folder}/matches 2020.xlsx", [["ATP", "Location ", "Court"], *[[r["r_regionkey"], r["r_name"], None] for r in regions]])
    xlsx.write_xlsx(f"{folder}/2021.xlsx", [["Winner"], *[[r["n_name"]] for r in nations]])
    made = tables.yearly_workbooks(spark, folder)
    return made.select("source_year", F.col("ATP").alias("atp"), F.col("Location").alias("location"), F.col("Winner").alias("winner"))


@query()
def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest over two tables and an absent one in place of yearly files."""
    paths = {y: f"{sf_dir}/{t}.parquet" for y, t in ((1, "region"), (2, "nation"), (3, "absent"))}
    return manifest.manifest(spark, sf_dir, 1, 3, "parquet", paths=paths).drop("local_path", "created_at_utc")


# --- models ---------------------------------------------------------------------------------------

_MODEL = ["rank_diff", "points_diff", "implied_prob_diff_avg", "win_rate_diff", "recent5_win_rate_diff", "h2h_win_rate_diff"]


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.mirrored(_features(spark, sf_dir)).select("match_id", "match_date", *_MODEL, "tournament_bucket", "player_a_win")


@query()
def q_dt_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree chosen over date folds, judged on held-out dates."""
    grid = {"max_depth": [2, 4], "min_samples_leaf": [20], "min_samples_split": [2, 50], "ccp_alpha": [0.0, 0.001]}
    rows = _model_rows(spark, sf_dir).persist()
    try:
        found = ml.search_tree(rows, "match_date", _MODEL, ["tournament_bucket"], "player_a_win", folds=2, grid=grid)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(str(found["best_params"]), found["best_cv_accuracy"], found["holdout_accuracy"], found["depth"], found["leaves"])], "best_params string, cv_accuracy double, holdout_accuracy double, depth int, leaves int")


@query()
def q_rf_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest's accuracy over expanding folds by row."""
    rows = features.row_numbers(_model_rows(spark, sf_dir), ["match_date", "match_id", "player_a_win"]).persist()
    try:
        found = ml.baseline_forest(rows, "row_id", _MODEL, [], "player_a_win", trees=10, depth=5, folds=2)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(found["cv_mean"], found["cv_std"], found["train_accuracy"])], "cv_mean double, cv_std double, train_accuracy double")


@query()
def q_feature_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by number of features, and the features that stay."""
    rows = features.row_numbers(_model_rows(spark, sf_dir), ["match_date", "match_id", "player_a_win"]).persist()
    try:
        found = ml.eliminate_features(rows, "row_id", _MODEL, [], "player_a_win", step=2, least=2, trees=5, depth=4, folds=2)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(n, m, n == found["n_selected"]) for n, m in found["cv_means"].items()], "n_features int, cv_mean double, chosen boolean")
