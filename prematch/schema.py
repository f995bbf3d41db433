"""Column lists and fixed values of the match data."""

# Names of the raw columns and what they become.
RAW_TO_CLEAN = {
    "source_year": "source_year",
    "ATP": "atp",
    "Location": "location",
    "Tournament": "tournament",
    "Date": "date",
    "Series": "series",
    "Court": "court",
    "Surface": "surface",
    "Round": "round",
    "Best of": "best_of",
    "Winner": "winner_name",
    "Loser": "loser_name",
    "WRank": "winner_rank",
    "LRank": "loser_rank",
    "WPts": "winner_points",
    "LPts": "loser_points",
    "Comment": "comment",
    "B365W": "b365_winner",
    "B365L": "b365_loser",
    "PSW": "ps_winner",
    "PSL": "ps_loser",
    "MaxW": "max_winner",
    "MaxL": "max_loser",
    "AvgW": "avg_winner",
    "AvgL": "avg_loser",
    "BFEW": "bfe_winner",
    "BFEL": "bfe_loser",
}
#: Set scores: known only after the match.
LEAKAGE = ["W1", "L1", "W2", "L2", "W3", "L3", "W4", "L4", "W5", "L5", "Wsets", "Lsets"]
# The raw layout.
RAW_COLUMNS = [
    "source_year",
    "ATP",
    "Location",
    "Tournament",
    "Date",
    "Series",
    "Court",
    "Surface",
    "Round",
    "Best of",
    "Winner",
    "Loser",
    "WRank",
    "LRank",
    "WPts",
    "LPts",
    "W1",
    "L1",
    "W2",
    "L2",
    "W3",
    "L3",
    "W4",
    "L4",
    "W5",
    "L5",
    "Wsets",
    "Lsets",
    "Comment",
    "B365W",
    "B365L",
    "PSW",
    "PSL",
    "MaxW",
    "MaxL",
    "AvgW",
    "AvgL",
    "BFEW",
    "BFEL",
]

ODDS = [f"{book}_{side}" for book in ("b365", "ps", "max", "avg", "bfe") for side in ("winner", "loser")]
INTEGERS = ["source_year", "atp", "best_of"]
NUMERIC = [*INTEGERS, "winner_rank", "loser_rank", "winner_points", "loser_points", *ODDS]
CLEAN_COLUMNS = [c for c in RAW_TO_CLEAN.values() if c != "comment"] + ["has_any_market_odds"]

# Spellings of series and rounds.
SERIES = {
    "ATP250": "ATP250",
    "ATP500": "ATP500",
    "Masters 1000": "Masters1000",
    "Masters1000": "Masters1000",
    "Grand Slam": "GrandSlam",
    "GrandSlam": "GrandSlam",
    "International": "International",
}
ROUNDS = {
    "The Final": "Final",
    "Final": "Final",
    "Semifinals": "Semifinals",
    "Semi-Finals": "Semifinals",
    "Quarterfinals": "Quarterfinals",
    "Quarter-Finals": "Quarterfinals",
    "4th Round": "4th Round",
    "3rd Round": "3rd Round",
    "2nd Round": "2nd Round",
    "1st Round": "1st Round",
    "Round Robin": "Round Robin",
}
COURTS = ["Indoor", "Outdoor"]
SURFACES = ["Hard", "Clay", "Grass", "Carpet"]
ROUND_ORDINAL = {"1st Round": 0, "2nd Round": 1, "3rd Round": 2, "4th Round": 3, "Quarterfinals": 4, "Semifinals": 5, "Final": 6}

# Strings that CSV readers of the source take for missing.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

#: What a participant's history holds, in order.
HISTORY = [
    "matches_before",
    "wins_before",
    "win_rate_before",
    "recent5_matches_before",
    "recent5_wins_before",
    "recent5_win_rate_before",
    "surface_matches_before",
    "surface_wins_before",
    "surface_win_rate_before",
    "days_since_last_match",
]
#: Service statistics: column suffix in the source, and name here.
SERVE = {
    "ace": "ace",
    "df": "df",
    "svpt": "svpt",
    "1stIn": "first_in",
    "1stWon": "first_won",
    "2ndWon": "second_won",
    "SvGms": "sv_games",
    "bpSaved": "bp_saved",
    "bpFaced": "bp_faced",
}
SERVE_RATES = ["ace_rate", "df_rate", "first_in_rate", "first_won_rate", "second_won_rate", "bp_saved_rate", "bp_faced_per_sv_game"]

#: Suffix of a winner/loser pair, and the difference made of it (winner less loser).
DIFFERENCES = {
    "matches_before": "experience_diff",
    "win_rate_before": "win_rate_diff",
    "recent5_win_rate_before": "recent5_win_rate_diff",
    "surface_win_rate_before": "surface_win_rate_diff",
    "days_since_last_match": "rest_days_diff",
    "h2h_win_rate_before": "h2h_win_rate_diff",
    "height": "height_diff",
    "age_years": "age_diff",
    **{f"{rate}_before": f"{rate}_diff" for rate in SERVE_RATES},
}
#: Pairs that change sides in a mirrored row, by suffix.
SWAPPED = [
    "rank",
    "points",
    "rank_missing",
    "points_missing",
    *HISTORY,
    "h2h_wins_before",
    "h2h_win_rate_before",
    "height",
    "age_years",
    *[f"{rate}_before" for rate in SERVE_RATES],
    "implied_prob_avg",
    "name",
    "sackmann_id",
    "hand",
    "ioc",
]
#: Columns whose sign turns in a mirrored row.
FLIPPED = ["rank_diff", "points_diff", "implied_prob_diff_avg", *DIFFERENCES.values()]

CATEGORICAL = ["series", "court", "surface", "tournament_bucket", "location_bucket"]

# Numeric features of a model, in order.
NUMERIC_FEATURES = [
    "source_year",
    "atp",
    "best_of",
    "round_ordinal",
    "winner_rank",
    "loser_rank",
    "rank_diff",
    "winner_rank_missing",
    "loser_rank_missing",
    "winner_points",
    "loser_points",
    "points_diff",
    "winner_points_missing",
    "loser_points_missing",
    "has_any_market_odds",
    "winner_implied_prob_avg",
    "loser_implied_prob_avg",
    "implied_prob_diff_avg",
    "winner_matches_before",
    "loser_matches_before",
    "experience_diff",
    "winner_win_rate_before",
    "loser_win_rate_before",
    "win_rate_diff",
    "winner_recent5_win_rate_before",
    "loser_recent5_win_rate_before",
    "recent5_win_rate_diff",
    "winner_surface_win_rate_before",
    "loser_surface_win_rate_before",
    "surface_win_rate_diff",
    "winner_days_since_last_match",
    "loser_days_since_last_match",
    "rest_days_diff",
    "h2h_matches_before",
    "winner_h2h_win_rate_before",
    "loser_h2h_win_rate_before",
    "h2h_win_rate_diff",
    "winner_height",
    "loser_height",
    "height_diff",
    "winner_age_years",
    "loser_age_years",
    "age_diff",
    "winner_ace_rate_before",
    "loser_ace_rate_before",
    "ace_rate_diff",
    "winner_df_rate_before",
    "loser_df_rate_before",
    "df_rate_diff",
    "winner_first_in_rate_before",
    "loser_first_in_rate_before",
    "first_in_rate_diff",
    "winner_first_won_rate_before",
    "loser_first_won_rate_before",
    "first_won_rate_diff",
    "winner_second_won_rate_before",
    "loser_second_won_rate_before",
    "second_won_rate_diff",
    "winner_bp_saved_rate_before",
    "loser_bp_saved_rate_before",
    "bp_saved_rate_diff",
    "winner_bp_faced_per_sv_game_before",
    "loser_bp_faced_per_sv_game_before",
    "bp_faced_per_sv_game_diff",
]
#: Left out of a model without market odds.
MARKET_FEATURES = ["winner_implied_prob_avg", "loser_implied_prob_avg", "implied_prob_diff_avg", "has_any_market_odds"]
