"""Declared schemas of every table, and the code values that rules refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PITCHES = "pitcher long, game_date date, seq long, batter long, description string, events string, inning int, inning_topbot string, pitch_type string, home_team string, away_team string, pitcher_days_since_prev_game double"
STARTERS = "Name string, Team string, IP double, GS int, WAR double, ERA double, `K/9` double, IDfg long"
PLAYER_XREF = "key_fangraphs long, key_mlbam long"
OPPONENT_K = "game_date date, Team string, K_pct_so_far double"
PARK_FACTORS = "Team_abbr string, K_park_factor double"
FANGRAPHS_PARK = "Team string, SO double"
PITCHER_GAMES = (
    "pitcher long, game_date date, pitch_count long, strikeouts long, max_inning int, num_pitch_types long, home_team string, away_team string, rest_days int, pitcher_team string, opponent_team string, "
    "whiff_rate double, csw_pct double, whiff_rate_expanding double, csw_pct_expanding double, opponent_k_pct double, park_factor_K double, rolling_K_avg_3 double, rolling_K_avg_5 double, rolling_pitch_count_5 double, rolling_K_rate double, pitcher_name string, pitcher_id long"
)
LINES = "player string, k_line double, over_american_price int, over_decimal_price double, over_payout_multiplier double, under_american_price int, under_decimal_price double, under_payout_multiplier double"
OPTION = "choice: string, selection_header: string, american_price: string, decimal_price: string, payout_multiplier: string"
ODDS = (
    "appearances array<struct<id: string, badges: array<struct<label: string, value: string>>>>, "
    f"over_under_lines array<struct<stat_value: string, over_under: struct<appearance_stat: struct<appearance_id: string>>, options: array<struct<{OPTION}>>>>"
)

# Team codes and the codes they stand for, description and event codes, and the model's features.
TEAM_ALIASES = {"AZ": "ARI", "SFG": "SF", "SDP": "SD", "KCR": "KC", "CWS": "CHW", "TBR": "TB", "FLA": "MIA", "WSN": "WSH", "OAK": "ATH"}
NICKNAMES = {
    "Diamondbacks": "ARI", "Braves": "ATL", "Orioles": "BAL", "Red Sox": "BOS", "Cubs": "CHC", "White Sox": "CHW", "Reds": "CIN", "Cleveland": "CLE", "Guardians": "CLE", "Rockies": "COL", "Tigers": "DET", "Astros": "HOU", "Royals": "KC", "Angels": "LAA", "Dodgers": "LAD", "Marlins": "MIA",
    "Brewers": "MIL", "Twins": "MIN", "Mets": "NYM", "Yankees": "NYY", "Athletics": "ATH", "Phillies": "PHI", "Pirates": "PIT", "Padres": "SD", "Giants": "SF", "Mariners": "SEA", "Cardinals": "STL", "Rays": "TB", "Rangers": "TEX", "Blue Jays": "TOR", "Nationals": "WSH",
}
WHIFFS = ("swinging_strike", "swinging_strike_blocked")
SWINGS = (*WHIFFS, "foul", "foul_tip", "hit_into_play")
CALLED = "called_strike"
STRIKEOUT = "strikeout"
FEATURES = [
    "pitch_count", "num_pitch_types", "max_inning", "rest_days", "rolling_K_avg_3", "rolling_K_avg_5", "rolling_pitch_count_5",
    "rolling_K_rate", "opponent_k_pct", "park_factor_K", "whiff_rate", "csw_pct", "whiff_rate_expanding", "csw_pct_expanding",
]
TARGET = "strikeouts"
SLIP_PAYOUTS = {2: 3, 3: 6, 4: 10, 5: 20, 6: 35, 7: 65, 8: 120}


def require(df: DataFrame, schema: str, *columns: str) -> DataFrame:
    """``df`` if it has the named columns (all of the schema's, if none is named), else an error that
    lists what is missing."""
    missing = [c for c in (columns or StructType.fromDDL(schema).names) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
