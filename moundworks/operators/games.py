"""Pitch rows to one row per pitcher and game, all pitchers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundworks.functions.semantics import drop_null_keys, fielding_team, first_non_null, opposing_team, safe_div
from moundworks.schemas import CALLED, STRIKEOUT, SWINGS, TEAM_ALIASES, WHIFFS


def canonical_teams(df: DataFrame, *columns: str) -> DataFrame:
    return df.replace(TEAM_ALIASES, subset=list(columns))


def counted_games(pitches: DataFrame, by: tuple[str, ...] = ("pitcher",)) -> DataFrame:
    """All counts and first values of a game in one aggregation. Pitch types are few, so their set is
    gathered in the same pass instead of a distinct count's second shuffle."""
    return drop_null_keys(pitches, *by, "game_date").groupBy(*by, "game_date").agg(
        F.count("description").alias("pitch_count"),
        F.count_if(F.col("events") == STRIKEOUT).alias("strikeouts"),
        F.max("inning").alias("max_inning"),
        F.size(F.collect_set("pitch_type")).cast("long").alias("num_pitch_types"),
        *[first_non_null(c, "seq").alias(c) for c in ("home_team", "away_team", "inning_topbot", "pitcher_days_since_prev_game")],
        F.count_if(F.col("description").isin(*WHIFFS)).alias("whiffs"),
        F.count_if(F.col("description").isin(*SWINGS)).alias("swings"),
        F.count_if(F.col("description") == CALLED).alias("called"),
    )


def pitcher_games(pitches: DataFrame, by: tuple[str, ...] = ("pitcher",)) -> DataFrame:
    """Games with teams, rest days, rates of the game and of the season so far (this game included).

    ``by`` holds the keys of one career's rows; add ``season`` to keep seasons apart.
    """
    g = counted_games(pitches, by)
    upto = Window.partitionBy(*by).orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({
        "rest_days": F.coalesce("pitcher_days_since_prev_game", F.lit(5.0)).cast("int"),
        "pitcher_team": fielding_team(),
        "opponent_team": opposing_team(),
        "whiff_rate": safe_div("whiffs", "swings", 0),
        "csw_pct": safe_div(F.col("whiffs") + F.col("called"), "pitch_count", 0),
        "all_whiffs": F.sum("whiffs").over(upto),
        "all_called": F.sum("called").over(upto),
        "all_pitches": F.sum("pitch_count").over(upto),
    })
    g = g.withColumns({"whiff_rate_expanding": safe_div("all_whiffs", "all_pitches", 0), "csw_pct_expanding": safe_div(F.col("all_whiffs") + F.col("all_called"), "all_pitches", 0)})
    g = canonical_teams(g, "home_team", "away_team", "pitcher_team", "opponent_team")
    rates = ["whiff_rate", "csw_pct", "whiff_rate_expanding", "csw_pct_expanding"]
    return g.select(*by, "game_date", "pitch_count", "strikeouts", "max_inning", "num_pitch_types", "home_team", "away_team", "rest_days", "pitcher_team", "opponent_team", *rates)


def nonempty(pitches: DataFrame, column: str = "description", by: str = "pitcher") -> DataFrame:
    """Rows of those entities that have the column at all."""
    some = pitches.where(F.col(column).isNotNull()).select(by).distinct()
    return pitches.join(some, by, "left_semi")


def latest(df: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The last row of each key; ``ties`` settle equal order values."""
    by = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), *[F.desc_nulls_last(t) for t in ties])
    return drop_null_keys(df, key).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
