"""What surrounds a game: the opponent's strikeout rate so far, and the park's factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundworks.functions.semantics import batting_team, drop_null_keys, safe_div
from moundworks.operators.games import canonical_teams
from moundworks.schemas import STRIKEOUT


def between(df: DataFrame, start: str | None, end: str | None, column: str = "game_date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def team_days(pitches: DataFrame, start: str | None = None, end: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Strikeouts and plate appearances of each batting team on each date. ``keys`` (such as season)
    keep runs of dates apart, here and below."""
    x = drop_null_keys(between(pitches, start, end), *keys, "game_date")
    # teams are told from few rows, not from each pitch
    x = x.groupBy(*keys, "game_date", "home_team", "away_team", "inning_topbot").agg(F.count_if(F.col("events") == STRIKEOUT).alias("so"), F.count("events").alias("pa"), F.count("*").alias("n"))
    x = canonical_teams(x.withColumn("Team", batting_team()), "Team").groupBy(*keys, "game_date", "Team").agg(*[F.sum(c).alias(c) for c in ("so", "pa", "n")])
    # n is never 0: it keeps conditions on the team, also those of later joins, from being pushed down to each pitch
    x = x.withColumn("Team", F.when(F.col("n") > 0, F.col("Team")))
    return drop_null_keys(x, "Team").drop("n")


def opponent_k(pitches: DataFrame, start: str | None = None, end: str | None = None, default: float = 0.055, compat: bool = True, keys: tuple[str, ...] = (), days: DataFrame | None = None) -> DataFrame:
    """Each team's strikeout rate over its dates before this one. ``days``: team-days made before.

    In the compatible form a team's first date carries the whole total of the team before it in
    alphabetical order, as the shift over the sorted table did; the strict form starts from nothing.
    That goes through a season's team-days in one task: a row for each team and date, whatever the
    pitches are.
    """
    days = team_days(pitches, start, end, keys) if days is None else days
    own = Window.partitionBy(*keys, "Team").orderBy("game_date")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns({c: F.sum(n).over(upto) for c, n in (("all_so", "so"), ("all_pa", "pa"))})
    days = days.withColumns({c: F.lag(n).over(own) for c, n in (("cum_so", "all_so"), ("cum_pa", "all_pa"))})
    if compat:  # before a team's first date stands the last one of the team before it, whose sums are its totals
        by_name = Window.partitionBy(*keys).orderBy("Team", "game_date")
        days = days.withColumns({c: F.lag(n).over(by_name) for c, n in (("carry_so", "all_so"), ("carry_pa", "all_pa"))})
    else:
        days = days.withColumns({"carry_so": F.lit(0), "carry_pa": F.lit(0)})
    rate = safe_div(F.coalesce("cum_so", "carry_so", F.lit(0)), F.coalesce("cum_pa", "carry_pa", F.lit(0)), default)
    return days.select(*keys, "game_date", "Team", rate.alias("K_pct_so_far"))


def park_counts(pitches: DataFrame, start: str | None = None, end: str | None = None, compat: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Strikeouts ``k`` and pitches with a batter ``n`` of each park, the null one too."""
    x = between(pitches, start, end).where(F.col("pitch_type").isNotNull()).select(*keys, "home_team", "events", "batter")
    if not compat:
        x = canonical_teams(x, "home_team")
    return x.groupBy(*keys, "home_team").agg(F.count_if(F.col("events") == STRIKEOUT).alias("k"), F.count("batter").alias("n"))


def park_factors(pitches: DataFrame, start: str | None = None, end: str | None = None, compat: bool = True, keys: tuple[str, ...] = (), counts: DataFrame | None = None) -> DataFrame:
    """A park's strikeouts per pitch with a batter over the league's, which counts rows without a park
    too. The compatible form groups before team codes are made canonical, so two codes of a team stay
    two rows. ``counts``: park counts made before."""
    parks = park_counts(pitches, start, end, compat, keys) if counts is None else counts
    every = Window.partitionBy(*keys)  # a row a park
    parks = parks.withColumn("league", safe_div(F.sum("k").over(every), F.sum("n").over(every)))
    parks = drop_null_keys(parks, *keys, "home_team").select(*keys, F.col("home_team").alias("Team_abbr"), safe_div(safe_div("k", "n"), "league").alias("K_park_factor"))
    return canonical_teams(parks, "Team_abbr")


def with_park(games: DataFrame, parks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Left join that also meets null with null; duplicate park rows give duplicate games. Parks are few: games
    stay where they are."""
    p = parks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("Team_abbr").alias("_team"), F.col("K_park_factor").alias("park_factor_K"))
    return games.join(F.broadcast(p), same(keys) & F.col("home_team").eqNullSafe(F.col("_team")), "left").drop("_team", *[f"_{k}" for k in keys])


def with_opponent(games: DataFrame, rates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Left join by date and opponent; a date without a rate keeps null. There is a rate for a team and date,
    whatever the pitches are: games stay where they are."""
    r = rates.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("game_date").alias("_date"), F.col("Team").alias("_team"), F.col("K_pct_so_far").alias("opponent_k_pct"))
    on = same(keys) & (F.col("game_date") == F.col("_date")) & (F.col("opponent_team") == F.col("_team"))
    return games.join(F.broadcast(r), on, "left").drop("_date", "_team", *[f"_{k}" for k in keys])


def same(keys: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(k) == F.col(f"_{k}"))
    return out


def with_static_opponent(games: DataFrame, rates: DataFrame) -> DataFrame:
    """The same from a table of one rate a team: (Team, K_pct)."""
    return games.join(rates.select(F.col("Team").alias("opponent_team"), F.col("K_pct").alias("opponent_k_pct")), "opponent_team", "left")
