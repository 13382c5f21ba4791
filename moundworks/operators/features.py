"""Form features, and the whole feature table of all pitchers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundworks.functions.semantics import rolling, safe_div
from moundworks.operators.context import opponent_k, park_factors, with_opponent, with_park
from moundworks.operators.games import nonempty, pitcher_games


def with_form(games: DataFrame, by: tuple[str, ...] = ("pitcher",), default_k: float = 5, default_pitches: float = 85, default_rate: float = 0.055, rate_games: int = 3) -> DataFrame:
    """Means of the last 3 and 5 games and strikeouts per pitch, of games before this one only.

    ``rate_games`` is how many games' strikeouts the rate's numerator has; its denominator has five.
    """
    w = Window.partitionBy(*by).orderBy("game_date")
    return games.withColumns({
        "rolling_K_avg_3": F.coalesce(rolling(F.avg, "strikeouts", 3, w), F.lit(float(default_k))),
        "rolling_K_avg_5": F.coalesce(rolling(F.avg, "strikeouts", 5, w), F.lit(float(default_k))),
        "rolling_pitch_count_5": F.coalesce(rolling(F.avg, "pitch_count", 5, w), F.lit(float(default_pitches))),
        "rolling_K_rate": safe_div(rolling(F.sum, "strikeouts", rate_games, w), rolling(F.sum, "pitch_count", 5, w), default_rate),
    })


def enriched_games(pitches: DataFrame, pitchers: DataFrame | None = None, by: tuple[str, ...] = ("pitcher",), compat: bool = True, context: DataFrame | None = None, days: DataFrame | None = None, parks: DataFrame | None = None) -> DataFrame:
    """The feature table. ``pitchers`` has (pitcher_name, pitcher_id) and picks whose games are made;
    rates of opponents and parks are of all of ``context`` (default: all pitches), but of
    ``days`` and ``parks`` where team-days and park counts were made before. With ``by`` of
    (season, pitcher) many seasons are made at once, each on its own."""
    context = pitches if context is None else context
    own = pitches
    if pitchers is not None:
        own = pitches.join(pitchers.select(F.col("pitcher_id").alias("pitcher")).distinct(), "pitcher", "left_semi")
    games = pitcher_games(own, by)
    keys = tuple(k for k in by if k != "pitcher")
    games = with_opponent(games, opponent_k(context, compat=compat, keys=keys, days=days), keys)
    games = with_park(games, park_factors(context, compat=compat, keys=keys, counts=parks), keys)
    games = with_form(games, by)
    if pitchers is None:
        return games
    return games.join(pitchers.select("pitcher_name", "pitcher_id"), F.col("pitcher") == F.col("pitcher_id"))


def latest_date(games: DataFrame):
    return games.agg(F.max("game_date")).first()[0]


def incremental(pitches: DataFrame, done: DataFrame, as_of: str, by: tuple[str, ...] = ("pitcher",), compat: bool = True) -> DataFrame:
    """``done`` brought up to the day before ``as_of`` with pitches since its last date.

    The compatible form makes the new games from the slice alone, so form starts cold there, and drops
    only rows that are equal throughout; the strict form computes on all pitches and replaces games by
    (pitcher, date). A ``done`` without rows is refused: the whole table is to be made first.
    """
    since = latest_date(done)
    if since is None:
        raise ValueError("nothing was made before")
    until = F.date_sub(F.lit(as_of).cast("date"), 1)
    known = pitches.where(F.col("game_date") <= until)
    if compat:
        fresh = nonempty(known.where(F.col("game_date") >= F.lit(since)))
        new = enriched_games(fresh, by=by, context=known)
        return done.unionByName(new, allowMissingColumns=True).dropDuplicates()
    new = enriched_games(known, by=by, compat=False).where(F.col("game_date") >= F.lit(since))
    old = done.join(new.select(*by, "game_date"), [*by, "game_date"], "left_anti")
    return old.unionByName(new, allowMissingColumns=True)


def top_starters(stats: DataFrame, n: int = 999, least_ip: float = 15, least_gs: int = 0) -> DataFrame:
    """Starters by WAR, those without it last, name and id settling ties."""
    some = stats.where((F.col("IP") >= least_ip) & (F.col("GS") > least_gs))
    return some.orderBy(F.desc_nulls_last("WAR"), "IDfg").limit(n)


def pitcher_ids(starters: DataFrame, xref: DataFrame) -> DataFrame:
    x = xref.select(F.col("key_fangraphs").cast("long").alias("_fg"), F.col("key_mlbam").cast("long").alias("pitcher_id"))
    return starters.join(x, F.col("IDfg").cast("long") == F.col("_fg")).select(F.col("Name").alias("pitcher_name"), "pitcher_id")
