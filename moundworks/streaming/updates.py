"""The feature table kept up by a stream of landed pitch files (an extension of the batch update)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moundworks.operators.context import park_counts, team_days
from moundworks.operators.features import enriched_games
from moundworks.schemas import PITCHER_GAMES, PITCHES
from moundworks.sources.readers import exists
from moundworks.sources.sinks import swap_parquet
from moundworks.sources.versions import PartTable


def follow(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: str = PITCHES) -> StreamingQuery:
    """Each batch of new files replaces the games of its pitchers, computed from all their pitches so
    far: late files change what they touch, and a batch that is run again gives the same table."""

    def upsert(batch: DataFrame, _: int) -> None:
        touched = batch.select("pitcher").distinct()
        every = batch.sparkSession.read.schema(schema).parquet(landing)
        new = enriched_games(every.join(touched, "pitcher", "left_semi"), compat=False, context=every)
        if exists(batch.sparkSession, table):
            old = batch.sparkSession.read.parquet(table)
            new = old.join(touched, "pitcher", "left_anti").unionByName(new)
        swap_parquet(new, table)

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, root: str, buckets: int = 16, schema: str = PITCHES) -> dict[str, PartTable]:
    """The tables that ``follow_parts`` keeps under ``root``, each by season and hash of a key: pitches so
    far and games by pitcher, counts of team-days by team, of parks by park."""
    games = ", ".join(f for f in PITCHER_GAMES.split(", ") if not f.startswith(("pitcher_name ", "pitcher_id ")))
    kinds = {"pitches": (schema, "pitcher"), "games": (games, "pitcher"), "days": ("game_date date, Team string, so long, pa long", "Team"), "parks": ("home_team string, k long, n long", "home_team")}
    return {name: PartTable(spark, f"{root.rstrip('/')}/{name}", f"{s}, season int", key=key, buckets=buckets) for name, (s, key) in kinds.items()}


def add(table: PartTable, counts: DataFrame, keys: list[str], sums: list[str], batch: int) -> None:
    """Counts of new rows added to those that stand, once for each batch."""
    if table.current().notes.get("batch", -1) >= batch:
        return
    counts = counts.select(*keys, *sums)
    touched = table.parts_of(counts)
    old = table.read({s for s, _ in touched}, {b for _, b in touched}).select(*keys, *sums)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    old = old.join(counts.select(*[F.col(k).alias(f"_{k}") for k in keys]), same, "left_semi")
    table.upsert(old.unionByName(counts).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]), keys, {"batch": batch})


def follow_parts(spark: SparkSession, landing: str, root: str, checkpoint: str, schema: str = PITCHES, buckets: int = 16) -> StreamingQuery:
    """The same in parts: each batch of new files reads and writes only the parts of its own pitchers,
    seasons, teams and parks, and a reader of ``stored(spark, root)["games"]`` meets a whole version.

    Games are those of the batch's pitchers in its seasons, each season on its own, from all their stored
    pitches; rates of opponents and parks come from stored counts. Every table notes the last batch it
    has, so that a batch that is run again adds nothing twice. Rows without a pitcher or date have no
    season or games and are left out of games, but count for teams and parks if they have a date.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        t = stored(spark, root, buckets, schema)
        dated = batch.where(F.col("game_date").isNotNull()).withColumn("season", F.year("game_date"))
        add(t["days"], team_days(dated, keys=("season",)), ["season", "game_date", "Team"], ["so", "pa"], number)
        add(t["parks"], park_counts(dated, compat=False, keys=("season",)), ["season", "home_team"], ["k", "n"], number)
        known = dated.where(F.col("pitcher").isNotNull())
        touched = t["pitches"].parts_of(known)
        if not touched:
            return
        if t["pitches"].current().notes.get("batch", -1) < number:
            t["pitches"].upsert(known, ["season", "seq"], {"batch": number})
        seasons, parts = {s for s, _ in touched}, {b for _, b in touched}
        mine = known.select("season", "pitcher").distinct()
        own = t["pitches"].read(seasons, parts).join(mine, ["season", "pitcher"], "left_semi")
        new = enriched_games(own, by=("season", "pitcher"), compat=False, days=t["days"].read(seasons), parks=t["parks"].read(seasons))
        if t["games"].current().notes.get("batch", -1) < number:
            t["games"].upsert(new, ["season", "pitcher", "game_date"], {"batch": number})

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
