"""Command lines of the batch jobs.

    python -m moundworks.cli starters STATS.csv XREF.parquet OUT.csv --top 999
    python -m moundworks.cli games PITCHES OUT --pitchers STARTERS.csv --season 2024
    python -m moundworks.cli update PITCHES TABLE --as-of 2024-06-01

``starters`` picks the best starters and their ids, ``games`` makes a season's feature table, ``update``
brings a table up to the day before a date. Paths are whatever Spark's readers take.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from moundworks import schemas
from moundworks.operators import features
from moundworks.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="moundworks")
    jobs = top.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("starters", help="best starters by WAR, with their ids")
    a.add_argument("stats")
    a.add_argument("xref")
    a.add_argument("out")
    a.add_argument("--top", type=int, default=999)
    a.add_argument("--least-ip", type=float, default=15)
    b = jobs.add_parser("games", help="a season's feature table")
    b.add_argument("pitches")
    b.add_argument("out")
    b.add_argument("--pitchers", help="CSV of pitcher_name and pitcher_id; all pitchers without it")
    b.add_argument("--season", type=int)
    c = jobs.add_parser("update", help="a feature table brought up to the day before a date")
    c.add_argument("pitches")
    c.add_argument("table")
    c.add_argument("--as-of", required=True)
    for x in (b, c):
        x.add_argument("--compat", action="store_true", help="the observable results of the described behaviour, not the evident intent")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"moundworks {args.job}").getOrCreate()
    if args.job == "starters":
        stats = readers.read_csv(spark, args.stats, schemas.STARTERS)
        chosen = features.top_starters(stats, args.top, args.least_ip)
        sinks.write_csv(features.pitcher_ids(chosen, readers.read_parquet(spark, args.xref)), args.out, one_file=True)  # ``top`` rows
    elif args.job == "games":
        pitchers = readers.read_csv(spark, args.pitchers, "pitcher_name string, pitcher_id long") if args.pitchers else None
        pitches = readers.read_pitches(spark, args.pitches, args.season)
        sinks.write_parquet(features.enriched_games(pitches, pitchers, compat=args.compat), args.out)
    else:
        done = readers.read_parquet(spark, args.table)
        pitches = readers.read_pitches(spark, args.pitches)
        named = "pitcher_name" in done.columns
        ids = done.select("pitcher_name", "pitcher_id").distinct() if named else None
        new = features.incremental(pitches, done.drop("pitcher_name", "pitcher_id"), args.as_of, compat=args.compat)
        if named:  # the table's own pitchers, under the names they have there
            new = new.join(ids, F.col("pitcher") == F.col("pitcher_id"))
        sinks.swap_parquet(new, args.table)


if __name__ == "__main__":
    main()
