"""Reading landed files. Nothing here goes to a network but ``fetch_json``."""

from __future__ import annotations

import json
import urllib.request
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundworks import schemas
from moundworks.functions.semantics import nan_to_null


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_parquet(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(reader.parquet(*paths))


def read_pitches(spark: SparkSession, path: str, season: int | None = None, start: str = "04-01", end: str = "10-01") -> DataFrame:
    """Raw pitches; with a season, its partition and its window of dates."""
    df = spark.read.parquet(path)
    if season is None:
        return df
    if "season" in df.columns:
        df = df.where(F.col("season") == season)
    return df.where(F.to_date("game_date").between(F.lit(f"{season}-{start}").cast("date"), F.lit(f"{season}-{end}").cast("date")))


def with_seq(df: DataFrame) -> DataFrame:
    """The files' own order as a column, for rows read from parquet."""
    return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("seq"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def lookup(table: dict, key: Column | str) -> Column:
    """The value of a key in a constant table, null where there is none."""
    key = F.col(key) if isinstance(key, str) else key
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def historic_park_factors(df: DataFrame) -> DataFrame:
    """From (Team nickname, SO percent) to (Team_abbr, K_park_factor); unknown nicknames give null."""
    return df.select(lookup(schemas.NICKNAMES, "Team").alias("Team_abbr"), (F.col("SO") / 100.0).alias("K_park_factor"))


def landed_park_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).select("Team_abbr", F.col("K_park_factor").cast("double").alias("K_park_factor"))


def read_odds(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the JSON files under ``path`` (one document, or a list of them, in each),
    with its ``file``. What can't be parsed is a row with its text under ``corrupt``."""
    x = spark.read.schema(f"{schemas.ODDS}, corrupt string").json(path, multiLine=True, columnNameOfCorruptRecord="corrupt", encoding="UTF-8")
    return x.select("*", F.col("_metadata.file_path").alias("file"))


def ends(df: DataFrame, n: int) -> DataFrame:
    """The first and the last ``n`` rows in the files' own order (files by name), with ``end`` (head or
    tail) and ``at`` from 1. Only so many rows of each task leave it; a small table's rows may be both."""
    place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    x = df.select("*", *place)

    def some(end: str, way) -> DataFrame:
        order = [way("_file"), way("_row")]
        best = x.orderBy(*order).limit(n)
        turn = F.row_number().over(Window.orderBy(F.asc("_file"), F.asc("_row")))  # of n rows
        return best.select(*df.columns, F.lit(end).alias("end"), turn.alias("at"))

    return some("head", F.asc).unionByName(some("tail", F.desc))


def fetch_json(url: str, params: dict[str, str], timeout: float = 30.0) -> dict:
    """GET on the driver, an error unless the status is good; land the result as a file before use."""
    from urllib.parse import urlencode

    with urllib.request.urlopen(f"{url}?{urlencode(params)}", timeout=timeout) as r:  # raises on 4xx and 5xx
        return json.load(r)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
