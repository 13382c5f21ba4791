"""Files in and out, schemas, and the stream of updates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from moundworks import schemas
from moundworks.functions.semantics import nan_to_null
from moundworks.operators import features, models
from moundworks.sources import readers, sinks


def test_swap_replaces_what_it_reads(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.write_parquet(spark.range(5), path)
    sinks.swap_parquet(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_csv_and_missing_columns(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    sinks.write_csv(spark.createDataFrame([("a", 1.5), (None, None)], "Team string, SO double"), path)
    df = readers.read_csv(spark, path, schemas.FANGRAPHS_PARK)
    assert df.count() == 2
    with pytest.raises(ValueError, match="K_park_factor"):
        schemas.require(df, schemas.PARK_FACTORS)


def test_nested_json_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    df = spark.createDataFrame([(1.5, [("a", "Over"), ("b", None)]), (None, [])], "ev double, legs array<struct<player:string,side:string>>")
    sinks.write_json(df, path)
    assert sorted(map(repr, spark.read.schema(df.schema).json(path).collect())) == sorted(map(repr, df.collect()))


def test_season_window(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    rows = [(1, "2024-03-31", 2024), (2, "2024-04-01", 2024), (3, "2024-10-01", 2024), (4, "2024-10-02", 2024), (5, "2023-05-01", 2023)]
    sinks.write_parquet(spark.createDataFrame(rows, "k int, game_date string, season int"), path, "season")
    assert sorted(r.k for r in readers.read_pitches(spark, path, 2024).collect()) == [2, 3]
    assert readers.read_pitches(spark, path).count() == 5


def test_nan_and_infinity_become_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double"))
    assert [r.x for r in df.collect()] == [None, None, 1.0, None]


def test_files_order(spark, tmp_path):
    path = f"file://{tmp_path}/o"
    spark.range(10).orderBy(F.desc("id")).coalesce(1).write.parquet(path)
    assert [r.id for r in readers.with_seq(spark.read.parquet(path)).orderBy("seq").collect()] == list(range(9, -1, -1))


def test_metadata_and_models(spark, tmp_path):
    meta = models.metadata("2021-2024", 1.23456)
    sinks.write_metadata(spark, meta, f"file://{tmp_path}/m.json")
    assert readers.read_metadata(spark, f"file://{tmp_path}/m.json") == meta
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "a double, strikeouts double")
    m = models.pipeline(models.ols(), ["a"]).fit(df)
    models.save(m, f"file://{tmp_path}/model")
    assert models.importances(models.load(f"file://{tmp_path}/model"), ["a"]) == models.importances(m, ["a"])


def test_exists(spark, tmp_path):
    assert readers.exists(spark, f"file://{tmp_path}")
    assert not readers.exists(spark, f"file://{tmp_path}/no")


def test_stream_keeps_the_table_whole(spark, tmp_path):
    from moundworks.streaming.updates import follow

    d0 = dt.date(2024, 4, 1)
    rows = [(i % 2, d0 + dt.timedelta(i // 4), i, 9, "foul", "strikeout" if i % 3 == 0 else None, 1, "Top", "FF", "AZ", "NYY", None) for i in range(40)]
    landing, table, check = (f"file://{tmp_path}/{x}" for x in ("landing", "table", "check"))
    whole = spark.createDataFrame(rows, schemas.PITCHES)
    for part in (whole.where("seq < 22 AND seq <> 5"), whole.where("seq >= 22 OR seq = 5")):  # one pitch comes late
        part.coalesce(1).write.mode("append").parquet(landing)
        q = follow(spark, landing, table, check)
        q.awaitTermination(120)
        assert q.exception() is None
    want = features.enriched_games(whole, compat=False)
    keys = ["pitcher", "game_date", "pitch_count", "strikeouts", "rolling_K_avg_3", "whiff_rate_expanding"]
    assert sorted(spark.read.parquet(table).select(keys).collect()) == sorted(want.select(keys).collect())


def test_a_range_of_days_opens_only_its_files(spark, tmp_path):
    from moundworks.sources.landed import LandedPitches, LandedReader

    d0 = dt.date(2023, 12, 30)
    rows = [(i % 3, d0 + dt.timedelta(i % 6), i, 9, "foul", None, 1, "Top", "FF", "AZ", "NYY", None) for i in range(60)] + [(1, None, 60, 9, None, None, 1, "Top", None, None, None, None)]
    path = f"file://{tmp_path}/landed"
    spark.createDataFrame(rows, schemas.PITCHES).write.partitionBy("game_date").parquet(path)
    spark.dataSource.register(LandedPitches)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    x = spark.read.format("landed_pitches").load(path)
    assert x.count() == 60 and x.columns[-1] == "season"
    some = spark.read.format("landed_pitches").schema("seq long, game_date date, season int").load(path)
    some = some.where("game_date >= DATE '2024-01-01' AND game_date < DATE '2024-01-03' AND season = 2024 AND seq > 5")
    assert sorted(r.seq for r in some.collect()) == [i for i in range(6, 60) if i % 6 in (2, 3)]
    assert some.rdd.getNumPartitions() == 2
    reader = LandedReader(path, x.schema)
    from pyspark.sql.datasource import EqualTo, In, LessThan

    assert list(reader.pushFilters([EqualTo(("season",), 2023), LessThan(("seq",), 9)])) == [LessThan(("seq",), 9)]
    assert [p.day for p in reader.partitions()] == ["2023-12-30", "2023-12-31"]
    list(reader.pushFilters([In(("game_date",), (d0,))]))
    assert [p.day for p in reader.partitions()] == ["2023-12-30"]


def test_a_tuned_row_is_there_once(spark, tmp_path):
    path = f"file://{tmp_path}/metrics"
    make = lambda *r: spark.createDataFrame(list(r), "model string, CV_MAE double")
    sinks.merge_parquet(make(("Linear", 1.0), ("Ridge", 1.1)), path, "model")
    for mae in (0.9, 0.8):
        sinks.merge_parquet(make(("Tuned", mae)).withColumn("trees", F.lit(30)), path, "model")
    assert sorted((r.model, r.CV_MAE, r.trees) for r in spark.read.parquet(path).collect()) == [("Linear", 1.0, None), ("Ridge", 1.1, None), ("Tuned", 0.8, 30)]


def test_json_is_fetched_or_an_error(tmp_path):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    class Quiet(SimpleHTTPRequestHandler):
        def log_message(self, *_):
            pass

    (tmp_path / "odds.json").write_text('{"a": [1, 2]}')
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert readers.fetch_json(f"{url}/odds.json", {"sport": "x y"}) == {"a": [1, 2]}
        with pytest.raises(OSError, match="404"):
            readers.fetch_json(f"{url}/none.json", {})
    finally:
        server.shutdown()


def test_landed_park_factors_are_numbers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Team_abbr,K_park_factor\nSF,0.97\nBOS,\n")
    got = {r.Team_abbr: r.K_park_factor for r in readers.landed_park_factors(spark, f"file://{tmp_path}/p.csv").collect()}
    assert got == {"SF": 0.97, "BOS": None}


def test_command_lines(spark, tmp_path):
    from moundworks import cli

    d0 = dt.date(2024, 4, 1)
    rows = [(i % 2, d0 + dt.timedelta(i // 4), i, 9, "foul", "strikeout" if i % 3 == 0 else None, 1, "Top", "FF", "AZ", "NYY", None) for i in range(40)]
    base = f"file://{tmp_path}"
    pitches = spark.createDataFrame(rows, schemas.PITCHES)
    pitches.write.parquet(f"{base}/pitches")
    sinks.write_csv(spark.createDataFrame([("A", "SF", 20.0, 3, 1.0, 3.0, 9.0, 1), ("B", "SF", 9.0, 3, 2.0, 3.0, 9.0, 2), ("C", "SF", 30.0, 3, None, 3.0, 9.0, 3)], schemas.STARTERS), f"{base}/stats")
    spark.createDataFrame([(1, 1), (3, 0)], schemas.PLAYER_XREF).write.parquet(f"{base}/xref")
    cli.main(["starters", f"{base}/stats", f"{base}/xref", f"{base}/starters"], spark)
    assert sorted(map(tuple, readers.read_csv(spark, f"{base}/starters", "pitcher_name string, pitcher_id long").collect())) == [("A", 1), ("C", 0)]
    early = f"{base}/early"
    pitches.where("seq < 20").write.parquet(early)
    cli.main(["games", early, f"{base}/games", "--pitchers", f"{base}/starters", "--season", "2024"], spark)
    assert spark.read.parquet(f"{base}/games").count() == 10
    cli.main(["update", f"{base}/pitches", f"{base}/games", "--as-of", "2024-04-09"], spark)
    got = spark.read.parquet(f"{base}/games")
    assert got.count() == 16 and got.where("pitcher_name = 'C' AND pitcher <> 0").count() == 0
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)
