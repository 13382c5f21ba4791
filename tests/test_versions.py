"""Tables in parts: what is written, what a reader meets, the season loop and the stream."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from moundworks import schemas
from moundworks.operators.features import enriched_games
from moundworks.plans import catalog, seasons
from moundworks.sources.versions import Conflict, PartTable

SF = "/root/testdata/sf0.001"


def table(spark, tmp_path, **more):
    return PartTable(spark, f"file://{tmp_path}/t", "season int, pitcher long, v string", buckets=4, **more)


def rows(spark, some):
    return spark.createDataFrame(some, "season int, pitcher long, v string")


def files(tmp_path):
    return {p: p.stat().st_mtime_ns for p in Path(tmp_path, "t/data").rglob("*.parquet")}


def test_only_touched_parts_are_written(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.current().number == 0
    t.upsert(rows(spark, [(s, p, "old") for s in (2023, 2024) for p in range(40)]), ["season", "pitcher"])
    before, first = files(tmp_path), t.current()
    t.upsert(rows(spark, [(2024, 7, "new"), (2024, 99, "more")]), ["season", "pitcher"])
    got = {(r.season, r.pitcher): r.v for r in t.read().collect()}
    assert len(got) == 81 and got[2024, 7] == "new" and got[2024, 99] == "more" and got[2023, 7] == "old"
    after = files(tmp_path)
    assert all(after[p] == m for p, m in before.items())  # nothing of the old version was touched
    changed = [k for k, v in t.current().parts.items() if first.parts.get(k) != v]
    assert 1 <= len(changed) <= 2 and all(k.startswith("season=2024/") for k in changed)
    # a reader of the version before still has all of it
    assert {r.v for r in t.read(version=first).collect()} == {"old"} and t.read(version=first).count() == 80
    assert t.read(seasons=[2023]).inputFiles() and not [f for f in t.read(seasons=[2023]).inputFiles() if "_season=2024" in f]
    assert t.clean(keep=1) >= 0 and t.read().count() == 81


def test_null_keys_are_equal_and_a_part_may_go(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, [(2024, None, "a"), (2024, 1, "b")]), ["season", "pitcher"])
    t.upsert(rows(spark, [(2024, None, "c")]), ["season", "pitcher"])
    assert sorted((r.pitcher is None, r.v) for r in t.read().collect()) == [(False, "b"), (True, "c")]
    base = t.current()
    t.replace(t.read().limit(0), [tuple(p.split("=")[1] for p in k.split("/")) for k in base.parts], base)
    assert t.read().count() == 0 and not t.current().parts


def test_a_second_writer_of_one_version_is_told(spark, tmp_path):
    t = table(spark, tmp_path)
    base = t.current()
    new = rows(spark, [(2024, 1, "x")])
    t.replace(new, t.parts_of(new), base)
    with pytest.raises(Conflict):
        t.replace(new, t.parts_of(new), base)
    assert t.current().number == 1 and t.read().count() == 1


def test_a_write_that_fails_leaves_the_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, [(2024, 1, "x")]), ["season", "pitcher"])
    bad = rows(spark, [(2024, 1, "y")]).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        t.upsert(bad, ["season", "pitcher"])
    assert [r.v for r in t.read().collect()] == ["x"] and t.current().number == 1


def test_seasons_stop_at_an_error_and_go_on(spark, tmp_path):
    t = table(spark, tmp_path)
    tried = []

    def pitches(season):
        tried.append(season)
        if season == 2023 and not os.path.exists(tmp_path / "mended"):
            raise OSError("no file for 2023")
        n = 0 if season == 2022 else 3
        return spark.range(n).select(F.col("id").alias("pitcher"), F.lit(str(season)).alias("v"))

    with pytest.raises(OSError, match="2023"):
        seasons.bootstrap(pitches, range(2021, 2025), t, lambda x: x)
    assert {r.season for r in t.read().collect()} == {2021} and tried == [2021, 2022, 2023]
    (tmp_path / "mended").touch()
    report = seasons.bootstrap(pitches, range(2021, 2025), t, lambda x: x)
    assert (report.made, report.empty, report.skipped) == ([2023, 2024], [], [2021, 2022])
    assert {r.season: r.n for r in t.read().groupBy("season").agg(F.count("*").alias("n")).collect()} == {2021: 3, 2023: 3, 2024: 3}
    again = seasons.bootstrap(pitches, [2022, 2024], t, lambda x: x, again=True)
    assert (again.made, again.empty) == ([2024], [2022]) and t.read().count() == 9


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stream_in_parts_gives_the_whole_table(spark, tmp_path):
    from moundworks.streaming.updates import follow_parts, stored

    all_pitches = catalog.pitches(spark, SF).select(*[F.col(c).cast(t) for c, t in (f.split() for f in schemas.PITCHES.split(", "))])
    for c, (_, kind) in zip(all_pitches.columns, (f.split() for f in schemas.PITCHES.split(", ")), strict=True):
        all_pitches = all_pitches.withColumn(c, F.col(c).cast(kind))
    landing, root, check = (f"file://{tmp_path}/{n}" for n in ("landing", "root", "check"))
    for k in range(3):  # late rows too: files are dealt by event, not by date
        all_pitches.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(landing)
        follow_parts(spark, landing, root, check, buckets=4).awaitTermination()
    got = stored(spark, root, 4)["games"].read()
    p = spark.read.schema(schemas.PITCHES).parquet(landing).withColumn("season", F.year("game_date"))
    want = enriched_games(p, by=("season", "pitcher"), compat=False)
    own = [c for c in want.columns if c not in ("opponent_k_pct",)]
    norm = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*own).where("park_factor_K IS NOT NULL").drop("park_factor_K").collect()), key=repr)
    assert norm(got) == norm(want)
