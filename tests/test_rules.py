"""Hand-made rows for each rule of nulls, zeros, order and defaults."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from moundworks import schemas
from moundworks.functions.semantics import decimal_odds, exact_normal_cdf, normal_cdf, soften
from moundworks.operators import context, features, games, models, odds, pricing, slips
from moundworks.plans import catalog

DAY = dt.date(2024, 4, 1)


def day(n):
    return DAY + dt.timedelta(n)


def pitch(seq, pitcher=1, on=0, description="foul", events=None, inning=1, topbot="Top", kind="FF", home="AZ", away="NYY", rest=None, batter=9):
    return (pitcher, None if on is None else day(on), seq, batter, description, events, inning, topbot, kind, home, away, rest)


@pytest.fixture
def pitches(spark):
    return lambda rows: spark.createDataFrame(rows, schemas.PITCHES)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_null_keys_go_and_null_conditions_are_false(pitches):
    rows = [pitch(1, pitcher=None), pitch(2, on=None), pitch(3, topbot=None), pitch(4, events="strikeout")]
    g = one(games.pitcher_games(pitches(rows)))
    assert (g.strikeouts, g.pitch_count) == (1, 2)
    assert g.pitcher_team == "ARI"  # the first half-inning that is known


def test_unknown_half_inning_takes_the_other_arm(pitches):
    g = one(games.pitcher_games(pitches([pitch(1, topbot=None)])))
    assert (g.pitcher_team, g.opponent_team) == ("NYY", "ARI")


def test_zero_denominators_are_zero_rates(pitches):
    g = one(games.pitcher_games(pitches([pitch(1, description=None), pitch(2, description=None)])))
    assert (g.pitch_count, g.whiff_rate, g.csw_pct, g.whiff_rate_expanding) == (0, 0.0, 0.0, 0.0)


def test_first_is_the_first_known_value_of_each_column(pitches):
    g = one(games.pitcher_games(pitches([pitch(2, home="SFG"), pitch(1, home=None, away="BOS"), pitch(3, home="OAK", away="CWS")])))
    assert (g.home_team, g.away_team) == ("SF", "BOS")


@pytest.mark.parametrize(("rest", "want"), [(None, 5), (4.9, 4), (-0.5, 0)])
def test_rest_days_are_cut_not_rounded(pitches, rest, want):
    assert one(games.pitcher_games(pitches([pitch(1, rest=rest)]))).rest_days == want


def test_form_needs_whole_frames(spark):
    k, n = [3, 6, 9, 0, 5, 7, 2], [80, 90, 100, 70, 60, 85, 95]
    rows = [(1, day(i), a, b) for i, (a, b) in enumerate(zip(k, n, strict=True))]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "pitcher long, game_date date, strikeouts long, pitch_count long")
    got = features.with_form(df).orderBy("game_date").collect()
    for i, r in enumerate(got):
        assert r.rolling_K_avg_3 == (sum(k[i - 3 : i]) / 3 if i >= 3 else 5.0)
        assert r.rolling_K_avg_5 == (sum(k[i - 5 : i]) / 5 if i >= 5 else 5.0)
        assert r.rolling_pitch_count_5 == (sum(n[i - 5 : i]) / 5 if i >= 5 else 85.0)
        assert r.rolling_K_rate == (sum(k[i - 3 : i]) / sum(n[i - 5 : i]) if i >= 5 else 0.055)


def test_form_without_pitches_takes_the_default(spark):
    df = spark.createDataFrame([(1, day(i), 1, 0) for i in range(6)], "pitcher long, game_date date, strikeouts long, pitch_count long")
    assert [r.rolling_K_rate for r in features.with_form(df).orderBy("game_date").collect()] == [0.055] * 6


def team_pitches(pitches):
    rows, seq = [], itertools.count()
    for team, on, ks, others in (("AAA", 0, 1, 1), ("AAA", 1, 2, 2), ("BBB", 0, 10, 0), ("BBB", 1, 20, 0)):
        rows += [pitch(next(seq), on=on, topbot="Bot", home=team, events="strikeout" if i < ks else "walk") for i in range(ks + others)]
    return pitches(rows)


def test_opponent_rate_carries_over_teams_only_in_the_compatible_form(pitches):
    p = team_pitches(pitches)
    rate = {m: {(r.Team, r.game_date): r.K_pct_so_far for r in context.opponent_k(p, compat=m).collect()} for m in (True, False)}
    assert rate[True] == {("AAA", day(0)): 0.055, ("AAA", day(1)): 0.5, ("BBB", day(0)): 0.5, ("BBB", day(1)): 1.0}
    assert rate[False] == {**rate[True], ("BBB", day(0)): 0.055}


def test_one_team_is_alike_in_both_forms(pitches):
    p = team_pitches(pitches).where("home_team = 'AAA'")
    assert sorted(context.opponent_k(p).collect()) == sorted(context.opponent_k(p, compat=False).collect())


def test_two_codes_of_a_park_fan_out_only_in_the_compatible_form(pitches):
    p = pitches([pitch(1, home="AZ", events="strikeout"), pitch(2, home="ARI"), pitch(3, home=None)])
    g = games.pitcher_games(p)
    assert context.with_park(g, context.park_factors(p)).count() == 2
    r = one(context.with_park(g, context.park_factors(p, compat=False)))
    assert r.park_factor_K == pytest.approx((1 / 2) / (1 / 3))


def test_unmatched_opponent_stays_null(pitches):
    p = pitches([pitch(1)])
    r = one(context.with_opponent(games.pitcher_games(p), context.opponent_k(p).where("false")))
    assert r.opponent_k_pct is None


def test_enriched_has_the_public_columns(spark, pitches):
    ids = spark.createDataFrame([("Ann", 1)], "pitcher_name string, pitcher_id long")
    x = features.enriched_games(pitches([pitch(1), pitch(2, pitcher=2)]), ids)
    assert sorted(x.columns) == sorted(c.split()[0] for c in schemas.PITCHER_GAMES.split(", "))
    assert one(x).pitcher_name == "Ann"


def test_increment_has_one_row_a_key_when_strict(pitches):
    p = pitches([pitch(i, on=i // 3, events="strikeout") for i in range(30)])
    done = features.enriched_games(p.where(F.col("game_date") <= F.lit(day(5))), compat=False)
    x = features.incremental(p, done, str(day(9)), compat=False)
    assert x.count() == x.select("pitcher", "game_date").distinct().count() == 9
    whole = features.enriched_games(p.where(F.col("game_date") < F.lit(day(9))), compat=False)
    assert sorted(x.select(whole.columns).collect()) == sorted(whole.collect())


def test_increment_starts_cold_in_the_compatible_form(pitches):
    p = pitches([pitch(i, on=i // 3, events="strikeout") for i in range(30)])
    done = features.enriched_games(p.where(F.col("game_date") <= F.lit(day(5))))
    x = features.incremental(p, done, str(day(9)))
    assert {r.rolling_K_avg_3 for r in x.where(F.col("game_date") == F.lit(day(8))).collect()} == {3.0}
    assert {r.rolling_K_avg_3 for r in x.where(F.col("game_date") == F.lit(day(6))).collect()} == {5.0}
    assert x.where(F.col("game_date") == F.lit(day(5))).count() == 2


def test_increment_refuses_nothing(pitches):
    p = pitches([pitch(1)])
    with pytest.raises(ValueError, match="nothing"):
        features.incremental(p, features.enriched_games(p).where("false"), "2024-05-01")


def test_starters_put_missing_war_last(spark):
    rows = [(1, 20.0, 3, None), (2, 20.0, 3, 1.5), (3, 14.9, 3, 9.0), (4, 20.0, 0, 9.0), (5, 30.0, 1, 2.5)]
    df = spark.createDataFrame(rows, "IDfg long, IP double, GS int, WAR double")
    assert [r.IDfg for r in features.top_starters(df).collect()] == [5, 2, 1]
    assert [r.IDfg for r in features.top_starters(df, n=1).collect()] == [5]


def test_latest_settles_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 2, 5), ("b", None, 3), (None, 9, 9)], "k string, o int, t int")
    assert sorted(map(tuple, games.latest(df, "k", "o", "t").collect())) == [("a", 2, 5), ("b", None, 3)]


def test_odds(spark):
    df = spark.createDataFrame([(150,), (-120,), (0,), (None,)], "o int")
    assert [r[0] for r in df.select(decimal_odds("o")).collect()] == [2.5, pytest.approx(1 + 100 / 120), None, None]


def test_normal_cdf(spark):
    from math import erf

    z = [x / 10 for x in range(-60, 61)]
    df = spark.createDataFrame([(x,) for x in z], "z double").select("z", normal_cdf(F.col("z")).alias("a"), exact_normal_cdf(F.col("z")).alias("b"))
    for r in df.collect():
        want = 0.5 * (1 + erf(r.z / 2**0.5))
        assert abs(r.a - want) < 1.5e-7
        assert r.b == pytest.approx(want, abs=1e-15)


def test_soften(spark):
    assert spark.range(1).select(soften(F.lit(0.9))).first()[0] == pytest.approx(0.84)


OPTION = dict(selection_header="P", american_price="-110", decimal_price="1.9", payout_multiplier="1.0")


def document(spark, lines, appearances):
    import json

    return spark.createDataFrame([(json.dumps({"appearances": appearances, "over_under_lines": lines}),)], "v string").select(F.from_json("v", schemas.ODDS).alias("d")).select("d.*")


def line(i, choices=("higher", "lower"), k="4.5"):
    return {"stat_value": k, "over_under": {"appearance_stat": {"appearance_id": i}}, "options": [{**OPTION, "choice": c} for c in choices]}


STARTS = [{"id": "a", "badges": [{"label": "Starting", "value": "Yes"}]}, {"id": "b", "badges": [{"label": "Starting", "value": "No"}]}, {"id": "c"}]


def test_only_starting_players_have_lines(spark):
    x = odds.strikeout_lines(document(spark, [line("a"), line("b"), line("c"), line("z"), {"stat_value": "1"}], STARTS))
    assert one(x).k_line == 4.5


def test_a_missing_side_is_an_error_or_null(spark):
    d = document(spark, [line("a", ("higher",))], STARTS)
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX_IN_ELEMENT_AT|out of bounds"):
        odds.strikeout_lines(d).collect()
    r = one(odds.strikeout_lines(d, strict=False))
    assert (r.over_american_price, r.under_american_price) == (-110, None)


def test_text_that_is_no_number_is_null(spark):
    assert one(odds.strikeout_lines(document(spark, [line("a", k="n/a")], STARTS))).k_line is None


def test_residual_of_one_row_takes_the_whole_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0)], "pitcher_name string, residual double")
    got = {r[0]: r[1] for r in pricing.residual_deviation(df).collect()}
    assert got == {"a": pytest.approx(2**0.5), "b": pytest.approx((28 / 3) ** 0.5)}


def test_simulation_is_near_the_distribution(spark):
    df = spark.createDataFrame([("a", 5.5, 6.2, 1.5), ("b", 3.5, 2.0, 2.0)], "pitcher_name string, k_line double, k_pred_mean double, hybrid_std double")
    n = 10_000
    a = pricing.simulate(df, n, seed=1, softness=1.0).collect()
    assert a == pricing.simulate(df, n, seed=1, softness=1.0).collect()
    want = df.select(1 - normal_cdf((F.col("k_line") - F.col("k_pred_mean")) / F.col("hybrid_std"))).collect()
    for r, w in zip(a, want, strict=True):
        assert abs(r.mc_p_over - w[0]) <= 4 * (w[0] * (1 - w[0]) / n) ** 0.5


def test_registered_draws_and_trees_are_the_defaults(spark, monkeypatch):
    made = []
    monkeypatch.setattr(catalog, "trained", lambda spark, sf, make: made.append(make(None)))
    catalog.QUERIES["gbt_fit"](spark, "")
    assert made[0].getMaxIter() == 100
    prices = spark.createDataFrame([(f"p{i}", 5.5, 4.0 + i / 10, 2.0, 1.9, 1.9) for i in range(20)], "pitcher_name string, k_line double, k_pred_mean double, hybrid_std double, payout_over double, payout_under double")
    monkeypatch.setattr(catalog, "priced", lambda spark, sf: prices)
    got = {r.pitcher_name: r.mc_p_over for r in catalog.QUERIES["mc_probs"](spark, "").collect()}
    assert got == {r.pitcher_name: r.mc_p_over for r in pricing.simulate(prices, 10_000).collect()}
    sides = {"PREDICTIONS": prices.select("pitcher_name", "k_pred_mean", F.col("hybrid_std").alias("k_pred_std")), "LINES": prices.select(F.col("pitcher_name").alias("player"), "k_line", F.lit(-110).alias("over_american_price"), F.lit(-110).alias("under_american_price"))}
    monkeypatch.setattr(catalog.views, "view", lambda spark, sf, body: next(d for n, d in sides.items() if body == getattr(catalog.views, n)))
    shares = [r.over_pct * 10_000 for r in catalog.QUERIES["simulated_ev"](spark, "").collect()]
    assert all(x == pytest.approx(round(x), abs=1e-6) for x in shares)
    assert any(round(x) % 5 for x in shares)  # 2,000 draws only give fives


def test_plays_keep_the_other_side(spark):
    df = spark.createDataFrame([("a", 0.2, -0.1, 1.9, 2.0)], "pitcher_name string, mc_ev_over double, mc_ev_under double, payout_over double, payout_under double")
    r = one(pricing.plays(df))
    assert (r.play, r.ev, r.payout, r.mc_ev_under, r.mc_ev_over) == ("over", 0.2, 1.9, -0.1, None)


LEGS = [(i, f"P{i % 8}", "over" if i < 8 else "under", round(0.45 + 0.03 * (i % 7), 2)) for i in range(12)]


def combos(sizes):
    pay = schemas.SLIP_PAYOUTS
    for k in sizes:
        for c in itertools.combinations(LEGS, k):
            if len({x[1] for x in c}) == k:
                p = 1.0
                for x in c:
                    p *= x[3]
                yield sum(1 << x[0] for x in c), p, p * pay[k] - 1, k


def legs(spark):
    return spark.createDataFrame(LEGS, "pos int, pitcher_name string, play string, p double")


def test_slips_are_all_combinations(spark):
    got = {r["mask"]: r.total_ev for r in slips.slips(legs(spark)).collect()}
    want = {m: ev for m, _, ev, _ in combos(range(2, 9))}
    assert got.keys() == want.keys()
    assert all(got[m] == pytest.approx(want[m]) for m in want)


def test_slips_of_the_best_plays(spark, monkeypatch):
    prices = spark.createDataFrame([(f"p{i:02}", 5.5, 3.0 + i * 0.31, 2.0, 1.9, 1.95) for i in range(20)], "pitcher_name string, k_line double, k_pred_mean double, hybrid_std double, payout_over double, payout_under double")
    monkeypatch.setattr(catalog, "priced", lambda spark, sf: prices)
    sides = [(p * pay - (1 - p), r.pitcher_name, p) for r in pricing.simulate(prices).collect() for p, pay in ((r.mc_p_over, r.payout_over), (r.mc_p_under, r.payout_under))]
    best = sorted((x for x in sides if x[0] > 0), key=lambda x: (-x[0], x[1]))
    assert len(best) > 12
    want = {}
    for k in range(2, 9):
        for c in itertools.combinations(range(12), k):
            if len({best[i][1] for i in c}) == k:
                want[sum(1 << i for i in c)] = math.prod(best[i][2] for i in c) * schemas.SLIP_PAYOUTS[k] - 1
    got = {r["mask"]: r.total_ev for r in catalog.QUERIES["slips_of_plays"](spark, "").collect()}
    assert got.keys() == want.keys()
    assert all(got[m] == pytest.approx(want[m], abs=1e-8) for m in want)


def test_draws_are_those_of_hash_expressions(spark):
    """Nulls, NaN and infinities included."""
    nan, inf = float("nan"), float("inf")
    odd = [(None, 5.5, 5.0, 1.0), ("a", None, 5.0, 1.0), ("b", 5.5, None, 1.0), ("c", -1.0, None, 1.0), ("d", nan, 5.0, 1.0), ("e", 5.5, nan, 1.0), ("f", 5.5, 5.0, None), ("g", 5.5, inf, 1.0), ("h", 5.0, 5.0, 0.0), ("i", -inf, 5.0, 1.0)]
    df = spark.createDataFrame([(f"p{i}", 2.5 + i % 5, 3 + i * 0.31, 0.5 + i * 0.17) for i in range(20)] + odd, "pitcher_name string, k_line double, k_pred_mean double, hybrid_std double")
    h = "xxhash64(9, pitcher_name, k_line, i)"
    z = f"sqrt(-2 * ln((shiftrightunsigned({h}, 33) + 0.5D) / 2147483648D)) * cos((({h} & 2147483647) + 0.5D) / 2147483648D * 2 * pi())"
    for clip, value in ((True, f"rint(greatest(k_pred_mean + hybrid_std * {z}, 0D))"), (False, f"k_pred_mean + hybrid_std * {z}")):
        want = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(300)))).groupBy("pitcher_name").agg(F.expr(f"count_if({value} > k_line) / 300D").alias("p"))
        got = pricing.simulate(df, 300, seed=9, softness=1.0, clip=clip)
        assert {r.pitcher_name: r.mc_p_over for r in got.collect()} == pytest.approx({r.pitcher_name: r.p for r in want.collect()})


def test_plays_simulate_once_and_on_all_cores(spark):
    df = spark.range(50).selectExpr("concat('p', id) AS pitcher_name", "5.5D AS k_line", "5D AS k_pred_mean", "1D AS hybrid_std", "2D AS payout_over", "2D AS payout_under").coalesce(1)
    x = pricing.simulate(pricing.spread(df), 100)
    assert x.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = slips.top_legs(pricing.plays(pricing.evs(x, "mc_p_over", "mc_p_under", "mc_ev_over", "mc_ev_under")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64") == 1 and plan.count("Generate explode") == 1


def test_teams_are_told_from_few_rows(spark):
    """No condition on a team's code stands below the first aggregation, where it would be met by each pitch."""
    rates = context.opponent_k(spark.range(3).selectExpr("date'2024-01-01' + int(id) AS game_date", "string(id) AS home_team", "string(id) AS away_team", "string(id) AS inning_topbot", "string(id) AS events"), compat=False)
    plan = context.with_opponent(spark.range(3).selectExpr("date'2024-01-01' + int(id) AS game_date", "string(id) AS opponent_team"), rates)._jdf.queryExecution().optimizedPlan().toString()
    assert "WSN" in plan and "WSN" not in plan[plan.rindex("Aggregate ") :]


def test_greedy_choices_follow_a_plain_loop(spark):
    s = slips.slips(legs(spark)).select("mask", "slip_size", "p_win", "payout", F.round("total_ev", 9).alias("total_ev"), "avg_ev", "ordinal")
    made = [(m, p, round(ev, 9), k) for m, p, ev, k in combos(range(2, 9))]
    seen = []
    for x in sorted(made, key=lambda x: -x[2]):
        if all(bin(x[0] & y[0]).count("1") <= 3 for y in seen):
            seen.append(x)
    kept = slips.diverse(s)
    assert {r["mask"] for r in kept.collect()} == {x[0] for x in seen}
    spent, want = 0, []
    for m, p, ev, _ in seen:
        if spent >= 7.15:
            break
        units = 5 if ev > 1.5 and p > 0.5 else 2 if ev > 1 and p > 0.4 else 1
        if spent + units <= 7.15:
            want.append((m, units))
            spent += units
    assert sorted((r["mask"], r.units) for r in slips.full_send(kept).collect()) == sorted(want)


def test_full_send_passes_over_what_does_not_fit(spark):
    rows = [(1, 2, 0.6, 3, 2.0, 1.0, -9), (2, 2, 0.6, 3, 1.9, 1.0, -8), (4, 2, 0.45, 3, 1.2, 1.0, -7), (8, 2, 0.1, 3, 0.1, 0.1, -6)]
    s = spark.createDataFrame(rows, "mask long, slip_size long, p_win double, payout int, total_ev double, avg_ev double, ordinal int")
    assert sorted((r["mask"], r.units) for r in slips.full_send(s).collect()) == [(1, 5), (4, 2)]


def test_conservative_takes_three_as_made(spark):
    s = slips.slips(legs(spark), sizes=(2, 2))
    assert [r["mask"] for r in slips.conservative(s).orderBy("ordinal").collect()] == [0b11, 0b101, 0b1001]


def test_folds_expand(spark):
    df = spark.range(0, 23).repartition(5)
    got = {r.id: r.f for r in models.positions(df, ["id"]).select("id", models.time_folds(F.col("_p"), 23).alias("f")).collect()}
    assert got == {i: 0 if i < 8 else (i - 8) // 5 + 1 for i in range(23)}


def test_ridge_is_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2)) * [1, 20]
    y = x @ [2.0, -0.3] + rng.normal(size=60) + 4
    df = spark.createDataFrame([Row(a=float(p), b=float(q), strikeouts=float(t)) for (p, q), t in zip(x, y, strict=True)])
    m = models.pipeline(models.ridge(df, alpha=5.0), ["a", "b"]).fit(df).stages[-1]
    xc, yc = x - x.mean(axis=0), y - y.mean()
    assert m.coefficients.toArray() == pytest.approx(np.linalg.solve(xc.T @ xc + 5 * np.eye(2), xc.T @ yc), rel=1e-6)


def test_cross_validation_and_comparison(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 5) * 2) for i in range(40)], "t int, a double, strikeouts double")
    assert models.cross_validate(df, models.ols(), ["t"], features=["a"]) == pytest.approx([0, 0, 0], abs=1e-6)
    best, score, _ = models.grid_search(df, lambda alpha: models.ridge(df, alpha), {"alpha": [0.0, 1000.0]}, ["t"], features=["a"])
    assert best == {"alpha": 0.0}
    assert score < 1e-6


def test_order_and_partitions_do_not_matter(spark, pitches):
    rows = [pitch(i, pitcher=i % 3, on=i % 7, events="strikeout" if i % 4 == 0 else None, home=None if i % 5 == 0 else "SFG") for i in range(200)]
    want = sorted(features.enriched_games(pitches(rows).coalesce(1)).collect())
    random.Random(1).shuffle(rows)
    assert sorted(features.enriched_games(pitches(rows).repartition(7)).collect()) == want


def test_bootstrap_and_comparison(spark):
    rows = [(i, float(i % 7), float(2 * (i % 7)) + (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, a double, strikeouts double")
    x = models.bootstrap(df, df.where("t < 5"), ["t"], models=4, make=models.ols, features=["a"])
    assert x.count() == 20
    assert x.select("model", "pred").distinct().count() > 4  # the resamples differ
    e = pricing.ensemble(x).collect()
    assert {r.k_pred_std for r in e} == {0.75}
    c = models.comparison(df, df, {"ols": models.ols(), "ridge": models.ridge(df)}, ["t"], features=["a"]).collect()
    assert [r.model for r in c] == ["ols", "ridge"]
    assert all(r.Test_RMSE == pytest.approx(r.Test_MSE**0.5) and r.CV_Std >= 0 for r in c)


def test_exact_distribution_keeps_its_digits(spark):
    """Against the C library over eight deviations, tails by their own size."""
    z = [i / 16 for i in range(-128, 129)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(exact_normal_cdf(F.col("z"))).collect()]
    want = [0.5 * math.erfc(-x / 2**0.5) for x in z]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 2e-15
    assert max(abs(a / b - 1) for a, b in zip(got, want, strict=True)) < 1e-14


def test_documents_are_kept_apart_and_corrupt_ones_told(spark, tmp_path):
    import json

    from moundworks.sources import readers

    one_doc = {"appearances": STARTS, "over_under_lines": [line("a"), line("b")]}
    other = {"appearances": [{"id": "b", "badges": [{"label": "Starting", "value": "Yes"}]}], "over_under_lines": [line("a", k="1.5"), line("b", k="2.5")]}
    (tmp_path / "one.json").write_text(json.dumps(one_doc, indent=1))
    (tmp_path / "two.json").write_text(json.dumps([other, {"over_under_lines": None}]))
    (tmp_path / "three.json").write_text('{"appearances": [')
    x = readers.read_odds(spark, f"file://{tmp_path}")
    assert sorted(r.k_line for r in odds.strikeout_lines(x).collect()) == [2.5, 4.5]
    assert [r.file.rsplit("/", 1)[1] for r in x.where("corrupt IS NOT NULL").collect()] == ["three.json"]
    assert x.count() == 4
