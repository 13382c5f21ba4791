"""The library's registered queries and their oracles, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundworks import schemas
from moundworks.functions.semantics import batting_team, decimal_odds, fielding_team, first_non_null, opposing_team
from moundworks.operators import boosting, context, features, games, models, odds, pricing, slips
from moundworks.plans import oracles as o
from moundworks.plans import views
from moundworks.sources import landed, readers, sinks, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pitches(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.PITCHES)


def scratch(spark: SparkSession) -> str:
    return sinks.scratch_dir(spark, "sink")


# Sources and sinks

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))


@query(ORDERS)
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf)


@query(ORDERS)
def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_parquet(orders(spark, sf), path, "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(ORDERS)
def parquet_swap(spark: SparkSession, sf: str) -> DataFrame:
    """A table replaced by what was read from it."""
    path = scratch(spark)
    sinks.write_parquet(orders(spark, sf), path)
    sinks.swap_parquet(spark.read.parquet(path).where("o_orderkey IS NOT NULL"), path)
    return spark.read.parquet(path)


@query(f"{o.P} SELECT pitcher, seq, game_date, description FROM pitches WHERE game_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-14'")
def landed_range(spark: SparkSession, sf: str) -> DataFrame:
    """A range of days from landed files, a partition a day; other days are not opened."""
    path = scratch(spark)
    pitches(spark, sf).repartition("game_date").write.partitionBy("game_date").parquet(path)
    spark.dataSource.register(landed.LandedPitches)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    x = spark.read.format("landed_pitches").schema("pitcher long, seq long, game_date date, description string").load(path)
    return x.where("game_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-14'")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_csv(table(spark, sf, "nation"), path)
    return readers.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS at, s_suppkey, s_name FROM supplier")
def csv_index(spark: SparkSession, sf: str) -> DataFrame:
    """A table with each row's place in it as a column, in files and back."""
    path = scratch(spark)
    x = models.positions(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), ["s_acctbal", "s_suppkey"])
    sinks.write_csv(x.select(F.col("_p").alias("at"), "s_suppkey", "s_name"), path)
    return readers.read_csv(spark, path, "at long, s_suppkey long, s_name string")


# Projections

@query("SELECT l_orderkey AS order_key, l_linenumber AS line, l_quantity AS quantity, l_extendedprice * (1 - l_discount) AS revenue, 'lineitem' AS origin FROM lineitem")
def projection(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "order_key", "l_linenumber": "line", "l_quantity": "quantity"})
    x = x.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn("origin", F.lit("lineitem"))
    return x.select("order_key", "line", "quantity", "revenue", "origin")


@query(f"{o.P} SELECT seq, {o.canonical('home_team')} AS home_team, {o.canonical('away_team')} AS away_team FROM pitches")
def alias_replace(spark: SparkSession, sf: str) -> DataFrame:
    return games.canonical_teams(pitches(spark, sf).select("seq", "home_team", "away_team"), "home_team", "away_team")


@query(f"SELECT {o.nickname('Team')} AS Team_abbr, SO / 100.0 AS K_park_factor FROM ({views.NICKNAMED}) x")
def dict_map_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return readers.historic_park_factors(views.view(spark, sf, views.NICKNAMED))


@query(
    f"{o.P} SELECT seq, CASE WHEN inning_topbot = 'Bot' THEN home_team ELSE away_team END AS batting, CASE WHEN inning_topbot = 'Top' THEN home_team ELSE away_team END AS pitcher_team, "
    "CASE WHEN inning_topbot = 'Top' THEN away_team ELSE home_team END AS opponent_team FROM pitches"
)
def case_team(spark: SparkSession, sf: str) -> DataFrame:
    return pitches(spark, sf).select("seq", batting_team().alias("batting"), fielding_team().alias("pitcher_team"), opposing_team().alias("opponent_team"))


@query(f"{o.P} SELECT seq, CAST(trunc(coalesce(pitcher_days_since_prev_game, 5)) AS INT) AS rest_days FROM pitches")
def fill_default(spark: SparkSession, sf: str) -> DataFrame:
    return pitches(spark, sf).select("seq", F.coalesce("pitcher_days_since_prev_game", F.lit(5.0)).cast("int").alias("rest_days"))


# Filters

@query(f"{o.P} SELECT seq, game_date FROM pitches WHERE game_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def date_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    return context.between(pitches(spark, sf), "2024-01-10", "2024-01-20").select("seq", "game_date")


@query(f"{o.P} SELECT pitcher, seq, description FROM pitches WHERE pitcher = 7")
def entity_filter(spark: SparkSession, sf: str) -> DataFrame:
    return pitches(spark, sf).where("pitcher = 7").select("pitcher", "seq", "description")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_membership(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(rich, "o_custkey", "left_semi")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def nonempty_groups(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "signup", 1).alias("signup"))
    return games.nonempty(x, "signup", "user_id").select("event_id", "user_id")


# Joins

@query(f"SELECT Name AS pitcher_name, key_mlbam AS pitcher_id FROM ({views.STARTERS}) s JOIN ({views.XREF}) x ON s.IDfg = x.key_fangraphs")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return features.pitcher_ids(views.view(spark, sf, views.STARTERS), views.view(spark, sf, views.XREF))


@query(f"{o.P} SELECT pitcher, game_date, home_team, K_park_factor AS park_factor_K FROM ({o.games('pitches')}) g LEFT JOIN ({views.PARKS}) p ON g.home_team = p.Team_abbr")
def join_left_dim(spark: SparkSession, sf: str) -> DataFrame:
    x = context.with_park(games.pitcher_games(pitches(spark, sf)), views.view(spark, sf, views.PARKS))
    return x.select("pitcher", "game_date", "home_team", "park_factor_K")


@query(f"{o.P} SELECT pitcher, g.game_date, opponent_team, K_pct_so_far AS opponent_k_pct FROM ({o.games('pitches')}) g LEFT JOIN ({o.opponent('pitches', False)}) k ON g.game_date = k.game_date AND g.opponent_team = k.Team")
def join_left_multikey(spark: SparkSession, sf: str) -> DataFrame:
    p = pitches(spark, sf)
    x = context.with_opponent(games.pitcher_games(p), context.opponent_k(p, compat=False))
    return x.select("pitcher", "game_date", "opponent_team", "opponent_k_pct")


@query(f"{o.P}, k AS (SELECT Team_abbr AS Team, K_park_factor AS K_pct FROM ({views.PARKS}) p) SELECT opponent_team, pitcher, game_date, K_pct AS opponent_k_pct FROM ({o.games('pitches')}) g LEFT JOIN k ON g.opponent_team = k.Team")
def join_static_opponent(spark: SparkSession, sf: str) -> DataFrame:
    rates = views.view(spark, sf, views.PARKS).toDF("Team", "K_pct")
    return context.with_static_opponent(games.pitcher_games(pitches(spark, sf)), rates).select("opponent_team", "pitcher", "game_date", "opponent_k_pct")


# Games and their context

@query(f"{o.P} {o.games('pitches')}")
def pitcher_games(spark: SparkSession, sf: str) -> DataFrame:
    return games.pitcher_games(pitches(spark, sf))


@query(f"{o.P} SELECT pitcher, game_date, arg_min(home_team, seq) FILTER (WHERE home_team IS NOT NULL) AS home_team, arg_min(batter, seq) FILTER (WHERE batter IS NOT NULL) AS batter FROM pitches GROUP BY pitcher, game_date")
def group_first(spark: SparkSession, sf: str) -> DataFrame:
    return pitches(spark, sf).groupBy("pitcher", "game_date").agg(*[first_non_null(c, "seq").alias(c) for c in ("home_team", "batter")])


@query(f"{o.P} {o.days('pitches')}")
def team_day_k(spark: SparkSession, sf: str) -> DataFrame:
    return context.team_days(pitches(spark, sf))


@query(f"{o.P} {o.opponent('pitches', True)}")
def opponent_k_compat(spark: SparkSession, sf: str) -> DataFrame:
    return context.opponent_k(pitches(spark, sf))


@query(f"{o.P} {o.opponent('pitches', False)}")
def opponent_k_strict(spark: SparkSession, sf: str) -> DataFrame:
    return context.opponent_k(pitches(spark, sf), compat=False)


@query(f"{o.P} {o.parks('pitches', True)}")
def k_park_factor(spark: SparkSession, sf: str) -> DataFrame:
    return context.park_factors(pitches(spark, sf))


@query(f"{o.P} {o.parks('pitches', False)}")
def k_park_factor_strict(spark: SparkSession, sf: str) -> DataFrame:
    return context.park_factors(pitches(spark, sf), compat=False)


@query(f"{o.P} SELECT pitcher, game_date, rolling_K_avg_3, rolling_K_avg_5, rolling_pitch_count_5 FROM ({o.form('(' + o.counted('pitches') + ') c')}) f")
def rolling_k_avg(spark: SparkSession, sf: str) -> DataFrame:
    return features.with_form(games.counted_games(pitches(spark, sf))).select("pitcher", "game_date", "rolling_K_avg_3", "rolling_K_avg_5", "rolling_pitch_count_5")


@query(f"{o.P} SELECT pitcher, game_date, rolling_K_rate FROM ({o.form('(' + o.counted('pitches') + ') c')}) f")
def rolling_k_rate(spark: SparkSession, sf: str) -> DataFrame:
    return features.with_form(games.counted_games(pitches(spark, sf))).select("pitcher", "game_date", "rolling_K_rate")


@query(f"{o.P} SELECT pitcher, game_date, whiff_rate_expanding, csw_pct_expanding FROM ({o.games('pitches')}) g")
def expanding_rates(spark: SparkSession, sf: str) -> DataFrame:
    return games.pitcher_games(pitches(spark, sf)).select("pitcher", "game_date", "whiff_rate_expanding", "csw_pct_expanding")


@query(f"{o.P}, s AS ({views.STARTERS}), x AS ({views.XREF}) SELECT e.*, s.Name AS pitcher_name, x.key_mlbam AS pitcher_id FROM ({o.enriched('pitches', True)}) e JOIN x ON e.pitcher = x.key_mlbam JOIN s ON s.IDfg = x.key_fangraphs")
def enriched_games(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the whole feature table of every listed pitcher."""
    ids = features.pitcher_ids(views.view(spark, sf, views.STARTERS), views.view(spark, sf, views.XREF))
    return features.enriched_games(pitches(spark, sf), ids)


@query(f"{o.P} {o.enriched('pitches', False)}")
def enriched_games_strict(spark: SparkSession, sf: str) -> DataFrame:
    return features.enriched_games(pitches(spark, sf), compat=False)


HALVES = {h: f"(SELECT * FROM pitches WHERE day(game_date) % 2 = {h})" for h in (0, 1)}


@query(f"{o.P}, even AS {HALVES[0]}, odd AS {HALVES[1]} SELECT 0 AS season, * FROM ({o.enriched('even', True)}) a UNION ALL SELECT 1, * FROM ({o.enriched('odd', True)}) b")
def enriched_by_season(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of dates made at once, each as if alone."""
    p = pitches(spark, sf).withColumn("season", F.day("game_date") % 2)
    return features.enriched_games(p, by=("season", "pitcher"))


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1")
def latest_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return games.latest(orders(spark, sf).select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


# Sets and increments

@query("SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_players(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_suppkey").distinct()


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def dedupe_rows(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return x.unionByName(x).dropDuplicates()


@query("SELECT o_orderkey AS k, o_totalprice AS v, CAST(NULL AS STRING) AS status FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders")
    a = x.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = x.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return a.unionByName(b, allowMissingColumns=True)


CUT = "DATE '2024-01-20'"


@query(
    f"{o.P}, before AS (SELECT * FROM pitches WHERE game_date <= {CUT}), known AS (SELECT * FROM pitches WHERE game_date < DATE '2024-01-28') "
    f"SELECT * FROM ({o.enriched('before', False)}) a WHERE game_date < {CUT} UNION ALL SELECT * FROM ({o.enriched('known', False)}) b WHERE game_date >= {CUT}"
)
def incremental_delta(spark: SparkSession, sf: str) -> DataFrame:
    p = pitches(spark, sf)
    done = features.enriched_games(p.where(f"game_date <= {CUT}"), compat=False)
    return features.incremental(p, done, "2024-01-28", compat=False)


@query(
    f"{o.P}, before AS (SELECT * FROM pitches WHERE game_date <= {CUT}), known AS (SELECT * FROM pitches WHERE game_date < DATE '2024-01-28'), "
    f"fresh AS (SELECT * FROM known WHERE game_date >= {CUT} AND pitcher IN (SELECT pitcher FROM known WHERE game_date >= {CUT} AND description IS NOT NULL)) "
    f"SELECT * FROM ({o.enriched('before', True)}) a UNION SELECT * FROM ({o.form('(SELECT g.*, k.K_pct_so_far AS opponent_k_pct, p.K_park_factor AS park_factor_K FROM (' + o.games('fresh') + ') g LEFT JOIN (' + o.opponent('known', True) + ') k ON g.game_date = k.game_date AND g.opponent_team = k.Team LEFT JOIN (' + o.parks('known', True) + ') p ON g.home_team IS NOT DISTINCT FROM p.Team_abbr) j')}) b"
)
def incremental_compat(spark: SparkSession, sf: str) -> DataFrame:
    p = pitches(spark, sf)
    return features.incremental(p, features.enriched_games(p.where(f"game_date <= {CUT}")), "2024-01-28")


@query(
    f"{o.P}, s AS (SELECT *, CAST(day(game_date) % 3 AS INT) AS season FROM pitches), a AS (SELECT season, pitcher, game_date, count(*) AS n, count(*) FILTER (WHERE events = 'strikeout') AS k, min(seq) AS first FROM s "
    f"WHERE game_date <= {CUT} GROUP BY ALL), b AS (SELECT season, pitcher, game_date, count(*) AS n, count(*) FILTER (WHERE events = 'strikeout') AS k, max(seq) AS first FROM s WHERE game_date >= {CUT} AND season = 1 AND pitcher % 3 = 0 GROUP BY ALL) "
    "SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.pitcher = a.pitcher AND b.game_date = a.game_date)"
)
def part_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A table in parts, of which an increment replaces some."""
    p = pitches(spark, sf).withColumn("season", F.day("game_date") % 3)

    def counted(x: DataFrame, seq) -> DataFrame:
        return x.groupBy("season", "pitcher", "game_date").agg(F.count("*").alias("n"), F.count_if(F.col("events") == schemas.STRIKEOUT).alias("k"), seq("seq").alias("first"))

    t = versions.PartTable(spark, scratch(spark), "season int, pitcher long, game_date date, n long, k long, first long", buckets=8)
    t.upsert(counted(p.where(f"game_date <= {CUT}"), F.min), ["season", "pitcher", "game_date"])
    t.upsert(counted(p.where(f"game_date >= {CUT} AND season = 1 AND pitcher % 3 = 0"), F.max), ["season", "pitcher", "game_date"])
    return t.read()


# Sorts

@query(f"SELECT * FROM ({views.STARTERS}) s WHERE IP >= 15 AND GS > 0 ORDER BY WAR DESC NULLS LAST, IDfg LIMIT 999")
def top_starters(spark: SparkSession, sf: str) -> DataFrame:
    return features.top_starters(views.view(spark, sf, views.STARTERS))


def priced(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.price(views.view(spark, sf, views.PREDICTIONS), views.view(spark, sf, views.LINES))


ROUNDED = ("hybrid_std", "p_over", "p_under", "payout_over", "payout_under", "ev_over", "ev_under")


@query(f"SELECT pitcher_name, k_line, {', '.join(f'round({c}, 6) AS {c}' for c in ROUNDED)} FROM ({o.priced()}) x")
def price_lines(spark: SparkSession, sf: str) -> DataFrame:
    return priced(spark, sf).select("pitcher_name", "k_line", *[F.round(c, 6).alias(c) for c in ROUNDED])


@query(
    f"SELECT pitcher_name, k_line, round(1 - p, 12) AS p_over, round(p, 12) AS p_under FROM (SELECT pitcher_name, k_line, {o.exact_phi('z')} AS p FROM ("
    f"SELECT pitcher_name, k_line, (k_line - k_pred_mean) / sqrt(k_pred_std * k_pred_std + residual_std * residual_std) AS z FROM ({views.PREDICTIONS}) p JOIN ({views.LINES}) l ON p.pitcher_name = l.player) a) b"
)
def price_exact(spark: SparkSession, sf: str) -> DataFrame:
    x = pricing.price(views.view(spark, sf, views.PREDICTIONS), views.view(spark, sf, views.LINES), exact=True)
    return x.select("pitcher_name", "k_line", *[F.round(c, 12).alias(c) for c in ("p_over", "p_under")])


@query(f"SELECT pitcher_name, k_line, round(ev_over, 6) AS ev_over FROM ({o.priced()}) x ORDER BY round(ev_over, 6) DESC, pitcher_name LIMIT 10")
def topk_ev(spark: SparkSession, sf: str) -> DataFrame:
    x = priced(spark, sf).select("pitcher_name", "k_line", F.round("ev_over", 6).alias("ev_over"))
    return x.orderBy(F.desc("ev_over"), "pitcher_name").limit(10)


@query(
    f"SELECT pitcher_name, k_line, k_pred_mean AS model_k_pred, k_pred_mean - k_line AS edge, abs(k_pred_mean - k_line) AS abs_edge FROM ({views.PREDICTIONS}) p LEFT JOIN ({views.LINES}) l ON p.pitcher_name = l.player ORDER BY abs_edge DESC NULLS LAST, pitcher_name LIMIT 20"
)
def edge_ranking(spark: SparkSession, sf: str) -> DataFrame:
    predictions = views.view(spark, sf, views.PREDICTIONS).select("pitcher_name", F.col("k_pred_mean").alias("model_k_pred"))
    return pricing.edges(predictions, views.view(spark, sf, views.LINES))


@query(f"SELECT player, CAST({o.odds('over_american_price')} AS DOUBLE) AS payout_over, CAST({o.odds('under_american_price')} AS DOUBLE) AS payout_under FROM ({views.LINES}) l")
def odds_to_decimal(spark: SparkSession, sf: str) -> DataFrame:
    x = views.view(spark, sf, views.LINES)
    return x.select("player", decimal_odds("over_american_price").alias("payout_over"), decimal_odds("under_american_price").alias("payout_under"))


@query(f"SELECT pitcher_name, play, k_line, round(ev, 6) AS ev, round(payout, 6) AS payout FROM ({o.plays()}) x")
def unpivot_plays(spark: SparkSession, sf: str) -> DataFrame:
    x = pricing.plays(priced(spark, sf), "ev_over", "ev_under")
    return x.select("pitcher_name", "play", "k_line", F.round("ev", 6).alias("ev"), F.round("payout", 6).alias("payout"))


# Slips

def all_slips(spark: SparkSession, sf: str, sizes: tuple[int, int] = (2, 8)) -> DataFrame:
    return slips.slips(views.view(spark, sf, views.LEGS), sizes=sizes)


SLIP = ("p_win", "total_ev", "avg_ev")


def rounded(x: DataFrame) -> DataFrame:
    return x.select("mask", F.col("slip_size").cast("int").alias("slip_size"), F.col("payout").cast("int").alias("payout"), *[F.round(c, 9).alias(c) for c in SLIP])


SLIP_SQL = f"SELECT mask, CAST(slip_size AS INT) AS slip_size, CAST(payout AS INT) AS payout, {', '.join(f'round({c}, 9) AS {c}' for c in SLIP)}"


@query(f"{SLIP_SQL} FROM ({o.slips()}) s", "slips")
def slips_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(all_slips(spark, sf))


@query(f"{o.diverse()} {SLIP_SQL} FROM s WHERE mask IN (SELECT mask FROM kept)")
def slips_diverse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(slips.diverse(all_slips(spark, sf)))


def priced_legs(spark: SparkSession, sf: str) -> DataFrame:
    x = pricing.evs(pricing.simulate(pricing.spread(priced(spark, sf))), "mc_p_over", "mc_p_under", "mc_ev_over", "mc_ev_under")
    return slips.top_legs(pricing.plays(x))


@query()
def slips_of_plays(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(slips.slips(priced_legs(spark, sf)))


@query(
    f"SELECT s.mask, CAST(any_value(slip_size) AS INT) AS slip_size, CAST(count(*) AS INT) AS n_legs, arg_min(pitcher_name, pos) AS first_pitcher, arg_max(play, pos) AS last_play "
    f"FROM ({o.slips(2, 4)}) s JOIN ({views.LEGS}) l ON (s.mask & (1 << pos)) <> 0 GROUP BY s.mask"
)
def slips_json(spark: SparkSession, sf: str) -> DataFrame:
    """Slips with their legs inside, as JSON files and back."""
    path = scratch(spark)
    sinks.write_json(slips.with_legs(all_slips(spark, sf, (2, 4)).select("mask", "slip_size"), views.view(spark, sf, views.LEGS)), path)
    x = spark.read.schema("mask long, slip_size int, legs array<struct<pitcher: string, play: string>>").json(path)
    return x.select("mask", "slip_size", F.size("legs").alias("n_legs"), F.col("legs")[0]["pitcher"].alias("first_pitcher"), F.element_at("legs", -1)["play"].alias("last_play"))


@query(f"{SLIP_SQL}, CAST(1 AS INT) AS units FROM ({o.slips(2, 2)}) s ORDER BY ordinal LIMIT 3")
def bankroll_conservative(spark: SparkSession, sf: str) -> DataFrame:
    s = all_slips(spark, sf, (2, 2))
    return rounded(slips.conservative(slips.diverse(s, slips.as_made(s)))).withColumn("units", F.lit(1))


@query(f"{o.full_send()} SELECT mask, CAST(slip_size AS INT) AS slip_size, CAST(payout AS INT) AS payout, CAST(units AS INT) AS units, round(total_ev, 9) AS total_ev FROM u WHERE mask IN (SELECT mask FROM taken)")
def bankroll_units(spark: SparkSession, sf: str) -> DataFrame:
    x = slips.full_send(slips.diverse(all_slips(spark, sf)))
    return x.select("mask", F.col("slip_size").cast("int").alias("slip_size"), F.col("payout").cast("int").alias("payout"), "units", F.round("total_ev", 9).alias("total_ev"))


@query()
def bankroll_fullsend(spark: SparkSession, sf: str) -> DataFrame:
    x = slips.full_send(slips.diverse(all_slips(spark, sf)))
    return slips.with_legs(x.select("mask", "slip_size", "payout", "units"), views.view(spark, sf, views.LEGS))


# Model tables

def residuals(spark: SparkSession, sf: str) -> DataFrame:
    x = games.counted_games(pitches(spark, sf))
    pred = F.col("strikeouts") + ((F.col("pitcher") * 7 + F.day("game_date")) % 5 - 2) * 0.5
    return x.select(F.concat(F.lit("P"), F.col("pitcher").cast("string")).alias("pitcher_name"), "game_date", "strikeouts", pred.cast("double").alias("prediction"), (F.col("strikeouts") - pred).cast("double").alias("residual"))


PRED = "(strikeouts + ((pitcher * 7 + day(game_date)) % 5 - 2) * 0.5)"
RESIDUALS = f"{o.P}, r AS (SELECT concat('P', pitcher) AS pitcher_name, game_date, strikeouts, CAST({PRED} AS DOUBLE) AS prediction, CAST(strikeouts - {PRED} AS DOUBLE) AS residual FROM ({o.counted('pitches')}) c)"


@query(f"{RESIDUALS} SELECT pitcher_name, round(coalesce(stddev_samp(residual), (SELECT stddev_samp(residual) FROM r)), 6) AS residual_std FROM r GROUP BY pitcher_name")
def residual_std(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.residual_deviation(residuals(spark, sf)).select("pitcher_name", F.round("residual_std", 6).alias("residual_std"))


#: Five made-up models' predictions of each game.
PSEUDO = "strikeouts + 0.5 * ((m * 3 + pitcher) % 4) - 0.6 + 0.1 * m"


@query(
    f"{RESIDUALS}, s AS ({views.STARTERS}), l AS ({views.LINES}), e AS (SELECT pitcher, game_date, avg({PSEUDO}) AS k_pred_mean, greatest(stddev_pop({PSEUDO}), 0.75) AS k_pred_std "
    f"FROM ({o.counted('pitches')}) c, (VALUES (0), (1), (2), (3), (4)) v(m) GROUP BY pitcher, game_date), "
    "d AS (SELECT *, row_number() OVER (PARTITION BY pitcher ORDER BY game_date DESC) AS k FROM e), "
    "own AS (SELECT pitcher_name, stddev_samp(residual) AS residual_std FROM r GROUP BY pitcher_name), "
    "h AS (SELECT s.Name AS pitcher_name, k_line, k_pred_mean, sqrt(k_pred_std ** 2 + coalesce(residual_std, (SELECT stddev_samp(residual) FROM r)) ** 2) AS hybrid_std, "
    f"{o.odds('over_american_price')} AS payout_over, {o.odds('under_american_price')} AS payout_under "
    "FROM d JOIN s ON s.IDfg = d.pitcher JOIN l ON l.player = s.Name LEFT JOIN own ON own.pitcher_name = concat('P', d.pitcher) WHERE k = 1), "
    f"p AS (SELECT *, {o.phi('(k_line - k_pred_mean) / hybrid_std')} AS p_under FROM h) "
    "SELECT pitcher_name, k_line, round(k_pred_mean, 6) AS k_pred_mean, round(hybrid_std, 6) AS hybrid_std, round(1 - p_under, 6) AS p_over, round((1 - p_under) * payout_over - p_under, 6) AS ev_over, round(p_under * payout_under - (1 - p_under), 6) AS ev_under FROM p"
)
def price_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Each pitcher's last game, its models' mean and spread, residuals pooled by pitcher, prices."""
    x = games.counted_games(pitches(spark, sf)).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("pred", F.expr(PSEUDO).cast("double"))
    x = x.withColumn("row_id", F.struct("pitcher", "game_date"))
    last = games.latest(pricing.ensemble(x).select("row_id.*", "k_pred_mean", "k_pred_std"), "pitcher", "game_date")
    known = views.view(spark, sf, views.STARTERS).select(F.col("IDfg").alias("pitcher"), F.col("Name").alias("pitcher_name"))
    past = residuals(spark, sf).join(known.select(F.concat(F.lit("P"), F.col("pitcher").cast("string")).alias("_p"), F.col("pitcher_name").alias("_name")), F.col("pitcher_name") == F.col("_p"), "left")
    past = past.select(F.coalesce("_name", "pitcher_name").alias("pitcher_name"), "residual")
    out = pricing.price(last.join(known, "pitcher"), views.view(spark, sf, views.LINES), past)
    return out.select("pitcher_name", "k_line", *[F.round(c, 6).alias(c) for c in ("k_pred_mean", "hybrid_std", "p_over", "ev_over", "ev_under")])


@query("SELECT l_orderkey AS row_id, round(avg(l_quantity), 6) AS k_pred_mean, round(greatest(stddev_pop(l_quantity), 0.75), 6) AS k_pred_std FROM lineitem GROUP BY l_orderkey")
def ensemble_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_quantity").alias("pred"))
    return pricing.ensemble(x).select("row_id", F.round("k_pred_mean", 6).alias("k_pred_mean"), F.round("k_pred_std", 6).alias("k_pred_std"))


@query(f"{RESIDUALS} SELECT round(avg(abs(residual)), 6) AS mae, round(avg(residual * residual), 6) AS mse, round(sqrt(avg(residual * residual)), 6) AS rmse FROM r")
def error_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return models.errors(residuals(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("mae", "mse", "rmse")])


@query(
    "SELECT c.model, cv_mae, cv_std, test_mae FROM (SELECT l_linenumber AS model, round(avg(l_quantity), 6) AS cv_mae, round(stddev_pop(l_quantity), 6) AS cv_std FROM lineitem GROUP BY 1) c "
    "LEFT JOIN (SELECT l_linenumber AS model, round(avg(l_tax), 6) AS test_mae FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) t ON c.model = t.model"
)
def metrics_join(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "model")
    cv = x.groupBy("model").agg(F.round(F.avg("l_quantity"), 6).alias("cv_mae"), F.round(F.stddev_pop("l_quantity"), 6).alias("cv_std"))
    test = x.where("l_returnflag = 'R'").groupBy("model").agg(F.round(F.avg("l_tax"), 6).alias("test_mae"))
    return cv.join(test, "model", "left")


PROFILED = ["description", "events", "pitch_type", "home_team", "batter", "pitcher_days_since_prev_game"]


@query(f"{o.P} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM pitches" for c in PROFILED))
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return models.null_profile(pitches(spark, sf), PROFILED)


@query(
    "WITH s AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem) "
    "SELECT CAST(least(floor((l_extendedprice - low) / (high - low) * 25), 24) AS INT) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1"
)
def ev_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


@query(
    f"{o.P}, p AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS n FROM pitches) "
    "SELECT seq, CAST(CASE WHEN i < n - 3 * (n // 4) THEN 0 ELSE (i - (n - 3 * (n // 4))) // (n // 4) + 1 END AS INT) AS fold FROM p"
)
def time_series_folds(spark: SparkSession, sf: str) -> DataFrame:
    x = pitches(spark, sf).select("seq")
    n = x.count()
    return models.positions(x, ["seq"]).select("seq", models.time_folds(F.col("_p"), n).alias("fold"))


# Odds documents: one for each nation, of its suppliers; an appearance's id is its place there, so that
# documents share ids

SUPPLIERS = "SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier"
LINE = (
    "SELECT s_name AS player, CAST(3.5 + s_suppkey % 5 AS DOUBLE) AS k_line, CAST(-110 - s_suppkey % 40 AS INT) AS over_american_price, CAST(1.5 + 0.25 * (s_suppkey % 3) AS DOUBLE) AS over_decimal_price, CAST(1.25 AS DOUBLE) AS over_payout_multiplier, "
    "CAST(100 + s_suppkey % 40 AS INT) AS under_american_price, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(2.0 AS DOUBLE) END AS under_decimal_price, CAST(1.5 AS DOUBLE) AS under_payout_multiplier "
    f"FROM ({SUPPLIERS}) s WHERE place % 3 = 1"
)


def odds_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Written as files and read again. A third of the players are marked as starting, a third as not,
    a third have no badges."""
    by = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    key, place = F.col("s_suppkey"), F.row_number().over(by)

    def text(c) -> F.Column:
        return c.cast("string")

    def option(choice: str, american, decimal, multiplier: str):
        return F.struct(F.lit(choice).alias("choice"), F.col("s_name").alias("selection_header"), american.alias("american_price"), text(decimal).alias("decimal_price"), F.lit(multiplier).alias("payout_multiplier"))

    badge = F.array(F.struct(F.lit("Starting").alias("label"), F.when(F.col("place") % 3 == 1, "Yes").otherwise("No").alias("value")))
    x = table(spark, sf, "supplier").withColumn("place", place).select(
        "s_nationkey",
        F.struct(text(F.col("place")).alias("id"), F.when(F.col("place") % 3 != 0, badge).alias("badges")).alias("a"),
        F.struct(
            text(3.5 + key % 5).alias("stat_value"),
            F.struct(F.struct(text(F.col("place")).alias("appearance_id")).alias("appearance_stat")).alias("over_under"),
            F.array(option("higher", F.concat(F.lit("-"), text(110 + key % 40)), 1.5 + 0.25 * (key % 3), "1.25"), option("lower", F.concat(F.lit("+"), text(100 + key % 40)), F.when(key % 7 != 0, F.lit(2.0)), "1.5")).alias("options"),
        ).alias("l"),
    )
    documents = x.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list("a").alias("appearances"), F.collect_list("l").alias("over_under_lines"))).alias("value"))
    path = scratch(spark)
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_odds(spark, path)


@query(LINE)
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    return odds.strikeout_lines(odds_documents(spark, sf))


@query(
    "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders) "
    "SELECT o_orderkey, 'head' AS \"end\", CAST(k AS INT) AS at FROM o WHERE k <= 7 UNION ALL SELECT o_orderkey, 'tail', CAST(k - n + 7 AS INT) FROM o WHERE k > n - 7"
)
def head_and_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Of a table in many files, in the files' own order."""
    path = scratch(spark)
    table(spark, sf, "orders").repartitionByRange(12, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("maxRecordsPerFile", 1000).parquet(path)
    return readers.ends(spark.read.parquet(path), 7).select("o_orderkey", "end", "at")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "SELECT rpad(player, 20, ' ') || ' ' || lpad(CAST(k_line AS VARCHAR), 4, ' ') || '     ' || rpad(over_american_price || '/' || CAST(over_decimal_price AS VARCHAR) || 'x1.25', 20, ' ') || ' ' "
    f"|| under_american_price || '/' || coalesce(CAST(under_decimal_price AS VARCHAR), 'None') || 'x1.5' AS line FROM ({LINE}) l"
)
def format_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.format_lines(odds.strikeout_lines(odds_documents(spark, sf)))


# Random and fitted: rows only

@query()
def mc_probs(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.simulate(pricing.spread(priced(spark, sf))).select("pitcher_name", "k_line", "mc_p_over", "mc_p_under")


@query()
def simulated_ev(spark: SparkSession, sf: str) -> DataFrame:
    x = views.view(spark, sf, views.PREDICTIONS).withColumnRenamed("k_pred_std", "hybrid_std").join(views.view(spark, sf, views.LINES), F.col("pitcher_name") == F.col("player"))
    return pricing.simulated_ev(pricing.spread(x)).select("pitcher_name", "k_line", "expected_value", "over_pct", "under_pct")


def trained(spark: SparkSession, sf: str, make) -> DataFrame:
    x = features.enriched_games(pitches(spark, sf), compat=False)
    return models.pipeline(make(x)).fit(x).transform(x).select("pitcher", "game_date", "strikeouts", "prediction")


@query()
def ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    return trained(spark, sf, models.ridge)


@query()
def poisson_glm_fit(spark: SparkSession, sf: str) -> DataFrame:
    return trained(spark, sf, lambda _: models.poisson())


@query()
def gbt_fit(spark: SparkSession, sf: str) -> DataFrame:
    return trained(spark, sf, lambda _: models.boosted())


def named_games(spark: SparkSession, sf: str) -> DataFrame:
    ids = features.pitcher_ids(views.view(spark, sf, views.STARTERS), views.view(spark, sf, views.XREF))
    return sinks.staged(features.enriched_games(pitches(spark, sf), ids, compat=False), "games")


@query()
def poisson_boost_fit(spark: SparkSession, sf: str) -> DataFrame:
    x = sinks.staged(features.enriched_games(pitches(spark, sf), compat=False), "games")
    out = boosting.fit(x, ["pitcher", "game_date"]).transform(x)
    return out.select("pitcher", "game_date", "strikeouts", F.col("predictions")[0].alias("prediction"))


@query()
def forest_fit(spark: SparkSession, sf: str) -> DataFrame:
    return trained(spark, sf, lambda _: models.forest())


@query()
def tuned_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Linear models cross-validated and tested on later games, a grid of boosted models on the same
    folds, and its best point as one more row of the written table."""
    x = sinks.staged(features.enriched_games(pitches(spark, sf), compat=False), "games")
    train, test = x.where(f"game_date < {CUT}"), x.where(f"game_date >= {CUT}")
    order, path = ["game_date", "pitcher"], scratch(spark)
    folds = models.folded(train, order)
    sinks.merge_parquet(models.comparison(train, test, {"Linear": models.ols(), "Ridge": models.ridge(train)}, order, folds=folds), path, "model")
    grid = sinks.staged(boosting.search(folds, ["pitcher", "game_date"], "_fold", trees=(10, 20, 30)), "grid")
    best = grid.where("place = 1").first()
    scored = boosting.fit(train, ["pitcher", "game_date"], trees=best["trees"], depth=best["depth"], rate=best["rate"]).transform(test)
    e = models.errors(scored.withColumn("prediction", F.col("predictions")[0])).first()
    row = (f"Boosted {best['trees']} x {best['depth']} x {best['rate']}", best["CV_MAE"], best["CV_Std"], e["mae"], e["mse"], e["rmse"])
    sinks.merge_parquet(spark.createDataFrame([row], spark.read.parquet(path).schema), path, "model")
    points = grid.select(F.format_string("grid %d x %d x %s", "trees", "depth", F.col("rate").cast("string")).alias("model"), "CV_MAE", "CV_Std")
    return spark.read.parquet(path).unionByName(points, allowMissingColumns=True)


@query()
def ensemble_slips(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way: a hundred boosted models on resamples of the games before a date, their spread and
    each pitcher's residuals on later games, prices of today's lines, simulated plays, slips."""
    x = named_games(spark, sf)
    scored = sinks.staged(boosting.ensemble(x.where(f"game_date < {CUT}"), x.where(f"game_date >= {CUT}"), ["pitcher_id", "game_date"]), "scored")
    past = scored.select("pitcher_name", (F.col("strikeouts") - F.col("k_pred_mean")).alias("residual"))
    today = games.latest(scored, "pitcher_name", "game_date", "pitcher_id").select("pitcher_name", "k_pred_mean", "k_pred_std")
    x = pricing.simulate(pricing.spread(pricing.price(today, views.view(spark, sf, views.LINES), past)))
    legs = sinks.staged(slips.top_legs(pricing.plays(pricing.evs(x, "mc_p_over", "mc_p_under", "mc_ev_over", "mc_ev_under"))), "legs")
    return rounded(slips.diverse(slips.slips(legs)))
