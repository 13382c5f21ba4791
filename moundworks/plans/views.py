"""Stand-in tables: the driver's tables seen as pitches, starters, lines and legs. Each body is SQL
that both engines take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PITCHES = """
SELECT user_id AS pitcher, CAST(ts AS DATE) AS game_date, event_id AS seq,
 CASE event_type WHEN 'view' THEN 'swinging_strike' WHEN 'click' THEN 'foul'
   WHEN 'signup' THEN 'called_strike' WHEN 'purchase' THEN 'hit_into_play' END AS description,
 CASE event_id % 5 WHEN 0 THEN 'strikeout' WHEN 1 THEN 'field_out' WHEN 2 THEN 'walk' END AS events,
 CAST(1 + event_id % 9 AS INT) AS inning,
 CASE event_id % 7 WHEN 0 THEN 'FF' WHEN 1 THEN 'SL' WHEN 2 THEN 'CH' WHEN 3 THEN 'CU' WHEN 4 THEN 'FC' END AS pitch_type,
 CASE WHEN event_id % 13 <> 0 THEN CASE (user_id + day(ts)) % 6 WHEN 0 THEN 'AZ' WHEN 1 THEN 'SFG' WHEN 2 THEN 'OAK'
   WHEN 3 THEN 'NYY' WHEN 4 THEN 'BOS' ELSE 'CWS' END END AS home_team,
 CASE (user_id + day(ts) + 1 + user_id % 4) % 6 WHEN 0 THEN 'AZ' WHEN 1 THEN 'SFG' WHEN 2 THEN 'OAK'
   WHEN 3 THEN 'NYY' WHEN 4 THEN 'BOS' ELSE 'CWS' END AS away_team,
 CASE WHEN (user_id + day(ts)) % 2 = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot,
 CASE WHEN user_id % 4 <> 0 THEN CAST(4 + user_id % 3 AS DOUBLE) + 0.9 END AS pitcher_days_since_prev_game,
 CASE WHEN event_id % 17 <> 0 THEN event_id % 50 END AS batter
FROM events"""

STARTERS = """
SELECT s_suppkey AS IDfg, s_name AS Name, CAST(s_suppkey % 40 AS DOUBLE) AS IP, CAST(s_suppkey % 5 AS INT) AS GS,
 CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal / 1000.0 END AS WAR FROM supplier"""

# a tenth are known under a key that nobody has
XREF = "SELECT CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey ELSE -1 - s_suppkey END AS key_fangraphs, s_suppkey AS key_mlbam FROM supplier"

PARKS = """
SELECT Team_abbr, CAST(K_park_factor AS DOUBLE) AS K_park_factor
FROM (VALUES ('ARI', 1.05), ('SF', 0.97), ('NYY', 1.01), ('CHW', 0.94)) AS t(Team_abbr, K_park_factor)"""

NICKNAMED = """
SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Giants' WHEN 1 THEN 'Cleveland' WHEN 2 THEN 'Guardians' ELSE 'Nobody' END AS Team,
 CAST(90 + s_suppkey % 20 AS DOUBLE) AS SO FROM supplier"""

# a quarter are of players without a prediction
LINES = """
SELECT CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE CONCAT('Nobody ', s_name) END AS player, CAST(3.5 + s_suppkey % 5 AS DOUBLE) AS k_line,
 CASE WHEN s_suppkey % 3 = 0 THEN 100 + s_suppkey ELSE -100 - s_suppkey END AS over_american_price,
 CASE WHEN s_suppkey % 3 = 1 THEN 100 + s_suppkey ELSE -100 - s_suppkey END AS under_american_price
FROM supplier"""

PREDICTIONS = """
SELECT s_name AS pitcher_name, CAST(3.0 + 0.8 * (s_suppkey % 7) AS DOUBLE) AS k_pred_mean, CAST(0.75 + 0.25 * (s_suppkey % 5) AS DOUBLE) AS k_pred_std,
 CAST(1.0 + 0.25 * (s_suppkey % 3) AS DOUBLE) AS residual_std FROM supplier"""

# the twelve of highest balance
LEGS = """
SELECT pos, CONCAT('P', CAST(pos % 8 AS STRING)) AS pitcher_name, CASE WHEN pos < 8 THEN 'over' ELSE 'under' END AS play, CAST(0.45 + 0.03 * (pos % 7) AS DOUBLE) AS p
FROM (SELECT CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS INT) AS pos FROM supplier) best WHERE pos < 12"""


def view(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """The view over the tables in ``sf_dir``."""
    names = [t for t in ("events", "supplier") if f"FROM {t}" in body]
    for t in names:
        body = body.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(body, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})
