"""SQL with the same rows as the queries, put together from named parts."""

from __future__ import annotations

from moundworks.functions.semantics import ERF, FRACTION, NEAR, SERIES
from moundworks.plans import views
from moundworks.schemas import NICKNAMES, SLIP_PAYOUTS, TEAM_ALIASES


def canonical(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TEAM_ALIASES.items()) + f" ELSE {c} END"


def ratio(a: str, b: str, default: str | None = None) -> str:
    out = f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"
    return out if default is None else f"coalesce({out}, {default})"


def cte(**parts: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in parts.items())


def counted(src: str) -> str:
    firsts = ", ".join(f"arg_min({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("home_team", "away_team", "inning_topbot", "pitcher_days_since_prev_game"))
    return f"""SELECT pitcher, game_date, count(description) AS pitch_count, count(*) FILTER (WHERE events = 'strikeout') AS strikeouts, max(inning) AS max_inning,
 count(DISTINCT pitch_type) AS num_pitch_types, {firsts},
 count(*) FILTER (WHERE description IN ('swinging_strike', 'swinging_strike_blocked')) AS whiffs,
 count(*) FILTER (WHERE description IN ('swinging_strike', 'swinging_strike_blocked', 'foul', 'foul_tip', 'hit_into_play')) AS swings,
 count(*) FILTER (WHERE description = 'called_strike') AS called
 FROM {src} WHERE pitcher IS NOT NULL AND game_date IS NOT NULL GROUP BY pitcher, game_date"""


def games(src: str) -> str:
    w = "OVER (PARTITION BY pitcher ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    home = "CASE WHEN inning_topbot = 'Top' THEN home_team ELSE away_team END"
    away = "CASE WHEN inning_topbot = 'Top' THEN away_team ELSE home_team END"
    return f"""SELECT pitcher, game_date, pitch_count, strikeouts, max_inning, num_pitch_types, {canonical("home_team")} AS home_team, {canonical("away_team")} AS away_team,
 CAST(trunc(coalesce(pitcher_days_since_prev_game, 5)) AS INT) AS rest_days, {canonical(f"({home})")} AS pitcher_team, {canonical(f"({away})")} AS opponent_team,
 {ratio("whiffs", "swings", "0")} AS whiff_rate, {ratio("whiffs + called", "pitch_count", "0")} AS csw_pct,
 {ratio(f"sum(whiffs) {w}", f"sum(pitch_count) {w}", "0")} AS whiff_rate_expanding, {ratio(f"sum(whiffs + called) {w}", f"sum(pitch_count) {w}", "0")} AS csw_pct_expanding
 FROM ({counted(src)}) c"""


def days(src: str) -> str:
    team = canonical("(CASE WHEN inning_topbot = 'Bot' THEN home_team ELSE away_team END)")
    return f"""SELECT game_date, Team, count(*) FILTER (WHERE events = 'strikeout') AS so, count(events) AS pa
 FROM (SELECT game_date, {team} AS Team, events FROM {src}) x WHERE game_date IS NOT NULL AND Team IS NOT NULL GROUP BY game_date, Team"""


def opponent(src: str, compat: bool) -> str:
    if compat:  # the running sum of a team, moved down one row of the whole sorted table
        run = "OVER (PARTITION BY Team ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return f"""SELECT game_date, Team, {ratio("coalesce(lag(a) OVER (ORDER BY Team, game_date), 0)", "coalesce(lag(b) OVER (ORDER BY Team, game_date), 0)", "0.055")} AS K_pct_so_far
 FROM (SELECT *, sum(so) {run} AS a, sum(pa) {run} AS b FROM ({days(src)}) d) e"""
    run = "OVER (PARTITION BY Team ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"SELECT game_date, Team, {ratio(f'coalesce(sum(so) {run}, 0)', f'coalesce(sum(pa) {run}, 0)', '0.055')} AS K_pct_so_far FROM ({days(src)}) d"


def parks(src: str, compat: bool) -> str:
    team = "home_team" if compat else canonical("home_team")
    league = f"(SELECT CAST(count(*) FILTER (WHERE events = 'strikeout') AS DOUBLE) / nullif(count(batter), 0) FROM {src} WHERE pitch_type IS NOT NULL)"
    return f"""SELECT {canonical("t")} AS Team_abbr, (CAST(k AS DOUBLE) / nullif(n, 0)) / {league} AS K_park_factor
 FROM (SELECT {team} AS t, count(*) FILTER (WHERE events = 'strikeout') AS k, count(batter) AS n FROM {src} WHERE pitch_type IS NOT NULL GROUP BY 1) p WHERE t IS NOT NULL"""


def form(src: str) -> str:
    def roll(f: str, c: str, n: int) -> str:
        w = f"OVER (PARTITION BY pitcher ORDER BY game_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        return f"CASE WHEN count({c}) {w} = {n} THEN {f}({c}) {w} END"

    return f"""SELECT *, coalesce({roll("avg", "strikeouts", 3)}, 5.0) AS rolling_K_avg_3, coalesce({roll("avg", "strikeouts", 5)}, 5.0) AS rolling_K_avg_5,
 coalesce({roll("avg", "pitch_count", 5)}, 85.0) AS rolling_pitch_count_5, {ratio(roll("sum", "strikeouts", 3), roll("sum", "pitch_count", 5), "0.055")} AS rolling_K_rate FROM {src}"""


def enriched(src: str, compat: bool) -> str:
    joined = f"""SELECT g.*, o.K_pct_so_far AS opponent_k_pct, p.K_park_factor AS park_factor_K FROM ({games(src)}) g
 LEFT JOIN ({opponent(src, compat)}) o ON g.game_date = o.game_date AND g.opponent_team = o.Team
 LEFT JOIN ({parks(src, compat)}) p ON g.home_team IS NOT DISTINCT FROM p.Team_abbr"""
    return form(f"({joined}) j")


def phi(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + {ERF[0]} * {x}))"
    poly = "0.0"
    for a in reversed(ERF[1:]):
        poly = f"(({poly} + {a}) * {t})"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - 0.5 * {poly} * exp(-{x} * {x}) ELSE 0.5 * {poly} * exp(-{x} * {x}) END)"


def exact_phi(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    series, fraction = "1.0::DOUBLE", x
    for k in range(SERIES, 0, -1):
        series = f"(1.0::DOUBLE + {series} * {x} * {x} * (2.0::DOUBLE / {2 * k + 1}))"
    for k in range(FRACTION, 0, -1):
        fraction = f"({x} + ({k}::DOUBLE / 2) / {fraction})"
    near, far = f"(0.5 - {x} * exp(-{x} * {x}) * {series} / sqrt(pi()))", f"(exp(-{x} * {x}) / {fraction} / (2 * sqrt(pi())))"
    half = f"(CASE WHEN {x} < {NEAR} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} >= 0 THEN 1.0::DOUBLE - {half} ELSE {half} END)"


def odds(c: str) -> str:
    return f"(CASE WHEN {c} > 0 THEN {c} / 100.0 + 1 WHEN {c} < 0 THEN 100.0 / abs({c}) + 1 END)"


def priced() -> str:
    z = "((k_line - k_pred_mean) / hybrid_std)"
    return f"""SELECT *, p_over * payout_over - (1 - p_over) AS ev_over, p_under * payout_under - (1 - p_under) AS ev_under FROM (
 SELECT *, 1.0 - p_under AS p_over FROM (SELECT *, {phi(z)} AS p_under FROM (
 SELECT p.*, l.*, sqrt(k_pred_std * k_pred_std + residual_std * residual_std) AS hybrid_std, CAST({odds("over_american_price")} AS DOUBLE) AS payout_over, CAST({odds("under_american_price")} AS DOUBLE) AS payout_under
 FROM ({views.PREDICTIONS}) p JOIN ({views.LINES}) l ON p.pitcher_name = l.player) a) b) c"""


def plays() -> str:
    return f"""SELECT * FROM (SELECT pitcher_name, 'over' AS play, k_line, ev_over AS ev, payout_over AS payout FROM ({priced()}) a
 UNION ALL SELECT pitcher_name, 'under', k_line, ev_under, payout_under FROM ({priced()}) b) u WHERE ev > 0"""


def slips(lo: int = 2, hi: int = 8, n: int = 12) -> str:
    place = " + ".join(f"((mask >> {i}) & 1) * {1 << (n - 1 - i)}" for i in range(n))
    pay = "CASE slip_size " + " ".join(f"WHEN {k} THEN {v}" for k, v in SLIP_PAYOUTS.items()) + " ELSE 0 END"
    return f"""SELECT mask, slip_size, p_win, payout, p_win * payout - 1 AS total_ev, (p_win * payout - 1) / slip_size AS avg_ev, ordinal FROM (
 SELECT *, {pay} AS payout, -({place}) AS ordinal FROM (
 SELECT mask, count(*) AS slip_size, count(DISTINCT pitcher_name) AS names, product(p) AS p_win
 FROM range({1 << n}) r(mask) JOIN ({views.LEGS}) l ON (mask & (1 << pos)) <> 0 WHERE bit_count(mask) BETWEEN {lo} AND {hi} GROUP BY mask) s
 WHERE names = slip_size AND slip_size = bit_count(mask)) t WHERE payout <> 0 AND p_win <> 0"""


def diverse(most_shared: int = 3) -> str:
    """CTEs: ``s`` with places by value, ``kept`` with the masks that a walk through them keeps."""
    return f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (ORDER BY round(total_ev, 12) DESC, slip_size, ordinal) AS i FROM ({slips()}) x),
 walk(i, masks) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
 SELECT s.i, CASE WHEN len(list_filter(masks, lambda k: bit_count(k & s.mask) > {most_shared})) > 0 THEN masks ELSE list_append(masks, s.mask) END FROM walk JOIN s ON s.i = walk.i + 1),
 kept AS (SELECT unnest(masks) AS mask FROM (SELECT masks FROM walk ORDER BY i DESC LIMIT 1) m)"""


def full_send(bankroll: float = 143, share: float = 0.05) -> str:
    """More CTEs: kept slips by value with their units, and those that the day's share still has room for."""
    cap = bankroll * share
    return f"""{diverse()}, u AS (SELECT s.*, row_number() OVER (ORDER BY s.i) AS j, CASE WHEN total_ev > 1.5 AND p_win > 0.5 THEN {min(int(cap), 5)} WHEN total_ev > 1.0 AND p_win > 0.4 THEN 2 ELSE 1 END AS units
 FROM s JOIN kept ON kept.mask = s.mask),
 spend(j, spent, masks) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
 SELECT u.j, CASE WHEN spent < {cap} AND spent + units <= {cap} THEN spent + units ELSE spent END, CASE WHEN spent < {cap} AND spent + units <= {cap} THEN list_append(masks, u.mask) ELSE masks END
 FROM spend JOIN u ON u.j = spend.j + 1), taken AS (SELECT unnest(masks) AS mask FROM (SELECT masks FROM spend ORDER BY j DESC LIMIT 1) m)"""


def nickname(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NICKNAMES.items()) + " END"


P = cte(pitches=views.PITCHES) + " "
