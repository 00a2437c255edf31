"""Queries of team profiles and the match matrix: all team features, from players to matches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions import text
from matchgrid.operators import dataset, profile
from matchgrid.plans.base import MATCHES_SQL, POSITION, matchup, r6, read
from matchgrid.plans.base import ratings as team_ratings

_W = profile.WEIGHTED


def _bold(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor("c_acctbal").cast("bigint").alias("b"))
    return c.join(read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("team")), F.col("c_nationkey") == F.col("n_nationkey"))


def _squad(spark, sf):
    """Customers as players with every event field, some of them missing."""
    b = F.col("b")
    fields = [F.when(b % (5 + i) != 0, (F.floor(F.abs(b) / (i + 1)) % (7 + 2 * i)).cast("double")).alias(f) for i, f in enumerate(_W)]
    return _bold(spark, sf).select(
        F.col("c_custkey").alias("pid"), "team", text.primary_position(F.expr(POSITION)).alias("position"), (F.abs(b) % 200).alias("minutes"), (b % 2 == 0).cast("int").alias("is_starter"),
        F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.concat(F.lit("club"), (F.col("c_custkey") % 40).cast("string"))).alias("current_club"), *fields,
    )


_FIELDS = ", ".join(f"CASE WHEN b % {5 + i} <> 0 THEN CAST((abs(b) // {i + 1}) % {7 + 2 * i} AS DOUBLE) END AS {f}" for i, f in enumerate(_W))
SQUAD_SQL = f"""sp AS (
  SELECT c_custkey AS pid, n_name AS team, upper(trim(split_part({POSITION}, ',', 1))) AS position, abs(b) % 200 AS minutes, CAST(b % 2 = 0 AS INTEGER) AS is_starter,
    CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'club' || (c_custkey % 40) END AS current_club, {_FIELDS}
  FROM (SELECT *, CAST(floor(c_acctbal) AS BIGINT) AS b FROM customer) JOIN nation ON c_nationkey = n_nationkey)"""


def _z(f):
    return f"coalesce({f}, 0)"


def _of(p, *fields):
    here = f"FILTER (position = '{p}')"
    return f"CASE WHEN coalesce(sum(minutes) {here}, 0) > 0 THEN coalesce(sum({' + '.join(map(_z, fields))}) {here}, 0) * 90 / sum(minutes) {here} ELSE 0 END"


_MIN = "CASE WHEN sum(minutes) = 0 THEN 1 ELSE sum(minutes) END"


def _features_sql(players):
    """CTEs sq to sf: squad features of a table of players."""
    return f"""sq AS (SELECT * FROM (SELECT *, max(CAST(minutes >= 90 AS INTEGER)) OVER (PARTITION BY team) AS a FROM {players}) WHERE minutes >= 90 OR a = 0),
mn AS (SELECT team, {', '.join(f'sum({_z(f)} * minutes) / {_MIN} AS nt_w_{f}' for f in _W)},
  CASE WHEN sum({_z('goals')}) > 0 THEN max({_z('goals')}) / sum({_z('goals')}) ELSE 0 END AS star_top_scorer_share, max({_z('dribble_success')}) AS star_max_dribbles,
  count(*) FILTER (is_starter <> 0) AS squad_starters, count(*) AS squad_depth, {_of('FW', 'xg')} AS pos_fw_xg_per90, {_of('FW', 'dribble_success')} AS pos_fw_dribbles_per90,
  {_of('FW', 'xg')} + 0.15 * {_of('FW', 'dribble_success')} AS pos_fw_attack_score, {_of('DF', 'tackles_won', 'interceptions', 'blocks')} AS pos_df_defense_per90,
  {_of('MF', 'key_passes', 'progressive_passes')} AS pos_mf_creative_per90, {_of('MF', 'carries_count')} AS pos_mf_carries_per90,
  coalesce(sum({_z('goalkeeper_saves')}) FILTER (position = 'GK'), 0) AS pos_gk_saves, sum({_z('pressures')}) * 90 / {_MIN} AS team_pressures_per90, sum({_z('carries_count')}) * 90 / {_MIN} AS team_carries_per90
  FROM sq GROUP BY team),
t3 AS (SELECT team, sum(x) AS star_top3_xg FROM (SELECT team, {_z('xg')} AS x, row_number() OVER (PARTITION BY team ORDER BY {_z('xg')} DESC) AS r FROM sq) WHERE r <= 3 GROUP BY team),
cu AS (SELECT team, count(*) OVER (PARTITION BY team) AS n, sum({_z('xg')}) OVER (PARTITION BY team) AS s, sum({_z('xg')}) OVER (PARTITION BY team ORDER BY {_z('xg')}, pid ROWS UNBOUNDED PRECEDING) AS cum FROM sq),
gi AS (SELECT team, CASE WHEN any_value(s) > 0 THEN (any_value(n) + 1 - 2 * sum(cum) / any_value(s)) / any_value(n) ELSE 0 END AS star_xg_gini FROM cu GROUP BY team),
cl AS (SELECT team, nullif(trim(current_club), '') AS c, count(*) AS k FROM sq GROUP BY 1, 2),
ch AS (SELECT team, sum(k) AS n, max(k) FILTER (c IS NOT NULL) AS top, sum(k * (k - 1) / 2) FILTER (c IS NOT NULL) AS pairs, count(c) AS clubs FROM cl GROUP BY team),
sf AS (SELECT *, CASE WHEN n >= 2 AND clubs > 0 THEN top / n END AS club_max_cluster_ratio, CASE WHEN n >= 2 AND clubs > 0 THEN pairs / (n * (n - 1) / 2) END AS club_pair_density,
  CASE WHEN n >= 2 AND clubs > 0 THEN clubs END AS club_distinct_clubs FROM mn JOIN t3 USING (team) JOIN gi USING (team) JOIN ch USING (team))"""


_OF_SQUAD = [f for g in ("national", "stars and depth", "positions", "style", "clubs") for f in profile.FEATURES[g] if f != "nt_competitions_count"]


def q64_squad_features(spark, sf):
    out = profile.squad_features(_squad(spark, sf))
    return out.select("team", *(F.round(F.col(f).cast("double"), 5).alias(f) for f in _OF_SQUAD))


Q64 = f"WITH {SQUAD_SQL}, {_features_sql('sp')} SELECT team, {', '.join(f'round(CAST({f} AS DOUBLE), 5) AS {f}' for f in _OF_SQUAD)} FROM sf"


def _league(spark, sf):
    """Customers' league seasons in sum, as appearances of 90 minutes."""
    b = F.col("b")
    return _bold(spark, sf).select(
        F.col("c_custkey").alias("pid"), "team", text.primary_position(F.expr(POSITION)).alias("position"), F.lit(90).alias("expected_minutes"), (F.abs(b) % 2500).alias("season_minutes"),
        F.lit(1).alias("is_starter"), F.lit(None).cast("string").alias("current_club"), (F.abs(b) % 13).alias("goals"), F.when(b % 3 != 0, F.abs(b) % 7).alias("assists"),
        F.when(b % 4 != 0, (F.abs(b) % 97) / 10).alias("xg"), F.when(b % 5 != 0, F.abs(b) % 31).alias("interceptions"), F.when(b % 6 != 0, F.abs(b) % 29).alias("tackles_won"),
    )


def q43_proxy_ladder(spark, sf):
    out = profile.proxy_events(_league(spark, sf))
    return out.select("pid", F.round("minutes", 5).alias("minutes"), F.round("assists", 5).alias("assists"), *(F.round(f, 5).alias(f) for f in _W))


def _case(values):
    return "CASE p " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in values.items()) + " END"


def _proxy_sql():
    base = {f: f"({_case({k: v[f] for k, v in profile.BASELINES.items()})}) * 1.0" for f in profile.BASELINES["GK"]}
    rows = {f: f"{base[f]} * qa" for f in ("through_balls", "crosses", "progressive_passes", "dribble_attempts", "dribble_success", "carries_count", "progressive_carry_distance")}
    shots = f"CASE WHEN xg > 0 THEN xg / 0.1 ELSE {base['shots']} * qa END"
    rows |= {
        "shots": shots, "shots_on_target": f"({shots}) * 0.42", "key_passes": f"CASE WHEN assists > 0 THEN greatest(assists * 5.5, {base['key_passes']} * qa) ELSE {base['key_passes']} * qa END",
        "blocks": f"CASE WHEN interceptions > 0 THEN interceptions * 0.6 ELSE {base['blocks']} * qd END", "clearances": f"CASE WHEN interceptions > 0 AND p = 'DF' THEN interceptions * 2.0 ELSE {base['clearances']} * qd END",
        "pressures": f"CASE WHEN tackles_won > 0 THEN tackles_won * 4.0 ELSE {base['pressures']} * qd END", "counter_pressures": f"{base['counter_pressures']} * qd",
        "tackle_attempts": f"CASE WHEN tackles_won > 0 THEN tackles_won / 0.6 ELSE {base['tackle_attempts']} * qd END", "goalkeeper_saves": f"CASE WHEN p = 'GK' THEN {base['goalkeeper_saves']} ELSE 0 END",
    }
    attack, defence = _case(profile.ATTACK_REF), _case(profile.DEFENCE_REF)
    return f"""lr AS (
  SELECT c_custkey AS pid, n_name AS team, upper(trim(split_part({POSITION}, ',', 1))) AS position, 90.0 / greatest(abs(b) % 2500, 90) AS sc, abs(b) % 13 AS g, CASE WHEN b % 3 <> 0 THEN abs(b) % 7 END AS a,
    CASE WHEN b % 4 <> 0 THEN (abs(b) % 97) / 10 END AS x, CASE WHEN b % 5 <> 0 THEN abs(b) % 31 END AS i, CASE WHEN b % 6 <> 0 THEN abs(b) % 29 END AS t
  FROM (SELECT *, CAST(floor(c_acctbal) AS BIGINT) AS b FROM customer) JOIN nation ON c_nationkey = n_nationkey),
ls AS (SELECT pid, team, position, CASE WHEN position IN ('GK', 'DF', 'MF', 'FW') THEN position ELSE 'MF' END AS p, CAST(g * sc AS DOUBLE) AS goals, CAST(coalesce(a, 0) * sc AS DOUBLE) AS assists,
  CAST(CASE WHEN coalesce(x, 0) = 0 THEN g * 0.65 ELSE x END * sc AS DOUBLE) AS xg, CAST(coalesce(i, 0) * sc AS DOUBLE) AS interceptions, CAST(coalesce(t, 0) * sc AS DOUBLE) AS tackles_won FROM lr),
lq AS (SELECT *, CASE WHEN xg > 0 AND p <> 'GK' THEN greatest(least(xg / ({attack}), 2.0), 0.25) ELSE 0.5 END AS qa,
  CASE WHEN tackles_won + interceptions > 0 THEN greatest(least((tackles_won + interceptions) / ({defence}), 2.0), 0.25) ELSE 0.5 END AS qd FROM ls),
px AS (SELECT pid, team, position, CAST(90 AS DOUBLE) AS minutes, 1 AS is_starter, team AS current_club, assists, {', '.join(f'CAST({rows[f]} AS DOUBLE) AS {f}' if f in rows else f for f in _W)} FROM lq)"""


PROXY_SQL = _proxy_sql()
Q43 = f"WITH {PROXY_SQL} SELECT pid, round(minutes, 5) AS minutes, round(assists, 5) AS assists, {', '.join(f'round({f}, 5) AS {f}' for f in _W)} FROM px"

_SEASONS = ((1999, 0.3), (2000, 0.5), (2001, 1.0))


def _rated(spark, sf):
    """Some nations' ratings with ranks and confederations; the others are unknown."""
    r = team_ratings(spark, sf).where("team < 'NATION_2'")
    rank = F.row_number().over(W.orderBy(F.desc("elo"), "team"))  # teams are a table of fixed size
    named = F.array(*map(F.lit, (*profile.CONFEDERATIONS, "OFC")))
    return r.select("team", "elo", rank.alias("rank")).withColumn("confederation", F.get(named, F.col("rank") % 6))


def _stats(spark, sf, players):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), F.year("o_orderdate").alias("season"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("goals"))
    o = o.groupBy("pid", "season").agg(F.sum("goals").alias("goals"))
    return o.join(players.select("pid", "team"), "pid").select("team", "pid", "season", "goals", (F.col("goals") % 11).alias("assists"), (F.col("goals") % 1000).alias("minutes_played"))


def _profiles(spark, sf):
    players = _squad(spark, sf)
    weights = spark.createDataFrame(list(_SEASONS), "season int, weight double")
    teams = read(spark, sf, "nation").select(F.col("n_name").alias("team"))
    return profile.team_profile(teams, _rated(spark, sf), players, _stats(spark, sf, players), weights, F.lit(2001), competitions=2)


_CONF = "CASE rank % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate((*profile.CONFEDERATIONS, "OFC"))) + " END"
PROFILE_SQL = f"""{MATCHES_SQL}, {SQUAD_SQL}, {_features_sql('sp')},
ra AS (SELECT *, {_CONF} AS conf FROM (SELECT team, elo, row_number() OVER (ORDER BY elo DESC, team) AS rank FROM rating WHERE team < 'NATION_2')),
os AS (SELECT o_custkey AS pid, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS BIGINT) AS goals FROM orders GROUP BY 1, 2),
st AS (SELECT team, pid, season, os.goals, os.goals % 11 AS assists, os.goals % 1000 AS mins FROM os JOIN sp USING (pid)),
ss AS (SELECT team, season, sum(st.goals) AS goals, sum(assists) AS assists, sum(mins) AS mins, count(*) AS players FROM st GROUP BY 1, 2),
wt AS (SELECT * FROM (VALUES {', '.join(f'({s}, {w}::DOUBLE)' for s, w in _SEASONS)}) v(season, w)),
iw AS (SELECT *, goals / players AS rate, row_number() OVER (PARTITION BY team ORDER BY season) - 1 AS i FROM ss JOIN wt USING (season)),
la AS (SELECT team, sum(goals * w) / sum(w) AS lg_goals_weighted, sum(assists * w) / sum(w) AS lg_assists_weighted, sum(mins * w) / sum(w) AS lg_minutes_weighted, sum((goals + assists) * w) / sum(w) AS lg_goal_involvement_weighted,
  CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(regr_slope(rate, i), 0) END AS lg_goal_trend, CASE WHEN count(*) < 2 THEN NULL WHEN avg(rate) <= 0 THEN 0 ELSE stddev_pop(rate) / avg(rate) END AS lg_consistency FROM iw GROUP BY team),
lb AS (SELECT team, sum(players) FILTER (season = 2001) AS lg_player_count, count(*) AS lg_seasons_available, CASE WHEN sum(mins) FILTER (season = 2001) > 0 THEN sum(goals) FILTER (season = 2001) / sum(mins) FILTER (season = 2001) * 90 END AS lg_goals_per90 FROM ss GROUP BY team),
lm AS (SELECT team, max(goals) AS lg_goals_max FROM st GROUP BY team),
co AS (SELECT sp.team, count(*) FILTER (position = 'FW') AS f, count(*) FILTER (position = 'MF') AS m, count(*) FILTER (position = 'DF') AS d, coalesce(sum(st.goals) FILTER (position = 'FW'), 0) AS fg, coalesce(sum(st.goals) FILTER (position = 'MF'), 0) AS mg, count(st.pid) AS has
  FROM sp LEFT JOIN st ON sp.pid = st.pid AND st.season = 2001 GROUP BY sp.team),
pr AS (SELECT n_name AS team, coalesce(elo, 1500) AS elo_rating, coalesce(rank, (SELECT count(*) FROM ra)) AS elo_rank,
  {', '.join(f"CAST(coalesce(conf = '{c}', {'true' if c == 'UEFA' else 'false'} AND elo IS NULL) AS INTEGER) AS conf_{c}" for c in profile.CONFEDERATIONS)},
  la.* EXCLUDE (team), lb.* EXCLUDE (team), lg_goals_max, CASE WHEN has > 0 THEN f / nullif(f + m + d, 0) END AS pos_fw_ratio, CASE WHEN has > 0 THEN m / nullif(f + m + d, 0) END AS pos_mf_ratio,
  CASE WHEN has > 0 THEN d / nullif(f + m + d, 0) END AS pos_df_ratio, CASE WHEN has > 0 THEN fg END AS pos_fw_goals, CASE WHEN has > 0 THEN mg END AS pos_mf_goals, 2 AS nt_competitions_count, sf.* EXCLUDE (team, n, top, pairs, clubs)
  FROM nation LEFT JOIN ra ON ra.team = n_name LEFT JOIN la ON la.team = n_name LEFT JOIN lb ON lb.team = n_name LEFT JOIN lm ON lm.team = n_name LEFT JOIN co ON co.team = n_name LEFT JOIN sf ON sf.team = n_name)"""


def q65_team_profile(spark, sf):
    out = _profiles(spark, sf)
    return out.select("team", *(F.round(f, 5).alias(f) for f in profile.TEAM_FEATURES))


Q65 = f"WITH {PROFILE_SQL} SELECT team, {', '.join(f'round(CAST({f} AS DOUBLE), 5) AS {f}' for f in profile.TEAM_FEATURES)} FROM pr"


def q65b_club_profile(spark, sf):
    """Squads of league rows only, all of one club: no national numbers, full familiarity."""
    players = profile.proxy_events(_league(spark, sf))
    out = profile.team_profile(players, _rated(spark, sf), players, same_club=True)
    shown = ["elo_rating", "nt_competitions_count", *_OF_SQUAD]
    return out.select("team", *(F.round(f, 5).alias(f) for f in shown))


_CLUB = {"club_max_cluster_ratio": "1.0", "club_pair_density": "CASE WHEN squad_depth >= 2 THEN 1.0 ELSE 0.0 END", "club_distinct_clubs": "1"}
Q65B = f"""WITH {MATCHES_SQL}, {PROXY_SQL}, {_features_sql('px')}
SELECT team, round(coalesce(CASE WHEN team < 'NATION_2' THEN elo END, 1500), 5) AS elo_rating, CAST(0 AS DOUBLE) AS nt_competitions_count,
  {', '.join(f"round(CAST({_CLUB.get(f, f)} AS DOUBLE), 5) AS {f}" for f in _OF_SQUAD)} FROM sf LEFT JOIN rating USING (team)"""


def q66_match_matrix(spark, sf):
    """Every pairing that was played, with all 188 columns."""
    m = matchup(spark, sf).select(F.col("home").alias("home_team"), F.col("away").alias("away_team")).distinct()
    out = dataset.feature_table(m, _profiles(spark, sf))
    return out.select("home_team", "away_team", *(F.round(c, 4).alias(c) for c in dataset.expected_columns()))


_SIDE = {"home": "CAST(h.{0} AS DOUBLE)", "away": "CAST(a.{0} AS DOUBLE)", "diff": "CAST(h.{0} AS DOUBLE) - CAST(a.{0} AS DOUBLE)"}
_SIDES = [f"round({e.format(f)}, 4) AS {p}_{f}" for p, e in _SIDE.items() for f in profile.TEAM_FEATURES]
_DUELS = {
    "matchup_home_fw_vs_away_df": ("h.pos_fw_attack_score", "a.pos_df_defense_per90"), "matchup_away_fw_vs_home_df": ("a.pos_fw_attack_score", "h.pos_df_defense_per90"),
    "matchup_mf_creative_diff": ("h.pos_mf_creative_per90", "a.pos_mf_creative_per90"), "matchup_press_vs_carry": ("h.team_pressures_per90", "a.team_carries_per90"),
    "matchup_carry_vs_press": ("h.team_carries_per90", "a.team_pressures_per90"),
}
Q66 = f"""WITH {PROFILE_SQL}, m AS (SELECT DISTINCT home AS home_team, away AS away_team FROM matchup)
SELECT home_team, away_team, {', '.join(_SIDES)}, {', '.join(f'round(CAST(coalesce({x}, 0) - coalesce({y}, 0) AS DOUBLE), 4) AS {n}' for n, (x, y) in _DUELS.items())}
FROM m JOIN pr h ON h.team = home_team JOIN pr a ON a.team = away_team"""


def q67_bottom_teams(spark, sf):
    """The three lowest rated teams of each region."""
    r = team_ratings(spark, sf).join(read(spark, sf, "nation").select(F.col("n_name").alias("team"), F.col("n_regionkey").alias("grp")), "team")
    return profile.bottom_k(r, ["grp"], ["elo", "team"], 3).select("grp", "team", r6("elo"), "place")


Q67 = f"""WITH {MATCHES_SQL}, p AS (SELECT n_regionkey AS grp, team, elo, row_number() OVER (PARTITION BY n_regionkey ORDER BY elo, team) AS place FROM rating JOIN nation ON n_name = team)
SELECT grp, team, round(elo, 6) AS elo, CAST(place AS INTEGER) AS place FROM p WHERE place <= 3"""

QUERIES = {
    "q43_proxy_ladder": (q43_proxy_ladder, Q43), "q64_squad_features": (q64_squad_features, Q64), "q65_team_profile": (q65_team_profile, Q65), "q65b_club_profile": (q65b_club_profile, Q65B),
    "q66_match_matrix": (q66_match_matrix, Q66), "q67_bottom_teams": (q67_bottom_teams, Q67),
}
