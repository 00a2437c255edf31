"""Queries of player events, team profiles and table maintenance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions import dates, nested, numbers, text
from matchgrid.operators import dataset, events, forest, merge, profile, resolve
from matchgrid.plans.base import POSITION, games, r6, read
from matchgrid.sources import readers
from matchgrid.sources.stored import stored


def _players(spark, sf):
    """Customers as players: team, position, minutes and stats from their account."""
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    b = F.floor("c_acctbal").cast("bigint")
    pos = F.expr(POSITION)
    return c.select(
        F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), F.col("n_name").alias("team"), text.primary_position(pos).alias("position"),
        (F.abs(b) % 200).alias("minutes"), (F.abs(b) % 13).alias("goals"), (F.abs(b) % 97 / 10).alias("xg"), F.when(b % 4 != 0, F.abs(b) % 31).alias("passes"),
        F.when(b % 5 != 0, F.abs(b) % 7).alias("tackles_won"), F.when(b % 6 != 0, F.abs(b) % 5).alias("interceptions"),
        F.concat(F.lit("club"), (F.col("c_custkey") % 40).cast("string")).alias("club_raw"), F.col("c_custkey"),
    ).withColumn("current_club", F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.col("club_raw"))).drop("club_raw", "c_custkey")


PLAYERS_SQL = f"""pl AS (
  SELECT c_custkey AS pid, c_name AS name, n_name AS team, upper(trim(split_part({POSITION}, ',', 1))) AS position, abs(b) % 200 AS minutes, abs(b) % 13 AS goals, (abs(b) % 97) / 10 AS xg,
    CASE WHEN b % 4 <> 0 THEN abs(b) % 31 END AS passes, CASE WHEN b % 5 <> 0 THEN abs(b) % 7 END AS tackles_won, CASE WHEN b % 6 <> 0 THEN abs(b) % 5 END AS interceptions,
    CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'club' || (c_custkey % 40) END AS current_club
  FROM (SELECT *, CAST(floor(c_acctbal) AS BIGINT) AS b FROM customer) JOIN nation ON c_nationkey = n_nationkey)"""


def _feed(spark, sf):
    """The event table as a match feed: a user is a player, the hour of a day a match. The JSON is read once a row."""
    e = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    kinds = {"click": "Pass", "view": "Carry", "purchase": "Shot", "signup": "Duel", "error": "Foul Committed"}
    x = F.col("event_id") % 100
    return e.select(
        F.concat(F.dayofmonth("ts").cast("string"), F.lit("-"), F.hour("ts").cast("string")).alias("match_id"), F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("player"),
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("team"), text.mapped(F.col("event_type"), kinds).alias("type"), (1 + k % 5).cast("int").alias("period"),
        F.array(x.cast("double"), (x / 2).cast("double")).alias("location"), F.col("value").alias("shot_statsbomb_xg"),
        F.when(k % 4 == 0, "Goal").when(k % 4 == 1, "Saved").otherwise("Off T").alias("shot_outcome"), F.when(k % 3 == 0, "Incomplete").alias("pass_outcome"), (k % 6 == 0).alias("pass_shot_assist"),
        F.when(k % 5 != 0, (k * 3).cast("double")).alias("pass_length"), F.array((x + k).cast("double"), (x / 2 + k).cast("double")).alias("pass_end_location"),
        F.array((x + k).cast("double"), (x / 2).cast("double")).alias("carry_end_location"), F.when(k % 2 == 0, "Tackle").otherwise("Aerial Lost").alias("duel_type"),
        F.when(k % 3 == 0, "Won").when(k % 3 == 1, "Success In Play").alias("duel_outcome"), F.when(k % 7 == 0, "Yellow Card").when(k % 7 == 1, "Second Yellow, Red Card").alias("foul_committed_card"), (k % 8 == 0).alias("under_pressure"),
    )


FEED_SQL = """fd AS (
  SELECT day(ts) || '-' || hour(ts) AS match_id, 'p' || (user_id % 40) AS player, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS team, event_type AS et, value AS v, k, event_id % 100 AS x
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
pm AS (
  SELECT match_id, team, player, round_even(CAST(sum(CASE WHEN et = 'purchase' THEN v ELSE 0 END) AS DOUBLE), 4) AS xg, count(*) FILTER (et = 'purchase' AND k % 4 = 0) AS goals,
    count(*) FILTER (et = 'purchase') AS shots, count(*) FILTER (et = 'purchase' AND k % 4 < 2) AS shots_on_target, count(*) FILTER (et = 'click' AND k % 3 <> 0) AS passes_completed,
    count(*) FILTER (et = 'click') AS passes_attempted, count(*) FILTER (et = 'click' AND k % 6 = 0) AS key_passes,
    count(*) FILTER (et = 'click' AND CASE WHEN k % 5 <> 0 THEN k * 3 >= 25 ELSE sqrt(CAST(k * k + k * k AS DOUBLE)) >= 10 END) AS progressive_passes,
    count(*) FILTER (et = 'view') AS carries_count, round_even(CAST(sum(CASE WHEN et = 'view' AND k >= 10 THEN k ELSE 0 END) AS DOUBLE), 2) AS progressive_carry_distance,
    count(*) FILTER (et = 'signup' AND k % 2 = 1 AND k % 3 = 0) AS aerial_duels_won, count(*) FILTER (et = 'signup' AND k % 2 = 1 AND k % 3 <> 0) AS aerial_duels_lost,
    count(*) FILTER (et = 'signup' AND k % 2 = 0) AS tackle_attempts, count(*) FILTER (et = 'signup' AND k % 2 = 0 AND k % 3 < 2) AS tackles_won, count(*) FILTER (et = 'error') AS fouls_committed,
    count(*) FILTER (k % 8 = 0) AS actions_under_pressure, count(*) FILTER (et = 'error' AND k % 7 < 2) AS yellow_cards, count(*) FILTER (et = 'error' AND k % 7 = 1) AS red_cards
  FROM fd GROUP BY match_id, team, player)"""
_SHOWN = ["goals", "shots", "shots_on_target", "passes_completed", "passes_attempted", "key_passes", "progressive_passes", "carries_count", "aerial_duels_won", "aerial_duels_lost",
          "tackle_attempts", "tackles_won", "fouls_committed", "actions_under_pressure", "yellow_cards", "red_cards"]


def q07_event_player_agg(spark, sf):
    t = events.player_metrics(events.match_player_metrics(_feed(spark, sf)), ("team", "player"))
    return t.select("team", "player", *_SHOWN, F.round("xg", 3).alias("xg"), F.round("progressive_carry_distance", 2).alias("carry"), "matches")


Q07 = f"""WITH {FEED_SQL} SELECT team, player, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SHOWN)}, round(sum(xg), 3) AS xg, round(sum(progressive_carry_distance), 2) AS carry, count(*) AS matches
FROM pm GROUP BY team, player"""


_RARE = ["Dribble", "Interception", "Block", "Clearance", "Ball Recovery", "Foul Won", "Pressure", "Goal Keeper", "Bad Behaviour", "Pass"]
_MORE = ["through_balls", "crosses", "dribble_attempts", "dribble_success", "interceptions", "blocks", "clearances", "ball_recoveries", "fouls_won", "pressures", "counter_pressures",
         "goalkeeper_saves", "yellow_cards", "red_cards"]


def q100_more_metrics(spark, sf):
    """The rarer event types by match and player; the through-ball flag is there in the feed."""
    e = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, i = F.col("k"), F.col("event_id")
    feed = e.select(
        F.concat(F.lit("m"), F.dayofmonth("ts").cast("string")).alias("match_id"), F.when(i % 17 != 0, F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string"))).alias("player"), F.lit("A").alias("team"),
        F.get(F.array(*map(F.lit, _RARE)), (i % 10).cast("int")).alias("type"), F.when(k % 4 != 0, k % 4 == 1).alias("pass_through_ball"), (k % 3 == 0).alias("pass_cross"),
        F.when(k % 3 == 0, "Complete").when(k % 3 == 1, "Success").otherwise("Incomplete").alias("dribble_outcome"), F.when(k % 2 == 0, k % 5 == 0).alias("counterpress"),
        F.when(k % 2 == 0, "Shot Saved").when(k % 3 == 0, "Saved Twice").otherwise("Goal Conceded").alias("goalkeeper_outcome"), F.when(k % 2 == 0, "Yellow Card").otherwise("Red Card").alias("bad_behaviour_card"),
    )
    return events.match_player_metrics(feed).select("match_id", "player", *_MORE)


_KIND = {n: f"event_id % 10 = {i}" for i, n in enumerate(_RARE)}
_MORE_SQL = {
    "through_balls": f"{_KIND['Pass']} AND k % 4 = 1", "crosses": f"{_KIND['Pass']} AND k % 3 = 0", "dribble_attempts": _KIND["Dribble"], "dribble_success": f"{_KIND['Dribble']} AND k % 3 < 2",
    "interceptions": _KIND["Interception"], "blocks": _KIND["Block"], "clearances": _KIND["Clearance"], "ball_recoveries": _KIND["Ball Recovery"], "fouls_won": _KIND["Foul Won"],
    "pressures": _KIND["Pressure"], "counter_pressures": f"{_KIND['Pressure']} AND k % 2 = 0 AND k % 5 = 0", "goalkeeper_saves": f"{_KIND['Goal Keeper']} AND (k % 2 = 0 OR k % 3 = 0)",
    "yellow_cards": f"{_KIND['Bad Behaviour']} AND k % 2 = 0", "red_cards": f"{_KIND['Bad Behaviour']} AND k % 2 <> 0",
}
Q100 = f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT 'm' || day(ts) AS match_id, 'p' || (user_id % 20) AS player, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _MORE_SQL.items())} FROM e WHERE event_id % 17 <> 0 GROUP BY 1, 2"""


def _lineups(spark, sf):
    e = read(spark, sf, "events")
    start = F.minute("ts")
    open_ = F.when(F.col("event_id") % 4 != 0, F.concat(F.least(start + F.col("user_id") % 50, F.lit(90)).cast("string"), F.lit(":00")))
    stint = F.struct(F.concat(F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(start).cast("string"), F.lit(":00")).alias("from"), open_.alias("to"), F.lit("x").alias("position"))
    return e.select(F.hour("ts").cast("string").alias("match_id"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("team"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("player_name"),
                    F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("player_nickname"), F.array(stint).alias("positions"), "event_id")


def q08_starter_flags(spark, sf):
    t = events.playing_time(_lineups(spark, sf))
    return t.select("team", "player", F.col("minutes").cast("bigint").alias("minutes"), F.col("starts").cast("bigint").alias("starts"), "appearances", events.starter_flag(F.col("starts"), F.col("appearances")).alias("is_starter"))


LINEUP_SQL = """lu AS (
  SELECT event_id, hour(ts) AS match_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS team, CASE WHEN user_id % 3 <> 0 THEN 'p' || user_id ELSE 'n' || user_id END AS player,
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE minute(ts) END AS f, CASE WHEN event_id % 4 <> 0 THEN least(minute(ts) + user_id % 50, 90) ELSE 90 END AS t FROM events)"""
Q08 = f"""WITH {LINEUP_SQL}, o AS (SELECT match_id, team, player, max(greatest(t - f, 0)) AS m, max(CAST(f = 0 AS INTEGER)) AS s FROM lu GROUP BY 1, 2, 3),
a AS (SELECT team, player, CAST(sum(m) AS BIGINT) AS minutes, CAST(sum(s) AS BIGINT) AS starts, count(*) FILTER (m > 0) AS appearances FROM o GROUP BY 1, 2)
SELECT *, CAST(starts / greatest(appearances, 1) >= 0.5 AS INTEGER) AS is_starter FROM a"""


def q09_weighted_means(spark, sf):
    p = profile.with_squad(_players(spark, sf))
    return p.groupBy("team").agg(F.count("*").alias("n"), *profile.weighted_means(["goals", "xg", "passes"])).select("team", "n", r6("nt_w_goals"), r6("nt_w_xg"), r6("nt_w_passes"))


SQUAD_SQL = PLAYERS_SQL + """,
sq AS (SELECT * FROM (SELECT *, max(CAST(minutes >= 90 AS INTEGER)) OVER (PARTITION BY team) AS a FROM pl) WHERE minutes >= 90 OR a = 0)"""
_M = "CASE WHEN sum(minutes) = 0 THEN 1 ELSE sum(minutes) END"
Q09 = f"""WITH {SQUAD_SQL} SELECT team, count(*) AS n, round(sum(goals * minutes) / {_M}, 6) AS nt_w_goals, round(sum(xg * minutes) / {_M}, 6) AS nt_w_xg, round(sum(coalesce(passes, 0) * minutes) / {_M}, 6) AS nt_w_passes FROM sq GROUP BY team"""


def q10_star_topk(spark, sf):
    p = profile.with_squad(_players(spark, sf)).withColumn("xg", F.col("xg").cast("double"))
    main = p.groupBy("team").agg(F.round(profile.share_of_max(F.col("goals")), 6).alias("share"), F.max("xg").alias("best"), F.count("*").alias("depth"))
    return profile.top_k(p, ["team"], "xg", 3, "top3").join(main, "team").select("team", r6("top3"), "share", "best", "depth")


Q10 = f"""WITH {SQUAD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY xg DESC) AS rn FROM sq)
SELECT team, round(sum(xg) FILTER (rn <= 3), 6) AS top3, round(CASE WHEN sum(goals) > 0 THEN max(goals) / sum(goals) ELSE 0 END, 6) AS share, max(xg) AS best, count(*) AS depth FROM r GROUP BY team"""


def q11_gini(spark, sf):
    g = profile.gini(_players(spark, sf).withColumn("xg", F.col("xg").cast("double")), ["team"], "xg")
    return g.select("team", r6("gini"))


Q11 = f"""WITH {PLAYERS_SQL}, c AS (SELECT team, count(*) OVER (PARTITION BY team) AS n, sum(xg) OVER (PARTITION BY team) AS s, sum(xg) OVER (PARTITION BY team ORDER BY xg, pid ROWS UNBOUNDED PRECEDING) AS cum FROM pl)
SELECT team, round(CASE WHEN any_value(s) > 0 THEN (any_value(n) + 1 - 2 * sum(cum) / any_value(s)) / any_value(n) ELSE 0 END, 6) AS gini FROM c GROUP BY team"""


def q12_position_per90(spark, sf):
    p = _players(spark, sf)
    rates = profile.bucket_rates("position", "minutes", [("FW", "goals"), ("MF", "passes"), ("DF", "interceptions"), ("GK", "tackles_won")])
    out = p.groupBy("team").agg(*rates)
    return out.select("team", *(r6(c) for c in out.columns[1:]))


def _rate_sql(p, f):
    return f"round(CASE WHEN coalesce(sum(minutes) FILTER (position = '{p}'), 0) > 0 THEN sum(coalesce({f}, 0)) FILTER (position = '{p}') * 90 / sum(minutes) FILTER (position = '{p}') ELSE 0 END, 6) AS pos_{p.lower()}_{f}_p90"


Q12 = f"WITH {PLAYERS_SQL} SELECT team, {', '.join(_rate_sql(*x) for x in (('FW', 'goals'), ('MF', 'passes'), ('DF', 'interceptions'), ('GK', 'tackles_won')))} FROM pl GROUP BY team"


def q13_club_chemistry(spark, sf):
    return profile.club_chemistry(_players(spark, sf)).select("team", r6("cluster_ratio"), r6("pair_density"), "n_clubs")


Q13 = f"""WITH {PLAYERS_SQL}, c AS (SELECT team, nullif(current_club, '') AS cl, count(*) AS k FROM pl GROUP BY 1, 2), t AS (SELECT team, sum(k) AS n, max(k) FILTER (cl IS NOT NULL) AS top, sum(k * (k - 1) / 2) FILTER (cl IS NOT NULL) AS pairs, count(cl) AS clubs FROM c GROUP BY team)
SELECT team, round(CASE WHEN n >= 2 AND clubs > 0 THEN top / n END, 6) AS cluster_ratio, round(CASE WHEN n >= 2 AND clubs > 0 THEN pairs / (n * (n - 1) / 2) END, 6) AS pair_density, CASE WHEN n >= 2 AND clubs > 0 THEN clubs END AS n_clubs FROM t"""


def _seasons(spark, sf):
    o = read(spark, sf, "orders").join(_players(spark, sf).select("pid", "team"), F.col("o_custkey") == F.col("pid"))
    return o.select("team", "pid", F.year("o_orderdate").alias("season"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("goals"), "o_orderkey")


SEASON_SQL = PLAYERS_SQL + ", se AS (SELECT team, pid, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(floor(o_totalprice / 1000) AS BIGINT) AS goals, o_orderkey FROM orders JOIN pl ON o_custkey = pid), st AS (SELECT team, season, sum(goals) AS goals, count(*) AS players FROM se GROUP BY 1, 2)"


def q14_season_recency(spark, sf):
    totals = profile.season_totals(_seasons(spark, sf), ["team"], "season", ["goals"])
    weights = spark.createDataFrame([(1999, 0.3), (2000, 0.5), (2001, 1.0)], "season int, weight double")
    out = profile.recency_weighted(totals, weights, ["team"], "season", ["goals", "players"])
    return out.select("team", r6("lg_goals"), r6("lg_players"))


Q14 = f"""WITH {SEASON_SQL}, w AS (SELECT * FROM (VALUES (1999, 0.3::DOUBLE), (2000, 0.5::DOUBLE), (2001, 1.0::DOUBLE)) t(season, w))
SELECT team, round(sum(goals * w) / sum(w), 6) AS lg_goals, round(sum(players * w) / sum(w), 6) AS lg_players FROM st JOIN w USING (season) GROUP BY team"""


def q15_trend(spark, sf):
    totals = profile.season_totals(_seasons(spark, sf), ["team"], "season", ["goals"])
    out = profile.trend_and_spread(totals, ["team"], "season", "goals")
    return out.select("team", F.round("trend", 4).alias("trend"), r6("variation"), "seasons", "latest")


Q15 = f"""WITH {SEASON_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY season) - 1 AS i FROM st)
SELECT team, round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(regr_slope(goals, i), 0) END, 4) AS trend, round(CASE WHEN count(*) < 2 THEN NULL WHEN avg(goals) <= 0 THEN 0 ELSE stddev_pop(goals) / avg(goals) END, 6) AS variation,
  count(*) AS seasons, CAST(arg_max(goals, season) AS BIGINT) AS latest FROM i GROUP BY team"""


def q16_composition(spark, sf):
    out = profile.composition(_players(spark, sf))
    return out.select("team", r6("comp_fw_ratio"), r6("comp_mf_ratio"), r6("comp_df_ratio"), "comp_fw_goals", "comp_mf_goals")


_OUT = "count(*) FILTER (position IN ('DF', 'MF', 'FW'))"
Q16 = f"""WITH {PLAYERS_SQL} SELECT team, {', '.join(f"round(count(*) FILTER (position = '{p.upper()}') / nullif({_OUT}, 0), 6) AS comp_{p}_ratio" for p in ('fw', 'mf', 'df'))},
  CAST(coalesce(sum(goals) FILTER (position = 'FW'), 0) AS BIGINT) AS comp_fw_goals, CAST(coalesce(sum(goals) FILTER (position = 'MF'), 0) AS BIGINT) AS comp_mf_goals FROM pl GROUP BY team"""


def q17_upper_median(spark, sf):
    li = read(spark, sf, "lineitem")
    return numbers.upper_median(li, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])


Q17 = """WITH q AS (SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, count(*) OVER p AS n, row_number() OVER (p ORDER BY l_quantity) AS a, row_number() OVER (p ORDER BY l_extendedprice) AS b FROM lineitem WINDOW p AS (PARTITION BY l_returnflag, l_linestatus))
SELECT l_returnflag, l_linestatus, max(l_quantity) FILTER (a = n // 2 + 1) AS l_quantity, max(l_extendedprice) FILTER (b = n // 2 + 1) AS l_extendedprice FROM q GROUP BY 1, 2"""


def q18_tiered_fill(spark, sf):
    p = _players(spark, sf).select("pid", "position", F.col("passes").cast("bigint").alias("passes"), F.col("tackles_won").cast("bigint").alias("tackles_won"), "current_club")
    club = text.first_class(F.col("current_club"), [("1", ["club1"]), ("2", ["club2"]), ("3", ["club3"])], "5").cast("int")
    return dataset.tier_fill(p.withColumn("tier", club), ["passes", "tackles_won"], "pid", "position", "tier", {1: 1.0, 2: 0.82, 3: 0.65, 4: 0.5, 5: 0.35}).select("pid", "position", "tier", "passes", "tackles_won", "filled")


Q18 = f"""WITH {PLAYERS_SQL}, t AS (SELECT *, CASE WHEN current_club LIKE '%club1%' THEN 1 WHEN current_club LIKE '%club2%' THEN 2 WHEN current_club LIKE '%club3%' THEN 3 ELSE 5 END AS tier, passes IS NOT NULL OR tackles_won IS NOT NULL AS has FROM pl),
m AS (SELECT position, list_sort(list(passes) FILTER (passes IS NOT NULL)) AS a, list_sort(list(tackles_won) FILTER (tackles_won IS NOT NULL)) AS b FROM t WHERE has GROUP BY position),
f AS (SELECT t.*, a[len(a) // 2 + 1] AS ma, b[len(b) // 2 + 1] AS mb, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.82 WHEN 3 THEN 0.65 ELSE 0.35 END::DOUBLE AS k FROM t LEFT JOIN m USING (position))
SELECT pid, position, tier, CASE WHEN has THEN passes ELSE CAST(trunc(ma * k) AS BIGINT) END AS passes, CASE WHEN has THEN tackles_won ELSE CAST(trunc(mb * k) AS BIGINT) END AS tackles_won, NOT has AS filled FROM f"""


def q31_latest_row(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), F.year("o_orderdate").alias("season"), F.col("o_orderkey").alias("k"))
    return profile.latest_season(o, "pid", "season", F.lit(2000)).select("pid", "season", "k")


Q31 = """WITH o AS (SELECT o_custkey AS pid, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderkey AS k FROM orders)
SELECT pid, season, k FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY CASE WHEN season = 2000 THEN 0 ELSE 1 END, season DESC, k) AS r FROM o) WHERE r = 1"""


def _halves(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), F.year("o_orderdate").alias("y"), F.floor("o_totalprice").cast("bigint").alias("p"))
    part = lambda c: o.where(c).groupBy("pid").agg(F.sum(F.col("p") % 7).alias("goals"), F.max(F.col("p") % 90).alias("minutes_played"), F.min(F.when(F.col("p") % 3 == 0, F.col("p") % 50)).alias("passes"), F.max(F.col("p") % 2).alias("xg"))
    return part("y < 1998"), part("y >= 1998")


def q32_upsert_merge(spark, sf):
    old, new = _halves(spark, sf)
    rules = {"goals": merge.raise_only("goals"), "passes": merge.keep_first("passes"), "xg": merge.keep_unless_zero("xg")}
    return merge.upsert(old, new, ["pid"], rules, when=merge.at_least_minutes(50))


_HALF = "SELECT o_custkey AS pid, CAST(sum(CAST(floor(o_totalprice) AS BIGINT) % 7) AS BIGINT) AS goals, max(CAST(floor(o_totalprice) AS BIGINT) % 90) AS minutes_played, min(CAST(floor(o_totalprice) AS BIGINT) % 50) FILTER (CAST(floor(o_totalprice) AS BIGINT) % 3 = 0) AS passes, max(CAST(floor(o_totalprice) AS BIGINT) % 2) AS xg FROM orders WHERE year(o_orderdate)"
Q32 = f"""WITH o AS ({_HALF} < 1998 GROUP BY 1), n AS ({_HALF} >= 1998 GROUP BY 1),
b AS (SELECT coalesce(o.pid, n.pid) AS pid, o.pid IS NOT NULL AS ho, n.pid IS NOT NULL AND (o.pid IS NULL OR coalesce(n.minutes_played >= 50 AND coalesce(o.minutes_played, 0) <= n.minutes_played, false)) AS u,
  o.goals AS og, n.goals AS ng, o.minutes_played AS om, n.minutes_played AS nm, o.passes AS op, n.passes AS np, o.xg AS ox, n.xg AS nx FROM o FULL JOIN n ON o.pid = n.pid)
SELECT pid, CASE WHEN u THEN greatest(ng, og) ELSE og END AS goals, CASE WHEN u THEN coalesce(nm, om) ELSE om END AS minutes_played, CASE WHEN u THEN coalesce(op, np) ELSE op END AS passes, CASE WHEN u THEN coalesce(nullif(nx, 0), ox) ELSE ox END AS xg FROM b"""


def q32b_insert_absent(spark, sf):
    old, new = _halves(spark, sf)
    return merge.insert_absent(old, new, ["pid"])


Q32B = f"WITH o AS ({_HALF} < 1998 GROUP BY 1), n AS ({_HALF} >= 1998 GROUP BY 1) SELECT * FROM o UNION ALL SELECT * FROM n WHERE pid NOT IN (SELECT pid FROM o)"


def q33_dedupe_union(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    return readers.concat_unique([d.where("lang = 'en'"), d.where("lang <> 'en'").drop("source"), d.where("doc_id % 2 = 0")], ["h"], [F.col("doc_id"), F.col("source").asc_nulls_last()])


Q33 = """WITH d AS (SELECT doc_id, lang, source, md5(coalesce(text, '')) AS h FROM documents),
u AS (SELECT * FROM d WHERE lang = 'en' UNION ALL SELECT doc_id, lang, NULL, h FROM d WHERE lang <> 'en' UNION ALL SELECT * FROM d WHERE doc_id % 2 = 0)
SELECT doc_id, lang, source, h FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, source NULLS LAST) AS r FROM u) WHERE r = 1"""


def q34_carry_forward(spark, sf):
    c = read(spark, sf, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("s"), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", "role", F.last(head, ignorenulls=True).over(w).alias("section"), F.coalesce(F.lag("role").over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) != F.col("role"), F.lit(True)).alias("new_role"))


Q34 = """SELECT conv_id, turn, role, last_value(CASE WHEN turn % 3 = 0 THEN 's' || turn END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS section, coalesce(lag(role) OVER w <> role, true) AS new_role
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)"""


def q35_name_normalize(spark, sf):
    p = read(spark, sf, "part")
    raw = F.concat(F.lit("12. "), F.upper(F.col("p_name")), F.lit("   Left Winger"))
    return p.select("p_partkey", text.name_key(F.concat(F.lit("  "), raw)).alias("key"), text.strip_ordinal(raw).alias("plain"), text.strip_labels(raw, ["Left Winger", "Winger", "Goalkeeper"]).alias("no_label"), text.last_word(F.col("p_name")).alias("last"),
                    text.mapped(F.col("p_brand"), {"Brand#11": "B11"}).alias("brand"))


Q35 = """SELECT p_partkey, regexp_replace(lower(trim('  12. ' || upper(p_name) || '   Left Winger')), '\\s+', ' ', 'g') AS key, upper(p_name) || '   Left Winger' AS plain, '12. ' || upper(p_name) AS no_label,
  string_split(p_name, ' ')[-1] AS last, CASE WHEN p_brand = 'Brand#11' THEN 'B11' ELSE p_brand END AS brand FROM part"""


def q36_roster_parse(spark, sf):
    p = read(spark, sf, "part")
    raw = F.concat(F.col("p_name"), F.lit(":"), (F.col("p_size") * 2).cast("string"), F.lit(", x:"), F.col("p_name"), F.lit(":45,, no minutes"))
    return p.select("p_partkey", F.posexplode(text.roster_entries(raw)).alias("slot", "e")).select("p_partkey", "slot", "e.name", "e.minutes", "e.starter")


Q36 = """SELECT p_partkey, 0 AS slot, p_name AS name, p_size * 2 AS minutes, p_size * 2 >= 60 AS starter FROM part UNION ALL SELECT p_partkey, 1, 'x:' || p_name, 45, false FROM part UNION ALL SELECT p_partkey, 2, 'no minutes', NULL, false FROM part"""


def q37_links(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.posexplode(text.links(F.col("html"))).alias("pos", "link"))
    return p.groupBy("page_id", "link").agg(F.min("pos").cast("int").alias("first"), F.count("*").alias("n"))


Q37 = """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1) AS a FROM pages), e AS (SELECT page_id, unnest(a) AS link, unnest(range(len(a))) AS pos FROM l)
SELECT page_id, link, CAST(min(pos) AS INTEGER) AS first, count(*) AS n FROM e GROUP BY 1, 2"""


def q39_stints(spark, sf):
    lu = _lineups(spark, sf)
    return lu.select("event_id", nested.stint_minutes(F.col("positions")).alias("minutes"), nested.started(F.col("positions")).alias("started"))


Q39 = f"WITH {LINEUP_SQL} SELECT event_id, CAST(greatest(t - f, 0) AS INTEGER) AS minutes, f = 0 AS started FROM lu"


def q40_date_season(spark, sf):
    o = read(spark, sf, "orders")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.lit("bad"))
    code = F.concat(F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lpad(((F.col("o_orderkey") + 1) % 100).cast("string"), 2, "0"))
    return o.select("o_orderkey", F.date_format(dates.match_date(t), "yyyy-MM-dd").alias("day"), dates.previous_season(code).alias("previous"), dates.season_of(F.col("o_orderdate")).alias("season"))


Q40 = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate + CASE WHEN year(o_orderdate) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
  (1999 + o_orderkey % 100) || '-' || (2000 + o_orderkey % 100) AS previous, (year(o_orderdate) - CAST(month(o_orderdate) < 7 AS INTEGER)) || '-' || (year(o_orderdate) - CAST(month(o_orderdate) < 7 AS INTEGER) + 1) AS season FROM orders"""


def q42_fuzzy_match(spark, sf):
    """Part names, their words turned round and one letter lost, against the different names."""
    p = read(spark, sf, "part").select("p_name").distinct()
    roster = p.withColumn("pos", F.xxhash64("p_name")).select(F.col("p_name").alias("name"), F.concat(F.lit("id"), F.col("pos").cast("string")).alias("entity_id"), "pos")
    words = F.reverse(F.split("p_name", " "))
    targets = p.select(F.concat(F.array_join(words, " "), F.lit(" É")).alias("target"))
    return resolve.best_matches(targets, roster)


def q44_null_census(spark, sf):
    return dataset.null_census(_players(spark, sf), ["passes", "tackles_won", "interceptions", "goals"]).select("column", "n_null", "n", r6("available"))


Q44 = f"WITH {PLAYERS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n, round(1 - count(*) FILTER ({c} IS NULL) / count(*), 6) AS available FROM pl" for c in ("passes", "tackles_won", "interceptions", "goals"))


def q44b_match_rate(spark, sf):
    return dataset.match_rate(_players(spark, sf), ["team"], F.col("passes").isNotNull() & F.col("tackles_won").isNotNull(), 0.62).select("team", "n", "matched", r6("rate"))


Q44B = f"WITH {PLAYERS_SQL} SELECT team, count(*) AS n, count(*) FILTER (passes IS NOT NULL AND tackles_won IS NOT NULL) AS matched, round(count(*) FILTER (passes IS NOT NULL AND tackles_won IS NOT NULL) / count(*), 6) AS rate FROM pl GROUP BY team HAVING count(*) FILTER (passes IS NOT NULL AND tackles_won IS NOT NULL) / count(*) < 0.62"


def q45_effect_size(spark, sf):
    from matchgrid.operators import backtest

    li = read(spark, sf, "lineitem").withColumn("correct", F.col("l_returnflag") == "R")
    out = backtest.effect_sizes(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("feature", *(r6(c) for c in ("mean_correct", "mean_wrong", "effect")))


Q45 = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}) FILTER (l_returnflag = 'R'), 6) AS mean_correct, round(avg({c}) FILTER (l_returnflag <> 'R'), 6) AS mean_wrong, round(abs(avg({c}) FILTER (l_returnflag = 'R') - avg({c}) FILTER (l_returnflag <> 'R')) / stddev_samp({c}), 6) AS effect FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def q46_regulation_score(spark, sf):
    e = _feed(spark, sf)
    m = e.select("match_id").distinct().select("match_id", F.lit("A").alias("home_team"), F.lit("B").alias("away_team"), F.lit(2).alias("home_score"), F.lit(1).alias("away_score"), F.when(F.length("match_id") % 2 == 0, "Group A").otherwise("Final").alias("competition_stage"))
    return events.regulation_scores(m, e).select("match_id", "is_knockout", "home_score_90", "away_score_90", "went_to_et", "went_to_penalties", "qualifier", "result")


Q46 = f"""WITH {FEED_SQL}, g AS (SELECT match_id, length(match_id) % 2 <> 0 AS ko, max(1 + k % 5) AS last, count(*) FILTER (team = 'A' AND et = 'purchase' AND k % 4 = 0 AND k % 5 < 2) AS h, count(*) FILTER (team = 'B' AND et = 'purchase' AND k % 4 = 0 AND k % 5 < 2) AS a FROM fd GROUP BY match_id)
SELECT match_id, ko AS is_knockout, CAST(CASE WHEN ko THEN h ELSE 2 END AS INTEGER) AS home_score_90, CAST(CASE WHEN ko THEN a ELSE 1 END AS INTEGER) AS away_score_90, ko AND last > 2 AS went_to_et, ko AND last >= 5 AS went_to_penalties,
  CASE WHEN ko THEN 'A' END AS qualifier, CAST(sign(CASE WHEN ko THEN h - a ELSE 1 END) AS INTEGER) AS result FROM g"""


#: Rows that a fold's model is fitted on (a bounded sample); all games are predicted.
FIT_ROWS = 1500


def _model_rows(spark, sf):
    g = games(spark, sf)
    key = F.concat_ws("-", "k", "pk", "sk", F.floor("xp").cast("string"))
    return g.select(key.alias("id"), "eh", "ea", F.col("disc").alias("f1"), F.when(F.col("tax") > 0.01, F.col("tax")).alias("f2"), (F.col("result") + 1).cast("double").alias("y"), F.col("hg").cast("double").alias("goals")).dropDuplicates(["id"])


_MODEL_FEATURES = ["eh", "ea", "f1", "f2"]


def q47_rf_cv(spark, sf):
    rows = _model_rows(spark, sf)
    out = forest.cross_predict(rows, "id", _MODEL_FEATURES, "y", 3, forest.Growth(trees=20, depth=4), FIT_ROWS)
    return out.join(rows.select("id", "y"), "id").groupBy("y", "prediction").agg(F.count("*").alias("n"))


def q48_poisson_glm(spark, sf):
    rows = stored(_model_rows(spark, sf).select("id", *_MODEL_FEATURES, "goals"), "games")  # each step of the fits and the predictions read it
    met = forest.poisson_predict(rows, "id", _MODEL_FEATURES, "goals", 3, keep=["goals"])
    return met.agg(F.count("*").alias("n"), F.avg(F.abs(numbers.clamp(F.col("prediction"), 0.05, 6.0) - F.col("goals"))).alias("mae"))


QUERIES = {
    "q07_event_player_agg": (q07_event_player_agg, Q07), "q08_starter_flags": (q08_starter_flags, Q08), "q09_weighted_means": (q09_weighted_means, Q09), "q10_star_topk": (q10_star_topk, Q10),
    "q11_gini": (q11_gini, Q11), "q12_position_per90": (q12_position_per90, Q12), "q13_club_chemistry": (q13_club_chemistry, Q13), "q14_season_recency": (q14_season_recency, Q14),
    "q15_trend": (q15_trend, Q15), "q16_composition": (q16_composition, Q16), "q17_upper_median": (q17_upper_median, Q17), "q18_tiered_fill": (q18_tiered_fill, Q18),
    "q31_latest_row": (q31_latest_row, Q31), "q32_upsert_merge": (q32_upsert_merge, Q32), "q32b_insert_absent": (q32b_insert_absent, Q32B), "q33_dedupe_union": (q33_dedupe_union, Q33),
    "q34_carry_forward": (q34_carry_forward, Q34), "q35_name_normalize": (q35_name_normalize, Q35), "q36_roster_parse": (q36_roster_parse, Q36), "q37_links": (q37_links, Q37),
    "q39_stints": (q39_stints, Q39), "q40_date_season": (q40_date_season, Q40), "q42_fuzzy_match": (q42_fuzzy_match, None),
    "q44_null_census": (q44_null_census, Q44), "q44b_match_rate": (q44b_match_rate, Q44B), "q45_effect_size": (q45_effect_size, Q45), "q46_regulation_score": (q46_regulation_score, Q46),
    "q100_more_metrics": (q100_more_metrics, Q100), "q47_rf_cv": (q47_rf_cv, None), "q48_poisson_glm": (q48_poisson_glm, None),
}
