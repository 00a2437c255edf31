"""Queries of windows in time, as-of lookups, ranks and composite profiles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions import numbers, text
from matchgrid.operators import backtest, builders, dataset, merge, profile, ratings, simulate
from matchgrid.plans.base import MATCHES_SQL, PRED_SQL, matchup, predictions, r6, read
from matchgrid.plans.market_queries import ELO_RANKS, Q20
from matchgrid.plans.profile_queries import PLAYERS_SQL, SEASON_SQL, _players, _seasons


def q49_event_windows(spark, sf):
    e = read(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("v", 4).alias("v"))


Q49 = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2"


def q50_sessions(spark, sf):
    e = read(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("t", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


Q50 = """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM i GROUP BY user_id, k"""


def q51_as_of(spark, sf):
    """Each event with its user's last purchase value before it, 1500 without one."""
    e = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("team"), F.struct("ts", "event_id").alias("t"), "event_id", "event_type", "value")
    hist = e.where("event_type = 'purchase'").select("team", "t", F.col("value").alias("elo"))
    out = ratings.rating_as_of(hist, e.select("team", "t", "event_id"), "t")
    return out.select("event_id", F.round("elo", 6).alias("before"))


Q51 = """SELECT event_id, round(coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1500), 6) AS before FROM events"""


def q52_ranks_before(spark, sf):
    """Both sides' ranks before every match; the fold that rates a region's teams ranks them too."""
    order = ["d", "k", "pk", "sk", "xp"]
    m = matchup(spark, sf).select("grp", "home", "away", "hg", "ag", *order)
    return ratings.elo_fold(m, "grp", order, ranks=True).select("grp", *order, "home", "away", "rank_home", "rank_away")


def q53_league_profile(spark, sf):
    stats = _seasons(spark, sf).withColumns({"assists": F.col("goals") % 11, "minutes_played": F.col("goals") % 1000})
    weights = spark.createDataFrame([(1999, 0.3), (2000, 0.5), (2001, 1.0)], "season int, weight double")
    out = builders.league_profile(stats, weights)
    return out.select("team", "lg_seasons_available", "lg_goals_max", *(F.round(c, 4).alias(c) for c in ("lg_goals", "lg_assists", "lg_minutes_played", "lg_goals_trend", "lg_goals_cv", "lg_latest_goals_p90")), "lg_latest_players")


Q53 = f"""WITH {SEASON_SQL}, s AS (SELECT team, season, sum(goals) AS goals, sum(goals % 11) AS assists, sum(goals % 1000) AS mins, count(*) AS players FROM se GROUP BY 1, 2),
w AS (SELECT * FROM (VALUES (1999, 0.3::DOUBLE), (2000, 0.5::DOUBLE), (2001, 1.0::DOUBLE)) t(season, w)), i AS (SELECT s.*, w, row_number() OVER (PARTITION BY team ORDER BY season) - 1 AS i FROM s JOIN w USING (season)),
a AS (SELECT team, count(*) AS lg_seasons_available, CAST(max(goals) AS BIGINT) AS lg_goals_max FROM s GROUP BY team),
b AS (SELECT team, round(sum(goals * w) / sum(w), 4) AS lg_goals, round(sum(assists * w) / sum(w), 4) AS lg_assists, round(sum(mins * w) / sum(w), 4) AS lg_minutes_played,
  round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(regr_slope(goals, i), 0) END, 4) AS lg_goals_trend, round(CASE WHEN count(*) < 2 THEN NULL WHEN avg(goals) <= 0 THEN 0 ELSE stddev_pop(goals) / avg(goals) END, 4) AS lg_goals_cv,
  round(arg_max(CASE WHEN mins > 0 THEN goals * 90 / mins END, season), 4) AS lg_latest_goals_p90, arg_max(players, season) AS lg_latest_players FROM i GROUP BY team)
SELECT * FROM a LEFT JOIN b USING (team)"""


def q54_starters(spark, sf):
    return builders.arrival_starters(_players(spark, sf).select("pid", "team"), "team", "pid").select("pid", "team", "is_starter", "minutes")


Q54 = "WITH " + PLAYERS_SQL + ", r AS (SELECT pid, team, row_number() OVER (PARTITION BY team ORDER BY pid) AS r FROM pl) SELECT pid, team, CAST(r <= 11 AS INTEGER) AS is_starter, CASE WHEN r <= 11 THEN 90 ELSE 30 END AS minutes FROM r"


def q55_z_scores(spark, sf):
    return numbers.z_scores(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r6("c_acctbal"))


Q55 = "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer"


def q56_interactions(spark, sf):
    out = numbers.interactions(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount"), [("diff", "l_quantity", "l_discount"), ("product", "l_quantity", "l_discount"), ("ratio", "l_quantity", "l_discount"), ("square", "l_quantity", "")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *(r6(c) for c in out.columns[-4:]))


Q56 = """SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_quantity - l_discount), 6) AS diff_l_quantity_l_discount, round(l_quantity * l_discount, 6) AS product_l_quantity_l_discount,
  round(l_quantity / CASE WHEN l_discount = 0 THEN 0.001 ELSE l_discount END, 6) AS ratio_l_quantity_l_discount, round(l_quantity * l_quantity, 6) AS square_l_quantity FROM lineitem"""


def q57_target_row(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), F.col("o_orderdate").alias("as_of_date"), F.col("o_orderkey").alias("k"))
    out = merge.target_row(o, "pid", F.year("as_of_date") == 1997)
    return out.select("pid", F.date_format("as_of_date", "yyyy-MM-dd").alias("day"), "k")


Q57 = """SELECT pid, strftime(d, '%Y-%m-%d') AS day, k FROM (SELECT o_custkey AS pid, o_orderdate AS d, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) = 1997 DESC, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1"""


def q58_orphans(spark, sf):
    return merge.orphans(read(spark, sf, "customer"), read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


Q58 = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"


def q59_log_loss(spark, sf):
    return predictions(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), F.round(backtest.log_loss("p_home", "p_draw", "p_away"), 6).alias("log_loss"))


Q59 = f"WITH {PRED_SQL} SELECT grp, count(*) AS n, round(avg(-ln(greatest(CASE result WHEN 1 THEN p_home WHEN 0 THEN p_draw ELSE p_away END, 1e-15))), 6) AS log_loss FROM pf GROUP BY grp"


def q60_date_heads(spark, sf):
    m = matchup(spark, sf)
    return simulate.with_date_heads(m, "d", ["k", "pk", "sk", "xp"]).select("k", "pk", "sk", "xp", "new_day", text.match_label(F.col("home"), F.col("away")).alias("label"), text.score_label(F.col("hg"), F.col("ag")).alias("score"))


Q60 = f"""WITH {MATCHES_SQL}
SELECT k, pk, sk, xp, coalesce(lag(d) OVER (ORDER BY d, k, pk, sk, xp) <> d, true) AS new_day, home || ' vs ' || away AS label, hg || '-' || ag AS score FROM matchup"""


def q61_squad_season(spark, sf):
    totals = profile.season_totals(_seasons(spark, sf).where("goals % 3 = 0"), ["team", "pid"], "season", ["goals"])
    return profile.squad_season(totals, "team", "season", [2001, 2000, 1999]).select("team", "pid", "season", "goals")


Q61 = f"""WITH {SEASON_SQL}, t AS (SELECT team, pid, season, CAST(sum(goals) AS BIGINT) AS goals FROM se WHERE goals % 3 = 0 AND season IN (1999, 2000, 2001) GROUP BY 1, 2, 3)
SELECT team, pid, season, goals FROM (SELECT *, max(season) OVER (PARTITION BY team) AS b FROM t) WHERE season = b"""


def q62_source_coverage(spark, sf):
    from matchgrid.plans.market_queries import q20_odds_join

    return q20_odds_join(spark, sf).groupBy(F.col("odds_source").alias("src")).agg(*backtest.source_coverage())


Q62 = f"""WITH q AS ({Q20}) SELECT odds_source AS src, count(*) AS n, count(*) FILTER (odds_source LIKE 'oddsportal%') AS bookmaker, count(*) FILTER (odds_source = 'elo_fallback') AS fallback FROM q GROUP BY 1"""


def q63_ratings_join(spark, sf):
    """Teams of the matches with defaults for those without a rating."""
    from matchgrid.plans.base import ratings as team_ratings

    r = team_ratings(spark, sf).where("team < 'NATION_2'").select("team", "elo", F.row_number().over(W.orderBy(F.desc("elo"), "team")).alias("rank"), F.lit(None).cast("string").alias("confederation"))
    m = matchup(spark, sf).groupBy(F.col("home").alias("home_team"), F.col("away").alias("away_team")).agg(F.count("*").alias("n"))
    return dataset.attach_ratings(m, r).select("home_team", "away_team", "n", "elo_home", "elo_away", "rank_home", "rank_away", "conf_home")


Q63 = f"""WITH {MATCHES_SQL}, r AS (SELECT team, elo, CAST(row_number() OVER (ORDER BY elo DESC, team) AS INTEGER) AS rank FROM rating WHERE team < 'NATION_2'), c AS (SELECT CAST(count(*) AS INTEGER) AS c FROM r)
SELECT m.home AS home_team, m.away AS away_team, count(*) AS n, coalesce(any_value(h.elo), 1500) AS elo_home, coalesce(any_value(a.elo), 1500) AS elo_away, coalesce(any_value(h.rank), any_value(c)) AS rank_home, coalesce(any_value(a.rank), any_value(c)) AS rank_away, 'UEFA' AS conf_home
FROM matchup m CROSS JOIN c LEFT JOIN r h ON m.home = h.team LEFT JOIN r a ON m.away = a.team GROUP BY 1, 2"""

QUERIES = {
    "q49_event_windows": (q49_event_windows, Q49), "q50_sessions": (q50_sessions, Q50), "q51_as_of": (q51_as_of, Q51), "q52_ranks_before": (q52_ranks_before, ELO_RANKS),
    "q53_league_profile": (q53_league_profile, Q53), "q54_starters": (q54_starters, Q54), "q55_z_scores": (q55_z_scores, Q55), "q56_interactions": (q56_interactions, Q56),
    "q57_target_row": (q57_target_row, Q57), "q58_orphans": (q58_orphans, Q58), "q59_log_loss": (q59_log_loss, Q59), "q60_date_heads": (q60_date_heads, Q60),
    "q61_squad_season": (q61_squad_season, Q61), "q62_source_coverage": (q62_source_coverage, Q62), "q63_ratings_join": (q63_ratings_join, Q63),
}
