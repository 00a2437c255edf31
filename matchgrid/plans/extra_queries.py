"""Queries of single functions and of operators that the larger queries do not show."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions import dates, market, numbers, text
from matchgrid.operators import backtest, builders, dataset, events, merge, profile, ratings, simulate
from matchgrid.plans.base import MATCHES_SQL, PRED_SQL, matchup, predictions, r6, read
from matchgrid.plans.base import ratings as team_ratings
from matchgrid.plans.profile_queries import FEED_SQL, LINEUP_SQL, PLAYERS_SQL, _feed, _lineups, _players
from matchgrid.sources import fixed, readers


def q68_window_frames(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"), F.floor("o_totalprice").cast("bigint").alias("p"))
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    near = W.partitionBy("o_custkey").orderBy("y").rangeBetween(-1, 0)
    return o.select("o_orderkey", F.ntile(4).over(w).alias("quarter"), F.lead("p").over(w).alias("next"), F.lag("p", 2, 0).over(w).alias("before"), F.sum("p").over(near).alias("two_years"), F.sum("p").over(w.rowsBetween(-2, 0)).alias("three_orders"))


Q68 = """WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)
SELECT o_orderkey, CAST(ntile(4) OVER w AS INTEGER) AS quarter, lead(p) OVER w AS next, lag(p, 2, 0) OVER w AS before, CAST(sum(p) OVER (PARTITION BY o_custkey ORDER BY y RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS two_years,
  CAST(sum(p) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three_orders FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""


def q69_numbers(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.floor("c_acctbal").cast("bigint").alias("b"))
    b = F.col("b")
    flags = numbers.one_hot(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], "is_")
    return c.select(
        "c_custkey", F.round(numbers.per90(F.abs(b), b % 90), 4).alias("per90"), numbers.finite(F.when(b % 5 == 0, F.lit(float("nan"))).otherwise(b.cast("double")), F.lit(-1.0)).alias("finite"),
        numbers.truncated(F.col("c_acctbal") / 7).alias("cut"), F.round(numbers.xg_proxy(F.when(b % 3 != 0, F.abs(b) % 5), F.when(b % 4 != 0, F.abs(b) % 9)), 6).alias("xg"), *flags,
        F.round(numbers.half_even(F.col("c_acctbal"), 1), 1).alias("even"),
    )


Q69 = """WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal, CAST(floor(c_acctbal) AS BIGINT) AS b FROM customer)
SELECT c_custkey, round(CASE WHEN b % 90 > 0 THEN abs(b) / (b % 90) * 90 ELSE 0 END, 4) AS per90, CASE WHEN b % 5 = 0 THEN -1 ELSE CAST(b AS DOUBLE) END AS finite, CAST(trunc(c_acctbal / 7) AS BIGINT) AS cut,
  round(CASE WHEN b % 3 <> 0 OR b % 4 <> 0 THEN 0.32 * CASE WHEN b % 3 <> 0 THEN abs(b) % 5 ELSE 0 END + 0.04 * greatest(CASE WHEN b % 4 <> 0 THEN abs(b) % 9 ELSE 0 END - CASE WHEN b % 3 <> 0 THEN abs(b) % 5 ELSE 0 END, 0) END, 6) AS xg,
  CAST(c_mktsegment = 'BUILDING' AS INTEGER)::DOUBLE AS is_building, CAST(c_mktsegment = 'MACHINERY' AS INTEGER)::DOUBLE AS is_machinery, round(CAST(round_even(CAST(c_acctbal AS DECIMAL(18, 2)), 1) AS DOUBLE), 1) AS even FROM c"""


def q70_text(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    line = F.concat(F.lit("Ann Lee (Club "), F.col("p_size").cast("string"), F.lit(", on loan), Bo Li (FC "), F.col("p_partkey").cast("string"), F.lit(")"))
    e = text.squad_entries(line)
    raw = F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.format_number((F.col("p_partkey") * 1000 + F.col("p_size")).cast("double"), 1))
    return p.select(
        "p_partkey", F.size(e).alias("n"), text.entry_name(e[0]).alias("first"), text.entry_club(e[0]).alias("club"), text.entry_club(e[1]).alias("other"), text.number(raw).alias("number"),
        text.whole(F.regexp_replace(raw, r"\.\d$", "")).alias("whole"), text.outcome_label(F.col("p_size") % 3 - 1).alias("outcome"), text.is_digits(F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_name"))).alias("digits"),
        text.contains_either(F.lit("10"), F.col("p_size").cast("string")).alias("either"), text.club_name(F.when(F.col("p_size") % 2 == 0, F.lit(" man  CITY")).otherwise(F.lit(" Other ")), fixed.CLUB_NAMES, fixed.CLUB_ALIASES).alias("canonical"),
        text.strip_labels(F.concat("p_name", F.lit("  Centre-Forward")), fixed.POSITION_LABELS).alias("bare"),
    )


Q70 = """SELECT p_partkey, 2 AS n, 'Ann Lee' AS first, 'Club ' || p_size AS club, 'FC ' || p_partkey AS other, CASE WHEN p_size % 3 <> 0 THEN CAST(p_partkey * 1000 + p_size AS DOUBLE) END AS number, CASE WHEN p_size % 3 <> 0 THEN CAST(p_partkey * 1000 + p_size AS BIGINT) END AS whole,
  CASE p_size % 3 WHEN 2 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS outcome, p_size % 2 = 0 OR regexp_full_match(p_name, '[0-9]+') AS digits, contains('10', CAST(p_size AS VARCHAR)) OR contains(CAST(p_size AS VARCHAR), '10') AS either,
  CASE WHEN p_size % 2 = 0 THEN 'Manchester City' ELSE 'Other' END AS canonical, p_name AS bare FROM part"""


def q71_dates(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    season = dates.season_of(F.col("o_orderdate"))
    stamp = F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 08:30:00 UTC")))
    return o.select("o_orderkey", F.date_format(dates.season_end(season), "yyyy-MM-dd").alias("ends"), F.date_format(dates.utc_time(stamp), "yyyy-MM-dd HH:mm").alias("kickoff"), F.inline(dates.season_weights(season)))


Q71 = """WITH s AS (SELECT o_orderkey, o_orderdate AS d, year(o_orderdate) - CAST(month(o_orderdate) < 7 AS INTEGER) AS y FROM orders), w AS (SELECT * FROM (VALUES (2, 0.3::DOUBLE), (1, 0.5::DOUBLE), (0, 1.0::DOUBLE)) t(back, weight))
SELECT o_orderkey, (y + 1) || '-06-30' AS ends, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(d, '%Y-%m-%d') || ' 08:30' END AS kickoff, (y - back) || '-' || (y - back + 1) AS season, weight FROM s, w"""


def q72_roll_up(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), F.when(F.col("o_orderkey") % 3 != 0, F.floor("o_totalprice").cast("bigint")).alias("goals"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("is_starter"))
    return profile.roll_up(o, ["pid"], ["goals"], ["is_starter"])


Q72 = "SELECT o_custkey AS pid, CAST(coalesce(sum(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END), 0) AS BIGINT) AS goals, max(CAST(o_orderkey % 5 = 0 AS INTEGER)) AS is_starter FROM orders GROUP BY 1"


def q73_fallback_upsert(spark, sf):
    """Careers by player and competition: rows without one take the new World Cup's; goals are estimated from caps, caps overwritten."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("bigint").alias("p"))
    old = o.where("k % 2 = 0").groupBy("pid").agg(F.max("k").alias("k"), F.max("p").alias("p")).select("pid", F.when(F.col("k") % 3 != 0, F.when(F.col("k") % 3 == 1, "WC").otherwise("EC")).alias("competition"), (F.col("p") % 9).alias("caps"), (F.col("p") % 5).alias("goals"))
    new = o.where("k % 2 = 1").groupBy("pid").agg(F.max("k").alias("k"), F.max("p").alias("p")).select("pid", F.lit("WC").alias("competition"), F.when(F.col("k") % 5 != 0, F.col("p") % 11).alias("caps"), (F.col("p") % 7).alias("goals"))
    rules = {"caps": merge.overwrite("caps"), "goals": merge.estimated_goals(F.coalesce("new_goals", "old_goals"), F.coalesce("new_caps", F.lit(0)))}
    return merge.upsert_with_fallback(old, new, "pid", "competition", "WC", rules).select("pid", "competition", "caps", F.col("goals").cast("bigint").alias("goals"))


Q73 = """WITH o AS (SELECT o_custkey AS pid, max(o_orderkey) AS k, max(CAST(floor(o_totalprice) AS BIGINT)) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
n AS (SELECT o_custkey AS pid, max(o_orderkey) AS k, max(CAST(floor(o_totalprice) AS BIGINT)) AS p FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
o2 AS (SELECT pid, CASE WHEN k % 3 = 0 AND pid IN (SELECT pid FROM n) THEN 'WC' WHEN k % 3 = 1 THEN 'WC' WHEN k % 3 = 2 THEN 'EC' END AS competition, p % 9 AS caps, p % 5 AS goals FROM o),
n2 AS (SELECT pid, 'WC' AS competition, CASE WHEN k % 5 <> 0 THEN p % 11 END AS caps, p % 7 AS goals FROM n),
j AS (SELECT coalesce(o2.pid, n2.pid) AS pid, coalesce(o2.competition, n2.competition) AS competition, n2.pid IS NOT NULL AS u, o2.caps AS oc, o2.goals AS og, n2.caps AS nc, n2.goals AS ng FROM o2 FULL JOIN n2 ON o2.pid = n2.pid AND o2.competition = n2.competition)
SELECT pid, competition, CASE WHEN u THEN nc ELSE oc END AS caps, CAST(CASE WHEN u THEN greatest(1, CASE WHEN coalesce(nc, 0) > 0 THEN CAST(trunc(coalesce(ng, og) / nc * 30) AS BIGINT) END) ELSE og END AS BIGINT) AS goals FROM j"""


def q74_stat_tables(spark, sf):
    p = _players(spark, sf).select(F.col("name").alias("player"), "team", "goals")
    shots = read(spark, sf, "orders").join(_players(spark, sf).select("pid", F.col("name").alias("player"), "team"), F.col("o_custkey") == F.col("pid")).select("player", "team", F.floor("o_totalprice").cast("bigint").alias("shots"))
    return builders.merge_stat_tables(p, [shots], wanted=["goals", "shots", "absent"])


Q74 = f"WITH {PLAYERS_SQL}, s AS (SELECT o_custkey AS pid, min(CAST(floor(o_totalprice) AS BIGINT)) AS shots FROM orders GROUP BY 1) SELECT name AS player, team, goals, shots FROM pl LEFT JOIN s USING (pid)"


def q75_tournament_stats(spark, sf):
    t = events.tournament_stats(_feed(spark, sf), _lineups(spark, sf))
    return t.select("team", "player", "goals", "shots", F.col("minutes").cast("bigint").alias("minutes"), F.col("starts").cast("bigint").alias("starts"), F.col("appearances").cast("bigint").alias("appearances"), "is_starter")


Q75 = f"""WITH {FEED_SQL}, {LINEUP_SQL}, g AS (SELECT team, player, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(shots) AS BIGINT) AS shots FROM pm GROUP BY 1, 2),
o AS (SELECT match_id, team, player, max(greatest(t - f, 0)) AS m, max(CAST(f = 0 AS INTEGER)) AS s FROM lu GROUP BY 1, 2, 3),
a AS (SELECT team, player, sum(m) AS minutes, sum(s) AS starts, count(*) FILTER (m > 0) AS appearances FROM o GROUP BY 1, 2),
j AS (SELECT g.*, CAST(coalesce(minutes, 0) AS BIGINT) AS minutes, CAST(coalesce(starts, 0) AS BIGINT) AS starts, coalesce(appearances, 0) AS appearances FROM g LEFT JOIN a USING (team, player))
SELECT *, CAST(starts / greatest(appearances, 1) >= 0.5 AS INTEGER) AS is_starter FROM j"""


def q76_predicted_standings(spark, sf):
    """Every pairing of a region predicted, and the tables that follow; places are the order of names."""
    n = read(spark, sf, "nation").select(F.col("n_name").alias("team"), F.col("n_regionkey").alias("grp"))
    r = team_ratings(spark, sf).join(n, "team")
    m = matchup(spark, sf).select("grp", "home", "away").distinct()
    side = lambda t, e: r.select(F.col("team").alias(t), F.col("elo").alias(e))
    predicted = simulate.predict(m.join(side("home", "elo_home"), "home").join(side("away", "elo_away"), "away"))
    slots = r.where("team <> 'NATION_3'").withColumn("slot", F.row_number().over(W.partitionBy("grp").orderBy("team")))
    out = simulate.standings(predicted, hg="pred_h", ag="pred_a", outcome="pick", slots=slots)
    return out.select("grp", "team", "played", "won", "drawn", "lost", "gf", "ga", "gd", "points", "rank")


Q76 = f"""WITH {MATCHES_SQL}, m AS (SELECT DISTINCT grp, home, away FROM matchup),
x AS (SELECT m.*, h.elo AS eh, a.elo AS ea, 1.0 / (1.0 + pow(10.0, -(h.elo - a.elo) / 400.0)) AS p, least(greatest(0.26 * (0.55 + 0.45 * exp(-abs(h.elo - a.elo) / 150.0)), 0.08), 0.38) AS d FROM m JOIN rating h ON h.team = home JOIN rating a ON a.team = away),
y AS (SELECT *, CASE WHEN (1 - d) * p >= d AND p >= 1 - p THEN 1 WHEN d >= (1 - d) * (1 - p) THEN 0 ELSE -1 END AS pick, CAST(round_even(greatest(2.55 * p, 0.15), 0) AS INTEGER) AS ph, CAST(round_even(greatest(2.55 * (1 - p), 0.15), 0) AS INTEGER) AS pa FROM x),
s AS (SELECT grp, home AS team, ph AS gf, pa AS ga, pick AS r FROM y UNION ALL SELECT grp, away, pa, ph, -pick FROM y),
t AS (SELECT grp, team, count(*) AS played, count(*) FILTER (r = 1) AS won, count(*) FILTER (r = 0) AS drawn, count(*) FILTER (r = -1) AS lost, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(sum(gf) - sum(ga) AS BIGINT) AS gd,
  3 * count(*) FILTER (r = 1) + count(*) FILTER (r = 0) AS points FROM s WHERE team <> 'NATION_3' GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY points DESC, gd DESC, gf DESC, team) AS INTEGER) AS rank FROM t"""


def q77_lopsided(spark, sf):
    f = predictions(spark, sf).withColumn("match_id", F.concat_ws("-", "k", "pk", "sk", F.floor("xp").cast("string")))
    return backtest.lopsided_listing(f, 250.0).select("match_id", "home", "away", r6("elo_gap"), "pick", "correct")


Q77 = f"WITH {PRED_SQL} SELECT concat_ws('-', k, pk, sk, CAST(floor(xp) AS BIGINT)) AS match_id, home, away, round(elo_gap, 6) AS elo_gap, pick, correct FROM pf WHERE elo_gap >= 250"


def q78_gap_report(spark, sf):
    p = _players(spark, sf).withColumn("hit", F.col("passes").isNotNull() & F.col("interceptions").isNotNull())
    return builders.gap_report(p, ["team"], "hit", 0.65).select("team", "n", "matched", r6("rate"))


Q78 = f"WITH {PLAYERS_SQL}, r AS (SELECT team, count(*) AS n, count(*) FILTER (passes IS NOT NULL AND interceptions IS NOT NULL) AS matched FROM pl GROUP BY team) SELECT team, n, matched, round(matched / n, 6) AS rate FROM r WHERE matched / n < 0.65"


def q79_draw_first(spark, sf):
    """Gated picks where the draw goes before an equally likely underdog, and the smaller of equally likely scores."""
    f = predictions(spark, sf)
    p = {1: F.col("p_home"), 0: F.round("p_draw", 1), -1: F.round("p_away", 1)}
    g = backtest.gated_pick(1 - F.greatest("p_home", "p_away"), F.lit(0.3), F.col("favorite"), F.col("elo_gap") >= 100, F.col("pick"), p | {1: F.round("p_home", 1)}, draw_first=True)
    return f.select("k", "pk", "sk", "xp", g.cast("int").alias("gated"))


Q79 = f"""WITH {PRED_SQL}, g AS (SELECT *, CASE favorite WHEN 1 THEN round(p_away, 1) ELSE round(p_home, 1) END AS dog FROM pf)
SELECT k, pk, sk, xp, CASE WHEN elo_gap < 100 THEN pick WHEN 1 - greatest(p_home, p_away) >= 0.3 THEN CASE WHEN round(p_draw, 1) >= dog THEN 0 ELSE -favorite END ELSE favorite END AS gated FROM g"""


def q80_small_scores(spark, sf):
    """The likeliest scores at equal rates, ties to the smaller."""
    m = read(spark, sf, "nation").select(F.col("n_name").alias("team"), (1 + F.col("n_nationkey") % 3).cast("double").alias("rate"))
    return market.top_scores(market.score_matrix(m, "rate", "rate", 6, normalised=False).withColumn("p", F.round("p", 12)), ["team"], 4, larger_first=False).select("team", "i", "j", r6("p"), "rank")


Q80 = """WITH m AS (SELECT n_name AS team, CAST(1 + n_nationkey % 3 AS DOUBLE) AS r FROM nation), g AS (SELECT CAST(range AS INTEGER) AS n FROM range(7)),
x AS (SELECT team, i.n AS i, j.n AS j, round(exp(-r) * pow(r, i.n) / factorial(i.n) * (exp(-r) * pow(r, j.n) / factorial(j.n)), 12) AS p FROM m, g i, g j),
k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY p DESC, i, j) AS rank FROM x) SELECT team, i, j, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 4"""


def q81_team_sets(spark, sf):
    """Sides of matches of one team's, their union and those with an unseen rank."""
    m = matchup(spark, sf).select("k", F.col("home").alias("home_team"), F.col("away").alias("away_team"))
    own = readers.matches_of(m, "NATION_3")
    known = team_ratings(spark, sf).where("elo < 1700").withColumn("rank", F.row_number().over(W.orderBy(F.desc("elo"), "team")))
    teams = readers.teams_of(own)
    shared = readers.known_teams(own, known).withColumn("known", F.lit(True))
    n = known.agg(F.count("*").cast("int").alias("n"))
    out = teams.join(known.select("team", "rank"), "team", "left").join(shared, "team", "left").crossJoin(n)
    return out.select("team", F.coalesce("known", F.lit(False)).alias("known"), ratings.rank_or_last(F.col("rank"), F.col("n")).alias("rank"))


Q81 = f"""WITH {MATCHES_SQL}, own AS (SELECT home, away FROM matchup WHERE home = 'NATION_3' OR away = 'NATION_3'), t AS (SELECT home AS team FROM own UNION SELECT away FROM own),
k AS (SELECT team, CAST(row_number() OVER (ORDER BY elo DESC, team) AS INTEGER) AS rank FROM rating WHERE elo < 1700)
SELECT t.team, k.team IS NOT NULL AS known, coalesce(rank, (SELECT CAST(count(*) AS INTEGER) FROM k) + 1) AS rank FROM t LEFT JOIN k ON k.team = t.team"""


def q82_medians(spark, sf):
    """Interpolated medians over the whole table, as imputation uses them."""
    from matchgrid.operators import models

    row = models.exact_medians(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return row.select(*(F.round(c, 6).alias(c) for c in row.columns))


Q82 = "SELECT round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity, round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice, round(quantile_cont(l_tax, 0.5), 6) AS l_tax FROM lineitem"


def q83_columns(spark, sf):
    """What a match matrix lacks and has beyond its catalogue."""
    from matchgrid.plans.team_queries import q66_match_matrix

    found = dataset.verify_columns(q66_match_matrix(spark, sf).drop("home_lg_goals_max"), ["home_team", *dataset.expected_columns()])
    rows = [(kind, c) for kind, cs in found.items() for c in cs]
    return spark.createDataFrame(rows, "kind string, name string")


Q83 = "SELECT 'missing' AS kind, 'home_lg_goals_max' AS name UNION ALL SELECT 'extra', 'away_team'"

QUERIES = {
    "q68_window_frames": (q68_window_frames, Q68), "q69_numbers": (q69_numbers, Q69), "q70_text": (q70_text, Q70), "q71_dates": (q71_dates, Q71), "q72_roll_up": (q72_roll_up, Q72),
    "q73_fallback_upsert": (q73_fallback_upsert, Q73), "q74_stat_tables": (q74_stat_tables, Q74), "q75_tournament_stats": (q75_tournament_stats, Q75), "q76_predicted_standings": (q76_predicted_standings, Q76),
    "q77_lopsided": (q77_lopsided, Q77), "q78_gap_report": (q78_gap_report, Q78), "q79_draw_first": (q79_draw_first, Q79), "q80_small_scores": (q80_small_scores, Q80), "q81_team_sets": (q81_team_sets, Q81),
    "q82_medians": (q82_medians, Q82), "q83_columns": (q83_columns, Q83),
}
